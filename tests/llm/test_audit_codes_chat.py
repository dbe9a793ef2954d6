"""The filter audit, vector codes and chat formatting: against brute force, and over the awkward cases."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, awkward_docs
from weir.llm import chat_format, filter_audit, queries, vector_codes

# filter audit


def _counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


def test_the_transducer_equals_brute_force():
    rng = random.Random(1)
    parts = ["a", "b", "word", "Word", "é", "中文", "😀", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "#", "&", "Z", "\x00", "\x85", " ", "abcdefgh", "abcdefghi", "x" * 63, "x" * 64, "x" * 65, "x" * 70 + "y", "x" * 70 + "z"]
    texts = [None, "", "  ", *("".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(2000)), "a " * 30_000, "q" * 90_000 + " " + "q" * 90_000, *(t for _, t, *_ in awkward_docs())]
    assert filter_audit.run(pa.array(texts)).tolist() == [_counts(t) for t in texts]
    assert filter_audit.run(pa.array(texts)[7:40]).tolist() == [_counts(t) for t in texts[7:40]]
    assert filter_audit.run(pa.array([None, ""], pa.string())).tolist() == [[0] * 5] * 2 and filter_audit.run(pa.array([], pa.string())).shape == (0, 5)


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    texts = ["a b c a", "b b " + "x" * 70 + "1 " + "x" * 70 + "2 abcdefgh1 abcdefgh2", "a"]
    monkeypatch.setattr(filter_audit.Words, "hashes", lambda self: np.zeros(len(self.start), np.uint64))
    assert filter_audit.run(pa.array(texts))[:, 1].tolist() == [len(set(t.split())) for t in texts]


def _audit(docs, labels):
    """Each row by walking through each order, document by document."""
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    told = []
    for d, t, part in docs:
        n, distinct, capitals, points, symbols = _counts(t)
        fails = {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 3 * points, "D": symbols > 0, "E": d is not None and d > least[t or ""]}
        told.append((part or "", {k for k, x in fails.items() if x}, d in good, d in toxic))
    out, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for p, *_ in told}:
            left = [x for x in told if x[0] == part]
            for step, k in enumerate(order, 1):
                removed = [x for x in left if k in x[1]]
                gone = [x for x in told if x[0] == part and not any(x is y for y in left)]
                left = [x for x in left if k not in x[1]]
                shapley[part, k] += len(removed)
                out[part, order, step] = [len(left), len(removed), sum(k in x[1] for x in gone), sum(x[0] == part and x[1] == {k} for x in told), sum(x[2] for x in removed), sum(x[3] for x in removed)]
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_audit_equals_brute_force_over_awkward_rows(spark):
    long = " ".join(f"w{k}" for k in range(250))
    docs = [(r[0], r[1], r[2]) for r in awkward_docs()]
    docs += [(50, long, "de"), (51, long, "en"), (51, long, "en"), (49, long, ""), (None, long, "de"), (52, long + " A#", "de"), (53, long + " A#", "de"), (54, "W " * 300, "de"), (54, "W " * 299, "de")]
    labels = [(50, 1, 0), (50, 0, 1), (51, 1, 1), (None, 1, 1), (52, None, None), (53, 1, 0), (5, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame([(*r, "s", 3) for r in docs], "doc_id long, text string, lang string, MASK string, n int")
    out = filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out}
    assert len(out) == len(got) and got == _audit(docs, labels)
    assert filter_audit.audit(table.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert filter_audit.measure(spark.createDataFrame([("x y", 1)], "text string, N_Words int")).columns == ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols", "text_sha256"]


def test_shapley_values_add_up_to_what_all_filters_remove(spark):
    docs = spark.createDataFrame(awkward_docs(), DOCS)
    rows = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'ABCDE'").groupBy("part").agg(F.sum("shapley").alias("s"), F.sum("removed").alias("r")).collect()
    assert rows and all(r.s == 120 * r.r for r in rows)


# vector codes


def _codes(rows):
    """Rows (id, vector, label) with code, error and label_error, and the codebooks' digest, in plain Python."""
    whole = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(whole[0][1]) // 8
    cut = [[v[p * size : (p + 1) * size] for p in range(8)] for _, v, _ in whole]
    books = [[list(c[p]) for c in cut[:16]] for p in range(8)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(6):
        found = [[near(p, c[p])[1] for p in range(8)] for c in cut]
        for p in range(8):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p] == k]
                books[p][k] = [sum(x) // len(own) for x in zip(*own)] if own else books[p][k]
    last = [[near(p, c[p]) for p in range(8)] for c in cut]
    errors = [sum(d for d, _ in x) for x in last]
    by_label = Counter()
    for (_, _, lab), e in zip(whole, errors):
        by_label[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in x), e, by_label[lab]) for (i, _, lab), x, e in zip(whole, last, errors)), digest


@pytest.mark.parametrize("n", [3, 60])
def test_codes_equal_plain_python(spark, n):
    rng = random.Random(n)
    rows = [(k, [rng.choice([-0.5, 0.25, rng.uniform(-1, 1)]) for _ in range(16)], rng.choice([None, 1, 2])) for k in range(n)]
    rows += [rows[1], (rows[2][0], rows[0][1], 2), (None, rows[0][1], None), (None, [0.0] * 16, 1)]
    bad = [(-1, None, 1), (-2, [None] + [0.5] * 15, 1), (-3, [float("nan")] + [0.5] * 15, None), (-4, [float("inf")] + [0.5] * 15, 1), (-5, [1e30] + [0.5] * 15, 1), (-6, [0.5] * 24, 1), (-7, [], 1), (-8, [0.5] * 15, 1)]
    want, digest = _codes(rows)
    table = spark.createDataFrame([(*r, "v", 7) for r in rows + bad], "vec_id long, embedding array<double>, label int, Code string, error int").repartition(5)
    out, books = vector_codes.compress(table)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error"] and books.sha256 == digest
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()) == want
    none, no_books = vector_codes.compress(table.where("vec_id < 0 and vec_id not in (-6)"))
    assert none.count() == 0 and none.columns == out.columns and no_books is None


@pytest.mark.parametrize("most", [vector_codes.MOST_CELLS, 10])
def test_cells_leave_the_nearest_in_and_most_out(most):
    rng = np.random.default_rng(2)
    entries = rng.integers(-2000, 2000, (16, 4))
    entries[5] = entries[3]
    cells = vector_codes.Cells(entries, 256, most)
    for _ in range(3):
        parts = rng.integers(-2500, 2500, (2000, 4))
        parts[:16] = entries
        distance = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        index, best = cells.nearest(parts)
        assert (index == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()
    assert cells.evaluated < 0.4 * 3 * 2000 * 16


def test_many_labels_are_joined_by_shuffling(spark, monkeypatch):
    rows = spark.range(200).select(F.col("id").alias("vec_id"), F.array(*((F.col("id") * (k + 1) % 97 / 97.0) for k in range(8))).alias("embedding"), F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("label"))
    want = {r.vec_id: tuple(r) for r in vector_codes.compress(rows)[0].collect()}
    monkeypatch.setattr(vector_codes, "MAX_SENT", 5)
    assert {r.vec_id: tuple(r) for r in vector_codes.compress(rows)[0].collect()} == want and len(want) == 200


# chat formatting

PIECES = ["###", "####", "#####", "#", "</turn>", "</turn>\n", "\\", "\\\\", "### user: ", "### assistant: x</turn>\n", ":", "<", " ", "\n", "a", "é", "😀"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), st.lists(st.sampled_from([*PIECES, "user", "assistant"]), max_size=3).map("".join))
def test_every_turn_is_read_back(text, role):
    out, start, end, level = chat_format.render(role, text)
    assert list(chat_format.parse(out + out)) == [(role, text, start, end), (role, text, len(out) + start, len(out) + end)]
    assert chat_format.unescape(out[start:end]) == text
    # no lower level would do, and plain texts stay as they are
    assert (level == 0) == (out[start:end] == text)
    assert level < 2 or "####" in text


def test_what_the_grammar_does_not_take():
    for text in ("x", "### user", "### user: a", "### user: a</turn>", "### user: a### b</turn>\n", "### a\\", "### user: a</turn>\nrest"):
        with pytest.raises(chat_format.Conflict):
            list(chat_format.parse(text))


def _digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, chat_format.render(r[2] or "", r[3] or "")[0].encode()))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat_format.render(r[2] or "", r[3] or "")[0]) for r in own))
    return out


@pytest.mark.parametrize("chunk", [chat_format.CHUNK, 50])
def test_conversations_are_read_back_over_awkward_rows(spark, chunk):
    rng = random.Random(chunk)
    rows = [(k % 7, k // 7, rng.choice(["user", "assistant", "system", "a: b#\n", None, ""]), "".join(rng.choices(PIECES, k=rng.randint(0, 6)))) for k in range(200)]
    rows += [(1, 3, "assistant", None), (1, 3, "assistant", ""), (1, 3, "assistant", ""), (None, None, None, None), (None, 1, "assistant", "x" * 3_000_000), (8, None, "assistant", "b"), (8, None, "assistant", "a"), (8, 0, "Assistant", "c")]
    table = spark.createDataFrame([(*r, "v", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, LOSS int").repartition(6)
    chunks = chat_format.format_conversations(table, chunk=chunk)
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.read_back(chunks).collect()}
    assert got == _digests(rows)
    own = {}
    for r in sorted(chunks.where("conv_id is not null").collect(), key=lambda r: (r.conv_id, r.chunk)):
        own[r.conv_id] = own.get(r.conv_id, "") + r.formatted
        assert len(r.formatted) <= chunk or len(list(chat_format.parse(r.formatted))) == 1
    assert all(hashlib.sha256("".join(f"{role}\n{said}\n" for role, said, *_ in chat_format.parse(text)).encode()).hexdigest() == got[conv][1] for conv, text in own.items())
    assert chat_format.read_back(chat_format.format_conversations(table.limit(0))).count() == 0


def test_the_added_conversation(spark):
    row = queries.op13_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").collect()
    text = r"\### Assistant: </turn> ok"
    want = hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert [(r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in row] == [(2, want, len(text), hashlib.sha256(text.encode()).hexdigest())]
