"""Audit of how filters of documents interact: what each removes in every order, what others had removed before, and what is lost of labels.

**Measures.** ``measure`` runs a byte transducer over the UTF-8 bytes of a batch: states GAP and WORD, tables ``NEXT`` (state after a byte) and
``OUT`` (what a byte puts out in a state: the start of a word, a capital, the start of a code point, a symbol). The state after a byte
follows from the byte alone, so the run over a batch is one lookup for each byte, with GAP before each text. The spans of words go
into a hash table with open addressing, a batch at once; a word counts as seen only after its bytes have been compared with those
of the word in its slot, so equal hashes of unlike words do no harm.

**Interaction.** A text's failures are a set of five filters (``FILTERS``). Rows with equal text, part, labels and id are counted first, then those of
equal text keep their count and smallest id, so copies in any number are a few rows, and no group is ever gathered. What is left,
counts by part and set of failures, does not grow with the table. A filter's figures depend on which filters ran before it, not on their order, so
they are added up for its 16 sets of predecessors and then told for all 120 orders.

Null texts are empty ones, so both are copies of each other. A null language and '' are one part. Rows with one id and text count each, and are no copies of
each other; a null id is smaller than none, so such rows are no one's copies. Of several labels of an id, quality or toxicity of 1
in any counts. Tables without rows have no parts and give no rows. Texts are told apart by SHA-256. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import added, column, slices, with_columns

#: The filters, the characters that end words, and those that filter D does not allow.
FILTERS = "ABCDE"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#$%&*|"

GAP, WORD = 0, 1
STARTS, CAPITAL, CODE_POINT, SYMBOL = 1, 2, 4, 8


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """NEXT by byte, and OUT by state and byte (256 * state + byte)."""
    byte = np.arange(256)
    following = np.where(np.isin(byte, list(SPACES)), GAP, WORD).astype(np.uint8)
    put = np.where((byte & 0xC0) != 0x80, CODE_POINT, 0) | np.where((byte >= 65) & (byte <= 90), CAPITAL, 0) | np.where(np.isin(byte, list(SYMBOLS)), SYMBOL, 0)
    return following, np.concatenate([put | np.where(following == WORD, STARTS, 0), put]).astype(np.uint8)


NEXT, OUT = _tables()
_PAD = 8
#: Bytes of a word that are compared eight at a time; longer ones are compared whole.
_SHORT = 64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_MULTIPLIER, _LENGTHS, _TEXTS = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Counts that ``measure`` adds, in the order of ``run``.
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


class Words:
    """Spans of words in some bytes, each with the number of its text, in an open hash table."""

    def __init__(self, padded: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray) -> None:
        self.data, self.start, self.size, self.text = padded, start, end - start, text
        # eight bytes from each place on
        self.eight = np.ndarray((len(padded) - _PAD + 1,), "<u8", padded.data, strides=(1,))
        self.head = self._chunk(np.arange(len(start)), 0)

    def _chunk(self, words: np.ndarray, at: int) -> np.ndarray:
        """Up to eight bytes of each word from ``at`` on, zeros after its end."""
        return self.eight[self.start[words] + at] & _MASKS[np.minimum(self.size[words] - at, 8)]

    def _bytes(self, word: int) -> bytes:
        return self.data[self.start[word] : self.start[word] + self.size[word]].tobytes()

    def hashes(self) -> np.ndarray:
        h = (self.head ^ (self.size.astype(np.uint64) * _LENGTHS) ^ (self.text.astype(np.uint64) * _TEXTS)) * _MULTIPLIER
        for at in range(8, _SHORT, 8):
            if not len(more := np.flatnonzero(self.size > at)):
                break
            h[more] = ((h[more] >> np.uint64(29)) ^ h[more] ^ self._chunk(more, at)) * _MULTIPLIER
        for w in np.flatnonzero(self.size > _SHORT):
            h[w] ^= np.uint64(zlib.crc32(self._bytes(w)))
        return h ^ (h >> np.uint64(32))

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words at ``a`` have the bytes and the text of those at ``b``."""
        same = (self.size[a] == self.size[b]) & (self.text[a] == self.text[b]) & (self.head[a] == self.head[b])
        for at in range(8, _SHORT, 8):
            more = np.flatnonzero(same & (self.size[a] > at))
            if not len(more):
                break
            same[more] = self._chunk(a[more], at) == self._chunk(b[more], at)
        for k in np.flatnonzero(same & (self.size[a] > _SHORT)):
            same[k] = self._bytes(a[k]) == self._bytes(b[k])
        return same

    def first_ones(self) -> np.ndarray:
        """Marks each word that its text does not have before."""
        n = len(self.start)
        size = 1 << max(4, (2 * n).bit_length())
        table = np.full(size, -1, np.int64)
        slot = (self.hashes() & np.uint64(size - 1)).astype(np.int64)
        first, todo = np.zeros(n, bool), np.arange(n)
        while len(todo):
            own = slot[todo]
            free = table[own] < 0
            # of several words for a free slot the last one written stays: the earliest
            table[own[free][::-1]] = todo[free][::-1]
            there = table[own]
            first[todo[there == todo]] = True
            todo = todo[~((there == todo) | self.equal(todo, there))]
            slot[todo] = (slot[todo] + 1) & (size - 1)
        return first


def run(texts: pa.Array) -> np.ndarray:
    """A row of ``COUNTS`` for each text; null is an empty one."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    size = int(ends[-1] - ends[0])
    out = np.zeros((n, len(COUNTS)), np.int64)
    if not size:
        return out
    padded = np.zeros(size + _PAD, np.uint8)
    padded[:size] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    code = padded[:size]
    before = np.empty(size + 1, np.uint16)
    before[0] = GAP
    before[1:] = NEXT[code]
    before[ends[:-1]] = GAP
    put = OUT[(before[:-1] << 8) | code]
    for k, bit in ((0, STARTS), (2, CAPITAL), (3, CODE_POINT), (4, SYMBOL)):
        at = np.flatnonzero(put & bit)
        found = np.searchsorted(at, ends)
        out[:, k] = np.diff(found)
        if bit == STARTS:
            start, text = at, np.repeat(np.arange(n), out[:, k])
    # a word ends before the next byte that leads to GAP, or where its text ends
    gaps = np.append(np.flatnonzero(NEXT[code] == GAP), size)
    end = np.minimum(gaps[np.searchsorted(gaps, start)], ends[text + 1])
    out[:, 1] = np.bincount(text[Words(padded, start, end, text).first_ones()], minlength=n)
    return out


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, n_distinct (words, in UTF-8 bytes), n_capitals (A-Z), n_points (code points), n_symbols (long) and text_sha256 (binary) in place of the text."""
    schema = added(df.schema, *((c, T.LongType()) for c in COUNTS), ("text_sha256", T.BinaryType()), drop=[text])
    arrow = to_arrow_schema(schema)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            texts = column(b, text)
            counts = run(texts)
            new = {c: pa.array(counts[:, k]) for k, c in enumerate(COUNTS)}
            new["text_sha256"] = pa.array([hashlib.sha256(t.as_buffer() or b"").digest() for t in texts.cast(pa.large_string()).fill_null("")], pa.binary())
            yield with_columns(b, arrow, new)

    return df.mapInArrow(measured, schema)


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step, with the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (long).

    A fails texts of under 200 words; B those with fewer distinct words than half of the words; C those with over 3 capitals in 100 code
    points; D those with a symbol; E those equal to the text of a smaller id. ``labels``: the id, quality and toxic.
    """
    own = measure(docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text")))
    fails = [F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words"), 100 * F.col("n_capitals") > 3 * F.col("n_points"), F.col("n_symbols") > 0]
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))
    # rows without an id meet no label; the salt deals them out
    rows = own.select("id", "part", "text_sha256", mask.alias("mask"), F.when(F.col("id").isNull(), F.xxhash64("text_sha256")).otherwise(0).alias("salt"))
    told = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(told.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left").fillna(False, ["good", "toxic"])
    same = ["text_sha256", "mask", "part", "good", "toxic"]
    ids = rows.groupBy("id", "salt", *same).agg(F.count("*").alias("n"))
    groups = ids.groupBy(*same).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    # a text has a group for each part and label that its copies have
    firsts = groups.groupBy("text_sha256").agg(F.min("first.id").alias("least"))
    both = groups.join(firsts, "text_sha256")
    alone = F.col("n_null") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = both.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", alone.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - alone).alias("n")))).alias("x"))
    counts = split.select("part", "good", "toxic", "x.*").where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    return interactions(counts)


def interactions(counts: DataFrame) -> DataFrame:
    """The audit from counts n by part, mask (bit k: the k-th filter fails), good and toxic."""
    spark = counts.sparkSession
    all_of = range(len(FILTERS))
    sets = [(k, sum(1 << j for j in s)) for k in all_of for r in all_of for s in itertools.combinations([j for j in all_of if j != k], r)]
    cases = F.explode(F.array(*(F.struct(F.lit(k).alias("filter"), F.lit(1 << k).alias("bit"), F.lit(s).alias("before")) for k, s in sets)))
    at = counts.select("*", cases.alias("c")).select("part", "mask", "good", "toxic", "n", "c.*")
    failing, free = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) == 0

    def total(condition) -> F.Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long")

    # first among the failing filters of a text in one of so many orders as it has failing filters
    share = F.when(failing, (120 / F.bit_count("mask")).cast("long") * F.col("n")).otherwise(0)
    figures = at.groupBy("part", "filter", "before").agg(
        total(~failing & free).alias("kept"), total(failing & free).alias("removed"), total(failing & ~free).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(failing & free & F.col("good")).alias("good_lost"), total(failing & free & F.col("toxic")).alias("toxic_lost"), F.sum(share).cast("long").alias("shapley"),
    )
    steps = [("".join(FILTERS[k] for k in order), step + 1, order[step], sum(1 << k for k in order[:step])) for order in itertools.permutations(all_of) for step in all_of]
    orders = spark.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    return figures.join(F.broadcast(orders), ["filter", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) AS c,
        regexp_matches(x, '[#$%&*|]') AS d, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY x), FALSE) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
m AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
        count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM one a, one b, one c, one d, one e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS k, filter_order[1:step - 1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, k, n, good, toxic, contains(fails, k) AS failing, fails = k AS alone, before <> '' AND regexp_matches(fails, '[' || before || '_]') AS earlier FROM m, s),
g AS (SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (NOT failing AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (failing AND NOT earlier), 0) AS removed, coalesce(sum(n) FILTER (failing AND earlier), 0) AS redundant,
        coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(good) FILTER (failing AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT earlier), 0) AS toxic_lost FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM g
"""
