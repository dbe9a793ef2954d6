"""Toxicity by a classifier chain.

The categories are predicted one after another: the first linear model sees the words of a text, each later one also the
probabilities of the categories before it. While it is fitted, these are out-of-fold predictions, made for each text by
models that have not seen it, so that a later model meets probabilities as uncertain as those it gets afterwards.

A text's features are counts over its distinct lower-cased words and runs of signs: the word, and its first three to six
letters (inflected words share these), each hashed to one of 2^18 slots. Words add up, so a word has one weight for each
category, looked up once for each distinct word of a task. Models are fitted by the driver on at most ``max_labels`` labelled
texts, picked by a hash of the id, with at most ``max_bytes`` of features together; each takes the ``max_features`` features that tell its category best among its own rows, by
the difference of the shares of texts that have them over its standard error. Scoring covers every row.

Null and empty texts, and all texts if there is no label to learn from, have the probability 0 and are clean. A category whose labels are all
alike gets these. Labels of unknown ids and null labels are left out; of repeated labels of an id the largest count. Of rows with one labelled
id the one with the smallest text fingerprint is learned from; equal texts are in one fold. Every row is scored on its own. Other columns pass through;
columns named as the new ones, in any case, are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import added, column, slices, texts_of, with_columns, written

_WORD = re.compile(r"[^\W\d_]+|[^\w\s]+")
SLOTS = 1 << 18


def word_slots(word: str) -> list[int]:
    raw = [word, *(f"^{word[:n]}" for n in range(3, 7) if len(word) >= n)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % SLOTS for x in raw]


def distinct_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


class Rows:
    """Sparse rows of counts by slot, a slot once a row."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray, sizes: list[int]) -> None:
        self.slots, self.counts, self.row, self.n = slots, counts, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), len(sizes)

    def dense(self, chosen: np.ndarray) -> np.ndarray:
        column = np.full(SLOTS, -1)
        column[chosen] = np.arange(len(chosen))
        at = column[self.slots]
        out = np.zeros((self.n, len(chosen)))
        out[self.row[at >= 0], at[at >= 0]] = self.counts[at >= 0]
        return out


@dataclass
class Linear:
    """Weights of some slots and of the probabilities of the categories before."""

    slots: np.ndarray
    weights: np.ndarray
    chained: np.ndarray
    bias: float

    def logit(self, rows: Rows, before: np.ndarray) -> np.ndarray:
        return rows.dense(self.slots) @ self.weights + before @ self.chained + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_linear(rows: Rows, before: np.ndarray, y: np.ndarray, use: np.ndarray, max_features: int, l2: float) -> Linear:
    """Logistic regression by Newton's method over the rows where ``use`` holds."""
    n1, n0 = max((use & (y == 1)).sum(), 1), max((use & (y == 0)).sum(), 1)
    own = use[rows.row]
    d1 = np.bincount(rows.slots[own & (y[rows.row] == 1)], minlength=SLOTS)
    d0 = np.bincount(rows.slots[own & (y[rows.row] == 0)], minlength=SLOTS)
    share = (d1 + d0 + 1) / (n1 + n0 + 2)
    z = np.abs(d1 / n1 - d0 / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    chosen = np.sort(np.argsort(-z, kind="stable")[:max_features])
    chosen = chosen[z[chosen] > 3]
    x = np.column_stack([rows.dense(chosen)[use], before[use], np.ones(use.sum())])
    target, p = y[use], np.zeros(x.shape[1])
    ridge = np.full(len(p), l2)
    ridge[-1] = 1e-6
    for _ in range(12):
        q = sigmoid(x @ p)
        step = np.linalg.solve((x.T * (q * (1 - q) + 1e-9)) @ x + np.diag(ridge), x.T @ (q - target) + ridge * p)
        p -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    k = len(chosen)
    return Linear(chosen, p[:k], p[k:-1], float(p[-1]))


@dataclass
class Chain:
    """One linear model a category, and the probability above which a category holds."""

    categories: list[str]
    models: list[Linear]
    thresholds: list[float]


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the best gap by F1 over out-of-fold predictions; 0.5 if there is none."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    last = np.append(p[order][1:] != p[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order][k] + below) / 2, 0.05, 0.95))


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], doc_id: str = "doc_id", text: str = "text", max_labels: int = 8000, max_bytes: int = 96 << 20, folds: int = 3, max_features: int = 300, l2: float = 1.0) -> Chain | None:
    """Fits the chain. ``labels``: an id and one column of 0 and 1 for each category; None if no labelled text is found."""
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(*(F.max(F.col(c).cast("int")).alias(c) for c in categories)).dropna()
    n = known.count()
    if not n:
        return None
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labels)
    # at most max_labels rows of a few numbers: small enough to be broadcast whatever the input
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"), F.xxhash64(text).alias("_th"))
    rows = texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("_id", "_text", "_th", *(F.col(c).alias(f"_y{k}") for k, c in enumerate(categories)))
    names = [f"_y{k}" for k in range(len(categories))]
    schema = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("_th", T.LongType()), *(T.StructField(x, T.IntegerType()) for x in names), T.StructField("slots", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [np.array([s for w in sorted(distinct_words(t)) for s in word_slots(w)], dtype="<i4").tobytes() for t in texts_of(column(b, "_text"))]
            yield with_columns(b, arrow, {"slots": pa.array(made, pa.binary())})

    # one row an id, so max_labels at most; then as many of these, in the order of the hash, as max_bytes holds
    one = rows.mapInArrow(featured, schema).groupBy("_id").agg(F.min(F.struct("_th", *names, "slots")).alias("x")).select("_id", "x.*")
    one = written(one.withColumn("_at", F.xxhash64("_id")), "features")
    room, most = max_bytes, None
    for at, size in one.select("_at", F.octet_length("slots").alias("size")).orderBy("_at", "_id").collect():
        room -= size
        if room < 0 and most is not None:
            break
        most = at
    if most is None:
        return None
    got = one.where(F.col("_at") <= most).toArrow().sort_by("_id")
    y = np.column_stack([got.column(x).to_numpy() for x in names]).astype(float)
    got_fold = got.column("_th").to_numpy() % folds
    slots, counts, sizes = [], [], []
    for packed in got.column("slots"):
        own, n = np.unique(np.frombuffer(packed.as_buffer(), "<i4"), return_counts=True)
        slots.append(own)
        counts.append(n.astype(np.float32))
        sizes.append(len(own))
    del got
    x = Rows(np.concatenate(slots), np.concatenate(counts), sizes)
    del slots, counts
    fold = got_fold
    before, models, thresholds = np.zeros((x.n, 0)), [], []
    for k in range(len(categories)):
        out_of_fold = np.zeros(x.n)
        for f in range(folds):
            model = fit_linear(x, before, y[:, k], fold != f, max_features, l2)
            out_of_fold = np.where(fold == f, sigmoid(model.logit(x, before)), out_of_fold)
        models.append(fit_linear(x, before, y[:, k], fold >= 0, max_features, l2))
        thresholds.append(best_threshold(out_of_fold, y[:, k]))
        before = np.column_stack([before, out_of_fold])
    return Chain(categories, models, thresholds)


class WordScorer:
    """The weights of words by category, kept for at most ``keep`` words of a task (about 30 MB), or those of one batch."""

    def __init__(self, chain: Chain, keep: int = 200_000) -> None:
        self.table = np.zeros((SLOTS, len(chain.categories)))
        for k, m in enumerate(chain.models):
            self.table[m.slots, k] = m.weights
        self.chain, self.keep, self.row_of = chain, keep, {}
        self.rows = np.zeros((1024, len(chain.categories)))

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.row_of]
        if not new:
            return
        if len(self.row_of) + len(new) > self.keep:
            self.row_of, self.rows = {}, self.rows[:1024].copy()
            new = list(words)
        slots = [word_slots(w) for w in new]
        sums = np.add.reduceat(self.table[[s for x in slots for s in x]], np.cumsum([0, *map(len, slots[:-1])]), axis=0)
        at = len(self.row_of)
        if at + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows[:at], np.zeros((at + 2 * len(new), self.rows.shape[1]))])
        self.rows[at : at + len(new)] = sums
        self.row_of.update(zip(new, range(at, at + len(new))))

    def probabilities(self, texts: list[str]) -> np.ndarray:
        words = [distinct_words(t) for t in texts]
        self._learn(set().union(*words))
        sums = np.zeros((len(texts), len(self.chain.categories)))
        for k, ws in enumerate(words):
            sums[k] = self.rows[np.fromiter(map(self.row_of.__getitem__, ws), dtype=np.int64, count=len(ws))].sum(axis=0)
        out = np.zeros_like(sums)
        for k, m in enumerate(self.chain.models):
            out[:, k] = sigmoid(sums[:, k] + out[:, :k] @ m.chained + m.bias)
        out[[not ws for ws in words]] = 0.0
        if len(self.row_of) > self.keep:
            self.row_of, self.rows = {}, self.rows[:1024].copy()
        return out


def score(df: DataFrame, chain: Chain | None, categories: list[str], text: str = "text", drop_text: bool = False) -> DataFrame:
    """Adds ``p_<category>`` (double) and ``is_<category>`` (boolean) for each category."""
    new = [*((f"p_{c}", T.DoubleType()) for c in categories), *((f"is_{c}", T.BooleanType()) for c in categories)]
    schema = added(df.schema, *new, drop=[text] if drop_text else [])
    arrow = to_arrow_schema(schema)
    shared = df.sparkSession.sparkContext.broadcast(chain)  # at most SLOTS numbers a category

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scorer = WordScorer(own) if own else None
        for b in slices(batches):
            texts = texts_of(column(b, text))
            p = scorer.probabilities(texts) if scorer and texts else np.zeros((len(texts), len(categories)))
            limit = np.array(own.thresholds if own else [1.0] * len(categories))
            columns = {f"p_{c}": pa.array(p[:, k]) for k, c in enumerate(categories)} | {f"is_{c}": pa.array(p[:, k] > limit[k]) for k, c in enumerate(categories)}
            yield with_columns(b, arrow, columns)

    return df.mapInArrow(scored, schema)
