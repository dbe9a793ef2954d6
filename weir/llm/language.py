"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Every labelled row counts: each task adds up the n-grams of its texts by language, Spark adds these up, and the counts, one
number for each language and slot (so their size doesn't follow the data), become a matrix of logarithms that is broadcast.
A batch is scored in numpy: the slots of all its n-grams, gathered from the matrix and added up text by text.

The n-grams are those of one to ``longest`` code points of the lower-cased text, with all runs of characters other than
letters as one blank. Null texts and texts without a letter are `und`, with the score 0; so are all if no row is labelled.
Of languages with equal probability the first by name is taken. Rows, repeated ones too, are predicted each on its own. Other columns pass
through, but for those named as the new ones, in any case, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import added, column, slices, texts_of, with_columns

_NO_LETTERS = re.compile(r"[\W\d_]+")
#: So many characters at a time, so that a very long text needs no more memory than others.
_BLOCK = 1 << 20


def gram_slots(text: str, longest: int, slots: int) -> Iterator[np.ndarray]:
    """The slots of the n-grams of a text, in arrays of bounded length; nothing if it has no letter."""
    if not any(map(str.isalpha, text)):
        return
    clean = _NO_LETTERS.sub(" ", text.lower())
    clean = f" {clean.strip()} "
    for at in range(0, len(clean), _BLOCK):
        lead = min(at, longest - 1)
        codes = np.frombuffer(clean[at - lead : at + _BLOCK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        own = codes * np.uint32(0x9E3779B1)
        grams = own
        for n in range(1, longest + 1):
            # grams[i]: hash of the n code points from i on; those wholly in the lead were counted with the block before
            grams = grams[:-1] * np.uint32(0x85EBCA6B) ^ own[n - 1 :] if n > 1 else grams
            mixed = grams[max(0, lead - n + 1) :]
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield (mixed >> np.uint32(33 - slots.bit_length())).astype(np.int32)


def learn(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, slots: int = 1 << 15) -> tuple[list[str], np.ndarray]:
    """The languages and the matrix of log probabilities, slot by language, from all rows of ``df`` with a language."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in batches:
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                have = totals.setdefault(name, np.zeros(slots, dtype=np.int64))
                rows[name] = rows.get(name, 0) + 1
                for s in gram_slots(t or "", longest, slots):
                    have += np.bincount(s, minlength=slots)
        for name, have in totals.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(have[at], rows[name]), pa.int64())], names=["lang", "slot", "n"])

    counts = df.where(F.col(lang).isNotNull()).select(F.col(text), F.col(lang)).mapInArrow(counted, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    at = {x: k for k, x in enumerate(names)}
    matrix, prior = np.ones((slots, len(names))), np.zeros(len(names))
    slot, n, which = counts.column("slot").to_numpy(), counts.column("n").to_numpy(), np.array([at[x] for x in counts.column("lang").to_pylist()], dtype=int)
    matrix[slot[slot >= 0], which[slot >= 0]] += n[slot >= 0]
    prior[which[slot < 0]] = n[slot < 0]
    # a uniform prior: how often a language occurs in the labels says little about a text of many n-grams
    return names, np.log(matrix / matrix.sum(axis=0, keepdims=True)).astype(np.float32) if names else matrix


def predict(df: DataFrame, names: list[str], matrix: np.ndarray, text: str = "text", longest: int = 4) -> DataFrame:
    """Adds ``lang_pred`` (string) and ``score`` (double, the posterior probability) and drops the text."""
    shared: Broadcast = df.sparkSession.sparkContext.broadcast(matrix)
    slots = len(matrix)
    schema = added(df.schema, ("lang_pred", T.StringType()), ("score", T.DoubleType()), drop=[text])
    arrow = to_arrow_schema(schema)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            langs, scores = [], []
            for t in texts_of(column(b, text)):
                total, some = np.zeros(len(names)), False
                for s in gram_slots(t, longest, slots):
                    some = True
                    total += np.bincount(s, minlength=slots).astype(np.float32) @ m if len(s) > slots else m[s].sum(axis=0, dtype=np.float64)
                if not (some and names):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                k = int(np.argmax(total))
                langs.append(names[k])
                scores.append(float(1 / np.exp(np.maximum(total - total[k], -700)).sum()))
            yield with_columns(b, arrow, {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return df.mapInArrow(scored, schema)
