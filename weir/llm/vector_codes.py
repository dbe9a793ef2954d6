"""Vector codes by product quantisation in whole numbers, with the entries that can be nearest memoised by grid cell.

A component x becomes floor(4096 * x), a vector is cut into ``PARTS`` equal consecutive parts, and each part position has a codebook. It starts as
that part of the ``entries`` smallest ids; in each round every part is assigned to its nearest entry (squared Euclidean distance,
ties to the lower index), then each used entry becomes the floor of its parts' mean. Sums are whole numbers, so partitions and
their order change nothing.

**Grid cells.** A part falls into a coarse cell, a box ``width`` wide in each component, found by hashing the cell's coordinates and
comparing them. For a new cell the least and the greatest distance of each entry to the box are added up from tables by component; an entry
whose least distance is beyond the smallest greatest distance of any entry is never nearest in the box. Those that are left are kept with the
cell, and only they are evaluated exactly for its parts. A worker forgets its cells when they are more than ``MOST_CELLS``, which
costs time and changes nothing.

A round is one pass over the vectors; a task hands on one sum for each entry and component. The driver holds codebooks alone.

Rows whose vector is null, has null or non-finite components, or components of ``LARGEST`` or more (their squared distances would not
fit into 64 bits), are dropped; so are those of another length than most (ties: the longer), of positive multiples of ``PARTS``. Rows with equal ids count each; ids
are ordered with null last, equal ids by their vectors. With fewer rows than entries a codebook has one entry for each row, without rows
the result has none. Other columns pass through, but for those named as the new ones, in any case, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import added, apart, column, slices, with_columns, written

#: Steps of a component's unit, parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LARGEST = float(1 << 16)
WIDTH = 256
MOST_CELLS = 100_000
#: Labels whose sums are sent to all tasks; more are joined by shuffling.
MAX_SENT = 100_000


@dataclass(frozen=True)
class Codebooks:
    """``entries``: part, entry, component."""

    entries: np.ndarray
    width: int = WIDTH

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Cells:
    """Nearest entries of one codebook; remembers by cell which entries can be nearest."""

    def __init__(self, entries: np.ndarray, width: int = WIDTH, most: int = MOST_CELLS) -> None:
        self.entries, self.width, self.most = entries, width, most
        self.evaluated = 0
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.possible = np.zeros((0, len(self.entries)), bool)

    def bounds(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest squared distance of each entry to each cell's box."""
        least, most = np.zeros((2, len(cells), len(self.entries)), np.int64)
        for d in range(cells.shape[1]):
            at, back = np.unique(cells[:, d], return_inverse=True)
            low = (at * self.width)[:, None] - self.entries[None, :, d]
            high = low + self.width - 1
            near = np.maximum(np.maximum(low, -high), 0)
            far = np.maximum(np.abs(low), np.abs(high))
            least += (near * near)[back]
            most += (far * far)[back]
        return least, most

    def candidates(self, parts: np.ndarray) -> np.ndarray:
        """Which entries can be nearest to each part."""
        cells = np.floor_divide(parts, self.width)
        mixed = np.zeros(len(cells), np.uint64)
        for d in range(cells.shape[1]):
            mixed = (mixed ^ cells[:, d].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        _, first, back = np.unique(mixed, return_index=True, return_inverse=True)
        own = np.ascontiguousarray(cells[first])
        keys = [row.tobytes() for row in own]
        if len(self.known) + len(keys) > self.most:
            self._forget()
        new = [k for k, key in enumerate(keys) if key not in self.known]
        if new:
            self.known.update(zip([keys[k] for k in new], range(len(self.possible), len(self.possible) + len(new))))
            least, most = self.bounds(own[new])
            self.possible = np.concatenate([self.possible, least <= most.min(axis=1, keepdims=True)])
        out = self.possible[np.fromiter((self.known[k] for k in keys), np.int64, len(keys))[back]]
        # cells that only share a hash: every entry is looked at
        out[(cells != own[back]).any(axis=1)] = True
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, and its squared distance."""
        possible = self.candidates(parts)
        best = np.full(len(parts), np.iinfo(np.int64).max)
        index = np.zeros(len(parts), np.int64)
        for k, entry in enumerate(self.entries):
            rows = np.flatnonzero(possible[:, k])
            self.evaluated += len(rows)
            off = parts[rows] - entry
            distance = (off * off).sum(axis=1)
            closer = distance < best[rows]
            best[rows[closer]], index[rows[closer]] = distance[closer], k
        return index, best


def _whole(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    """Row, part, component, as whole numbers."""
    values = column(batch, name).flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * values.astype(np.float64)).astype(np.int64).reshape(-1, PARTS, dim // PARTS)


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows that can have a code, their vectors as arrays of doubles."""
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    n = F.size(v)
    fine = df.where(v.isNotNull() & (n > 0) & (n % PARTS == 0) & ~F.coalesce(bad, F.lit(True)))
    most = fine.groupBy(n.alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).limit(1).collect()
    return fine.where(n == (most[0][0] if most else -1)).withColumn(vector, v)


def learn(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS, width: int = WIDTH) -> Codebooks | None:
    """Codebooks of rows as ``usable`` gives them; None without rows."""
    start = [r[0] for r in df.select(vector, vec_id).orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(entries).collect()]
    if not start:
        return None
    dim = len(start[0])
    books = np.floor(SCALE * np.array(start)).astype(np.int64).reshape(len(start), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for part, entry, at, total, n in _sums(df.select(vector), vector, Codebooks(books.copy(), width), dim).collect():
            books[part, entry, at] = total // n
    return Codebooks(books, width)


def _sums(vectors: DataFrame, vector: str, books: Codebooks, dim: int) -> DataFrame:
    """For each part, used entry and component: the sum over the parts that are nearest to the entry, and their number."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "entry", "at", "total", "n")])
    arrow = to_arrow_schema(schema)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(e, books.width) for e in books.entries]
        totals, counts = np.zeros_like(books.entries), np.zeros(books.entries.shape[:2], np.int64)
        for b in slices(batches, 8192):
            x = _whole(b, vector, dim)
            for p in range(PARTS):
                index, _ = cells[p].nearest(x[:, p])
                for k in np.unique(index):
                    totals[p, k] += x[index == k, p].sum(axis=0)
                counts[p] += np.bincount(index, minlength=counts.shape[1])
        part, entry = np.nonzero(counts)
        size = totals.shape[2]
        out = [np.repeat(part, size), np.repeat(entry, size), np.tile(np.arange(size), len(part)), totals[part, entry].ravel(), np.repeat(counts[part, entry], size)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=arrow)

    return vectors.mapInArrow(summed, schema).groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def encode(df: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """Adds code (two hex digits a part) and error (long: squared distances to the entries, summed over the parts); drops the vector."""
    dim = books.entries.shape[0] * books.entries.shape[2]
    schema = added(df.schema, ("code", T.StringType()), ("error", T.LongType()), drop=[vector])
    arrow = to_arrow_schema(schema)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(e, books.width) for e in books.entries]
        for b in slices(batches, 8192):
            x = _whole(b, vector, dim)
            found = [c.nearest(x[:, p]) for p, c in enumerate(cells)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            error = sum(distance for _, distance in found)
            yield with_columns(b, arrow, {"code": pa.array([row.tobytes().hex() for row in codes], pa.string()), "error": pa.array(error, pa.int64())})

    return df.mapInArrow(coded, schema)


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """``df`` without the vector and with code, error and label_error (the errors of all rows with an equal label; null is one label), and the codebooks."""
    own, name = apart(df, vec_id, vector, label)
    rows = usable(own, name[vector])
    books = learn(rows, name[vec_id], name[vector], entries, rounds)
    rest = [(k, c) for k, c in enumerate(df.columns) if f"c{k}" != name[vector] and c.lower() not in ("code", "error", "label_error")]
    if books is None:
        return rows.select(*(F.col(f"c{k}").alias(c) for k, c in rest), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")).limit(0), None
    # used twice, for the sums by label and for the rows
    coded = written(encode(rows, books, name[vector]), "codes")
    sums = written(coded.groupBy(F.col(name[label]).alias("label")).agg(F.sum("error").alias("label_error")), "label_errors")
    sums = F.broadcast(sums) if sums.count() <= MAX_SENT else sums
    out = coded.join(sums, F.col(name[label]).eqNullSafe(F.col("label")))
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in rest), "code", "error", "label_error"), books


def _round_sql(k: int) -> str:
    """Assignment to codebook k, and codebook k + 1."""
    return f"""
a{k} AS MATERIALIZED (SELECT row, x.part, any_value(x.x) AS x, min(list_sum(list_transform(list_zip(x.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {ENTRIES} + c.k) AS m FROM p x JOIN c{k} c ON x.part = c.part GROUP BY 1, 2),
n{k} AS (SELECT part, k, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT part, m % {ENTRIES} AS k, i, CAST(sum(x[i]) AS DOUBLE) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, (SELECT any_value(len(x)) FROM p) + 1)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.k, coalesce(n.c, c.c) AS c FROM c{k} c LEFT JOIN n{k} n ON n.part = c.part AND n.k = c.k),"""


ORACLE_SQL = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS x FROM v, (SELECT unnest(range({PARTS})) AS part)),
c0 AS MATERIALIZED (SELECT part, row - 1 AS k, x AS c FROM p WHERE row <= {ENTRIES}),{"".join(map(_round_sql, range(ROUNDS)))}
a AS (SELECT row, x.part, min(list_sum(list_transform(list_zip(x.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {ENTRIES} + c.k) AS m FROM p x JOIN c{ROUNDS} c ON x.part = c.part GROUP BY 1, 2),
e AS (SELECT row, string_agg(printf('%02x', CAST(m % {ENTRIES} AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM a GROUP BY 1),
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, k)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN e ON e.row = v.row, b
"""
