"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that separate words in the contracts of the operators.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A session of this machine alone gets one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="weir-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: the lineage ends there, and the rows outlive an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weir-{uuid.uuid4().hex}/{name}"
    (df.select(*keep) if keep else df).write.parquet(path)
    return spark.read.schema((df.select(*keep) if keep else df).schema).parquet(path)


def row_key(doc_id: str, text: str) -> list[Column]:
    """A row of documents is told by its id and a fingerprint of its text, so that rows with one id and unlike texts stay apart."""
    return [F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_th")]


def same(left: str, right: str, *names: str) -> Column:
    """Null-safe equality of equally named columns of two aliased frames."""
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return cond


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, '' for null."""
    return ["" if t is None else t for t in column.to_pylist()]


#: Bytes of a slice, about; one text may have more.
SLICE_BYTES = 6 << 20


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches by rows and bytes, so that what a task holds besides its input stays small."""
    for b in batches:
        step = max(1, min(rows, int(size * b.num_rows / max(b.nbytes, 1)) if b.num_rows else rows))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
        del b
        # what a batch took goes back to the system, as the worker lives on through other stages
        pa.default_memory_pool().release_unused()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column by name; like Spark, whatever its case if no name is equal."""
    names = batch.schema.names
    return batch.column(names.index(name) if name in names else [n.lower() for n in names].index(name.lower()))


def added(schema: T.StructType, *fields: tuple[str, T.DataType], drop: Iterable[str] = ()) -> T.StructType:
    """``schema`` without ``drop`` and without columns named as the new ones, whatever their case, then the new ones."""
    gone = {n.lower() for n in (*drop, *(n for n, _ in fields))}
    return T.StructType([f for f in schema.fields if f.name.lower() not in gone] + [T.StructField(n, t) for n, t in fields])


def but(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` other than ``names``, whatever their case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def apart(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns renamed to c0, c1, ... and the new name of each of ``names``.

    An operator that joins or adds helpers works on such names, so that no column of the caller's clashes with its own.
    """
    short = {c: f"c{k}" for k, c in enumerate(df.columns)}
    lower = {c.lower(): s for c, s in short.items()}
    return df.toDF(*short.values()), {n: short.get(n) or lower[n.lower()] for n in names}


def with_columns(batch: pa.RecordBatch, schema: pa.Schema, new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in schema], schema=schema)
