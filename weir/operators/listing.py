"""Pages, lookups and distinct lists."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import ANY, check_name, every


def page(df: DataFrame, where: Sequence[Column], sort: str, allowed: Sequence[str], key: str, descending: bool = True, number: int = 1, size: int = 50) -> DataFrame:
    """One page in the order of ``sort`` (nulls last), ties by ``key``; the filters reach the scan and Spark keeps only the first rows."""
    column = F.col(check_name(sort, allowed))
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    out = df.where(every(where)).orderBy(order, F.col(key).asc())
    return (out.offset((number - 1) * size) if number > 1 else out).limit(size)


def total(df: DataFrame, where: Sequence[Column]) -> DataFrame:
    return df.where(every(where)).agg(F.count("*").alias("total"))


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def fetch(spans: DataFrame, ids: DataFrame, bodies: Sequence[str] = (), with_bodies: bool = False) -> DataFrame:
    """The spans of each group in ``ids`` (group, id), with their place in time; bodies are not read unless asked for."""
    from pyspark.sql import Window

    light = spans if with_bodies else spans.drop(*bodies)
    order = Window.partitionBy("group").orderBy("request_us", F.col("complete_us").asc_nulls_last(), "id")
    return ids.join(light, "id").withColumn("sequence", F.row_number().over(order))


def distinct_values(rollup: DataFrame, column: str) -> DataFrame:
    """The values of a dimension, from the rollup, without the mark of rolled-up rows."""
    return rollup.where((F.col(column) != ANY) & F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()


def after_cursor(columns: Sequence[str], values: Sequence) -> Column:
    """Rows strictly after ``values`` in descending order of ``columns``."""
    out, equal = F.lit(False), F.lit(True)
    for c, v in zip(columns, values):
        out = out | (equal & (F.col(c) < F.lit(v)))
        equal = equal & (F.col(c) == F.lit(v))
    return out


def encode_cursor(values: Sequence) -> str:
    return json.dumps(list(values)).encode().hex()


def decode_cursor(cursor: str) -> list:
    try:
        out = json.loads(bytes.fromhex(cursor))
    except ValueError as e:
        raise ValueError("bad cursor") from e
    if not isinstance(out, list):
        raise ValueError("bad cursor")
    return out
