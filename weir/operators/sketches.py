"""Rollups whose percentiles can be merged: the finest groups once, coarser windows and tiers from them.

Spans are grouped at the finest window and by all dimensions, with counters, sums and a KLL quantile sketch of each distribution. Coarser windows
add these rows up and merge their sketches; a span goes through one grouping, not sixteen. Only rows of all dimensions (``finest``) are stored;
``tiers`` makes the rolled-up ones when they are read, where sums and sketches of the same rows are all that is needed.

A sketch of ``K`` = 200 tells the value at a rank within about 1.65 per cent of the rank, however often it was merged. Groups without a
value have no sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import COUNTERS, DISTRIBUTIONS, KEYS, counters, measures
from .metrics import field as plain_field
from .predicates import ANY, GRANULARITIES

K = 200
FINEST = "10s"
DIMENSIONS = ("wire_api", "model", "server_ip")
#: Which dimensions each tier keeps.
TIERS = ((True, True, True), (True, True, False), (False, False, True), (False, False, False))
_SUMS = (*COUNTERS, *(f"{d}_{x}" for d in DISTRIBUTIONS for x in ("sum", "count")))


def window(time: str, seconds: int | Column) -> Column:
    size = (F.lit(seconds) if isinstance(seconds, int) else seconds).cast("long") * 1_000_000
    return F.col(time) - F.pmod(F.col(time), size)


def finest(spans: DataFrame, granularity: str = FINEST) -> DataFrame:
    """A row for each window, source, wire API, model, server and tool surface."""
    own = spans.withColumns({f"_{n}": c for n, c in measures().items()})
    keys = [window("request_us", GRANULARITIES[granularity]).alias("window_us"), "source_id", F.lit(granularity).alias("granularity"), *DIMENSIONS, "tool_surface"]
    out = []
    for d in DISTRIBUTIONS:
        x = F.col(f"_{d}").cast("double")
        out += [F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{d}_sum"), F.count(x).alias(f"{d}_count"), F.kll_sketch_agg_double(x, K).alias(f"{d}_sketch")]
    return _told(own.groupBy(*keys).agg(*counters(), *out)).withColumn("finest", F.lit(True))


def _told(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"{d}_sketch": F.when(F.col(f"{d}_count") > 0, F.col(f"{d}_sketch")) for d in DISTRIBUTIONS})


def merged(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Sums of the counters and merged sketches by key."""
    return _told(rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in _SUMS), *(F.kll_merge_agg_double(f"{d}_sketch").alias(f"{d}_sketch") for d in DISTRIBUTIONS)))


def coarser(rows: DataFrame, granularities: dict[str, int] = GRANULARITIES) -> DataFrame:
    """The rows of ``finest`` (of one granularity) in each longer window."""
    longer = F.explode(F.array(*(F.struct(F.lit(n).alias("granularity"), F.lit(s).alias("seconds")) for n, s in granularities.items() if n != FINEST)))
    own = rows.drop("granularity").withColumn("_g", longer)
    return merged(own, window("window_us", F.col("_g.seconds")).alias("window_us"), "source_id", F.col("_g.granularity").alias("granularity"), *DIMENSIONS, "tool_surface").withColumn("finest", F.lit(True))


def rollup(spans: DataFrame, granularities: dict[str, int] = GRANULARITIES) -> DataFrame:
    rows = finest(spans)
    return rows.unionByName(coarser(rows, granularities))


def tiers(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``finest``) and those of the rolled-up tiers that they add to; readers add rows up, so none is grouped here."""
    if "finest" not in rows.columns:
        return rows
    kept = F.explode(F.array(*(F.struct(*((F.col(d) if keep else F.lit(ANY)).alias(d) for d, keep in zip(DIMENSIONS, t))) for t in TIERS)))
    rest = [c for c in rows.columns if c not in (*DIMENSIONS, "finest")]
    return rows.withColumn("_t", kept).select(*rest, *(F.col(f"_t.{d}").alias(d) for d in DIMENSIONS))


def percentile(sketch: Column, p: float) -> Column:
    return F.when(sketch.isNotNull(), F.kll_sketch_get_quantile_double(sketch, F.lit(p)))


def field(name: str) -> Column:
    """As ``metrics.field``, percentiles from merged sketches."""
    d, _, p = name.rpartition("_p")
    if d in DISTRIBUTIONS and p in ("50", "95", "99"):
        return percentile(F.when(F.sum(f"{d}_count") > 0, F.kll_merge_agg_double(f"{d}_sketch")), int(p) / 100).alias(name)
    return plain_field(name)


def cover(start_us: int, end_us: int, granularities: dict[str, int] = GRANULARITIES) -> Column:
    """Windows that cover start <= window < end of the finest granularity just once, each part of the range by the longest windows that fit."""
    left, right = start_us, end_us
    parts: list[tuple[str, int, int]] = []
    inner: tuple[int, int] | None = None
    for n, s in sorted(granularities.items(), key=lambda x: -x[1]):
        size = s * 1_000_000
        lo, hi = -(-left // size) * size, right // size * size
        if n == FINEST:
            lo, hi = left, right
        if inner is None:
            if lo < hi:
                parts.append((n, lo, hi))
                inner = (lo, hi)
        else:
            parts += [(n, a, b) for a, b in ((lo, inner[0]), (inner[1], hi)) if a < b]
            inner = (min(lo, inner[0]), max(hi, inner[1]))
    out = F.lit(False)
    for n, a, b in parts:
        out = out | ((F.col("granularity") == n) & (F.col("window_us") >= a) & (F.col("window_us") < b))
    return out


#: Columns of a stored row.
COLUMNS = (*KEYS, *_SUMS, *(f"{d}_sketch" for d in DISTRIBUTIONS))
