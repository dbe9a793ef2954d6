"""Metric rollups over spans and the questions asked of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .predicates import ANY, GRANULARITIES, check_name, time_range

DISTRIBUTIONS = ("ttft", "ttft_stream", "ttft_nonstream", "e2e", "tpot")
PERCENTILES = (50, 95, 99)
COUNTERS = (
    "call_count", "stream_count", "non_stream_count", "error_count", "error_4xx_count", "error_429_count", "error_5xx_count",
    "input_tokens_sum", "input_tokens_count", "output_tokens_sum", "output_tokens_count",
    "cache_read_tokens_sum", "cache_read_tokens_count", "cache_creation_tokens_sum", "cache_creation_tokens_count",
)
KEYS = ("window_us", "source_id", "granularity", "wire_api", "model", "server_ip", "tool_surface")


def tpot_ms() -> Column:
    """Milliseconds per output token of a stream, where it took time and made tokens."""
    took = F.col("complete_us") - F.col("response_us")
    return F.when(F.col("is_stream") & (took > 0) & (F.col("output_tokens") > 0), took / 1000.0 / F.col("output_tokens"))


def measures() -> dict[str, Column]:
    """The value of each distribution for one span."""
    ttft = F.col("ttft_ms")
    return {"ttft": ttft, "ttft_stream": F.when(F.col("is_stream"), ttft), "ttft_nonstream": F.when(~F.col("is_stream"), ttft), "e2e": F.col("e2e_latency_ms"), "tpot": tpot_ms()}


def _how_many(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def counters() -> list[Column]:
    status = F.col("status_code")
    out = [
        F.count("*").alias("call_count"),
        _how_many(F.col("is_stream")).alias("stream_count"),
        _how_many(~F.col("is_stream")).alias("non_stream_count"),
        _how_many(status >= 400).alias("error_count"),
        _how_many(status.between(400, 499)).alias("error_4xx_count"),
        _how_many(status == 429).alias("error_429_count"),
        _how_many(status >= 500).alias("error_5xx_count"),
    ]
    for name, column in (("input", "input_tokens"), ("output", "output_tokens"), ("cache_read", "cache_read_input_tokens"), ("cache_creation", "cache_creation_input_tokens")):
        out += [F.coalesce(F.sum(column), F.lit(0)).cast("long").alias(f"{name}_tokens_sum"), F.count(column).alias(f"{name}_tokens_count")]
    return out


def distributions(exact: bool = True) -> list[Column]:
    """Sum, count and three percentiles of each distribution. Exact percentiles keep the values of a group; sketches bound them."""
    out = []
    for name in DISTRIBUTIONS:
        x = F.col(f"_{name}")
        out += [F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{name}_sum"), F.count(x).alias(f"{name}_count")]
        points = [p / 100 for p in PERCENTILES]
        # one buffer for all percentiles of a distribution
        out.append((F.percentile(x, points) if exact else F.percentile_approx(x, points, 1000)).alias(f"_p_{name}"))
    return out


def unpacked(rows: DataFrame) -> DataFrame:
    """Each percentile as a column."""
    names = [f"_p_{d}" for d in DISTRIBUTIONS]
    return rows.withColumns({f"{d}_p{p}": F.get(f"_p_{d}", F.lit(k)) for d in DISTRIBUTIONS for k, p in enumerate(PERCENTILES)}).drop(*names)


def rollup(spans: DataFrame, granularities: dict[str, int] = GRANULARITIES, exact: bool = True) -> DataFrame:
    """Rollup rows of each source, window, tier and tool surface.

    A span counts in four tiers: (wire API, model, server), (wire API, model), (server) and all; a rolled-up dimension is '*'.
    Each span becomes a row for each granularity and tier before one grouping, whose partial sums keep the shuffle to groups.
    """
    windows = F.explode(F.array(*(F.struct(F.lit(n).alias("granularity"), F.lit(s * 1_000_000).cast("long").alias("size")) for n, s in granularities.items())))
    tiers = F.explode(F.array(*(F.struct((F.col("wire_api") if w else F.lit(ANY)).alias("wire_api"), (F.col("model") if w else F.lit(ANY)).alias("model"), (F.col("server_ip") if s else F.lit(ANY)).alias("server_ip")) for w, s in ((1, 1), (1, 0), (0, 1), (0, 0)))))
    used = ["is_stream", "status_code", "input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]
    own = spans.withColumns({f"_{n}": c for n, c in measures().items()})
    rows = own.select("request_us", "source_id", "tool_surface", *used, *(f"_{n}" for n in DISTRIBUTIONS), windows.alias("g"), F.struct("wire_api", "model", "server_ip").alias("d"))
    rows = rows.select("*", F.col("d.wire_api"), F.col("d.model"), F.col("d.server_ip")).select("request_us", "source_id", "tool_surface", "g", *used, *(f"_{n}" for n in DISTRIBUTIONS), tiers.alias("t"))
    rows = rows.select((F.col("request_us") - F.col("request_us") % F.col("g.size")).alias("window_us"), "source_id", F.col("g.granularity"), "t.wire_api", "t.model", "t.server_ip", "tool_surface", *used, *(f"_{n}" for n in DISTRIBUTIONS))
    return unpacked(rows.groupBy(*KEYS).agg(*counters(), *distributions(exact)))


def finish_rollup(spans: DataFrame, granularities: dict[str, int] = GRANULARITIES) -> DataFrame:
    """Counts by finish reason, for the same windows and tiers."""
    windows = F.explode(F.array(*(F.struct(F.lit(n).alias("granularity"), F.lit(s * 1_000_000).cast("long").alias("size")) for n, s in granularities.items())))
    tiers = F.array(*(F.struct((F.col("wire_api") if w else F.lit(ANY)).alias("wire_api"), (F.col("model") if w else F.lit(ANY)).alias("model"), (F.col("server_ip") if s else F.lit(ANY)).alias("server_ip")) for w, s in ((1, 1), (1, 0), (0, 1), (0, 0))))
    rows = spans.where(F.col("finish_reason").isNotNull()).select("request_us", "source_id", "finish_reason", tiers.alias("tiers"), windows.alias("g")).select("*", F.explode("tiers").alias("t"))
    return rows.groupBy((F.col("request_us") - F.col("request_us") % F.col("g.size")).alias("window_us"), "source_id", F.col("g.granularity").alias("granularity"), F.col("t.wire_api").alias("wire_api"), F.col("t.model").alias("model"), F.col("t.server_ip").alias("server_ip"), "finish_reason").agg(F.count("*").alias("count"))


def finish_rows(spans: DataFrame, granularities: dict[str, int] = GRANULARITIES) -> DataFrame:
    """Counts by finish reason and all dimensions, as stored: the rolled-up tiers follow from them."""
    windows = F.explode(F.array(*(F.struct(F.lit(n).alias("granularity"), F.lit(s * 1_000_000).cast("long").alias("size")) for n, s in granularities.items())))
    rows = spans.where(F.col("finish_reason").isNotNull()).select("request_us", "source_id", "finish_reason", "wire_api", "model", "server_ip", windows.alias("g"))
    keys = [(F.col("request_us") - F.pmod(F.col("request_us"), F.col("g.size"))).alias("window_us"), "source_id", F.col("g.granularity").alias("granularity"), "wire_api", "model", "server_ip", "finish_reason"]
    return rows.groupBy(*keys).agg(F.count("*").alias("count")).withColumn("finest", F.lit(True))


#: Fields that can be asked for, each with its aggregate over rollup rows.
def field(name: str) -> Column:
    """A field over rollup rows: sums for counters, sum by count for averages, count-weighted means of the rows' percentiles."""
    if name in COUNTERS or name.removesuffix("_sum") in DISTRIBUTIONS and name.endswith("_sum"):
        return F.sum(name).alias(name)
    for d in DISTRIBUTIONS:
        if name == f"{d}_avg":
            return F.when(F.sum(f"{d}_count") > 0, F.sum(f"{d}_sum") / F.sum(f"{d}_count")).alias(name)
        if name in (f"{d}_p50", f"{d}_p95", f"{d}_p99"):
            weight = F.when(F.col(name).isNotNull(), F.col(f"{d}_count"))
            return F.when(F.sum(weight) > 0, F.sum(F.col(name) * weight) / F.sum(weight)).alias(name)
        if name == f"{d}_count":
            return F.sum(name).alias(name)
    if name == "active_calls_max":
        return F.max(name).alias(name)
    raise ValueError(f"unknown field: {name}")


def timeseries(rows: DataFrame, fields: Sequence[str], granularity: str, start_us: int, end_us: int, tier: Column, group_by: str | None = None, aggregate: Callable[[str], Column] = field) -> DataFrame:
    """ts (seconds), the group if any, and the fields, for each window in the range. ``aggregate``: a field over rollup rows."""
    keys = [(F.col("window_us") / 1_000_000).cast("long").alias("ts")]
    if group_by:
        keys.append(F.col(check_name(group_by, ("wire_api", "model"))))
    return rows.where(time_range("window_us", start_us, end_us) & (F.col("granularity") == granularity) & tier).groupBy(*keys).agg(*map(aggregate, fields))


def on_grid(series: DataFrame, fields: Sequence[str], start_s: int, end_s: int, step: int, group_by: str | None = None) -> DataFrame:
    """Every point of the grid for each group and field, as (group, field, ts, value), null where there is none."""
    spark = series.sparkSession
    first = -(-start_s // step) * step
    grid = spark.range(first, max(first, end_s), step).select(F.col("id").alias("ts"))
    groups = series.select(F.col(group_by).alias("group")).distinct() if group_by else spark.range(1).select(F.lit("").alias("group"))
    # the grid has at most MAX_BUCKETS points (check_buckets), so it can be sent to all
    points = groups.select("group", F.explode(F.array(*map(F.lit, fields))).alias("field")).join(F.broadcast(grid))
    stacked = series.select((F.col(group_by) if group_by else F.lit("")).alias("group"), "ts", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields))).alias("x")).select("group", "ts", "x.*")
    return points.join(stacked, ["group", "field", "ts"], "left")


def summary(rows: DataFrame, start_us: int, end_us: int, tier: Column) -> DataFrame:
    """Totals over the finest windows; one row, with zeros, if there are none."""
    return totals(rows.where(time_range("window_us", start_us, end_us) & (F.col("granularity") == "10s") & tier))


def totals(own: DataFrame) -> DataFrame:
    """Totals over rollup rows; one row, with zeros, if there are none."""
    counts = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS]
    averages = [field(f"{d}_avg") for d in DISTRIBUTIONS]
    return own.agg(*counts, *averages)


def by_model(rows: DataFrame, start_us: int, end_us: int, sort: str = "call_count", limit: int = 20) -> DataFrame:
    """Figures by wire API and model, the largest ``sort`` first; ties by name."""
    own = rows.where(time_range("window_us", start_us, end_us) & (F.col("granularity") == "10s") & (F.col("wire_api") != ANY) & (F.col("model") != ANY) & (F.col("server_ip") == ANY))
    return model_totals(own, sort, limit)


def model_totals(own: DataFrame, sort: str = "call_count", limit: int = 20, aggregate: Callable[[str], Column] = field) -> DataFrame:
    check_name(sort, (*COUNTERS, "ttft_avg", "e2e_avg"))
    out = own.groupBy("wire_api", "model").agg(*map(aggregate, ("call_count", "error_count", "input_tokens_sum", "output_tokens_sum", "ttft_avg", "e2e_avg", "e2e_p95")))
    return out.orderBy(F.col(sort).desc_nulls_last(), "wire_api", "model").limit(limit)


def finish_series(rows: DataFrame, granularity: str) -> DataFrame:
    """Points by finish reason, in order, from the rolled-up rows."""
    own = rows.where((F.col("granularity") == granularity) & (F.col("wire_api") == ANY) & (F.col("model") == ANY) & (F.col("server_ip") == ANY))
    return own.groupBy("finish_reason", "window_us").agg(F.sum("count").alias("count"))


def active_samples(spans: DataFrame, chunk_us: int = 3_600_000_000) -> DataFrame:
    """source_id, ts_us and active: the calls under way at each start of one, by source: a running count that starts add to and ends take from, never below 0.

    With S the running sum of +1 and -1, the count floored at 0 is S - min(0, running minimum of S); it is sampled at starts.
    Both run within chunks of time first, then over the chunks' totals, so no task needs all rows of a source.
    """
    starts = spans.select("source_id", "id", F.col("request_us").alias("ts_us"), F.lit(1).alias("delta"))
    ends = spans.where(F.col("complete_us").isNotNull()).select("source_id", "id", F.col("complete_us").alias("ts_us"), F.lit(-1).alias("delta"))
    steps = starts.union(ends).withColumn("chunk", (F.col("ts_us") / chunk_us).cast("long"))
    order = Window.partitionBy("source_id", "chunk").orderBy("ts_us", "delta", "id").rowsBetween(Window.unboundedPreceding, 0)
    run = steps.withColumn("s", F.sum("delta").over(order)).withColumn("low", F.min("s").over(order))
    totals = run.groupBy("source_id", "chunk").agg(F.sum("delta").alias("d"), F.min("s").alias("m"))
    before = Window.partitionBy("source_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("d").over(before), F.lit(0))).withColumn("lowest", F.min(F.col("offset") + F.col("m")).over(before)).select("source_id", "chunk", "offset", "lowest")
    both = run.where("delta = 1").join(offsets, ["source_id", "chunk"])
    lowest = F.least(F.lit(0), F.coalesce("lowest", F.lit(0)), F.col("offset") + F.col("low"))
    active = (F.col("offset") + F.col("s") - lowest).cast("long")
    return both.select("source_id", "ts_us", active.alias("active"))


def active_calls(spans: DataFrame) -> DataFrame:
    """The most calls under way at once in each minute, by source."""
    return active_samples(spans).groupBy("source_id", (F.col("ts_us") - F.col("ts_us") % 60_000_000).alias("window_us")).agg(F.max("active").alias("active_calls_max"))


def rates(rows: DataFrame, seconds: int) -> DataFrame:
    """Rates that follow from counters: calls and tokens a second, shares of errors, of too many requests and of tokens read from a cache."""

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))

    return rows.withColumns({
        "call_rate": F.col("call_count") / seconds,
        "token_rate": (F.col("input_tokens_sum") + F.col("output_tokens_sum")) / seconds,
        "error_rate": share("error_count", "call_count"),
        "success_rate": F.when(F.col("call_count") > 0, 1 - F.col("error_count") / F.col("call_count")),
        "throttled_rate": share("error_429_count", "call_count"),
        "cache_hit_rate": share("cache_read_tokens_sum", "input_tokens_sum"),
    })
