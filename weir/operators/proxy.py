"""Proxies: calls seen on both sides of a proxy or twice on a mirror, and what differs between their legs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Starts of one group lie at most so far apart; copies of a mirror lie closer.
GAP_US, MIRROR_US = 100_000, 500


def groups(turns: DataFrame, content: Sequence[str]) -> DataFrame:
    """turn_id, pair_id, role, size and peers (the other members, sorted), for turns of equal content that are one call seen more than once.

    ``turns``: turn_id, start_us, end_us, view and the content. Turns are clustered by gaps between starts. The outermost one of a cluster (first
    start, then last end, then id) leads; of the others, those on its own view are no copies; those whose start and end are within the mirror distance
    are `mirror_secondary`, those that lie within it `proxy_out`; what overlaps it in another way belongs to no group. The leader is
    `proxy_in` if there is a `proxy_out`, else `mirror_primary`; without any other member there is no group. The pair has the leader's id.
    """
    by = Window.partitionBy(*content).orderBy("start_us", F.col("end_us").desc(), "turn_id")
    gap = F.when(F.col("start_us") - F.lag("start_us").over(by) > GAP_US, 1).otherwise(0)
    own = turns.select(*content, "turn_id", "start_us", "end_us", "view", gap.alias("_gap")).withColumn("_cluster", F.sum("_gap").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*content, "_cluster")
    led = own.withColumn("_lead", F.first(F.struct("turn_id", "start_us", "end_us", "view")).over(inside.orderBy("start_us", F.col("end_us").desc(), "turn_id")))
    at = lambda name: F.col(f"_lead.{name}")
    mirror = (F.abs(F.col("start_us") - at("start_us")) <= MIRROR_US) & (F.abs(F.col("end_us") - at("end_us")) <= MIRROR_US)
    nested = (at("start_us") <= F.col("start_us")) & (at("end_us") >= F.col("end_us"))
    role = F.when(F.col("turn_id") == at("turn_id"), "lead").when(F.col("view") == at("view"), None).when(mirror, "mirror_secondary").when(nested, "proxy_out")
    told = led.withColumn("_role", role).where(F.col("_role").isNotNull())
    # the members of a group are put together once, and told to each of them by its leader's id
    members = told.select("turn_id", at("turn_id").alias("pair_id"), "_role")
    of = members.groupBy("pair_id").agg(F.count("*").alias("size"), F.max(F.col("_role") == "proxy_out").alias("_hop"), F.sort_array(F.collect_set("turn_id")).alias("_all")).where("size > 1")
    role = F.when(F.col("_role") != "lead", F.col("_role")).when(F.col("_hop"), "proxy_in").otherwise("mirror_primary")
    return members.join(of, "pair_id").select("turn_id", "pair_id", role.alias("role"), "size", F.array_remove("_all", F.col("turn_id")).alias("peers"))


#: What must be equal in all legs of a call.
CONTENT = ("session_id", "agent_kind", "call_count", "total_input_tokens", "total_output_tokens")


def patches(traces: DataFrame, from_us: int) -> DataFrame:
    """turn_id, start_us and patch (map): what ``metadata`` must say under `proxy` where it does not say so yet, for turns that start at or after ``from_us``.

    ``traces``: also earlier ones, from which groups may reach into the range, with client_ip, server_ip and metadata (map of JSON texts). A turn
    that belongs to no group any more has its entry taken away (null).
    """
    view = F.concat_ws("->", "client_ip", "server_ip")
    content = [c for c in CONTENT if c in traces.columns]
    told = groups(traces.select("turn_id", "start_us", "end_us", view.alias("view"), *content), content)
    said = F.to_json(F.struct("role", "pair_id", F.col("peers").alias("peer_turn_ids"), F.get("peers", F.lit(0)).alias("peer_turn_id")))
    own = traces.where(F.col("start_us") >= from_us).select("turn_id", "start_us", F.try_element_at("metadata", F.lit("proxy")).alias("_now"))
    both = own.join(told.select("turn_id", said.alias("_new")), "turn_id", "left").where(~F.col("_now").eqNullSafe(F.col("_new")))
    return both.select("turn_id", "start_us", F.create_map(F.lit("proxy"), F.col("_new")).alias("patch"))


def header_diff(legs: DataFrame) -> DataFrame:
    """How each header compares over the legs of a group: common, modified or per_leg; names without case, first spelling kept.

    ``legs``: pair_id, leg (order), headers (array of name and value). Legs are dealt out by pair once, as they came; names by leg, names and
    pairs then all go by one order within a task, row by row. A row of each leg beside its headers (no ``own``) tells how many legs a pair has.
    """
    one = F.struct(F.lit(False).alias("own"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value"))
    listed = F.transform(F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>")), lambda h, k: F.struct(F.lit(True).alias("own"), k.alias("pos"), h["name"].alias("name"), h["value"].alias("value")))
    flat = legs.select("pair_id", "leg", "headers").repartition("pair_id").select("pair_id", "leg", F.explode(F.concat(F.array(one), listed)).alias("h"))
    flat = flat.select("pair_id", F.col("h.own").alias("own"), F.lower("h.name").alias("key"), "leg", F.col("h.pos").alias("pos"), F.col("h.name").alias("name"), F.col("h.value").alias("value"))
    # more than one value: the least and the greatest differ
    by_leg = flat.groupBy("pair_id", "own", "key", "leg").agg(F.min(F.struct("pos", "name")).alias("first"), F.min("value").alias("low"), F.max("value").alias("high"))
    by_name = by_leg.groupBy("pair_id", "own", "key").agg(F.count("leg").alias("seen"), F.min_by("first", F.struct("leg")).alias("first"), F.min("low").alias("low"), F.max("high").alias("high"))
    told = by_name.withColumn("legs", F.max(F.when(~F.col("own"), F.col("seen"))).over(Window.partitionBy("pair_id")))
    kind = F.when(F.col("seen") < F.col("legs"), "per_leg").when(F.col("low") < F.col("high"), "modified").otherwise("common")
    return told.where("own").select("pair_id", F.col("first.name").alias("name"), kind.alias("kind"))


def latency(members: DataFrame) -> DataFrame:
    """What a proxy adds: its own time less that of the call behind it."""
    outer = F.max(F.when(F.col("role") == "proxy_in", F.col("duration_us")))
    inner = F.max(F.when(F.col("role") == "proxy_out", F.col("duration_us")))
    return members.groupBy("pair_id").agg((outer / 1000.0).alias("client_ms"), (inner / 1000.0).alias("upstream_ms"), ((outer - inner) / 1000.0).alias("overhead_ms"))


def view(members: DataFrame, spans: DataFrame) -> DataFrame:
    """The legs of each group with their first calls: outermost first, then by id.

    ``members``: turn_id, pair_id, role, first_span; ``spans``: id and what is shown of a call.
    """
    rank = F.when(F.col("role") == "proxy_in", 0).when(F.col("role") == "mirror_primary", 1).when(F.col("role") == "proxy_out", 2).otherwise(3)
    order = Window.partitionBy("pair_id").orderBy(rank, "turn_id")
    return members.join(spans, F.col("first_span") == F.col("id")).withColumn("position", F.row_number().over(order)).drop("first_span")


def model_rewrites(members: DataFrame) -> DataFrame:
    """Groups whose legs ask for different models: what the client asked for and what was asked upstream."""
    client = F.max(F.when(F.col("role") == "proxy_in", F.col("model")))
    upstream = F.max(F.when(F.col("role") == "proxy_out", F.col("model")))
    return members.groupBy("pair_id").agg(client.alias("client_model"), upstream.alias("upstream_model")).where("client_model <> upstream_model")
