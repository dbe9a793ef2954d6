"""Filters of the query surface: time ranges, lists, substrings and the choice of rollup tier."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: marks a rolled-up dimension; no real value may equal it.
ANY = "*"
#: Window lengths in seconds by name.
GRANULARITIES = {"10s": 10, "1m": 60, "5m": 300, "1h": 3600}
TOOL_SURFACES = ("function_call", "mcp", "cli", "mixed", "unknown")
LATEST_SECOND = 4_102_444_800
MAX_BUCKETS = 20_000


def every(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def time_range(column: str, start: int | None, end: int | None) -> Column:
    """start <= column < end."""
    parts = ([F.col(column) >= start] if start is not None else []) + ([F.col(column) < end] if end is not None else [])
    return every(parts)


def one_of(column: str, values: Sequence | None) -> Column:
    """No list, or an empty one, filters nothing."""
    return F.col(column).isin(list(values)) if values else F.lit(True)


def like(column: str, text: str | None) -> Column:
    """Substring; per cent and underscore in ``text`` keep their meaning as wildcards, blanks alone filter nothing."""
    return F.col(column).like(f"%{text.strip()}%") if text and text.strip() else F.lit(True)


def equals(column: str, value: bool | None) -> Column:
    return F.col(column) == F.lit(value) if value is not None else F.lit(True)


def overlaps(column: str, values: Sequence[str] | None) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))) if values else F.lit(True)


def tier(wire_apis: Sequence[str] | None = None, models: Sequence[str] | None = None, server_ips: Sequence[str] | None = None, group_by: str | None = None) -> Column:
    """The rollup rows that answer a query: the coarsest tier that still has the dimensions it filters or groups by."""
    detail = bool(wire_apis or models) or group_by in ("wire_api", "model")
    out = []
    for name, values in (("wire_api", wire_apis), ("model", models)):
        out.append(F.col(name).isin(list(values)) if values else F.col(name) != ANY if detail else F.col(name) == ANY)
    out.append(F.col("server_ip").isin(list(server_ips)) if server_ips else F.col("server_ip") == ANY)
    return every(out)


def dimensions(wire_apis: Sequence[str] | None = None, models: Sequence[str] | None = None, server_ips: Sequence[str] | None = None) -> Column:
    """The rows of all dimensions that a query asks for."""
    return every([one_of("wire_api", wire_apis), one_of("model", models), one_of("server_ip", server_ips)])


def tier_name() -> Column:
    """The tier of a rollup row, as a column to be written with it."""
    w, m, s = (F.col(c) != ANY for c in ("wire_api", "model", "server_ip"))
    return F.when(w & m & s, "wms").when(w & m & ~s, "wm").when(~w & ~m & s, "s").when(~w & ~m & ~s, "all").otherwise("other")


def not_hidden_hop(role: Column) -> Column:
    """Leaves out the inner hops of proxies and mirrors."""
    return role.isNull() | ~role.isin("proxy_out", "mirror_secondary")


def check_range(start_s: int, end_s: int) -> tuple[int, int]:
    """Seconds as they come from a request, checked, in microseconds."""
    if not 0 <= start_s <= end_s <= LATEST_SECOND:
        raise ValueError(f"bad time range: {start_s} to {end_s}")
    return start_s * 1_000_000, end_s * 1_000_000


def check_buckets(start_s: int, end_s: int, granularity: str) -> int:
    if granularity not in GRANULARITIES:
        raise ValueError(f"unknown granularity: {granularity}")
    step = GRANULARITIES[granularity]
    if (end_s - start_s) / step > MAX_BUCKETS:
        raise ValueError("too many buckets")
    return step


def check_name(name: str, allowed: Iterable[str]) -> str:
    if name not in set(allowed):
        raise ValueError(f"unknown field: {name}")
    return name


def csv_list(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]
