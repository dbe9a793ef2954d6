"""JSON of bodies and headers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(body: Column, *paths: str) -> Column:
    """The first path that is there."""
    return F.coalesce(*(F.get_json_object(body, p) for p in paths))


def number(body: Column, *paths: str) -> Column:
    return F.coalesce(*(F.get_json_object(body, p).try_cast("long") for p in paths))


def stripped(value: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def strings(value: Column) -> Column:
    """A JSON list of texts; empty if malformed."""
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, whatever its case."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), 0)["value"]


def render(data: Column) -> Column:
    """Bytes as text, or how many there are."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.format_string("[binary, %d bytes]", F.octet_length(data)))


def kind(body: Column, path: str) -> Column:
    """The kind of the value at a path: STRING, BIGINT, BOOLEAN, ARRAY<...>, OBJECT<...>, VOID for a JSON null; null if there is none."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), path, "variant"))


def is_there(body: Column, path: str) -> Column:
    """There is a value at a path, a JSON null too."""
    return kind(body, path).isNotNull()


def is_list(body: Column, path: str) -> Column:
    return F.coalesce(kind(body, path).startswith("ARRAY"), F.lit(False))
