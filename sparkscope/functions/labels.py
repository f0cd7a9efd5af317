"""Label sets as sorted arrays of (name, value) structs.

Unlike maps, such arrays can be grouped, joined and ordered by. Filtering keeps the order, so a projection is canonical
without another sort. A label with an empty value is the same as an absent one and is never stored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = "__name__"
TYPE = "array<struct<name:string,value:string>>"
_VALID = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*\Z")


def check_name(name: str) -> str:
    if not _VALID.match(name):
        raise ValueError(f"invalid label name {name!r}")
    return name


def empty() -> Column:
    return F.array().cast(TYPE)


def pack(pairs: dict[str, Column]) -> Column:
    """Label set of named columns; null and empty ones are left out."""
    if not pairs:
        return empty()
    items = [F.struct(F.lit(k).alias("name"), pairs[k].cast("string").alias("value")) for k in sorted(pairs)]
    return F.filter(F.array(*items), lambda x: F.coalesce(x["value"], F.lit("")) != "").cast(TYPE)


def from_map(labels: Column) -> Column:
    entries = F.transform(F.map_entries(labels), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    return F.array_sort(F.filter(entries, lambda x: F.coalesce(x["value"], F.lit("")) != ""))


def value_of(labels: Column, name: str) -> Column:
    """Value of a label, empty if absent."""
    return F.coalesce(F.get(F.filter(labels, lambda x: x["name"] == name), F.lit(0))["value"], F.lit(""))


def only(labels: Column, names: list[str]) -> Column:
    wanted = [n for n in names if n != NAME]
    return F.filter(labels, lambda x: x["name"].isin(wanted)) if wanted else empty()


def without(labels: Column, names: list[str]) -> Column:
    return F.filter(labels, lambda x: ~x["name"].isin([*names, NAME]))


def put(labels: Column, name: str, value: Column) -> Column:
    """labels with one label set, or removed where the value is empty."""
    rest = F.filter(labels, lambda x: x["name"] != name)
    item = F.array(F.struct(F.lit(name).alias("name"), value.alias("value")))
    return F.when(F.coalesce(value, F.lit("")) == "", rest).otherwise(F.array_sort(F.concat(rest, item)))


def shown(labels: Column) -> Column:
    """name=value pairs, comma-joined: one flat text for each label set."""
    return F.array_join(F.transform(labels, lambda x: F.concat(x["name"], F.lit("="), x["value"])), ",")
