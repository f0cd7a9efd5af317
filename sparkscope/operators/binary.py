"""Arithmetic, comparisons and set operators between vectors and scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.functions import floats
from sparkscope.functions import labels as L
from sparkscope.plans.ast import Matching

COMPARISONS = floats.COMPARE.keys()


def scalar_scalar(op: str, a: Column, b: Column) -> Column:
    return floats.COMPARE[op](a, b).cast("double") if op in COMPARISONS else floats.ARITHMETIC[op](a, b)


def vector_scalar(vector: DataFrame, scalar: Column | DataFrame, op: str, swapped: bool, returns_bool: bool) -> DataFrame:
    """vector op scalar, or scalar op vector if swapped. A scalar that is a frame has one row for each step of the grid."""
    if isinstance(scalar, DataFrame):
        vector = vector.join(scalar.withColumnRenamed("value", "other"), "step_ts")
        scalar = F.col("other")
    a, b = (scalar, F.col("value")) if swapped else (F.col("value"), scalar)
    dropped = L.without(F.col("labels"), []).alias("labels")
    if op in COMPARISONS:
        hit = floats.COMPARE[op](a, b)
        if returns_bool:
            return vector.select("step_ts", dropped, hit.cast("double").alias("value"))
        return vector.where(hit).select("step_ts", "labels", "value")
    return vector.select("step_ts", dropped, floats.ARITHMETIC[op](a, b).alias("value"))


def signature(matching: Matching) -> Column:
    own = F.col("labels")
    return L.only(own, matching.labels) if matching.on else L.without(own, matching.labels)


def _one(vector: DataFrame, matching: Matching, side: str, words: str) -> DataFrame:
    """One row for each step and signature; a second series there raises an error when the value is used."""
    rows = vector.groupBy("step_ts", signature(matching).alias("sig")).agg(F.first("labels").alias(f"{side}_labels"), F.first("value").alias("v"), F.count("*").alias("n"))
    guarded = F.when(F.col("n") > 1, F.raise_error(F.lit(words)).cast("double")).otherwise(F.col("v"))
    return rows.select("step_ts", "sig", f"{side}_labels", guarded.alias(f"{side}_value"))


def _many(vector: DataFrame, matching: Matching, side: str) -> DataFrame:
    return vector.select("step_ts", signature(matching).alias("sig"), F.col("labels").alias(f"{side}_labels"), F.col("value").alias(f"{side}_value"))


def vector_vector(left: DataFrame, right: DataFrame, op: str, matching: Matching | None, returns_bool: bool) -> DataFrame:
    """Join on (step, signature); one-to-one, or many-to-one with grouping labels from the one side."""
    m = matching or Matching()
    twice = "found duplicate series for the match group on the {} side; many-to-many matching needs group_left or group_right"
    a = _many(left, m, "l") if m.group == "left" else _one(left, m, "l", "multiple matches for labels: grouping labels must ensure unique matches" if m.group == "one" else twice.format("left"))
    b = _many(right, m, "r") if m.group == "right" else _one(right, m, "r", twice.format("right"))
    rows = a.join(b, ["step_ts", "sig"])
    x, y = F.col("l_value"), F.col("r_value")
    compare = op in COMPARISONS
    keeps_name = compare and not returns_bool
    if m.group == "one":
        own = F.col("l_labels")
        if m.on:
            labels = F.filter(own, lambda e: e["name"].isin(m.labels)) if m.labels else L.empty()
        elif keeps_name:
            labels = F.filter(own, lambda e: ~e["name"].isin(m.labels)) if m.labels else own
        else:
            labels = L.without(own, m.labels)
    else:
        many, one = ("l_labels", "r_labels") if m.group == "left" else ("r_labels", "l_labels")
        labels = F.col(many) if keeps_name else L.without(F.col(many), [])
        for name in m.include:
            labels = L.put(labels, name, L.value_of(F.col(one), name))
    if compare:
        hit = floats.COMPARE[op](x, y)
        if returns_bool:
            return rows.select("step_ts", labels.alias("labels"), hit.cast("double").alias("value"))
        return rows.where(hit).select("step_ts", labels.alias("labels"), x.alias("value"))
    return rows.select("step_ts", labels.alias("labels"), floats.ARITHMETIC[op](x, y).alias("value"))


def set_operation(left: DataFrame, right: DataFrame, op: str, matching: Matching | None) -> DataFrame:
    """and: semi join; unless: anti join; or: the left, then what of the right has no signature there. Labels stay as they are."""
    m = matching or Matching()
    columns = ["step_ts", "labels", "value"]
    a, b = left.select(*columns, signature(m).alias("sig")), right.select(*columns, signature(m).alias("sig"))
    if op == "or":
        return a.select(*columns).unionByName(b.join(a.select("step_ts", "sig"), ["step_ts", "sig"], "left_anti").select(*columns))
    return a.join(b.select("step_ts", "sig"), ["step_ts", "sig"], "left_semi" if op == "and" else "left_anti").select(*columns)
