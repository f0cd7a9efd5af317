"""Aggregations of an instant vector by label sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.functions import floats
from sparkscope.functions import labels as L


def group_key(labels: list[str], exclude: bool) -> Column:
    own = F.col("labels")
    return L.without(own, labels) if exclude else L.only(own, labels)


def number_text(v: Column) -> Column:
    """A value as a label: 1 for 1.0, else the shortest decimal."""
    whole = (F.abs(v) < 1e15) & (v == F.floor(v))
    plain = F.when(F.isnan(v), "NaN").when(v == floats.INF, "+Inf").when(v == -floats.INF, "-Inf")
    return plain.when(whole, v.cast("decimal(20,0)").cast("string")).otherwise(v.cast("string"))


def aggregate(vector: DataFrame, op: str, labels: list[str], exclude: bool, param: float | str | None = None) -> DataFrame:
    """One row for each step and group; topk and bottomk keep the rows' own labels.

    Spark sums partially before it shuffles; row_number() <= k is limited before the shuffle too.
    """
    v, number = F.col("value"), floats.number(F.col("value"))
    keyed = vector.withColumn("key", group_key(labels, exclude))
    if op in ("topk", "bottomk"):
        k = int(param) if param == param and abs(param) < 2**62 else 0
        order = v.desc() if op == "topk" else v.asc()
        rank = F.row_number().over(Window.partitionBy("step_ts", "key").orderBy(F.isnan(v), order, "labels"))
        return keyed.withColumn("rank", rank).where(F.col("rank") <= max(k, 0)).select("step_ts", "labels", "value")
    if op == "count_values":
        L.check_name(param)
        keyed = keyed.withColumn("key", L.put(F.col("key"), param, number_text(v)))
    if op == "quantile" and not 0 <= param <= 1:
        out = F.max(F.lit(floats.NAN if param != param else floats.INF if param > 1 else -floats.INF))
    else:
        out = {
            "sum": lambda: F.sum(v), "avg": lambda: F.avg(v), "count": lambda: F.count("*").cast("double"), "group": lambda: F.max(F.lit(1.0)),
            "min": lambda: F.min(v), "max": lambda: floats.nan_if_null(F.max(number)),  # NaN is the greatest in Spark's order
            "stdvar": lambda: F.coalesce(F.var_pop(number), F.lit(0.0)), "stddev": lambda: F.coalesce(F.stddev_pop(number), F.lit(0.0)),
            "quantile": lambda: F.percentile(v, param), "count_values": lambda: F.count("*").cast("double"),
        }[op]()
    return keyed.groupBy("step_ts", "key").agg(out.alias("value")).select("step_ts", F.col("key").alias("labels"), "value")
