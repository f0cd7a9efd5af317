"""Label matchers, and selectors over an evaluation grid.

Samples: labels (sorted array, see functions.labels), name, ts (seconds), ts_nano, value. A vector: step_ts, labels,
value and, straight from a selector, sample_ts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.functions import labels as L
from sparkscope.operators.grid import Grid
from sparkscope.plans.ast import Matcher

#: A sample is copied to at most this many steps; beyond, a window over the series is cheaper.
MOST_COPIES = 32


def anchored(pattern: str) -> str:
    return rf"\A(?s:{pattern})\z"


def condition(m: Matcher) -> Column:
    """A matcher as a predicate; an absent label is an empty one. The metric name is a column, so it prunes partitions."""
    value = F.col("name") if m.name == L.NAME else L.value_of(F.col("labels"), m.name)
    if m.op == "=":
        return value == m.value
    if m.op == "!=":
        return value != m.value
    if re.fullmatch(r"[A-Za-z0-9_ -]+(\|[A-Za-z0-9_ -]+)*", m.value):  # a plain list of values
        hit = value.isin(m.value.split("|"))
    else:
        hit = value.rlike(anchored(m.value))
    return hit if m.op == "=~" else ~hit


def matching(samples: DataFrame, matchers: list[Matcher]) -> DataFrame:
    out = samples
    for m in matchers:
        out = out.where(condition(m))
    return out


def shifted(samples: DataFrame, offset: int) -> DataFrame:
    return samples if not offset else samples.withColumn("ts", F.col("ts") + offset)


def instant(samples: DataFrame, grid: Grid, lookback: int, offset: int = 0) -> DataFrame:
    """At each step the last sample in [step - lookback, step] of each series; the latest ts_nano of a second wins.

    Where a sample can serve few steps it is copied to them and aggregated, which combines before the shuffle and
    doesn't mind hot series. Else each sample is valid until the next of its series, found by a window.
    """
    rows = shifted(samples, offset).where(F.col("ts").between(grid.start - lookback, grid.last))
    if grid.size == 1:
        return _latest(rows.withColumn("step_ts", F.lit(grid.start).cast("bigint")))
    if lookback // grid.step + 1 <= MOST_COPIES // 4:
        return _latest(rows.withColumn("step_ts", F.explode(grid.between(F.col("ts"), F.col("ts") + lookback))))
    following = F.lead("ts").over(Window.partitionBy("labels").orderBy("ts_nano"))
    rows = rows.withColumn("until", F.least(F.coalesce(following - 1, F.col("ts") + lookback), F.col("ts") + lookback))
    rows = rows.withColumn("step_ts", F.explode(grid.between(F.col("ts"), F.col("until"))))
    return rows.select("step_ts", "labels", "value", F.col("ts").alias("sample_ts"))


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("step_ts", "labels").agg(F.max_by("value", "ts_nano").alias("value"), F.max("ts").alias("sample_ts"))


def pinned(vector: DataFrame, grid: Grid) -> DataFrame:
    """A vector of one step, held at every step of a grid."""
    return vector.withColumn("step_ts", F.explode(grid.all_steps()))
