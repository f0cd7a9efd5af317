"""Functions of instant vectors: element-wise maths, clocks, labels, absence, and quantiles of classic histograms."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.functions import floats
from sparkscope.functions import labels as L
from sparkscope.operators.grid import Grid
from sparkscope.operators.selectors import anchored
from sparkscope.plans.ast import Matcher


def _domain(ok, f):
    return lambda v: F.when(F.isnan(v) | ~ok(v), floats.nan()).otherwise(f(v))


MATHS = {
    "abs": F.abs, "ceil": lambda v: _kept(v, F.ceil), "floor": lambda v: _kept(v, F.floor), "exp": F.exp, "sqrt": _domain(lambda v: v >= 0, F.sqrt),
    "ln": lambda v: floats.log(v, F.ln), "log2": lambda v: floats.log(v, F.log2), "log10": lambda v: floats.log(v, F.log10), "sgn": lambda v: F.when(F.isnan(v), v).otherwise(F.signum(v)),
    "acos": F.acos, "acosh": F.acosh, "asin": F.asin, "asinh": F.asinh, "atan": F.atan, "atanh": F.atanh, "cos": F.cos, "cosh": F.cosh, "sin": F.sin, "sinh": F.sinh, "tan": F.tan, "tanh": F.tanh,
    "deg": F.degrees, "rad": F.radians,
}


def _kept(v: Column, f) -> Column:
    """f(v) as a double; NaN, infinities and values too large for fractions stay."""
    return F.when(F.isnan(v) | (F.abs(v) >= 2.0**53), v).otherwise(f(F.when(F.abs(v) < 2.0**53, v).otherwise(0.0)).cast("double"))


def rounded(v: Column, to: float) -> Column:
    """Nearest multiple, halves up."""
    inverse = 1.0 / to
    return floats.div(_kept(v * inverse + 0.5, F.floor), F.lit(inverse))


def clamped(v: Column, low: Column | None, high: Column | None) -> Column:
    out = v
    if low is not None:
        out = F.when(F.isnan(out) | F.isnan(low), floats.nan()).when(out < low, low).otherwise(out)
    if high is not None:
        out = F.when(F.isnan(out) | F.isnan(high), floats.nan()).when(out > high, high).otherwise(out)
    return out


def clock(name: str, seconds: Column) -> Column:
    """Parts of a UTC time given in seconds."""
    t = F.timestamp_seconds(seconds.cast("bigint"))
    return {
        "minute": F.minute, "hour": F.hour, "day_of_month": F.dayofmonth, "day_of_year": F.dayofyear, "month": F.month, "year": F.year,
        "day_of_week": lambda x: F.dayofweek(x) - 1, "days_in_month": lambda x: F.dayofmonth(F.last_day(x)),
    }[name](t).cast("double")


def mapped(vector: DataFrame, value: Column, keep_name: bool = False) -> DataFrame:
    labels = F.col("labels") if keep_name else L.without(F.col("labels"), []).alias("labels")
    return vector.select("step_ts", labels, value.alias("value"))


def absent(vector: DataFrame, grid: Grid, matchers: list[Matcher] | None) -> DataFrame:
    """1 at each step without any row; labels from the equality matchers of a plain selector, but for names matched twice."""
    names = [m.name for m in matchers or []]
    pairs = {m.name: F.lit(m.value) for m in matchers or [] if m.op == "=" and m.name != L.NAME and names.count(m.name) == 1}
    steps = grid.steps(vector.sparkSession)
    return steps.join(vector.select("step_ts").distinct(), "step_ts", "left_anti").select("step_ts", L.pack(pairs).alias("labels"), F.lit(1.0).alias("value"))


def to_scalar(vector: DataFrame, grid: Grid) -> DataFrame:
    """(step_ts, value) of every step: the value where there is just one row, else NaN."""
    one = vector.groupBy("step_ts").agg(F.count("*").alias("n"), F.first("value").alias("v"))
    return grid.steps(vector.sparkSession).join(one, "step_ts", "left").select("step_ts", F.when(F.col("n") == 1, F.col("v")).otherwise(floats.nan()).alias("value"))


def label_replace(vector: DataFrame, target: str, replacement: str, source: str, pattern: str) -> DataFrame:
    if target != L.NAME:
        L.check_name(target)
    value = L.value_of(F.col("labels"), source)
    java = re.sub(r"\$\{?(\w+)\}?", lambda m: "$" + m[1] if m[1].isdigit() else "${" + m[1] + "}", replacement.replace("\\", "\\\\"))
    pattern = pattern.replace("(?P<", "(?<")
    new = F.regexp_replace(value, anchored(pattern), java)
    return vector.select("step_ts", F.when(value.rlike(anchored(pattern)), L.put(F.col("labels"), target, new)).otherwise(F.col("labels")).alias("labels"), "value")


def label_join(vector: DataFrame, target: str, separator: str, sources: list[str]) -> DataFrame:
    if target != L.NAME:
        L.check_name(target)
    new = F.concat_ws(separator, *[L.value_of(F.col("labels"), s) for s in sources]) if sources else F.lit("")
    return vector.select("step_ts", L.put(F.col("labels"), target, new).alias("labels"), "value")


def histogram_quantile(q: float, buckets: DataFrame) -> DataFrame:
    """Quantile of cumulative buckets (label le), interpolated linearly; see the cases below.

    Equal bounds are summed, counts made monotonic. Without a +Inf bucket, with fewer than two buckets or no
    observations: NaN. A rank above all finite bounds gives the highest finite one. Buckets whose le is no number count
    as absent.
    """
    bound = F.col("labels")
    le = F.lower(L.value_of(bound, "le"))
    ub = F.when(le.isin("+inf", "inf"), F.lit(floats.INF)).otherwise(le.try_cast("double"))
    rows = buckets.select("step_ts", L.without(F.col("labels"), ["le"]).alias("key"), ub.alias("ub"), "value").where(F.col("ub").isNotNull())
    rows = rows.groupBy("step_ts", "key", "ub").agg(F.sum("value").alias("c"))
    if math.isnan(q) or q < 0 or q > 1:
        fixed = floats.NAN if math.isnan(q) else -floats.INF if q < 0 else floats.INF
        return rows.select("step_ts", "key").distinct().select("step_ts", F.col("key").alias("labels"), F.lit(fixed).alias("value"))
    order = Window.partitionBy("step_ts", "key").orderBy("ub")
    rows = rows.withColumn("c", F.max("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"below": F.coalesce(F.lag("c").over(order), F.lit(0.0)), "from": F.lag("ub").over(order)})
    group = Window.partitionBy("step_ts", "key")
    total, top, n = F.max_by("c", "ub").over(group), F.max("ub").over(group), F.count("*").over(group)
    second = F.max(F.when(F.col("ub") < floats.INF, F.col("ub"))).over(group)
    rows = rows.withColumns({"total": total, "top": top, "n": n, "second": second})
    rank = F.col("total") * q
    hit = (F.col("c") >= rank) & (F.col("ub") < floats.INF)
    inside = F.col("c") - F.col("below")
    # the first bucket starts at 0 if its bound is positive; else its bound is the answer
    start = F.when(F.col("from").isNotNull(), F.col("from")).otherwise(F.lit(0.0))
    value = F.when(F.col("from").isNull() & (F.col("ub") <= 0), F.col("ub")).otherwise(start + (F.col("ub") - start) * floats.div(rank - F.col("below"), inside))
    found = rows.groupBy("step_ts", "key").agg(F.min_by(F.when(hit, value), F.when(hit, F.col("ub"))).alias("v"), F.max("total").alias("total"), F.max("top").alias("top"), F.max("n").alias("n"), F.max("second").alias("second"))
    out = F.when((F.col("top") != floats.INF) | (F.col("n") < 2) | (F.col("total") == 0) | F.isnan("total"), floats.nan()).otherwise(F.coalesce("v", "second"))
    return found.select("step_ts", F.col("key").alias("labels"), out.alias("value"))
