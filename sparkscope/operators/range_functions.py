"""Functions from the samples of a window [step - range, step] to one value: one grouped aggregation each.

A sample is copied to the steps whose windows hold it and grouped by (step, series); where that would be many copies,
markers for the steps are mixed into each series instead. Functions of a window's first and last sample and of what is
summed between them then look up both ends, with sums that run over the series, in time linear in samples and steps; for
the others a range frame is aggregated. What a function needs of a sample's predecessor comes from one lag over the
series; the share of the window's first sample is taken off again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.functions import floats
from sparkscope.functions import labels as L
from sparkscope.operators.grid import Grid
from sparkscope.operators.selectors import MOST_COPIES, shifted

LAGGED = {"rate", "increase", "delta", "irate", "idelta", "changes", "resets"}
#: Functions of what each sample has against its predecessor, and that column.
OWN = {"rate": "reset", "increase": "reset", "changes": "changed", "resets": "dropped"}
#: Functions of a window's ends, and what is summed between them.
ENDS = {**OWN, "delta": None}
_number = lambda: floats.number(F.col("value"))
#: Results that are no plain aggregates, over a frame.
FRAMED = {
    "max_over_time": {"out": lambda w: floats.nan_if_null(F.max(_number()).over(w))},
    "count_over_time": {"out": lambda w: F.count("value").over(w).cast("double")},
    "stdvar_over_time": {"out": lambda w: F.coalesce(F.var_pop(_number()).over(w), F.lit(0.0))},
    "stddev_over_time": {"out": lambda w: F.coalesce(F.stddev_pop(_number()).over(w), F.lit(0.0))},
    "holt_winters": {"all": lambda w: F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("ts_nano", "value"))).over(w))},
}


def _own(before: str) -> Column:
    """Sum over the window of what each sample has against its predecessor, without the first's."""
    return F.sum(before) - F.min_by(before, "ts_nano")


def aggregates(name: str, param: float | None) -> dict[str, Column]:
    """The aggregates a function needs; n, the number of samples, is always there."""
    v, number = F.col("value"), floats.number(F.col("value"))
    n = {"n": F.count("value")}
    simple: dict[str, Callable[[], Column]] = {
        "avg_over_time": lambda: F.avg(v), "sum_over_time": lambda: F.sum(v), "min_over_time": lambda: F.min(v), "max_over_time": lambda: floats.nan_if_null(F.max(number)),
        "count_over_time": lambda: F.count(v).cast("double"), "stdvar_over_time": lambda: F.coalesce(F.var_pop(number), F.lit(0.0)), "stddev_over_time": lambda: F.coalesce(F.stddev_pop(number), F.lit(0.0)),
        "last_over_time": lambda: F.max_by(v, "ts_nano"), "present_over_time": lambda: F.max(F.when(v.isNotNull(), 1.0)),
        "changes": lambda: _own("changed"), "resets": lambda: _own("dropped"),
    }
    if name in simple:
        return n | {"out": simple[name]()}
    if name == "quantile_over_time":
        return n | {"out": F.max(F.lit(floats.INF if param > 1 else -floats.INF)) if not 0 <= param <= 1 else F.percentile(v, param)}
    if name in ("rate", "increase", "delta"):
        ends = {"first": F.min_by(v, "ts_nano"), "last": F.max_by(v, "ts_nano"), "t0": F.min("at"), "t1": F.max("at")}
        return n | ends | ({} if name == "delta" else {"reset": _own("reset")})
    if name in ("irate", "idelta"):
        return n | {"last": F.max_by(v, "ts_nano"), "prev": F.max_by("prev", "ts_nano"), "t1": F.max("at"), "t0": F.max_by("prev_ts", "ts_nano")}
    if name in ("deriv", "predict_linear"):
        return n | {"slope": F.regr_slope(v, F.col("at").cast("double")), "mean": F.avg(v), "mean_ts": F.avg("at")}
    if name == "holt_winters":
        return n | {"all": F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct("ts_nano", "value"))))}
    raise ValueError(f"unknown range function {name}")


def _extrapolated(name: str, seconds: int) -> Column:
    """Value of rate, increase and delta: the change between the ends, stretched to the window's bounds."""
    counter = name != "delta"
    d = lambda c: c.cast("double")
    change = F.col("last") - F.col("first") + (F.col("reset") if counter else 0.0)
    span = d(F.col("t1") - F.col("t0"))
    each = floats.div(span, d(F.col("n") - 1))
    to_start, to_end = d(F.col("t0") - (F.col("step_ts") - seconds)), d(F.col("step_ts") - F.col("t1"))
    if counter:  # a counter starts at zero at the earliest
        to_zero = span * floats.div(F.col("first"), change)
        to_start = F.when((change > 0) & (F.col("first") >= 0) & (to_zero < to_start), to_zero).otherwise(to_start)
    limit = each * 1.1
    stretched = span + F.when(to_start < limit, to_start).otherwise(each / 2) + F.when(to_end < limit, to_end).otherwise(each / 2)
    out = change * floats.div(stretched, span)
    return out / float(seconds) if name == "rate" else out


def finish(name: str, seconds: int, params: list[float]) -> tuple[Column, Column]:
    """The value, and whether the window has one."""
    n = F.col("n")
    if name in ("rate", "increase", "delta"):
        return _extrapolated(name, seconds), (n >= 2) & (F.col("t1") > F.col("t0"))
    if name in ("irate", "idelta"):
        step = F.col("last") - F.col("prev")
        if name == "irate":
            step = floats.div(F.when(floats.COMPARE["<"](F.col("last"), F.col("prev")), F.col("last")).otherwise(step), (F.col("t1") - F.col("t0")).cast("double"))
        return step, (n >= 2) & (F.col("t1") > F.col("t0"))
    if name == "deriv":
        return F.col("slope"), (n >= 2) & F.col("slope").isNotNull()
    if name == "predict_linear":
        return F.col("mean") + F.col("slope") * (F.col("step_ts") + F.lit(params[0]) - F.col("mean_ts")), (n >= 2) & F.col("slope").isNotNull()
    if name == "holt_winters":
        smooth, trend = params
        x = F.col("all")
        start = F.struct(x[0]["value"].alias("s"), (x[1]["value"] - x[0]["value"]).alias("b"))

        def step(acc: Column, e: Column) -> Column:
            s = e["value"] * smooth + (acc["s"] + acc["b"]) * (1 - smooth)
            return F.struct(s.alias("s"), ((s - acc["s"]) * trend + acc["b"] * (1 - trend)).alias("b"))

        # the first trend step keeps the initial slope
        second = F.struct((x[1]["value"] * smooth + (start["s"] + start["b"]) * (1 - smooth)).alias("s"), start["b"].alias("b"))
        return F.aggregate(F.slice(x, F.lit(3), F.greatest(F.size(x) - 2, F.lit(0))), second, step)["s"], n >= 2
    return F.col("out"), n >= 1


def _with_previous(rows: DataFrame) -> DataFrame:
    series = Window.partitionBy("labels").orderBy("ts_nano")
    rows = rows.withColumns({"prev": F.lag("value").over(series), "prev_ts": F.lag("ts").over(series)})
    fell = floats.COMPARE["<"](F.col("value"), F.col("prev")) & F.col("prev").isNotNull()
    same = (F.col("value") == F.col("prev")) | F.col("prev").isNull()  # NaN equals NaN here, as a change should see it
    return rows.withColumns({"reset": F.when(fell, F.col("prev")).otherwise(0.0), "dropped": fell.cast("double"), "changed": (~same).cast("double")})


def _by_ends(rows: DataFrame, name: str, seconds: int, grid: Grid) -> DataFrame:
    """The aggregates of a function of ENDS: each step's window is found by its first sample and its last."""
    running = Window.partitionBy("labels").orderBy("ts_nano").rowsBetween(Window.unboundedPreceding, 0)
    between = F.sum(ENDS[name]).over(running) if ENDS[name] else F.lit(0.0)
    point = F.struct(F.count("value").over(running).alias("n"), "value", F.col("ts").alias("at"), between.alias("between"))
    samples = rows.select("labels", "ts", "ts_nano", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("step_ts"), point.alias("p"))
    steps = rows.select("labels").distinct().withColumn("step_ts", F.explode(grid.all_steps()))
    edge = F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col("step_ts").alias("ts")), F.struct(F.lit(2).alias("kind"), (F.col("step_ts") - seconds).alias("ts"))))
    marks = steps.select("labels", "step_ts", edge.alias("m")).select("labels", "step_ts", "m.kind", "m.ts")
    both = samples.unionByName(marks, allowMissingColumns=True)
    # samples at a mark's own time come before it in either order
    up = Window.partitionBy("labels").orderBy("ts", "kind", "ts_nano").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("labels").orderBy(F.desc("ts"), "kind", F.desc("ts_nano")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.select("labels", "step_ts", "kind", F.last("p", True).over(up).alias("before"), F.last("p", True).over(down).alias("behind")).where("kind > 0")
    ends = seen.groupBy("labels", "step_ts").agg(F.max(F.when(F.col("kind") == 2, F.col("behind"))).alias("a"), F.max(F.when(F.col("kind") == 1, F.col("before"))).alias("b"))
    ends = ends.where("a.n <= b.n")
    between = F.col("b.between") - F.col("a.between")
    return ends.select(
        "labels", "step_ts", (F.col("b.n") - F.col("a.n") + 1).alias("n"), F.col("a.value").alias("first"), F.col("b.value").alias("last"), F.col("a.at").alias("t0"), F.col("b.at").alias("t1"),
        between.alias("reset"), between.alias("out"),
    )


def over_time(samples: DataFrame, name: str, seconds: int, grid: Grid, params: list[float] | None = None, offset: int = 0, keep_name: bool = False) -> DataFrame:
    """The function's vector over the grid. Windows without (enough) samples give no row."""
    params = params or []
    seconds = int(seconds)
    rows = shifted(samples, offset).where(F.col("ts").between(grid.start - seconds, grid.last))
    rows = rows.withColumn("at", F.col("ts"))  # of samples only, not of the markers below
    if name in LAGGED:
        rows = _with_previous(rows)
    aggs = aggregates(name, params[0] if params else None)
    if grid.size == 1:
        out = rows.groupBy(F.lit(grid.start).cast("bigint").alias("step_ts"), "labels").agg(*[c.alias(k) for k, c in aggs.items()])
    elif seconds // grid.step + 1 <= MOST_COPIES:
        out = rows.withColumn("step_ts", F.explode(grid.between(F.col("ts"), F.col("ts") + seconds))).groupBy("step_ts", "labels").agg(*[c.alias(k) for k, c in aggs.items()])
    elif name in ENDS:
        out = _by_ends(rows, name, seconds, grid)
    else:
        marks = rows.select("labels").distinct().withColumn("ts", F.explode(grid.all_steps()))
        both = rows.withColumn("mark", F.lit(False)).unionByName(marks.withColumn("mark", F.lit(True)), allowMissingColumns=True)
        frame = Window.partitionBy("labels").orderBy("ts").rangeBetween(-seconds, 0)
        parts = {k: c.over(frame) for k, c in aggs.items() if k not in FRAMED.get(name, {})}
        parts |= {k: f(frame) for k, f in FRAMED.get(name, {}).items()}
        out = both.select("mark", F.col("ts").alias("step_ts"), "labels", *[c.alias(k) for k, c in parts.items()]).where("mark")
    value, there = finish(name, seconds, params)
    labels = F.col("labels") if keep_name or name == "last_over_time" else L.without(F.col("labels"), [])
    return out.where(there).select("step_ts", labels.alias("labels"), value.alias("value"))


