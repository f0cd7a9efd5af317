"""From an expression to one lazy DataFrame over the evaluation grid.

Nothing is evaluated step by step: each node becomes DataFrame operations over all steps at once, and Catalyst sees the
whole query. Scalars that depend on no data stay Columns. Equal selectors share a plan, so Spark reuses their exchange.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.functions import floats
from sparkscope.functions import labels as L
from sparkscope.operators import aggregations, binary, instant_functions, range_functions, selectors
from sparkscope.operators.grid import Grid
from sparkscope.plans.ast import SCALAR, Aggregate, Binary, Call, Node, Number, Paren, QueryError, Range, Selector, Subquery, Text, Unary
from sparkscope.plans.parser import SETS


@dataclass
class Options:
    """lookback: seconds that a sample stays valid; subquery_step: resolution where a subquery names none;
    max_samples: samples that the selectors of a query may read (counted first, if set); strict: a result with two equal
    label sets at a step raises an error."""

    lookback: int = 300
    subquery_step: int = 60
    max_samples: int | None = None
    strict: bool = True


class TooManySamples(RuntimeError):
    """The query reads more samples than its budget."""


def whole(seconds: float, what: str) -> int:
    """A time in whole seconds, the resolution of samples; a fraction raises an error instead of being dropped."""
    if seconds != int(seconds):
        raise QueryError(f"{what} must be whole seconds, not {seconds:g}")
    return int(seconds)


def constant(node: Node) -> float | None:
    """Value of a scalar expression without data, folded before planning; None if it needs the step."""
    if isinstance(node, Number):
        return node.value
    if isinstance(node, Paren):
        return constant(node.inner)
    if isinstance(node, Unary):
        x = constant(node.inner)
        return None if x is None else -x if node.op == "-" else x
    if isinstance(node, Call) and node.name == "pi":
        return math.pi
    if isinstance(node, Binary):
        a, b = constant(node.left), constant(node.right)
        return None if a is None or b is None else _folded(node.op, a, b)
    return None


def _folded(op: str, a: float, b: float) -> float:
    if op in floats.COMPARE:
        return float({"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op])
    try:
        if op == "/":
            if b == 0:
                return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)
            return a / b
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: math.fmod(a, b), "^": lambda: math.pow(a, b), "atan2": lambda: math.atan2(a, b)}[op]()
    except ValueError:
        return math.nan
    except OverflowError:
        return math.inf


def differs_without_name(node: Node) -> bool:
    """Whether the label sets of a node's result, at one step, are sure to differ in labels other than the name."""
    if isinstance(node, Selector):
        return any(m.name == L.NAME and m.op == "=" for m in node.matchers)
    if isinstance(node, Range):
        return differs_without_name(node.selector)
    if isinstance(node, (Paren, Unary, Subquery)):
        return differs_without_name(node.inner)
    if isinstance(node, Aggregate):
        return node.op not in ("topk", "bottomk") or differs_without_name(node.inner)
    if isinstance(node, Binary):
        if node.left.type() == SCALAR or node.right.type() == SCALAR:
            return differs_without_name(node.right if node.left.type() == SCALAR else node.left)
        return node.op not in SETS and (node.matching is None or node.matching.group == "one")
    if isinstance(node, Call):
        if node.name in ("label_replace", "label_join"):
            return False
        labelled = [a for a in node.args if a.type() != SCALAR]
        return all(differs_without_name(a) for a in labelled)
    return False


class Planner:
    """Plans over samples (name, labels, ts, ts_nano, value)."""

    def __init__(self, samples: DataFrame, options: Options | None = None) -> None:
        self.samples, self.options = samples, options or Options()
        self.spark = samples.sparkSession
        self._seen: dict = {}

    def plan(self, node: Node, grid: Grid) -> DataFrame:
        """The expression's rows: vectors (step_ts, labels, value); a scalar has empty labels."""
        if self.options.max_samples is not None:
            self._check_budget(node, grid)
        if node.type() == SCALAR:
            value = self.scalar(node, grid)
            rows = value if isinstance(value, DataFrame) else grid.steps(self.spark).select("step_ts", value.alias("value"))
            return rows.select("step_ts", L.empty().alias("labels"), F.col("value").cast("double").alias("value"))
        return self.vector(node, grid)

    def _check_budget(self, node: Node, grid: Grid) -> None:
        total = 0
        for x in node.walk():
            if isinstance(x, Selector):
                total += selectors.matching(self.samples, x.matchers).where(F.col("ts").between(grid.start - self.options.lookback - x.offset, grid.last - x.offset)).count()
        if total > self.options.max_samples:
            raise TooManySamples(f"the query reads {total} samples; its budget is {self.options.max_samples}")

    # scalars

    def scalar(self, node: Node, grid: Grid) -> Column | DataFrame:
        fixed = constant(node)
        if fixed is not None:
            return F.lit(float(fixed))
        if isinstance(node, Paren):
            return self.scalar(node.inner, grid)
        if isinstance(node, Unary):
            x = self.scalar(node.inner, grid)
            if node.op == "+":
                return x
            return x.select("step_ts", (-F.col("value")).alias("value")) if isinstance(x, DataFrame) else -x
        if isinstance(node, Call) and node.name == "time":
            return F.col("step_ts").cast("double")
        if isinstance(node, Call) and node.name == "scalar":
            return instant_functions.to_scalar(self.vector(node.args[0], grid), grid)
        if isinstance(node, Binary):
            a, b = self.scalar(node.left, grid), self.scalar(node.right, grid)
            if not isinstance(a, DataFrame) and not isinstance(b, DataFrame):
                return binary.scalar_scalar(node.op, a, b)
            rows = grid.steps(self.spark)
            columns = []
            for name, x in (("a", a), ("b", b)):
                if isinstance(x, DataFrame):
                    rows = rows.join(x.withColumnRenamed("value", name), "step_ts")
                    x = F.col(name)
                columns.append(x)
            return rows.select("step_ts", binary.scalar_scalar(node.op, *columns).alias("value"))
        raise QueryError(f"no scalar: {node}")

    def _fixed(self, node: Node, what: str) -> float:
        value = constant(node)
        if value is None:
            raise QueryError(f"{what} must be a constant")
        return value

    # vectors

    def vector(self, node: Node, grid: Grid) -> DataFrame:
        if isinstance(node, Paren):
            return self.vector(node.inner, grid)
        if isinstance(node, Selector):
            return self._selected(node, grid).select("step_ts", "labels", "value")
        if isinstance(node, Unary):
            inner = self.vector(node.inner, grid)
            return inner if node.op == "+" else self._unique(instant_functions.mapped(inner, -F.col("value")), node.inner)
        if isinstance(node, Aggregate):
            param = None
            if node.param is not None:
                param = node.param.value if isinstance(node.param, Text) else self._fixed(node.param, f"{node.op}'s parameter")
            return aggregations.aggregate(self.vector(node.inner, grid), node.op, node.labels, node.exclude, param)
        if isinstance(node, Binary):
            return self._binary(node, grid)
        if isinstance(node, Call):
            return self._call(node, grid)
        raise QueryError(f"no instant vector: {node}")

    def _binary(self, node: Binary, grid: Grid) -> DataFrame:
        left, right = node.left.type() == SCALAR, node.right.type() == SCALAR
        if left or right:
            scalar, vector = (node.left, node.right) if left else (node.right, node.left)
            out = binary.vector_scalar(self.vector(vector, grid), self.scalar(scalar, grid), node.op, left, node.returns_bool)
            return out if node.op in binary.COMPARISONS and not node.returns_bool else self._unique(out, vector)
        a, b = self.vector(node.left, grid), self.vector(node.right, grid)
        if node.op in SETS:
            return binary.set_operation(a, b, node.op, node.matching)
        out = binary.vector_vector(a, b, node.op, node.matching, node.returns_bool)
        return self._unique(out) if node.matching and node.matching.group != "one" else out

    def _unique(self, vector: DataFrame, source: Node | None = None) -> DataFrame:
        """The rows; two with the same labels at a step raise an error when they are read.

        source: what the vector's labels come from. Where its label sets differ in more than the metric's name, as
        those of one metric do, dropping the name makes no two equal and the check, with its shuffle, is left out.
        """
        if not self.options.strict or (source is not None and differs_without_name(source)):
            return vector
        rows = vector.groupBy("step_ts", "labels").agg(F.first("value").alias("v"), F.count("*").alias("n"))
        fault = F.raise_error(F.lit("vector cannot contain metrics with the same labelset")).cast("double")
        return rows.select("step_ts", "labels", F.when(F.col("n") > 1, fault).otherwise(F.col("v")).alias("value"))

    def _pin(self, at: float | str | None, grid: Grid) -> Grid:
        if at is None:
            return grid
        t = grid.start if at == "start" else grid.last if at == "end" else int(at)
        return Grid(t, t)

    def _selected(self, node: Selector, grid: Grid) -> DataFrame:
        key = ("instant", tuple(node.matchers), grid, node.offset, node.at)
        if key not in self._seen:
            own = self._pin(node.at, grid)
            out = selectors.instant(selectors.matching(self.samples, node.matchers), own, self.options.lookback, whole(node.offset, "an offset"))
            self._seen[key] = out if own is grid else selectors.pinned(out, grid)
        return self._seen[key]

    def raw(self, node: Range, at: int) -> DataFrame:
        """The samples (labels, ts, value) of a plain range selector at one time."""
        s = node.selector
        t = self._pin(s.at, Grid(at, at)).start - whole(s.offset, "an offset")
        return selectors.matching(self.samples, s.matchers).where(F.col("ts").between(t - whole(node.seconds, "a range"), t)).select("labels", "ts", "ts_nano", "value")

    def _windows(self, node: Node, grid: Grid) -> tuple[DataFrame, int, int, Grid]:
        """Samples, range and offset of a range vector, and the grid it is evaluated on."""
        if isinstance(node, Paren):
            return self._windows(node.inner, grid)
        if isinstance(node, Range):
            s = node.selector
            return selectors.matching(self.samples, s.matchers), whole(node.seconds, "a range"), whole(s.offset, "an offset"), self._pin(s.at, grid)
        if isinstance(node, Subquery):
            own = self._pin(node.at, grid)
            step = max(1, whole(node.step or self.options.subquery_step, "a step"))
            seconds, offset = whole(node.seconds, "a range"), whole(node.offset, "an offset")
            first = own.start - offset - seconds
            first = first + -first % step  # steps of a subquery are multiples of its step
            last = own.last - offset
            if last < first:
                first = last
            rows = self.plan_inner(node.inner, Grid(first, last, step))
            name = L.value_of(F.col("labels"), L.NAME).alias("name")
            rows = rows.select(name, "labels", F.col("step_ts").alias("ts"), (F.col("step_ts") * 1_000_000_000).alias("ts_nano"), "value")
            return rows, seconds, offset, own
        raise QueryError(f"no range vector: {node}")

    def plan_inner(self, node: Node, grid: Grid) -> DataFrame:
        if node.type() == SCALAR:
            value = self.scalar(node, grid)
            rows = value if isinstance(value, DataFrame) else grid.steps(self.spark).select("step_ts", value.alias("value"))
            return rows.select("step_ts", L.empty().alias("labels"), "value")
        return self.vector(node, grid)

    def _over_time(self, name: str, node: Node, grid: Grid, params: list[float]) -> DataFrame:
        rows, seconds, offset, own = self._windows(node, grid)
        out = range_functions.over_time(rows, name, seconds, own, params, offset)
        return out if own is grid else selectors.pinned(out, grid)

    def _call(self, node: Call, grid: Grid) -> DataFrame:
        name, args = node.name, node.args
        v = F.col("value")
        if name.endswith("_over_time") and name not in ("absent_over_time", "quantile_over_time") or name in range_functions.LAGGED or name == "deriv":
            return self._unique(self._over_time(name, args[0], grid, []), args[0])
        if name == "quantile_over_time":
            return self._unique(self._over_time(name, args[1], grid, [self._fixed(args[0], "the quantile")]), args[1])
        if name == "predict_linear":
            return self._unique(self._over_time(name, args[0], grid, [self._fixed(args[1], "the time ahead")]), args[0])
        if name == "holt_winters":
            factors = [self._fixed(a, "a smoothing factor") for a in args[1:]]
            if not all(0 < f < 1 for f in factors):
                raise QueryError("smoothing factors lie between 0 and 1")
            return self._unique(self._over_time(name, args[0], grid, factors), args[0])
        if name == "absent_over_time":
            inner = args[0].selector if isinstance(args[0], Range) else None
            return instant_functions.absent(self._over_time("present_over_time", args[0], grid, []), grid, inner.matchers if inner else None)
        if name == "absent":
            bare = args[0]
            while isinstance(bare, Paren):
                bare = bare.inner
            return instant_functions.absent(self.vector(args[0], grid), grid, bare.matchers if isinstance(bare, Selector) else None)
        if name == "vector":
            value = self.scalar(args[0], grid)
            rows = value if isinstance(value, DataFrame) else grid.steps(self.spark).select("step_ts", value.alias("value"))
            return rows.select("step_ts", L.empty().alias("labels"), "value")
        if name == "timestamp":
            bare = args[0]
            while isinstance(bare, Paren):
                bare = bare.inner
            if isinstance(bare, Selector):
                return self._unique(instant_functions.mapped(self._selected(bare, grid), F.col("sample_ts").cast("double")), bare)
            return self._unique(instant_functions.mapped(self.vector(args[0], grid), F.col("step_ts").cast("double")), args[0])
        if name in ("sort", "sort_desc"):
            order = v.asc() if name == "sort" else v.desc()
            return self.vector(args[0], grid).orderBy("step_ts", F.isnan(v), order, "labels")
        if name == "histogram_quantile":
            return instant_functions.histogram_quantile(self._fixed(args[0], "the quantile"), self.vector(args[1], grid))
        if name in ("histogram_count", "histogram_sum", "histogram_fraction"):
            raise QueryError(f"{name} needs native histograms, which samples do not hold")
        if name == "label_replace":
            return self._unique(instant_functions.label_replace(self.vector(args[0], grid), *[a.value for a in args[1:]]))
        if name == "label_join":
            return self._unique(instant_functions.label_join(self.vector(args[0], grid), args[1].value, args[2].value, [a.value for a in args[3:]]))
        if name in ("minute", "hour", "day_of_week", "day_of_month", "day_of_year", "days_in_month", "month", "year"):
            if not args:
                return grid.steps(self.spark).select("step_ts", L.empty().alias("labels"), instant_functions.clock(name, F.col("step_ts")).alias("value"))
            return self._unique(instant_functions.mapped(self.vector(args[0], grid), instant_functions.clock(name, v)), args[0])
        vector = self.vector(args[0], grid)
        if name == "round":
            to = self._fixed(args[1], "the unit to round to") if len(args) > 1 else 1.0
            return self._unique(instant_functions.mapped(vector, instant_functions.rounded(v, to)), args[0])
        if name.startswith("clamp"):
            bounds = [F.lit(self._fixed(a, "a bound")) for a in args[1:]]
            if name == "clamp":
                low, high = (self._fixed(a, "a bound") for a in args[1:])
                if low > high:
                    return vector.where(F.lit(False)).select("step_ts", "labels", "value")
            low, high = bounds if name == "clamp" else (bounds[0], None) if name == "clamp_min" else (None, bounds[0])
            return self._unique(instant_functions.mapped(vector, instant_functions.clamped(v, low, high)), args[0])
        return self._unique(instant_functions.mapped(vector, instant_functions.MATHS[name](v)), args[0])
