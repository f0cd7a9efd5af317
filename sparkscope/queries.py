"""Named queries over the benchmark tables, each with SQL that gives the same rows.

Metric queries return (step_ts, labels, value): labels as comma-joined name=value text, values rounded to six digits.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope import api
from sparkscope.functions import labels as L
from sparkscope.operators import catalog, traces
from sparkscope.plans.planner import Options
from sparkscope.sources import otlp, testdata
from sparkscope.sources.store import Store
from sparkscope.streaming import ingest

DAY = 86400
T0 = 1704067200
#: The events' thirty days: windows of a step's length cover them all.
START, END, STEP, LOOKBACK = T0 + 2 * DAY, T0 + 30 * DAY, 2 * DAY, 2 * DAY
HISTOGRAM_AT = 1704153600

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("step_ts").cast("bigint").alias("step_ts"), L.shown(F.col("labels")).alias("labels"), F.round("value", 6).alias("value"))


def _promql(name: str, query: str, sql: str, at: int | None = None, step: int = STEP) -> None:
    """Register a query over the grid, or at one time; sql follows the common tables below."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data, options = api.Telemetry(testdata.samples(spark, sf_dir)), Options(lookback=LOOKBACK)
        return shown(api.query_instant(data, query, at, options) if at is not None else api.query_range(data, query, START, END, step, options))

    QUERIES[name] = run
    steps = f"(VALUES ({at}))" if at is not None else f"(SELECT unnest(range({START}, {END + 1}, {step})))"
    ORACLES[name] = _TABLES.replace("STEPS", steps) + sql


_TABLES = f"""WITH steps AS (SELECT s::BIGINT AS s FROM STEPS x(s)),
ev AS (SELECT event_type AS et, user_id::VARCHAR AS uid, floor(epoch(ts))::BIGINT AS t, epoch_us(ts) * 1000 + event_id % 1000 AS n, value::DOUBLE AS v FROM events),
tot AS (SELECT event_type AS et, (user_id % 4)::VARCHAR AS sh, floor(epoch(ts))::BIGINT AS t, epoch_us(ts) * 1000 + event_id % 1000 AS n,
  (count(*) OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS v FROM events),
daily AS (SELECT event_type AS et, floor(epoch(ts))::BIGINT AS t, epoch_us(ts) * 1000 + event_id % 1000 AS n,
  (count(*) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS v FROM events),
bounds AS (SELECT * FROM (VALUES ('10', 10.0), ('20', 20.0), ('30', 30.0), ('40', 40.0), ('50', 50.0), ('+Inf', 1e300)) b(le, ub)),
hist AS (SELECT l_returnflag AS rf, le, ub, (count(*) FILTER (WHERE l_quantity <= ub))::DOUBLE AS v FROM lineitem, bounds GROUP BY ALL),
iev AS (SELECT s, et, uid, arg_max(v, n) AS v, max(t) AS st FROM steps JOIN ev ON t BETWEEN s - {LOOKBACK} AND s GROUP BY s, et, uid),
itot AS (SELECT s, et, sh, arg_max(v, n) AS v, max(t) AS st FROM steps JOIN tot ON t BETWEEN s - {LOOKBACK} AND s GROUP BY s, et, sh),
sumev AS (SELECT s, et, sum(v) AS v FROM iev GROUP BY s, et),
sumtot AS (SELECT s, et, sum(v) AS v FROM itot GROUP BY s, et)
"""


def _out(labels: str, source: str, value: str = "v", where: str = "") -> str:
    return f"SELECT s AS step_ts, {labels} AS labels, round(({value})::DOUBLE, 6) AS value FROM {source}{' WHERE ' + where if where else ''}"


_EV = "'__name__=event_value,event_type=' || et || ',user_id=' || uid"
_EV_BARE = "'event_type=' || et || ',user_id=' || uid"
_TOT = "'__name__=events_total,event_type=' || et || ',shard=' || sh"
_TOT_BARE = "'event_type=' || et || ',shard=' || sh"
_ET = "'event_type=' || et"

# selectors and matchers
_promql("selector_instant", "event_value", _out(_EV, "iev"), at=END)
_promql("selector_range", "events_total", _out(_TOT, "itot"))
_promql("selector_fine_grid", "events_total", _out(_TOT, "itot"), step=DAY // 8)
_promql("matcher_eq", 'event_value{event_type="click"}', _out(_EV, "iev", where="et = 'click'"))
_promql("matcher_neq", 'event_value{event_type!="click"}', _out(_EV, "iev", where="et <> 'click'"))
_promql("matcher_regex", 'event_value{event_type=~"c.*k|view"}', _out(_EV, "iev", where="et IN ('click', 'view')"))
_promql("matcher_nregex", 'event_value{event_type!~"c.*|v.*"}', _out(_EV, "iev", where="et NOT IN ('click', 'view')"))
_promql("matcher_empty", 'events_total{user_id="",shard!=""}', _out(_TOT, "itot"))
_promql("raw_range", 'events_total{shard="1"}[6h]', f"SELECT t AS step_ts, {_TOT} AS labels, round(v, 6) AS value FROM tot WHERE sh = '1' AND t BETWEEN {END - 21600} AND {END}", at=END)
_offset = f"(SELECT s, et, sh, arg_max(v, n) AS v FROM steps JOIN tot ON t + {DAY} BETWEEN s - {LOOKBACK} AND s GROUP BY s, et, sh)"
_promql("offset", "events_total offset 1d", _out(_TOT, _offset))
_promql("at_modifier", f"sum by (event_type) (events_total @ {T0 + 10 * DAY})", f"SELECT s AS step_ts, {_ET} AS labels, round(w, 6) AS value FROM steps, (SELECT et, sum(v) AS w FROM (SELECT et, sh, arg_max(v, n) AS v FROM tot WHERE t BETWEEN {T0 + 10 * DAY - LOOKBACK} AND {T0 + 10 * DAY} GROUP BY et, sh) GROUP BY et)")

# aggregations
for _op, _sql in {"sum": "sum(v)", "min": "min(v)", "max": "max(v)", "avg": "avg(v)", "count": "count(*)", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)", "group": "1"}.items():
    _promql(f"agg_{_op}_by" if _op == "sum" else f"agg_{_op}", f"{_op} by (event_type) (event_value)", f"SELECT s AS step_ts, {_ET} AS labels, round(({_sql})::DOUBLE, 6) AS value FROM iev GROUP BY s, et")
_promql("agg_sum_without", "sum without (user_id) (event_value)", _out(_ET, "sumev"))
_promql("agg_sum_all", "sum(event_value)", "SELECT s AS step_ts, '' AS labels, round(sum(v), 6) AS value FROM iev GROUP BY s")
_promql("agg_quantile", "quantile by (event_type) (0.9, event_value)", f"SELECT s AS step_ts, {_ET} AS labels, round(quantile_cont(v, 0.9), 6) AS value FROM iev GROUP BY s, et")
_promql("agg_count_values", 'count_values("v", floor(event_value / 100))', "SELECT s AS step_ts, 'v=' || floor(v / 100)::BIGINT AS labels, count(*)::DOUBLE AS value FROM iev GROUP BY s, floor(v / 100)::BIGINT")
for _op, _dir in (("topk", "DESC"), ("bottomk", "ASC")):
    _promql(_op, f"{_op}(3, events_total)", _out(_TOT, f"(SELECT *, row_number() OVER (PARTITION BY s ORDER BY v {_dir}, et, sh) AS r FROM itot)", where="r <= 3"))
    _promql(f"{_op}_by", f"{_op} by (event_type) (2, events_total)", _out(_TOT, f"(SELECT *, row_number() OVER (PARTITION BY s, et ORDER BY v {_dir}, sh) AS r FROM itot)", where="r <= 2"))

# scalars and comparisons
_promql("scalar_arith", "2 ^ 3 ^ 0 * events_total % 7 - -1 / 4", _out(_TOT_BARE, "itot", "fmod(2 * v, 7) + 0.25"))
_promql("scalar_only", "1 + 2 * 3 > bool 6", "SELECT s AS step_ts, '' AS labels, 1.0::DOUBLE AS value FROM steps")
_promql("divide_by_zero", "events_total / 0", _out(_TOT_BARE, "itot", "'Infinity'::DOUBLE"))
_promql("vector_scalar_cmp", "event_value > 100", _out(_EV, "iev", where="v > 100"))
_promql("vector_scalar_bool", "event_value > bool 100", _out(_EV_BARE, "iev", "CASE WHEN v > 100 THEN 1 ELSE 0 END"))
_promql("time_function", "time() - vector(0)", "SELECT s AS step_ts, '' AS labels, s::DOUBLE AS value FROM steps")
_promql("scalar_function", "events_total / scalar(sum(events_total))", _out(_TOT_BARE, "itot JOIN (SELECT s AS s2, sum(v) AS w FROM itot GROUP BY s) ON s = s2", "v / w"))
_promql("unary_neg", "-events_total", _out(_TOT_BARE, "itot", "-v"))

# vector matching
_pair = f"(SELECT a.s, a.et, a.sh, a.v AS v, b.v AS w FROM itot a JOIN {_offset} b ON a.s = b.s AND a.et = b.et AND a.sh = b.sh)"
_promql("vv_one_to_one", "events_total - events_total offset 1d", _out(_TOT_BARE, _pair, "v - w"))
_promql("vv_compare", "events_total > events_total offset 1d", _out(_TOT, _pair, where="v > w"))
_promql("vv_on", "sum by (event_type) (events_total) / on (event_type) sum by (event_type) (event_value)", _out(_ET, "(SELECT a.s, a.et, a.v / b.v AS v FROM sumtot a JOIN sumev b ON a.s = b.s AND a.et = b.et)"))
_promql("vv_ignoring", 'events_total{shard="0"} / ignoring (shard) sum by (event_type) (events_total)', _out(_ET, "(SELECT a.s, a.et, a.v / b.v AS v FROM itot a JOIN sumtot b ON a.s = b.s AND a.et = b.et WHERE sh = '0')"))
_share = "(SELECT a.s, a.et, a.sh, a.v / b.v AS v FROM itot a JOIN sumtot b ON a.s = b.s AND a.et = b.et)"
_promql("vv_group_left", "events_total / ignoring (shard) group_left sum by (event_type) (events_total)", _out(_TOT_BARE, _share))
_promql("vv_group_right", "sum by (event_type) (events_total) * on (event_type) group_right events_total", _out(_TOT_BARE, "(SELECT a.s, a.et, a.sh, a.v * b.v AS v FROM itot a JOIN sumtot b ON a.s = b.s AND a.et = b.et)"))
_promql("vv_include", 'events_total * on (event_type) group_left (unit) label_replace(sum by (event_type) (event_value), "unit", "$1", "event_type", "(.).*")', _out("'event_type=' || et || ',shard=' || sh || ',unit=' || left(et, 1)", "(SELECT a.s, a.et, a.sh, a.v * b.v AS v FROM itot a JOIN sumev b ON a.s = b.s AND a.et = b.et)"))

# set operators
_promql("set_and", 'events_total and on (event_type) event_value{user_id="7"}', _out(_TOT, "itot", where="EXISTS (FROM iev e WHERE e.s = itot.s AND e.et = itot.et AND uid = '7')"))
_promql("set_or", 'events_total{shard="0"} or ignoring (shard) events_total{event_type="click"}', _out(_TOT, "itot", where="sh = '0' OR (et = 'click' AND NOT EXISTS (FROM itot o WHERE o.s = itot.s AND o.et = itot.et AND o.sh = '0'))"))
_promql("set_unless", 'events_total unless on (event_type) event_value{user_id="7"}', _out(_TOT, "itot", where="NOT EXISTS (FROM iev e WHERE e.s = itot.s AND e.et = itot.et AND uid = '7')"))

# functions of vectors
for _f, _sql in {
    "abs": "abs(v - 100)", "ceil": "ceil(v - 100) + 0.0", "floor": "floor(v - 100)", "sgn": "sign(v - 100)", "exp": "exp((v - 100) / 100)", "sqrt": "CASE WHEN v < 100 THEN 'NaN'::DOUBLE ELSE sqrt(v - 100) END",
    "ln": "CASE WHEN v < 100 THEN 'NaN'::DOUBLE WHEN v = 100 THEN '-Infinity'::DOUBLE ELSE ln(v - 100) END", "log2": "CASE WHEN v < 100 THEN 'NaN'::DOUBLE WHEN v = 100 THEN '-Infinity'::DOUBLE ELSE log2(v - 100) END",
    "log10": "CASE WHEN v < 100 THEN 'NaN'::DOUBLE WHEN v = 100 THEN '-Infinity'::DOUBLE ELSE log10(v - 100) END",
    "sin": "sin(v - 100)", "cos": "cos(v - 100)", "tan": "tan(v - 100)", "atan": "atan(v - 100)", "deg": "degrees(v - 100)", "rad": "radians(v - 100)", "tanh": "tanh((v - 100) / 100)",
    "sinh": "sinh((v - 100) / 100)", "cosh": "cosh((v - 100) / 100)", "asinh": "asinh((v - 100) / 100)",
    "acos": "CASE WHEN abs((v - 100) / 100) > 1 THEN 'NaN'::DOUBLE ELSE acos(greatest(-1, least(1, (v - 100) / 100))) END", "asin": "CASE WHEN abs((v - 100) / 100) > 1 THEN 'NaN'::DOUBLE ELSE asin(greatest(-1, least(1, (v - 100) / 100))) END",
    "acosh": "CASE WHEN (v - 100) / 100 < 1 THEN 'NaN'::DOUBLE ELSE acosh(greatest(1, (v - 100) / 100)) END",
    "atanh": "CASE WHEN abs((v - 100) / 100) > 1 THEN 'NaN'::DOUBLE WHEN v = 200 THEN 'Infinity'::DOUBLE WHEN v = 0 THEN '-Infinity'::DOUBLE ELSE atanh(greatest(-0.999999999, least(0.999999999, (v - 100) / 100))) END",
}.items():
    _arg = "(event_value - 100) / 100" if "/ 100" in _sql else "event_value - 100"
    _promql(f"fn_{_f}", f"{_f}({_arg})", _out(_EV_BARE, "iev", _sql))
_promql("fn_round", "round(event_value, 5)", _out(_EV_BARE, "iev", "floor(v * 0.2 + 0.5) / 0.2"))
_promql("fn_clamp", "clamp(event_value, 10, 50)", _out(_EV_BARE, "iev", "least(greatest(v, 10), 50)"))
_promql("fn_clamp_min", "clamp_min(event_value, 10)", _out(_EV_BARE, "iev", "greatest(v, 10)"))
_promql("fn_clamp_max", "clamp_max(event_value, 50)", _out(_EV_BARE, "iev", "least(v, 50)"))
_promql("fn_timestamp", "timestamp(events_total)", _out(_TOT_BARE, "itot", "st"))
for _f, _sql in {"minute": "minute", "hour": "hour", "day_of_week": "dayofweek", "day_of_month": "day", "day_of_year": "dayofyear", "month": "month", "year": "year"}.items():
    _promql(f"fn_{_f}", f"{_f}(timestamp(events_total))", _out(_TOT_BARE, "itot", f"{_sql}(make_timestamp(st * 1000000))"))
_promql("fn_days_in_month", "days_in_month(timestamp(events_total))", _out(_TOT_BARE, "itot", "day(last_day(make_timestamp(st * 1000000)::DATE))"))
_promql("fn_sort", "sort(events_total)", _out(_TOT, "itot"), at=END)
_promql("fn_sort_desc", "sort_desc(events_total)", _out(_TOT, "itot"), at=END)
_promql("fn_label_replace", 'label_replace(events_total, "kind", "$1-x", "event_type", "(c).*")', _out("CASE WHEN et[1] = 'c' THEN '__name__=events_total,event_type=' || et || ',kind=c-x,shard=' || sh ELSE " + _TOT + " END", "itot"))
_promql("fn_label_join", 'label_join(events_total, "both", "/", "event_type", "shard")', _out("'__name__=events_total,both=' || et || '/' || sh || ',event_type=' || et || ',shard=' || sh", "itot"))
_promql("fn_absent", 'absent(nothing{job="a",env=~"b"})', "SELECT s AS step_ts, 'job=a' AS labels, 1.0::DOUBLE AS value FROM steps")
_promql("fn_absent_present", "absent(events_total)", "SELECT s AS step_ts, '' AS labels, 1.0::DOUBLE AS value FROM steps WHERE NOT EXISTS (FROM itot WHERE itot.s = steps.s)")

# functions of ranges
_windows = "(SELECT s, et, uid, t, n, v FROM steps JOIN ev ON t BETWEEN s - 172800 AND s)"
for _f, _sql in {
    "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "sum": "sum(v)", "count": "count(*)", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)", "last": "arg_max(v, n)", "present": "1", "quantile": "quantile_cont(v, 0.5)",
}.items():
    _names = _EV if _f == "last" else _EV_BARE
    _promql(f"fn_{_f}_over_time", f"{_f}_over_time({'0.5, ' if _f == 'quantile' else ''}event_value[2d])", f"SELECT s AS step_ts, {_names} AS labels, round(({_sql})::DOUBLE, 6) AS value FROM {_windows} GROUP BY s, et, uid")
_promql("fn_absent_over_time", 'absent_over_time(nothing{job="a"}[1d])', "SELECT s AS step_ts, 'job=a' AS labels, 1.0::DOUBLE AS value FROM steps")


def _rate(source: str, key: str, seconds: int, counter: bool, per_second: bool, labels: str) -> str:
    reset = "CASE WHEN v < pv THEN pv ELSE 0 END"
    change = f"arg_max(v, n) - arg_min(v, n) + {f'sum({reset}) - arg_min({reset}, n)' if counter else '0'}"
    zero = "CASE WHEN ch > 0 AND f >= 0 AND sp * (f / ch) < ts THEN sp * (f / ch) ELSE ts END" if counter else "ts"
    return f""", p AS (SELECT *, lag(v) OVER (PARTITION BY {key} ORDER BY n) AS pv FROM {source}),
w AS (SELECT s, {key}, count(*) AS c, arg_min(v, n) AS f, {change} AS ch, (max(t) - min(t))::DOUBLE AS sp, (min(t) - (s - {seconds}))::DOUBLE AS ts, (s - max(t))::DOUBLE AS te
  FROM steps JOIN p ON t BETWEEN s - {seconds} AND s GROUP BY s, {key} HAVING count(*) >= 2 AND max(t) > min(t)),
y AS (SELECT *, sp / (c - 1) AS ea, {zero} AS ts2 FROM w)
SELECT s AS step_ts, {labels} AS labels, round(ch * ((sp + CASE WHEN ts2 < ea * 1.1 THEN ts2 ELSE ea / 2 END + CASE WHEN te < ea * 1.1 THEN te ELSE ea / 2 END) / sp){f' / {seconds}.0' if per_second else ''}, 6) AS value FROM y"""


_promql("fn_rate", "rate(events_total[1d])", _rate("tot", "et, sh", DAY, True, True, _TOT_BARE))
_promql("fn_increase", "increase(events_daily_total[2d])", _rate("daily", "et", 2 * DAY, True, False, _ET))
_promql("fn_increase_fine", "increase(events_daily_total[2d])", _rate("daily", "et", 2 * DAY, True, False, _ET), step=DAY // 24)
_promql("fn_delta", "delta(event_value[2d])", _rate("ev", "et, uid", 2 * DAY, False, False, _EV_BARE))
_last2 = ", p AS (SELECT *, lag(v) OVER (PARTITION BY et ORDER BY n) AS pv, lag(t) OVER (PARTITION BY et ORDER BY n) AS pt FROM daily), w AS (SELECT s, et, arg_max(v, n) AS l, arg_max(pv, n) AS pl, max(t) AS t1, arg_max(pt, n) AS t0 FROM steps JOIN p ON t BETWEEN s - 86400 AND s GROUP BY s, et HAVING count(*) >= 2) "
_promql("fn_irate", "irate(events_daily_total[1d])", _last2 + _out(_ET, "w", "CASE WHEN l < pl THEN l ELSE l - pl END / (t1 - t0)", "t1 > t0"))
_promql("fn_idelta", "idelta(events_daily_total[1d])", _last2 + _out(_ET, "w", "l - pl", "t1 > t0"))
for _f, _test in (("changes", "v <> pv"), ("resets", "v < pv")):
    _case = f"CASE WHEN {_test} THEN 1 ELSE 0 END"
    _promql(f"fn_{_f}", f"{_f}(events_daily_total[2d])", f", p AS (SELECT *, lag(v) OVER (PARTITION BY et ORDER BY n) AS pv FROM daily) SELECT s AS step_ts, {_ET} AS labels, (sum({_case}) - arg_min({_case}, n))::DOUBLE AS value FROM steps JOIN p ON t BETWEEN s - 172800 AND s GROUP BY s, et")
_slope = "FROM steps JOIN tot ON t BETWEEN s - 172800 AND s GROUP BY s, et, sh HAVING count(*) >= 2 AND max(t) > min(t)"
_promql("fn_deriv", "deriv(events_total[2d]) * 1000", f"SELECT s AS step_ts, {_TOT_BARE} AS labels, round(regr_slope(v, (t - s)::DOUBLE) * 1000, 6) AS value {_slope}")
_promql("fn_predict_linear", "round(predict_linear(events_total[2d], 3600), 0.001)", f"SELECT s AS step_ts, {_TOT_BARE} AS labels, round(floor((regr_intercept(v, (t - s)::DOUBLE) + 3600 * regr_slope(v, (t - s)::DOUBLE)) * 1000 + 0.5) / 1000, 6) AS value {_slope}")
_sub = f"SELECT s, et, max(v) AS v FROM (SELECT steps.s, i.i, et, sum(v) AS v FROM steps JOIN (SELECT unnest(range({(START - 2 * DAY) // 21600 * 21600}, {END + 1}, 21600)) AS i) i ON i.i BETWEEN steps.s - 172800 AND steps.s JOIN (SELECT i, et, sh, arg_max(v, n) AS v FROM (SELECT unnest(range({(START - 2 * DAY) // 21600 * 21600}, {END + 1}, 21600)) AS i) JOIN tot ON t BETWEEN i - {LOOKBACK} AND i GROUP BY i, et, sh) x ON x.i = i.i GROUP BY ALL) GROUP BY s, et"
_promql("subquery", "max_over_time(sum by (event_type) (events_total)[2d:6h])", _out(_ET, f"({_sub})"))
_quantile = """, h AS (SELECT s, rf, le, ub, v, coalesce(lag(v) OVER w, 0) AS below, coalesce(lag(ub) OVER w, 0) AS lo, max(v) OVER (PARTITION BY s, rf) AS total FROM steps, hist WINDOW w AS (PARTITION BY s, rf ORDER BY ub)),
q AS (SELECT s, rf, min(ub) FILTER (WHERE v >= Q * total) AS b FROM h WHERE ub < 1e300 GROUP BY s, rf)
SELECT h.s AS step_ts, 'returnflag=' || h.rf AS labels, round(CASE WHEN b IS NULL THEN 50 ELSE lo + (ub - lo) * ((Q * total - below) / (v - below)) END, 6) AS value
FROM h JOIN q ON h.s = q.s AND h.rf = q.rf AND ub = coalesce(b, 50)"""
_promql("fn_histogram_quantile", "histogram_quantile(0.5, quantity_bucket)", _quantile.replace("Q", "0.5"), at=HISTOGRAM_AT)
_promql("fn_histogram_quantile_by", "histogram_quantile(0.95, sum by (le, returnflag) (quantity_bucket))", _quantile.replace("Q", "0.95"), at=HISTOGRAM_AT)


def _query(name: str, sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


# catalogues
@_query("label_names", "SELECT * FROM (VALUES ('__name__'), ('event_type'), ('le'), ('returnflag'), ('shard'), ('user_id')) x(label)")
def _label_names(spark, sf_dir):
    return api.labels(api.Telemetry(testdata.samples(spark, sf_dir)))


@_query("label_names_match", "SELECT * FROM (VALUES ('__name__'), ('event_type'), ('shard')) x(label)")
def _label_names_match(spark, sf_dir):
    return api.labels(api.Telemetry(testdata.samples(spark, sf_dir)), ['events_total{shard=~"0|1"}', "events_daily_total"])


@_query("label_values", "SELECT DISTINCT user_id::VARCHAR AS value FROM events WHERE event_type = 'click'")
def _label_values(spark, sf_dir):
    return api.label_values(api.Telemetry(testdata.samples(spark, sf_dir)), "user_id", ['event_value{event_type="click"}'])


@_query("series", "SELECT DISTINCT '__name__=events_total,event_type=' || event_type || ',shard=' || (user_id % 4) AS labels FROM events")
def _series(spark, sf_dir):
    return api.series(api.Telemetry(testdata.samples(spark, sf_dir)), ["events_total", 'events_total{shard="1"}']).select(L.shown(F.col("labels")).alias("labels"))


def _metadata_rows(spark, sf_dir):
    """Metadata as two exporters would write it: a metric for each event type, a service for each remainder of users."""
    e = testdata.read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "Gauge").when(F.col("event_type") == "view", "Sum").otherwise("Histogram")
    return e.select(F.concat(F.lit("app_"), F.col("event_type")).alias("metric"), F.concat(F.lit("svc"), F.pmod("user_id", F.lit(2))).alias("service_name"), kind.alias("type"), F.lit("help").alias("description"), F.lit("1").alias("unit"))


@_query("metric_metadata", "SELECT 'app_' || event_type AS metric, CASE event_type WHEN 'click' THEN 'gauge' WHEN 'view' THEN 'counter' ELSE 'histogram' END AS type, 'help' AS help, count(DISTINCT user_id % 2) AS entries FROM events GROUP BY event_type")
def _metric_metadata(spark, sf_dir):
    found = api.metadata(api.Telemetry(metric_metadata=_metadata_rows(spark, sf_dir)))
    return found.select("metric", F.explode("entries").alias("e")).groupBy("metric", "e.type", "e.help").agg(F.count("*").alias("entries"))


@_query("metric_names", "SELECT DISTINCT 'app_' || event_type AS metric FROM events")
def _metric_names(spark, sf_dir):
    return catalog.metric_names(_metadata_rows(spark, sf_dir))


# spans and traces
_SPANS = """WITH spans AS (
SELECT o_orderkey::VARCHAR AS trace_id, o_orderkey || '-0' AS span_id, 'order' AS op, '' AS parent, 'orders' AS svc, 'orders' AS process, epoch(o_orderdate)::BIGINT * 1000000000 AS start, 1000000000::BIGINT AS dur, 1 AS status, NULL AS rf, o_orderpriority AS prio FROM orders
UNION ALL SELECT l_orderkey::VARCHAR, l_orderkey || '-' || l_linenumber, p_type, l_orderkey || '-0', n_name, s_suppkey::VARCHAR, epoch(l_shipdate)::BIGINT * 1000000000, (l_quantity * 1000000)::BIGINT, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END, l_returnflag, NULL
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)
"""
_SPAN_ROW = "SELECT trace_id, span_id, op AS operation_name, svc AS service_name, start AS start_time_unix_nano, dur AS duration_nanoseconds FROM spans WHERE "


def _telemetry(spark, sf_dir):
    rows = testdata.spans(spark, sf_dir)
    return api.Telemetry(spans=rows, span_metadata=catalog.span_metadata(rows))


def _found(q: traces.TraceQuery):
    def run(spark, sf_dir):
        rows = traces.find_spans(testdata.spans(spark, sf_dir), q)
        return rows.select("trace_id", "span_id", F.col("span_name").alias("operation_name"), F.col("resource.service_name").alias("service_name"), "start_time_unix_nano", "duration_nanoseconds")

    return run


_Y1996, _Y1997 = 820454400 * 10**9, 852076800 * 10**9
_query("find_spans_service", _SPANS + _SPAN_ROW + "svc = 'NATION_3' AND op = 'ECONOMY'")(_found(traces.TraceQuery(service="NATION_3", operation="ECONOMY")))
_query("find_spans_time", _SPANS + _SPAN_ROW + f"start BETWEEN {_Y1996} AND {_Y1997}")(_found(traces.TraceQuery(start_min=_Y1996, start_max=_Y1997)))
_query("find_spans_duration", _SPANS + _SPAN_ROW + "dur BETWEEN 10000000 AND 12000000")(_found(traces.TraceQuery(duration_min=10_000_000, duration_max=12_000_000)))
_query("find_spans_tags", _SPANS + _SPAN_ROW + "rf = 'R' AND process = '3'")(_found(traces.TraceQuery(tags={"returnflag": "R", "supplier": "3"})))


@_query("services", _SPANS + "SELECT DISTINCT svc AS service_name FROM spans")
def _services(spark, sf_dir):
    return api.services(_telemetry(spark, sf_dir))


@_query("operations", _SPANS + "SELECT DISTINCT op AS operation_name FROM spans WHERE svc = 'NATION_3'")
def _operations(spark, sf_dir):
    return api.operations(_telemetry(spark, sf_dir), "NATION_3")


def _summary(found: DataFrame) -> DataFrame:
    """Flat facts of assembled traces."""
    s = F.col("spans")
    errors = F.size(F.filter(s, lambda x: F.exists(x["tags"], lambda t: t["key"] == "error")))
    children = F.size(F.filter(s, lambda x: F.size(x["references"]) > 0))
    duration = F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + x["duration"])
    return found.select("trace_id", F.size(s).cast("bigint").alias("n_spans"), F.size("processes").cast("bigint").alias("n_processes"), errors.cast("bigint").alias("n_errors"), children.cast("bigint").alias("n_children"), F.get(s, F.lit(0))["start_time"].alias("first_start"), duration.alias("duration_us"))


_TRACE_ROW = "count(*) AS n_spans, count(DISTINCT process) AS n_processes, count(*) FILTER (WHERE status = 2) AS n_errors, count(*) FILTER (WHERE parent <> '') AS n_children, min(start) // 1000 AS first_start, sum(dur // 1000)::BIGINT AS duration_us"


@_query("trace_assembly", _SPANS + f"SELECT trace_id, {_TRACE_ROW} FROM spans GROUP BY trace_id")
def _trace_assembly(spark, sf_dir):
    return _summary(traces.assemble(testdata.spans(spark, sf_dir)))


@_query("find_traces", _SPANS + f", top AS (SELECT trace_id FROM spans WHERE rf = 'R' GROUP BY trace_id ORDER BY max(start) DESC, trace_id LIMIT 20) SELECT trace_id, {_TRACE_ROW} FROM spans WHERE rf = 'R' AND trace_id IN (FROM top) GROUP BY trace_id")
def _find_traces(spark, sf_dir):
    return _summary(api.find_traces(_telemetry(spark, sf_dir), tags='{"returnflag": "R"}', limit=20))


@_query("find_whole_traces", _SPANS + f", top AS (SELECT trace_id FROM spans WHERE rf = 'R' GROUP BY trace_id ORDER BY max(start) DESC, trace_id LIMIT 20) SELECT trace_id, {_TRACE_ROW} FROM spans WHERE trace_id IN (FROM top) GROUP BY trace_id")
def _find_whole_traces(spark, sf_dir):
    return _summary(api.find_traces(_telemetry(spark, sf_dir), tags='{"returnflag": "R"}', limit=20, whole_trace=True))


@_query("trace_by_id", _SPANS + f"SELECT trace_id, {_TRACE_ROW} FROM spans WHERE trace_id = '7' GROUP BY trace_id")
def _trace_by_id(spark, sf_dir):
    return _summary(api.get_trace(_telemetry(spark, sf_dir), "7"))


@_query("topology", _SPANS + "SELECT p.svc AS parent, c.svc AS child, count(*) AS calls FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent = p.span_id WHERE c.parent <> '' AND p.svc <> c.svc GROUP BY ALL")
def _topology(spark, sf_dir):
    return traces.service_edges(testdata.spans(spark, sf_dir))


@_query("red_metrics", _SPANS + "SELECT (start // 86400000000000) * 86400 AS window_start, svc AS service_name, op AS operation_name, count(*) AS requests, count(*) FILTER (WHERE status = 2) AS errors, sum(dur)::BIGINT AS duration_sum, max(dur) AS duration_max FROM spans GROUP BY ALL")
def _red_metrics(spark, sf_dir):
    return traces.red_metrics(testdata.spans(spark, sf_dir), "1 day")


# normalisation of OpenTelemetry messages, written as JSON texts from the events
def _texts(spark, sf_dir, data: str, *columns) -> DataFrame:
    """(value) the text of one message for each event: data is the metric's JSON with %s for the columns."""
    head = '{"resourceMetrics":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"shop"}}]},"scopeMetrics":[{"metrics":['
    e = testdata.read(spark, sf_dir, "events").withColumn("nano", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string"))
    text = F.format_string(head.replace("%", "%%") + data + "]}]}]}", *columns)
    return e.select(text.alias("value"))


def _messages(spark, sf_dir, data: str, *columns) -> DataFrame:
    return _texts(spark, sf_dir, data, *columns).select(F.from_json("value", otlp.METRICS_SCHEMA).alias("m")).select("m.*")


def _normalised(rows: DataFrame) -> DataFrame:
    return otlp.points(rows).select(L.shown(F.col("labels")).alias("labels"), "type", "ts_nano", F.round("value", 6).alias("value"))


_POINT = '"attributes":[{"key":"event.type","value":{"stringValue":"%s"}},{"key":"user","value":{"intValue":"%d"}}],"timeUnixNano":"%s"'
_KEYS = ("event_type", "user_id", "nano")
_OTLP = "SELECT {labels} AS labels, '{type}' AS type, epoch_us(ts) * 1000 AS ts_nano, round(({value})::DOUBLE, 6) AS value FROM events"


def _labels_sql(name: str, extra: str = "") -> str:
    return f"'__name__={name},event_type=' || event_type || '{extra},service_name=shop,user=' || user_id"


@_query("otlp_gauge", _OTLP.format(labels=_labels_sql("event_value_milliseconds"), type="Gauge", value="value"))
def _otlp_gauge(spark, sf_dir):
    return _normalised(_messages(spark, sf_dir, '{"name":"event.value","unit":"ms","gauge":{"dataPoints":[{' + _POINT + ',"asDouble":%s}]}}', *_KEYS, F.col("value").cast("string")))


@_query("otlp_sum", _OTLP.format(labels=_labels_sql("requests_per_second_total"), type="Sum", value="event_id"))
def _otlp_sum(spark, sf_dir):
    return _normalised(_messages(spark, sf_dir, '{"name":"requests","unit":"{request}/s","sum":{"dataPoints":[{' + _POINT + ',"asInt":"%d"}]}}', *_KEYS, "event_id"))


def _union(parts: list[tuple[str, str]], kind: str) -> str:
    return " UNION ALL ".join(_OTLP.format(labels=labels, type=kind, value=value) for labels, value in parts)


@_query("otlp_histogram", _union([(_labels_sql("latency_seconds_sum"), "value"), (_labels_sql("latency_seconds_count"), "6"), (_labels_sql("latency_seconds_bucket", ",le=0.5"), "1"), (_labels_sql("latency_seconds_bucket", ",le=10"), "3"), (_labels_sql("latency_seconds_bucket", ",le=+Inf"), "6")], "Histogram"))
def _otlp_histogram(spark, sf_dir):
    return _normalised(_messages(spark, sf_dir, '{"name":"latency","unit":"s","histogram":{"dataPoints":[{' + _POINT + ',"sum":%s,"count":"6","explicitBounds":[0.5,10],"bucketCounts":["1","2","3"]}]}}', *_KEYS, F.col("value").cast("string")))


_EXP = [("-2", "3"), ("-1", "5"), ("0", "6"), ("2", "8"), ("+Inf", "12")]


@_query("otlp_exphistogram", _union([(_labels_sql("size_bytes_sum"), "value"), (_labels_sql("size_bytes_count"), "12"), *[(_labels_sql("size_bytes_bucket", f",le={le}"), v) for le, v in _EXP]], "ExponentialHistogram"))
def _otlp_exphistogram(spark, sf_dir):
    return _normalised(_messages(spark, sf_dir, '{"name":"size","unit":"By","exponentialHistogram":{"dataPoints":[{' + _POINT + ',"sum":%s,"count":"12","scale":0,"zeroCount":"1","positive":{"offset":0,"bucketCounts":["2","4"]},"negative":{"offset":0,"bucketCounts":["2","3"]}}]}}', *_KEYS, F.col("value").cast("string")))


@_query("otlp_summary", _union([(_labels_sql("wait_sum"), "value"), (_labels_sql("wait_count"), "4"), ("'__name__=wait_quantile,event_type=' || event_type || ',quantile=0.5,service_name=shop,user=' || user_id", "value / 2"), ("'__name__=wait_quantile,event_type=' || event_type || ',quantile=1,service_name=shop,user=' || user_id", "value")], "Summary"))
def _otlp_summary(spark, sf_dir):
    half, whole = (F.col("value") / 2).cast("string"), F.col("value").cast("string")
    return _normalised(_messages(spark, sf_dir, '{"name":"wait","unit":"1","summary":{"dataPoints":[{' + _POINT + ',"sum":%s,"count":"4","quantileValues":[{"quantile":0.5,"value":%s},{"quantile":1,"value":%s}]}]}}', *_KEYS, whole, half, whole))


@_query("otlp_metadata", "SELECT DISTINCT * FROM (VALUES ('latency_seconds_sum', 'shop', 'Histogram', 's'), ('latency_seconds_count', 'shop', 'Histogram', '1'), ('latency_seconds_bucket', 'shop', 'Histogram', 's')) x(metric, service_name, type, unit)")
def _otlp_metadata(spark, sf_dir):
    rows = _messages(spark, sf_dir, '{"name":"latency","unit":"s","histogram":{"dataPoints":[{' + _POINT + ',"sum":1,"count":"1"}]}}', *_KEYS)
    return otlp.metric_metadata(rows).select("metric", "service_name", "type", "unit").distinct()


_EVENT_SPANS = "SELECT lower(printf('%016x', event_id + 1)) AS trace_id, lower(printf('%016x', event_id)) AS span_id, event_type AS span_name, epoch_us(ts) * 1000 AS start_time_unix_nano, 5000::BIGINT AS duration_nanoseconds, 'shop' AS service_name, 'True' AS flag FROM events"


def _event_spans(spark, sf_dir) -> DataFrame:
    text = '{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"shop"}}]},"scopeSpans":[{"spans":[{"traceId":"%032X","spanId":"%016X","name":"%s","kind":2,"startTimeUnixNano":"%s","endTimeUnixNano":"%s","attributes":[{"key":"ok","value":{"boolValue":true}}]}]}]}]}'
    e = testdata.read(spark, sf_dir, "events").withColumn("nano", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    rows = e.select(F.from_json(F.format_string(text, F.col("event_id") + 1, "event_id", "event_type", F.col("nano").cast("string"), (F.col("nano") + 5000).cast("string")), otlp.TRACES_SCHEMA).alias("m")).select("m.*")
    return otlp.spans(rows)


def _flat(spans: DataFrame) -> DataFrame:
    return spans.select("trace_id", "span_id", "span_name", "start_time_unix_nano", "duration_nanoseconds", F.col("resource.service_name").alias("service_name"), F.col("attributes")[0]["value"].alias("flag"))


@_query("otlp_spans", _EVENT_SPANS)
def _otlp_spans(spark, sf_dir):
    return _flat(_event_spans(spark, sf_dir))


# the store and continuous ingest, in a folder that goes when the application ends
def _folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.gettempdir()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{found.rstrip('/')}/sparkscope-store-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)  # only what is there can be marked
    files.deleteOnExit(path)
    return str(path)


def _streamed(spark: SparkSession, sf_dir: str) -> Store:
    """A store that has taken in a gauge of every event as files of messages; every seventh has no value."""
    root = _folder(spark)
    value = F.when(F.col("event_id") % 7 != 0, F.col("value").cast("string")).otherwise("null")
    texts = _texts(spark, sf_dir, '{"name":"event.value","unit":"ms","gauge":{"dataPoints":[{' + _POINT + ',"asDouble":%s}]}}', *_KEYS, value)
    texts.repartition(4).write.text(f"{root}/in")
    store = Store(spark, f"{root}/store")
    ingest.ingest_metrics(ingest.messages(spark, f"{root}/in", otlp.METRICS_SCHEMA), store, f"{root}/progress").awaitTermination()
    return store


@_query("stream_ingest", "SELECT " + _labels_sql("event_value_milliseconds") + " AS labels, epoch_us(ts) * 1000 AS ts_nano, round(value::DOUBLE, 6) AS value FROM events WHERE event_id % 7 <> 0")
def _stream_ingest(spark, sf_dir):
    return _streamed(spark, sf_dir).metrics().select(L.shown(F.col("labels")).alias("labels"), "ts_nano", F.round("value", 6).alias("value"))


@_query("stream_rejected", "SELECT 'no value' AS reason, epoch_us(ts) * 1000 AS ts_nano FROM events WHERE event_id % 7 = 0")
def _stream_rejected(spark, sf_dir):
    return _streamed(spark, sf_dir).rejected().select("reason", F.get_json_object("row", "$.ts_nano").cast("bigint").alias("ts_nano"))


@_query("store_spans", _EVENT_SPANS)
def _store_spans(spark, sf_dir):
    store, spans = Store(spark, _folder(spark)), _event_spans(spark, sf_dir)
    for _ in range(2):  # the second try of a batch replaces the first
        store.write_spans(spans, "batch")
    return _flat(store.spans())


#: The flagship: request rate of each event type.
FLAGSHIP = "sum by (event_type) (rate(events_total[1d]))"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(api.query_range(api.Telemetry(testdata.samples(spark, sf_dir)), FLAGSHIP, T0 + DAY, T0 + 29 * DAY, DAY, Options(lookback=LOOKBACK)))


QUERIES["flagship"] = flagship
_flagship_sql = _rate("tot", "et, sh", DAY, True, True, _ET).replace(", 6) AS value FROM y", ", 12) AS value FROM y")
ORACLES["flagship"] = _TABLES.replace("STEPS", f"(SELECT unnest(range({T0 + DAY}, {T0 + 29 * DAY + 1}, {DAY})))") + _flagship_sql.replace("SELECT s AS step_ts", "SELECT step_ts, labels, round(sum(value), 6) AS value FROM (SELECT s AS step_ts") + ") GROUP BY step_ts, labels"
