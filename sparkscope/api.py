"""The query surface: metric queries, catalogues and trace search as Python functions, and their JSON forms."""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope.functions import labels as L
from sparkscope.operators import catalog, traces
from sparkscope.operators.grid import Grid
from sparkscope.plans.ast import MATRIX, SCALAR, STRING, Matcher, Paren, QueryError, Range, Selector
from sparkscope.plans.parser import parse
from sparkscope.plans.planner import Options, Planner, TooManySamples, whole

MOST_POINTS = 11_000
_UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 31536000}


def api_duration(text: str | float) -> float:
    """Seconds of an API duration: a number of seconds, or an integer with a unit."""
    if isinstance(text, (int, float)):
        return float(text)
    if found := re.fullmatch(r"([0-9]+)(ms|[smhdwy])", text.strip()):
        return int(found[1]) * _UNITS[found[2]]
    try:
        value = float(text)
    except ValueError:
        raise QueryError(f"bad duration {text!r}") from None
    if not math.isfinite(value):
        raise QueryError(f"bad duration {text!r}")
    return value


@dataclass
class Telemetry:
    """What is queried: samples, spans and metadata, each a DataFrame."""

    samples: DataFrame | None = None
    spans: DataFrame | None = None
    metric_metadata: DataFrame | None = None
    span_metadata: DataFrame | None = None

    @classmethod
    def of_store(cls, store) -> Telemetry:
        return cls(store.samples(), store.spans(), store.metric_metadata(), store.span_metadata())


def query_instant(data: Telemetry, query: str, at: float, options: Options | None = None, limit: int | None = None) -> DataFrame:
    """Rows (step_ts, labels, value) of a query at one time; a range selector alone gives its raw samples, step_ts theirs."""
    node = parse(query)
    planner = Planner(data.samples, options)
    bare = node
    while isinstance(bare, Paren):
        bare = bare.inner
    if isinstance(bare, Range):
        return planner.raw(bare, int(at)).select(F.col("ts").alias("step_ts"), "labels", "value")
    if node.type() == STRING:
        return data.samples.sparkSession.createDataFrame([], f"step_ts long, labels {L.TYPE}, value double")
    if node.type() == MATRIX:
        raise QueryError("only a plain range selector can be a result")
    return _limited(planner.plan(node, Grid(int(at), int(at))), limit)


def query_range(data: Telemetry, query: str, start: float, end: float, step: str | float, options: Options | None = None, limit: int | None = None) -> DataFrame:
    """Rows (step_ts, labels, value) of a query at every step."""
    seconds = api_duration(step)
    if seconds <= 0:
        raise QueryError("zero or negative query resolution step widths are not accepted")
    if end < start:
        raise QueryError("end timestamp must not be before start time")
    if (end - start) / seconds > MOST_POINTS:
        raise QueryError(f"exceeded maximum resolution of {MOST_POINTS} points per timeseries")
    node = parse(query)
    if node.type() in (MATRIX, STRING):
        raise QueryError(f"invalid expression type {node.type()!r} for a range query")
    return _limited(Planner(data.samples, options).plan(node, Grid(int(start), int(end), whole(seconds, "a step"))), limit)


def _limited(rows: DataFrame, limit: int | None) -> DataFrame:
    """The rows of the first `limit` series, all their points; None or 0 for all."""
    if not limit:
        return rows
    first = rows.select("labels").distinct().orderBy("labels").limit(limit)
    return rows.join(first, "labels", "left_semi").select("step_ts", "labels", "value")


def matchers(query: str) -> list[Matcher]:
    node = parse(query)
    if not isinstance(node, Selector):
        raise QueryError("expected a plain selector")
    return node.matchers


def series(data: Telemetry, match: list[str], start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
    if not match:
        raise QueryError("no match[] parameter provided")
    return catalog.series(data.samples, [matchers(m) for m in match], start, end, limit)


def labels(data: Telemetry, match: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    return catalog.label_names(data.samples, [matchers(m) for m in match or []], start, end)


def label_values(data: Telemetry, label: str, match: list[str] | None = None, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
    return catalog.label_values(data.samples, L.check_name(label), [matchers(m) for m in match or []], start, end, limit)


def metadata(data: Telemetry, metric: str | None = None, limit: int | None = None) -> DataFrame:
    return catalog.metric_metadata(data.metric_metadata, metric, limit)


def services(data: Telemetry) -> DataFrame:
    return catalog.services(data.span_metadata)


def operations(data: Telemetry, service: str) -> DataFrame:
    return catalog.operations(data.span_metadata, service)


def find_traces(data: Telemetry, service: str | None = None, operation: str | None = None, tags: str | None = None, start: int | None = None, end: int | None = None, lookback: str | None = None, min_duration: str | None = None, max_duration: str | None = None, limit: int = 20, trace_ids: list[str] | None = None, whole_trace: bool = False, now: float | None = None) -> DataFrame:
    """Traces (trace_id, spans, processes). start and end in microseconds; lookback counts back from now and replaces them."""
    low, high = (None if x is None else int(x) * 1000 for x in (start, end))
    if lookback and lookback != "custom":
        high = int((time.time() if now is None else now) * 1_000_000_000)
        low = high - traces.nanoseconds(lookback)
    if trace_ids:
        return traces.assemble(traces.trace_spans(data.spans, trace_ids, low, high))
    q = traces.TraceQuery(service, operation, traces.tags_from_json(tags), low, high, traces.nanoseconds(min_duration) if min_duration else None, traces.nanoseconds(max_duration) if max_duration else None, limit, whole_trace)
    return traces.assemble(traces.find_trace_spans(data.spans, q))


def get_trace(data: Telemetry, trace_id: str, start: int | None = None, end: int | None = None) -> DataFrame:
    low, high = (None if x is None else int(x) * 1000 for x in (start, end))
    return traces.assemble(traces.trace_spans(data.spans, [trace_id], low, high))


def build_info() -> dict:
    return {"status": "success", "data": {"version": "2.45.0", "application": "sparkscope"}}


# rendering: collects a result, which an API answer does anyway


def number_text(x: float) -> str:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    return repr(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _metric(entries) -> dict[str, str]:
    return {e["name"]: e["value"] for e in entries}


def answer(data: Telemetry, query: str, at: float | None = None, start: float | None = None, end: float | None = None, step: str | float | None = None, options: Options | None = None, timeout: str | float | None = None) -> dict:
    """The JSON-shaped answer of an instant query (at) or a range query; errors become an error envelope.

    timeout: after so long the query's jobs are cancelled and the answer is an error.
    """
    spark = data.samples.sparkSession
    try:
        node = parse(query)
        if at is not None and node.type() == STRING:
            return {"status": "success", "data": {"resultType": "string", "result": [at, node.value]}}
        rows = query_instant(data, query, at, options) if at is not None else query_range(data, query, start, end, step, options)
        ordered = query.strip().startswith("sort")
        found = _collected(spark, rows if ordered else rows.orderBy("labels", "step_ts"), timeout)
        point = lambda r: [r["step_ts"], number_text(r["value"])]
        if at is not None and node.type() == SCALAR:
            return {"status": "success", "data": {"resultType": "scalar", "result": point(found[0])}}
        if at is not None and node.type() != MATRIX:
            return {"status": "success", "data": {"resultType": "vector", "result": [{"metric": _metric(r["labels"]), "value": point(r)} for r in found]}}
        lines: dict[str, dict] = {}
        for r in found:
            metric = _metric(r["labels"])
            lines.setdefault(json.dumps(metric, sort_keys=True), {"metric": metric, "values": []})["values"].append(point(r))
        return {"status": "success", "data": {"resultType": "matrix", "result": list(lines.values())}}
    except (QueryError, ValueError) as e:
        return {"status": "error", "errorType": "bad_data", "error": str(e)}
    except TooManySamples as e:
        return {"status": "error", "errorType": "execution", "error": str(e)}
    except TimeoutError as e:
        return {"status": "error", "errorType": "timeout", "error": str(e)}


def _collected(spark: SparkSession, rows: DataFrame, timeout: str | float | None) -> list:
    if timeout is None:
        return rows.collect()
    import threading

    tag = f"sparkscope-{uuid.uuid4().hex}"
    over = threading.Event()

    def stop() -> None:
        over.set()
        spark.interruptTag(tag)

    timer = threading.Timer(api_duration(timeout), stop)
    spark.addTag(tag)
    timer.start()
    try:
        return rows.collect()
    except Exception as e:
        if over.is_set():
            raise TimeoutError("query timed out") from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)
