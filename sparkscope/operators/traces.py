"""Search of spans, and their assembly into traces.

Spans are nested rows (sources.schemas.SPAN_TYPE), so attributes, events and links need no joins.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.plans.ast import QueryError

_UNITS = {"d": 86_400_000_000_000, "h": 3_600_000_000_000, "m": 60_000_000_000, "s": 1_000_000_000, "ms": 1_000_000, "us": 1000, "μs": 1000, "µs": 1000}


def nanoseconds(text: str) -> int:
    """Nanoseconds of a duration like 1.5s, 100ms or 20us."""
    found = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*(ms|us|μs|µs|d|h|m|s)\s*", text)
    if not found:
        raise QueryError(f"bad duration {text!r}")
    return int(float(found[1]) * _UNITS[found[2]])


def tags_from_json(text: str | None) -> dict[str, str]:
    """Tags of a JSON object; booleans as attributes store them."""
    show = lambda v: ("True" if v else "False") if isinstance(v, bool) else v if isinstance(v, str) else json.dumps(v)
    return {k: show(v) for k, v in json.loads(text).items()} if text else {}


@dataclass
class TraceQuery:
    """Conditions on spans, all of which must hold; times in nanoseconds, bounds included. limit: traces, 0 for all."""

    service: str | None = None
    operation: str | None = None
    tags: dict[str, str] = field(default_factory=dict)
    start_min: int | None = None
    start_max: int | None = None
    duration_min: int | None = None
    duration_max: int | None = None
    limit: int = 20
    whole_trace: bool = False


def has_tag(key: str, value: str) -> Column:
    """Whether the span or its resource has an attribute of that key and text."""
    test = lambda a: (a["key"] == key) & (a["value"] == value)
    own = F.coalesce(F.exists("attributes", test), F.lit(False))
    return own | F.coalesce(F.exists(F.col("resource.attributes"), test), F.lit(False))


def find_spans(spans: DataFrame, q: TraceQuery) -> DataFrame:
    """The spans that a query matches. Bounds on the start prune partitions and row groups."""
    out = spans
    for column, low, high in (("start_time_unix_nano", q.start_min, q.start_max), ("duration_nanoseconds", q.duration_min, q.duration_max)):
        out = out if low is None else out.where(F.col(column) >= low)
        out = out if high is None else out.where(F.col(column) <= high)
    if q.start_min is not None and "date" in spans.columns:
        out = out.where(F.col("date") >= F.to_date(F.timestamp_seconds(F.lit(q.start_min // 1_000_000_000))))
    if q.start_max is not None and "date" in spans.columns:
        out = out.where(F.col("date") <= F.to_date(F.timestamp_seconds(F.lit(q.start_max // 1_000_000_000))))
    if (q.service or "").strip():
        out = out.where(F.col("resource.service_name") == q.service)
    if (q.operation or "").strip():
        out = out.where(F.col("span_name") == q.operation)
    for k, v in q.tags.items():
        out = out.where(has_tag(k, v))
    return out


def find_trace_spans(spans: DataFrame, q: TraceQuery) -> DataFrame:
    """The matching spans of the latest `limit` traces, or, with whole_trace, all spans of those traces."""
    found = find_spans(spans, q)
    if not q.limit and not q.whole_trace:
        return found
    latest = found.groupBy("trace_id").agg(F.max("start_time_unix_nano").alias("latest"))
    if q.limit:
        latest = latest.orderBy(F.desc("latest"), "trace_id").limit(q.limit)
    return (spans if q.whole_trace else found).join(latest.select("trace_id"), "trace_id", "left_semi")


def trace_spans(spans: DataFrame, trace_ids: list[str], start_min: int | None = None, start_max: int | None = None) -> DataFrame:
    return find_spans(spans.where(F.col("trace_id").isin(trace_ids)), TraceQuery(start_min=start_min, start_max=start_max))


KINDS = {1: "internal", 2: "server", 3: "client", 4: "producer", 5: "consumer"}
_TAG_TYPES = {1: "string", 2: "bool", 3: "int64", 4: "float64"}
ERROR = 2


def _tag(key: str, kind: str, value: str) -> Column:
    return F.struct(F.lit(key).alias("key"), F.lit(kind).alias("type"), F.lit(value).alias("value"))


def _tags(attributes: Column) -> Column:
    def kind(t: Column) -> Column:
        out = None
        for n, name in _TAG_TYPES.items():
            out = F.when(t == n, name) if out is None else out.when(t == n, name)
        return out.otherwise("string")

    return F.transform(F.coalesce(attributes, F.array().cast("array<struct<key:string,value_type:tinyint,value:string>>")), lambda a: F.struct(a["key"].alias("key"), kind(a["value_type"]).alias("type"), a["value"].alias("value")))


def process_id() -> Column:
    """Instance id of the resource or, where that is blank, the service's name."""
    instance = F.trim(F.coalesce(F.col("resource.service_instance_id"), F.lit("")))
    return F.when(instance != "", F.col("resource.service_instance_id")).otherwise(F.col("resource.service_name"))


def presented(spans: DataFrame) -> DataFrame:
    """Spans as an API shows them: microseconds, references, synthetic tags first, logs."""
    kind = None
    for n, name in KINDS.items():
        here = F.array(_tag("span.kind", "string", name))
        kind = F.when(F.col("span_kind") == n, here) if kind is None else kind.when(F.col("span_kind") == n, here)
    none = F.array().cast("array<struct<key:string,type:string,value:string>>")
    error = F.when(F.col("status_code") == ERROR, F.array(_tag("error", "bool", "true"))).otherwise(none)
    parent = F.trim(F.coalesce("parent_span_id", F.lit("")))
    reference = F.struct(F.lit("CHILD_OF").alias("ref_type"), F.col("trace_id").alias("trace_id"), F.col("parent_span_id").alias("span_id"))
    references = F.when(parent != "", F.array(reference)).otherwise(F.array().cast("array<struct<ref_type:string,trace_id:string,span_id:string>>"))
    micro = lambda c: F.floor(c / F.lit(1000)).cast("bigint")
    logs = F.transform("events", lambda e: F.struct(micro(e["timestamp_unix_nano"]).alias("timestamp"), _tags(e["attributes"]).alias("fields")))
    return spans.select(
        "trace_id", "span_id", "parent_span_id", F.col("span_name").alias("operation_name"), F.col("trace_flags").alias("flags"), references.alias("references"),
        micro(F.col("start_time_unix_nano")).alias("start_time"), micro(F.col("duration_nanoseconds")).alias("duration"),
        F.concat(error, F.coalesce(kind, none), _tags(F.col("attributes"))).alias("tags"), logs.alias("logs"), process_id().alias("process_id"),
        F.col("resource.service_name").alias("service_name"), _tags(F.col("resource.attributes")).alias("process_tags"), "start_time_unix_nano",
    )


def assemble(spans: DataFrame) -> DataFrame:
    """(trace_id, spans array by start, processes array): one row for each trace; of a process the earliest span's tags."""
    rows = presented(spans)
    shown = [c for c in rows.columns if c not in ("service_name", "process_tags", "start_time_unix_nano")]
    each = F.struct("start_time_unix_nano", "span_id", F.struct(*shown).alias("span"))
    # one row for each process first, so that a trace gathers its processes, not each span's copy of them
    process = F.struct("service_name", F.col("process_tags").alias("tags"))
    first = rows.groupBy("trace_id", "process_id").agg(F.min_by(process, F.struct("start_time_unix_nano", "span_id")).alias("p"), F.collect_list(each).alias("s"))
    entry = F.struct("process_id", "p.service_name", "p.tags")
    traces = first.groupBy("trace_id").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("s"), F.array_sort(F.collect_list(entry)).alias("processes"))
    return traces.select("trace_id", F.transform("s", lambda x: x["span"]).alias("spans"), "processes")


def service_edges(spans: DataFrame) -> DataFrame:
    """(parent, child, calls): the service topology, from spans joined to their parents."""
    child = spans.where(F.coalesce("parent_span_id", F.lit("")) != "").select("trace_id", F.col("parent_span_id").alias("span_id"), F.col("resource.service_name").alias("child"))
    parent = spans.select("trace_id", "span_id", F.col("resource.service_name").alias("parent"))
    return child.join(parent, ["trace_id", "span_id"]).where("parent <> child").groupBy("parent", "child").agg(F.count("*").alias("calls"))


def red_metrics(spans: DataFrame, width: str = "1 day") -> DataFrame:
    """Requests, errors and durations of each service and operation in tumbling windows; works on streams with a watermark."""
    at = F.timestamp_seconds(F.floor(F.col("start_time_unix_nano") / 1_000_000_000))
    rows = spans if "at" in spans.columns else spans.withColumn("at", at)
    grouped = rows.groupBy(F.window("at", width).alias("w"), F.col("resource.service_name").alias("service_name"), F.col("span_name").alias("operation_name"))
    out = grouped.agg(F.count("*").alias("requests"), F.count(F.when(F.col("status_code") == ERROR, 1)).alias("errors"), F.sum("duration_nanoseconds").alias("duration_sum"), F.max("duration_nanoseconds").alias("duration_max"))
    return out.select(F.unix_timestamp("w.start").alias("window_start"), "service_name", "operation_name", "requests", "errors", "duration_sum", "duration_max")


def latest_per_trace(spans: DataFrame) -> DataFrame:
    """The latest span of each trace."""
    order = Window.partitionBy("trace_id").orderBy(F.desc("start_time_unix_nano"), "span_id")
    return spans.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
