"""Catalogues: label names and values, series, metric metadata, services and operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscope.functions import labels as L
from sparkscope.operators.selectors import matching
from sparkscope.plans.ast import Matcher


def _selected(samples: DataFrame, matches: list[list[Matcher]], start: int | None, end: int | None) -> DataFrame:
    rows = samples if start is None else samples.where(F.col("ts") >= start)
    rows = rows if end is None else rows.where(F.col("ts") <= end)
    if not matches:
        return rows
    # a series that several selectors match comes once
    out = matching(rows, matches[0])
    for m in matches[1:]:
        out = out.unionByName(matching(rows, m))
    return out


def series(samples: DataFrame, matches: list[list[Matcher]], start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
    """(labels): distinct label sets."""
    out = _selected(samples, matches, start, end).select("labels").distinct()
    return out if limit is None else out.orderBy("labels").limit(limit)


def label_names(samples: DataFrame, matches: list[list[Matcher]] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """(label): distinct names, in order. Label sets are made distinct before they are unfolded."""
    sets = _selected(samples, matches or [], start, end).select("labels").distinct()
    return sets.select(F.explode("labels").alias("x")).select(F.col("x.name").alias("label")).distinct().orderBy("label")


def label_values(samples: DataFrame, label: str, matches: list[list[Matcher]] | None = None, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
    """(value): distinct values of a label, in order."""
    value = L.value_of(F.col("labels"), label) if label != L.NAME else F.col("name")
    out = _selected(samples, matches or [], start, end).select(value.alias("value")).where(F.col("value") != "").distinct().orderBy("value")
    return out if limit is None else out.limit(limit)


def metric_names(metadata: DataFrame) -> DataFrame:
    return metadata.select("metric").distinct().orderBy("metric")


_SHOWN_TYPES = {"Gauge": "gauge", "Sum": "counter", "Histogram": "histogram", "ExponentialHistogram": "histogram", "Summary": "summary"}


def shown_type(kind):
    out = None
    for k, v in _SHOWN_TYPES.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out.otherwise("untyped")


def metric_metadata(metadata: DataFrame, metric: str | None = None, limit: int | None = None) -> DataFrame:
    """(metric, entries array<struct<type, help, unit>>): one entry for each service; a counter's samples may end in _total."""
    rows = metadata
    if metric:
        rows = rows.where(F.col("metric").isin([metric, metric.removesuffix("_total")]))
    rows = rows.dropDuplicates(["metric", "service_name"])
    entry = F.struct(shown_type(F.col("type")).alias("type"), F.col("description").alias("help"), "unit")
    out = rows.groupBy("metric").agg(F.array_sort(F.collect_list(entry)).alias("entries")).orderBy("metric")
    return out if limit is None else out.limit(limit)


def services(span_metadata: DataFrame) -> DataFrame:
    return span_metadata.select("service_name").distinct().orderBy("service_name")


def operations(span_metadata: DataFrame, service: str) -> DataFrame:
    return span_metadata.where(F.col("service_name") == service).select("operation_name").distinct().orderBy("operation_name")


def span_metadata(spans: DataFrame) -> DataFrame:
    return spans.select(F.col("resource.service_name").alias("service_name"), F.col("span_name").alias("operation_name")).distinct()
