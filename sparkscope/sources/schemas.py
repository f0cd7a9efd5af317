"""Schemas of stored telemetry."""

from __future__ import annotations

from pyspark.sql import types as T

_ATTRIBUTES = "array<struct<key:string,value_type:tinyint,value:string>>"


def _parsed(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


class _Lazy:
    """Parsed on first use: parsing needs a session."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.schema: T.StructType | None = None

    def get(self) -> T.StructType:
        if self.schema is None:
            self.schema = _parsed(self.text)
        return self.schema

    def __iter__(self):
        return iter(self.get().fields)


#: One row for each point of a metric; date and name are partitions where it is stored.
METRIC_TYPE = _Lazy("name string, type string, description string, unit string, labels array<struct<name:string,value:string>>, value double, ts_nano bigint")
SPAN_TYPE = _Lazy(
    "trace_id string, span_id string, span_name string, parent_span_id string, start_time_unix_nano bigint, end_time_unix_nano bigint, duration_nanoseconds bigint, status_code tinyint, status_message string, "
    f"span_kind tinyint, trace_flags bigint, trace_state string, resource struct<service_name:string,service_instance_id:string,attributes:{_ATTRIBUTES}>, attributes {_ATTRIBUTES}, "
    f"events array<struct<name:string,timestamp_unix_nano:bigint,attributes:{_ATTRIBUTES}>>, links array<struct<linked_trace_id:string,linked_span_id:string,linked_trace_state:string,linked_trace_flags:bigint,attributes:{_ATTRIBUTES}>>"
)
METRIC_METADATA_TYPE = _Lazy("metric string, service_name string, type string, description string, unit string")
SPAN_METADATA_TYPE = _Lazy("service_name string, operation_name string")
#: What could not be taken: rows of a batch, and whole batches.
REJECTED_TYPE = _Lazy("reason string, row string")
DEAD_LETTER_TYPE = _Lazy("message string, error string")
