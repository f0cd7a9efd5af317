"""OpenTelemetry messages (the JSON encoding of the protocol) to flat points, spans and metadata.

The same functions serve batches and streams. A message is one resource with its scopes; every level is unfolded by
explode, and values are built by Columns. Integers of 64 bits come as text in this encoding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.functions import labels as L

_VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,arrayValue:string,kvlistValue:string,bytesValue:string>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_NUMBER = f"struct<attributes:{_ATTRIBUTES},timeUnixNano:string,asDouble:double,asInt:string>"
_HISTOGRAM = f"struct<attributes:{_ATTRIBUTES},timeUnixNano:string,count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>>"
_SIDE = "struct<offset:int,bucketCounts:array<string>>"
_EXPONENTIAL = f"struct<attributes:{_ATTRIBUTES},timeUnixNano:string,count:string,sum:double,scale:int,zeroCount:string,positive:{_SIDE},negative:{_SIDE}>"
_SUMMARY = f"struct<attributes:{_ATTRIBUTES},timeUnixNano:string,count:string,sum:double,quantileValues:array<struct<quantile:double,value:double>>>"
_METRIC = (
    f"struct<name:string,description:string,unit:string,gauge:struct<dataPoints:array<{_NUMBER}>>,sum:struct<dataPoints:array<{_NUMBER}>>,histogram:struct<dataPoints:array<{_HISTOGRAM}>>,"
    f"exponentialHistogram:struct<dataPoints:array<{_EXPONENTIAL}>>,summary:struct<dataPoints:array<{_SUMMARY}>>>"
)
#: Schemas of one resource's metrics and spans, for spark.read.json and readStream.
METRICS_SCHEMA = f"resourceMetrics array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeMetrics:array<struct<metrics:array<{_METRIC}>>>>>"
_SPAN = (
    f"struct<traceId:string,spanId:string,parentSpanId:string,traceState:string,flags:bigint,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRIBUTES},status:struct<code:int,message:string>,"
    f"events:array<struct<timeUnixNano:string,name:string,attributes:{_ATTRIBUTES}>>,links:array<struct<traceId:string,spanId:string,traceState:string,flags:bigint,attributes:{_ATTRIBUTES}>>>"
)
TRACES_SCHEMA = f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<spans:array<{_SPAN}>>>>>"

#: Units of the Unified Code for Units of Measure and their names in metric names (fixed values).
UNITS = {
    "d": "days", "h": "hours", "min": "minutes", "s": "seconds", "ms": "milliseconds", "us": "microseconds", "ns": "nanoseconds",
    "By": "bytes", "KiBy": "kibibytes", "MiBy": "mebibytes", "GiBy": "gibibytes", "TiBy": "tibibytes", "KBy": "kilobytes", "MBy": "megabytes", "GBy": "gigabytes", "TBy": "terabytes",
    "B": "bytes", "KB": "kilobytes", "MB": "megabytes", "GB": "gigabytes", "TB": "terabytes",
    "m": "meters", "V": "volts", "A": "amperes", "J": "joules", "W": "watts", "g": "grams", "Cel": "celsius", "Hz": "hertz", "1": "", "%": "percent", "$": "dollars",
}
#: The unit after a slash.
PER = {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week", "mo": "month", "y": "year"}


def _looked_up(x: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), x), x)


def unit_name(unit: Column) -> Column:
    """Name of a unit: annotations in braces go; a/b becomes a_per_b."""
    plain = F.trim(F.regexp_replace(F.coalesce(unit, F.lit("")), r"\{[^}]*\}", ""))
    parts = F.split(plain, "/", 2)
    above, below = _looked_up(F.trim(parts[0]), UNITS), _looked_up(F.trim(F.get(parts, F.lit(1))), PER)
    name = F.when((F.size(parts) == 2) & (F.trim(F.get(parts, F.lit(1))) != ""), F.when(above != "", F.concat(above, F.lit("_per_"), below)).otherwise(F.concat(F.lit("per_"), below))).otherwise(above)
    return F.regexp_replace(name, r"[^A-Za-z0-9_]+", "_")


def metric_name(name: Column, unit: Column) -> Column:
    """Sanitised name with its unit as suffix, unless it has that suffix already; without _total."""
    plain = F.regexp_replace(F.regexp_replace(name, r"\.", "_"), r"_total$", "")
    u = unit_name(unit)
    return F.when((u == "") | F.endswith(plain, F.concat(F.lit("_"), u)) | (plain == u), plain).otherwise(F.concat(plain, F.lit("_"), u))


def bool_text(b: Column) -> Column:
    """Booleans are stored as True and False."""
    return F.initcap(b.cast("string"))


def double_text(d: Column) -> Column:
    """Shortest text of a double; whole ones without a fraction."""
    plain = F.when(F.isnan(d), "NaN").when(d == float("inf"), "+Inf").when(d == -float("inf"), "-Inf")
    return plain.when((d == F.floor(d)) & (F.abs(d) < 1e15), F.floor(d).cast("string")).otherwise(d.cast("string"))


def attributes(column: Column) -> Column:
    """Attributes as (key, value_type, value as text)."""

    def one(a: Column) -> Column:
        v = a["value"]
        kinds = [(v["stringValue"], 1), (bool_text(v["boolValue"]), 2), (v["intValue"], 3), (double_text(v["doubleValue"]), 4), (v["arrayValue"], 5), (v["kvlistValue"], 6), (v["bytesValue"], 7)]
        code = F.when(v["stringValue"].isNotNull(), 1)
        for x, n in kinds[1:]:
            code = code.when(x.isNotNull(), n)
        return F.struct(a["key"].alias("key"), code.otherwise(0).cast("tinyint").alias("value_type"), F.coalesce(*[x for x, _ in kinds], F.lit("")).alias("value"))

    return F.transform(F.coalesce(column, F.array().cast(_ATTRIBUTES)), one)


def label_set(*columns: Column) -> Column:
    """Label set of attributes: dots become underscores, a later one wins, empty ones and complex values are left out."""
    items = F.filter(F.concat(*[attributes(c) for c in columns]), lambda a: a["value_type"].between(1, 4) & (a["value"] != ""))
    named = F.transform(items, lambda a: F.struct(F.regexp_replace(a["key"], r"\.", "_").alias("name"), a["value"].alias("value")))
    start = F.array().cast(L.TYPE)
    return F.array_sort(F.aggregate(named, start, lambda acc, x: F.array_append(F.filter(acc, lambda e: e["name"] != x["name"]), x)))


def _attribute(column: Column, key: str) -> Column:
    return F.coalesce(F.get(F.filter(attributes(column), lambda a: a["key"] == key), F.lit(0))["value"], F.lit(""))


def _metrics(messages: DataFrame) -> DataFrame:
    rows = messages.select(F.explode("resourceMetrics").alias("r")).select("r.resource", F.explode("r.scopeMetrics").alias("s"))
    rows = rows.select("resource", F.explode("s.metrics").alias("m"))
    return rows.select(F.col("resource.attributes").alias("shared"), "m", metric_name(F.col("m.name"), F.col("m.unit")).alias("base"))


def _running(counts: Column) -> Column:
    """Running sums of an array, each from the one before."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("sums"))
    step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["sums"], a["sum"] + x).alias("sums"))
    return F.aggregate(counts, start, step)["sums"]


def _numbers(column: Column) -> Column:
    return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: x.cast("double"))


_ENTRY = "struct<suffix:string,label:string,text:string,value:double>"


def _entry(suffix: str, value: Column, label: str = "", text: Column | None = None) -> Column:
    return F.struct(F.lit(suffix).alias("suffix"), F.lit(label).alias("label"), (F.lit("") if text is None else text).alias("text"), value.cast("double").alias("value"))


def _number(p: Column) -> Column:
    return F.coalesce(p["asDouble"], p["asInt"].cast("double"))


def _sum_and_count(p: Column) -> Column:
    return F.array(_entry("_sum", p["sum"]), _entry("_count", p["count"]))


def _histogram(p: Column) -> Column:
    bounds = F.coalesce(p["explicitBounds"], F.array().cast("array<double>"))
    buckets = F.transform(_running(_numbers(p["bucketCounts"])), lambda c, i: _entry("_bucket", c, "le", F.coalesce(double_text(F.get(bounds, i)), F.lit("+Inf"))))
    return F.concat(_sum_and_count(p), buckets)


def _exponential(p: Column) -> Column:
    base = F.pow(F.lit(2.0), F.pow(F.lit(2.0), -p["scale"].cast("double")))

    def side(name: str) -> tuple[Column, Column]:
        return _numbers(p[name]["bucketCounts"]), F.coalesce(p[name]["offset"], F.lit(0))

    (low, low_at), (high, high_at) = side("negative"), side("positive")
    pair = lambda bound, c: F.struct(bound.alias("b"), c.alias("c"))
    # bucket i holds (base^(offset+i), base^(offset+i+1)]; below zero the upper bound is the smaller magnitude
    negative = F.reverse(F.transform(low, lambda c, i: pair(-F.pow(base, (low_at + i).cast("double")), c)))
    zero = F.when(p["zeroCount"].cast("double") > 0, F.array(pair(F.lit(0.0), p["zeroCount"].cast("double")))).otherwise(F.array().cast("array<struct<b:double,c:double>>"))
    positive = F.transform(high, lambda c, i: pair(F.pow(base, (high_at + i + 1).cast("double")), c))
    finite = F.concat(negative, zero, positive)
    running = _running(F.transform(finite, lambda x: x["c"]))
    # the last positive bucket is +Inf; without one, +Inf repeats the whole count
    last_open, n = F.size(high) > 0, F.size(low) + F.size(high) + F.size(zero)
    named = F.transform(F.arrays_zip(finite.alias("f"), running.alias("c")), lambda x, i: _entry("_bucket", x["c"], "le", F.when(last_open & (i == n - 1), F.lit("+Inf")).otherwise(double_text(x["f"]["b"]))))
    rest = F.when(last_open, F.array().cast(f"array<{_ENTRY}>")).otherwise(F.array(_entry("_bucket", p["count"], "le", F.lit("+Inf"))))
    return F.concat(_sum_and_count(p), named, rest)


def _summary(p: Column) -> Column:
    values = F.coalesce(p["quantileValues"], F.array().cast("array<struct<quantile:double,value:double>>"))
    return F.concat(_sum_and_count(p), F.transform(values, lambda q: _entry("_quantile", q["value"], "quantile", double_text(q["quantile"]))))


#: Field of a metric, its type, and the entries of one of its points.
KINDS = {
    "gauge": ("Gauge", lambda p: F.array(_entry("", _number(p)))),
    "sum": ("Sum", lambda p: F.array(_entry("_total", _number(p)))),
    "histogram": ("Histogram", _histogram),
    "exponentialHistogram": ("ExponentialHistogram", _exponential),
    "summary": ("Summary", _summary),
}


def points(messages: DataFrame) -> DataFrame:
    """(name, type, description, unit, labels, value, ts_nano) of every point of a frame of METRICS_SCHEMA rows.

    Sums end in _total. Histograms give _sum, _count and cumulative _bucket rows; exponential ones order their buckets
    from the most negative over zero to the most positive; summaries give _quantile rows. One pass over the messages.
    """
    none = F.array().cast(f"array<struct<attributes:{_ATTRIBUTES},nano:string,type:string,entries:array<{_ENTRY}>>>")

    def of(field: str, kind: str, entries) -> Column:
        each = lambda p: F.struct(p["attributes"].alias("attributes"), p["timeUnixNano"].alias("nano"), F.lit(kind).alias("type"), entries(p).alias("entries"))
        return F.coalesce(F.transform(F.col(f"m.{field}.dataPoints"), each), none)

    rows = _metrics(messages).withColumn("p", F.explode(F.concat(*[of(k, *v) for k, v in KINDS.items()])))
    rows = rows.select("base", "m.description", "m.unit", "p.type", F.col("p.nano").cast("bigint").alias("ts_nano"), "p.entries", label_set(F.col("shared"), F.col("p.attributes")).alias("own"))
    rows = rows.withColumn("e", F.explode("entries")).withColumn("name", F.concat("base", "e.suffix"))
    # labels that the point itself brings: its name, and the bound or the quantile
    given = F.array(F.struct(F.lit(L.NAME).alias("name"), F.col("name").alias("value")), F.struct(F.col("e.label").alias("name"), F.col("e.text").alias("value")))
    rest = F.filter("own", lambda x: ~x["name"].isin(L.NAME) & (x["name"] != F.col("e.label")))
    labels = F.array_sort(F.concat(rest, F.filter(given, lambda x: x["name"] != "")))
    return rows.select("name", "type", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("unit", F.lit("")).alias("unit"), labels.alias("labels"), F.col("e.value").alias("value"), "ts_nano")


def metric_metadata(messages: DataFrame) -> DataFrame:
    """(metric, service_name, type, description, unit): one row for each metric, three for histograms and summaries.

    A sum's metadata has its name without _total. Counts have the unit 1.
    """
    rows = _metrics(messages)
    parts = {"Gauge": [""], "Sum": [""], "Summary": ["_sum", "_count", "_quantile"]}
    kinds = [(field, kind, parts.get(kind, ["_sum", "_count", "_bucket"])) for field, (kind, _) in KINDS.items()]
    none = "array<struct<suffix:string,type:string,unit:string>>"
    entries = F.array().cast(none)
    for kind, name, suffixes in kinds:
        each = F.array(*[F.struct(F.lit(s).alias("suffix"), F.lit(name).alias("type"), (F.lit("1") if s == "_count" else F.coalesce("m.unit", F.lit(""))).alias("unit")) for s in suffixes])
        entries = F.when(F.col(f"m.{kind}").isNotNull(), each).otherwise(entries)
    out = rows.withColumn("e", F.explode(entries))
    return out.select(F.concat("base", "e.suffix").alias("metric"), _attribute(F.col("shared"), "service.name").alias("service_name"), "e.type", F.coalesce("m.description", F.lit("")).alias("description"), "e.unit")


def _trace_id(x: Column) -> Column:
    """Lower-case hex; an id whose high half is zero has 16 digits; an absent one is empty."""
    h = F.lower(F.coalesce(x, F.lit("")))
    return F.when((F.length(h) == 32) & h.startswith("0" * 16), F.substring(h, 17, 16)).otherwise(h)


def spans(messages: DataFrame) -> DataFrame:
    """Spans (schemas.SPAN_TYPE) of a frame of TRACES_SCHEMA rows."""
    rows = messages.select(F.explode("resourceSpans").alias("r")).select("r.resource", F.explode("r.scopeSpans").alias("s")).select("resource", F.explode("s.spans").alias("x"))
    shared = F.col("resource.attributes")
    start, end = F.col("x.startTimeUnixNano").cast("bigint"), F.col("x.endTimeUnixNano").cast("bigint")
    none_event = "array<struct<name:string,timestamp_unix_nano:bigint,attributes:array<struct<key:string,value_type:tinyint,value:string>>>>"
    none_link = "array<struct<linked_trace_id:string,linked_span_id:string,linked_trace_state:string,linked_trace_flags:bigint,attributes:array<struct<key:string,value_type:tinyint,value:string>>>>"
    events = F.transform("x.events", lambda e: F.struct(e["name"].alias("name"), e["timeUnixNano"].cast("bigint").alias("timestamp_unix_nano"), attributes(e["attributes"]).alias("attributes")))
    links = F.transform("x.links", lambda k: F.struct(_trace_id(k["traceId"]).alias("linked_trace_id"), F.lower(k["spanId"]).alias("linked_span_id"), k["traceState"].alias("linked_trace_state"), F.coalesce(k["flags"], F.lit(0)).cast("bigint").alias("linked_trace_flags"), attributes(k["attributes"]).alias("attributes")))
    return rows.select(
        _trace_id(F.col("x.traceId")).alias("trace_id"), F.lower(F.coalesce("x.spanId", F.lit(""))).alias("span_id"), F.col("x.name").alias("span_name"), F.lower(F.coalesce("x.parentSpanId", F.lit(""))).alias("parent_span_id"),
        start.alias("start_time_unix_nano"), end.alias("end_time_unix_nano"), (end - start).alias("duration_nanoseconds"), F.col("x.status.code").cast("tinyint").alias("status_code"), F.col("x.status.message").alias("status_message"),
        F.coalesce("x.kind", F.lit(0)).cast("tinyint").alias("span_kind"), F.coalesce("x.flags", F.lit(0)).cast("bigint").alias("trace_flags"), F.col("x.traceState").alias("trace_state"),
        F.struct(_attribute(shared, "service.name").alias("service_name"), _attribute(shared, "service.instance.id").alias("service_instance_id"), attributes(shared).alias("attributes")).alias("resource"),
        attributes(F.col("x.attributes")).alias("attributes"), F.coalesce(events, F.array().cast(none_event)).alias("events"), F.coalesce(links, F.array().cast(none_link)).alias("links"),
    )
