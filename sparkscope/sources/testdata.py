"""Telemetry views of the benchmark tables: metrics from events and line items, spans from orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkscope.functions import labels as L
from sparkscope.sources.schemas import SPAN_TYPE


def _seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def _sample(name: str, labels: dict[str, Column], ts: Column, nano: Column, value: Column) -> list[Column]:
    return [F.lit(name).alias("name"), L.pack({L.NAME: F.lit(name), **labels}).alias("labels"), ts.cast("bigint").alias("ts"), nano.cast("bigint").alias("ts_nano"), value.cast("double").alias("value")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of: event_value (gauge by event_type and user), events_total (counter by event_type and shard of users),
    events_daily_total (the same by event_type, restarting each day), quantity_bucket (histogram by return flag)."""
    e = read(spark, sf_dir, "events")
    ts, nano = _seconds(F.col("ts")), F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.pmod("event_id", F.lit(1000))
    gauge = e.select(*_sample("event_value", {"event_type": F.col("event_type"), "user_id": F.col("user_id")}, ts, nano, F.col("value")))
    shard = F.pmod("user_id", F.lit(4))
    running = F.count("*").over(Window.partitionBy("event_type", shard).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    counter = e.withColumn("n", running).select(*_sample("events_total", {"event_type": F.col("event_type"), "shard": shard}, ts, nano, F.col("n")))
    daily = F.count("*").over(Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    resets = e.withColumn("n", daily).select(*_sample("events_daily_total", {"event_type": F.col("event_type")}, ts, nano, F.col("n")))
    x = read(spark, sf_dir, "lineitem")
    bounds = ["10", "20", "30", "40", "50", "+Inf"]
    sums = x.groupBy("l_returnflag").agg(*[F.count(F.when(F.col("l_quantity") <= float(b.replace("+", "")), 1)).alias(b) for b in bounds])
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(b).alias("n")) for b in bounds])).alias("p")
    at = F.lit(1704153600).cast("bigint")
    histogram = sums.select("l_returnflag", pairs).select(*_sample("quantity_bucket", {"returnflag": F.col("l_returnflag"), "le": F.col("p.le")}, at, at * F.lit(1_000_000_000), F.col("p.n")))
    return gauge.unionByName(counter).unionByName(resets).unionByName(histogram)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order a root span of service `orders`, each line item a child span of its supplier's nation."""
    o, x = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    s, n, p = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation"), read(spark, sf_dir, "part")
    attribute = lambda k, v, t=1: F.struct(F.lit(k).alias("key"), F.lit(t).cast("tinyint").alias("value_type"), v.cast("string").alias("value"))
    nothing = {"status_message": F.lit(None).cast("string"), "trace_flags": F.lit(0).cast("bigint"), "trace_state": F.lit(None).cast("string"), "events": F.array(), "links": F.array()}
    start = _seconds(F.col("o_orderdate")) * F.lit(1_000_000_000).cast("bigint")
    roots = o.select(
        F.col("o_orderkey").cast("string").alias("trace_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit("-0")).alias("span_id"), F.lit("order").alias("span_name"), F.lit("").alias("parent_span_id"),
        start.alias("start_time_unix_nano"), (start + 1_000_000_000).alias("end_time_unix_nano"), F.lit(1_000_000_000).cast("bigint").alias("duration_nanoseconds"),
        F.lit(1).cast("tinyint").alias("status_code"), F.lit(2).cast("tinyint").alias("span_kind"),
        F.struct(F.lit("orders").alias("service_name"), F.lit("").alias("service_instance_id"), F.array(attribute("priority", F.col("o_orderpriority"))).alias("attributes")).alias("resource"),
        F.array(attribute("status", F.col("o_orderstatus"))).alias("attributes"), *[v.alias(k) for k, v in nothing.items()],
    )
    shipped = _seconds(F.col("l_shipdate")) * F.lit(1_000_000_000).cast("bigint")
    length = (F.col("l_quantity") * 1_000_000).cast("bigint")
    items = x.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    children = items.select(
        F.col("l_orderkey").cast("string").alias("trace_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("span_id"), F.col("p_type").alias("span_name"), F.concat(F.col("l_orderkey").cast("string"), F.lit("-0")).alias("parent_span_id"),
        shipped.alias("start_time_unix_nano"), (shipped + length).alias("end_time_unix_nano"), length.alias("duration_nanoseconds"),
        F.when(F.col("l_returnflag") == "R", 2).otherwise(1).cast("tinyint").alias("status_code"), F.lit(3).cast("tinyint").alias("span_kind"),
        F.struct(F.trim("n_name").alias("service_name"), F.col("s_suppkey").cast("string").alias("service_instance_id"), F.array(attribute("supplier", F.col("s_suppkey"), 3)).alias("attributes")).alias("resource"),
        F.array(attribute("returnflag", F.col("l_returnflag")), attribute("linestatus", F.col("l_linestatus"))).alias("attributes"), *[v.alias(k) for k, v in nothing.items()],
    )
    cast = lambda df: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SPAN_TYPE])
    return cast(roots).unionByName(cast(children))
