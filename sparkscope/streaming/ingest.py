"""Continuous ingest: telemetry messages to the store, exactly once for facts and idempotent for metadata.

A micro-batch is normalised by the same functions as a batch. Progress is the checkpoint's. Facts of a batch are written
under the batch's number, so that a replay replaces them. Rows that cannot be taken go to the store's rejected rows and the
rest of the batch is written. A batch that fails in all its tries goes to the dead letters, and the stream goes on; where
not even those can be written, the stream fails and reads the batch again.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkscope.operators import catalog, traces
from sparkscope.sources import otlp
from sparkscope.sources.store import Store


#: Where messages() keeps the text of a malformed message.
MALFORMED = "_corrupt_record"


def messages(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the JSON messages that arrive as files in a folder; of malformed ones the text is kept in MALFORMED."""
    reader = spark.readStream.schema(f"{schema}, {MALFORMED} string").option("maxFilesPerTrigger", files_per_batch)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED).json(folder)


def _reason(kind: str) -> Column:
    """Why a span or point cannot be taken; null where it can."""
    if kind == "spans":
        return F.when(F.col("trace_id") == "", "no trace id").when(F.col("span_id") == "", "no span id").when(F.col("start_time_unix_nano").isNull(), "no time")
    return F.when(F.col("value").isNull(), "no value").when(F.col("ts_nano").isNull(), "no time")


def split(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The spans or points that can be taken, and (reason, row as JSON) of the others."""
    marked = rows.withColumn("_reason", _reason(kind))
    bad = marked.where(F.col("_reason").isNotNull()).select(F.col("_reason").alias("reason"), F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("row"))
    return marked.where(F.col("_reason").isNull()).drop("_reason"), bad


def _ingest(stream: DataFrame, store: Store, checkpoint: str, group: str, kind: str, facts: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, DataFrame, str], None], tries: int, pause: float) -> StreamingQuery:
    """Start a query that hands write() each batch's messages, the facts that can be taken, and the batch's name."""

    def once(rows: DataFrame, batch: str) -> None:
        good, bad = split(facts(rows), kind)
        if MALFORMED in rows.columns:
            bad = bad.unionByName(rows.where(F.col(MALFORMED).isNotNull()).select(F.lit("malformed").alias("reason"), F.col(MALFORMED).alias("row")))
        write(rows, good, batch)
        store.write_rejected(bad, kind, batch)
        store.forget_dead_letters(kind, batch)

    def run(rows: DataFrame, number: int) -> None:
        rows, batch = rows.persist(), f"{group}-{number}"
        try:
            for left in reversed(range(tries)):
                try:
                    once(rows, batch)
                    break
                except Exception as error:  # whatever it is, the batch must not stop the stream
                    if not left:
                        store.write_dead_letters(rows, kind, batch, str(error)[:2000])
                    else:
                        time.sleep(pause)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_metrics(stream: DataFrame, store: Store, checkpoint: str, group: str = "default", tries: int = 4, pause: float = 1.0) -> StreamingQuery:
    """Points appended to metrics, metadata upserted; all files there are at the start, then ends."""

    def write(rows: DataFrame, good: DataFrame, batch: str) -> None:
        store.upsert_metric_metadata(otlp.metric_metadata(rows), batch)
        store.write_metrics(good, batch)

    return _ingest(stream, store, checkpoint, group, "metrics", otlp.points, write, tries, pause)


def ingest_spans(stream: DataFrame, store: Store, checkpoint: str, group: str = "default", tries: int = 4, pause: float = 1.0) -> StreamingQuery:
    """Spans appended, their services and operations added; all files there are at the start, then ends."""

    def write(rows: DataFrame, good: DataFrame, batch: str) -> None:
        store.add_span_metadata(catalog.span_metadata(good), batch)
        store.write_spans(good, batch)

    return _ingest(stream, store, checkpoint, group, "spans", otlp.spans, write, tries, pause)


def rejected(rows: DataFrame, kind: str) -> DataFrame:
    """How many spans or points of a batch cannot be taken, and how many there are."""
    return rows.agg(F.count(_reason(kind)).alias("rejected"), F.count("*").alias("received"))


def red_stream(spans: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests, errors and durations by window on a stream of spans; windows close when the watermark passes them."""
    at = F.timestamp_seconds(F.floor(F.col("start_time_unix_nano") / 1_000_000_000))
    return traces.red_metrics(spans.withColumn("at", at).withWatermark("at", late), width)
