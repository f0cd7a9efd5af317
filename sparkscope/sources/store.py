"""Tables of telemetry as Parquet: metrics by name and day, spans by day, keyed metadata, and what could not be taken.

Every write goes to partitions named by its batch, through a staging folder of its own job. So a replay replaces what it
wrote before, and streams with different groups can write to one store at the same time.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscope.sources import schemas


class Store:
    """Reads and writes under one root folder; missing tables read as empty ones."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _exists(self, table: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(table))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _read(self, table: str, schema: schemas._Lazy, partitions: str) -> DataFrame:
        """The table with its partition columns, typed by the schema: a metric named 1 stays text, an empty folder reads."""
        whole = T.StructType([*schema.get().fields, *schemas._parsed(partitions).fields])
        if not self._exists(table):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(self._path(table))

    # facts

    def _append(self, rows: DataFrame, table: str, partitions: list[str], batch: str | None) -> None:
        """Append; a named batch replaces what an earlier try of it has written."""
        rows = rows.withColumn("batch", F.lit(batch or uuid.uuid4().hex))
        rows.write.partitionBy(*partitions, "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self._path(table))

    def write_metrics(self, metrics: DataFrame, batch: str | None = None) -> None:
        """Append points; sorted by series within files, so that row groups skip by labels and time."""
        rows = metrics.select(*[F.col(f.name) for f in schemas.METRIC_TYPE]).withColumn("date", F.to_date(F.timestamp_seconds(F.floor(F.col("ts_nano") / 1_000_000_000))))
        # the spread keeps a metric that holds most points from one task
        spread = F.pmod(F.xxhash64("labels"), F.lit(16))
        self._append(rows.repartition("name", "date", spread).sortWithinPartitions("name", "date", "labels", "ts_nano"), "metrics", ["name", "date"], batch)

    def metrics(self) -> DataFrame:
        return self._read("metrics", schemas.METRIC_TYPE, "date date, batch string")

    def samples(self) -> DataFrame:
        """Points as samples: (name, labels, ts in seconds, ts_nano, value)."""
        ts = F.floor(F.col("ts_nano") / F.lit(1_000_000_000)).cast("bigint")
        return self.metrics().select("name", "labels", ts.alias("ts"), "ts_nano", "value")

    def write_spans(self, spans: DataFrame, batch: str | None = None) -> None:
        day = F.to_date(F.timestamp_seconds(F.floor(F.col("start_time_unix_nano") / 1_000_000_000)))
        rows = spans.select(*[F.col(f.name) for f in schemas.SPAN_TYPE]).withColumn("date", day)
        self._append(rows.repartition("date", F.pmod(F.xxhash64("trace_id"), F.lit(16))).sortWithinPartitions("date", "trace_id"), "spans", ["date"], batch)

    def spans(self) -> DataFrame:
        return self._read("spans", schemas.SPAN_TYPE, "date date, batch string")

    # what could not be taken

    def write_rejected(self, rows: DataFrame, kind: str, batch: str | None = None) -> None:
        """Keep rows (reason, row as JSON) that a batch of this kind could not take."""
        self._append(rows.select("reason", "row").withColumn("kind", F.lit(kind)), "rejected", ["kind"], batch)

    def rejected(self) -> DataFrame:
        return self._read("rejected", schemas.REJECTED_TYPE, "kind string, batch string")

    def write_dead_letters(self, messages: DataFrame, kind: str, batch: str, error: str) -> None:
        """Keep the messages of a batch that could not be written in any of its tries."""
        rows = messages.select(F.to_json(F.struct("*")).alias("message"), F.lit(error).alias("error"), F.lit(kind).alias("kind"))
        self._append(rows, "dead_letters", ["kind"], batch)

    def forget_dead_letters(self, kind: str, batch: str) -> None:
        """Take back the letters of a batch that a replay has written after all."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._path('dead_letters')}/kind={kind}/batch={batch}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def dead_letters(self) -> DataFrame:
        return self._read("dead_letters", schemas.DEAD_LETTER_TYPE, "kind string, batch string")

    # metadata: keyed; a write adds only what is new or changed, and readers take the latest of each key

    def _latest(self, table: str, schema: schemas._Lazy, keys: list[str]) -> DataFrame:
        columns = [f.name for f in schema]
        rows = self._read(table, schema, "at bigint, batch string")
        others = [c for c in columns if c not in keys]
        newest = F.max_by(F.struct(F.lit(1).alias("there"), *others), F.struct("at", "batch", *others)).alias("x")
        return rows.groupBy(*keys).agg(newest).select(*[c if c in keys else F.col(f"x.{c}").alias(c) for c in columns])

    def _add(self, table: str, schema: schemas._Lazy, keys: list[str], rows: DataFrame, batch: str | None) -> None:
        columns = [f.name for f in schema]
        first = Window.partitionBy(*keys).orderBy(*[c for c in columns if c not in keys] or keys)
        rows = rows.select(*columns).withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")
        known = self._latest(table, schema, keys)
        same: list[Column] = [rows[c].eqNullSafe(known[c]) for c in columns]
        new = rows.join(known, same, "left_anti").persist()
        try:
            if not new.isEmpty():
                # a batch's later write goes beside its earlier one, which a replay no longer finds new
                self._append(new.withColumn("at", F.lit(time.time_ns())), table, ["at"], batch)
        finally:
            new.unpersist()

    def compact(self, table: str) -> None:
        """Write a metadata table's current rows as one batch and delete those it replaces.

        A failure in between leaves rows twice, which reads as before. Run it while no query reads the table.
        """
        schema, keys = self._KEYED[table]
        if not self._exists(table):
            return
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path(table))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        old = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("at=")]
        newest = max((int(p.getName()[3:]) for p in old), default=0)
        # the newest time that was read, so that a write in the meantime stays the later one
        self._append(self._latest(table, schema, keys).coalesce(1).withColumn("at", F.lit(newest + 1)), table, ["at"], None)
        for p in old:
            fs.delete(p, True)

    _KEYED = {  # noqa: RUF012
        "span_metadata": (schemas.SPAN_METADATA_TYPE, ["service_name", "operation_name"]),
        "metric_metadata": (schemas.METRIC_METADATA_TYPE, ["metric", "service_name"]),
    }

    def span_metadata(self) -> DataFrame:
        return self._latest("span_metadata", *self._KEYED["span_metadata"])

    def add_span_metadata(self, rows: DataFrame, batch: str | None = None) -> None:
        """Insert the pairs that are not there yet."""
        self._add("span_metadata", *self._KEYED["span_metadata"], rows, batch)

    def metric_metadata(self) -> DataFrame:
        return self._latest("metric_metadata", *self._KEYED["metric_metadata"])

    def upsert_metric_metadata(self, rows: DataFrame, batch: str | None = None) -> None:
        """Insert or update by (metric, service); replaying a batch changes nothing."""
        self._add("metric_metadata", *self._KEYED["metric_metadata"], rows, batch)
