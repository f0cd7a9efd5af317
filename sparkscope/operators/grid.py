"""The evaluation grid of a query: start, start + step, ... up to end, in whole seconds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    start: int
    end: int
    step: int = 1

    def __post_init__(self) -> None:
        if self.step <= 0 or self.end < self.start:
            raise ValueError("a grid needs a positive step and an end that is not before its start")

    @property
    def size(self) -> int:
        return (self.end - self.start) // self.step + 1

    @property
    def last(self) -> int:
        return self.start + (self.size - 1) * self.step

    def steps(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.start, self.last + 1, self.step).select(F.col("id").alias("step_ts"))

    def all_steps(self) -> Column:
        return F.sequence(F.lit(self.start), F.lit(self.last), F.lit(self.step)).cast("array<bigint>")

    def first_at_or_after(self, ts: Column) -> Column:
        """First step not before ts; before the start it is the start."""
        k = F.greatest(F.lit(0), F.ceil((ts - self.start) / F.lit(self.step)))
        return (F.lit(self.start) + k * self.step).cast("bigint")

    def between(self, low: Column, high: Column) -> Column:
        """Array of the steps in [low, high]; empty where there is none. sequence() would count down, hence the test."""
        first = self.first_at_or_after(low)
        top = F.least(high, F.lit(self.last)).cast("bigint")
        return F.when(first <= top, F.sequence(first, top, F.lit(self.step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
