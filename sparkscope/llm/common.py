"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: White space that separates words, everywhere in this package: space and TAB to CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch on its way to or from a Python worker, where the session names no other bound.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes too: ten thousand long texts in one batch would fill buffers on both sides."""
    if not spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and the master is local, as in
    tests, a temporary one; on a cluster that would be a folder of one machine, so it raises an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a cut of the lineage that outlives executors.

    The files go when the application ends, or earlier through release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkscope-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkscope_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a table from materialise() that nothing reads any more."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._sparkscope_path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null becomes the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, undecoded; null becomes empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most most_bytes of column, or of one row, so that a worker's memory stays bounded."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if batch.nbytes <= most_bytes:
            yield batch
            continue
        sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.float64))
        begin = 0
        total = 0.0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0.0
            total += n
        yield batch.slice(begin)
    pa.default_memory_pool().release_unused()


class Memo(dict):
    """A bounded memo of a pure function: emptied when full, so it changes speed only."""

    def __init__(self, f: Callable, most: int = 150_000, longest: int = 64) -> None:
        super().__init__()
        self.f, self.most, self.longest = f, most, longest

    def __missing__(self, key):
        value = self.f(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


_kept: dict = {}


def per_process(key, make: Callable):
    """What make() returns, made once in each Python process; only the latest key's is held.

    A worker process goes from one operator's tasks to another's, so what the last one needed is given back first.
    """
    if key not in _kept:
        if _kept:
            _kept.clear()
            give_back()
        _kept[key] = make()
    return _kept[key]


def hold_pages(most: int = 8 << 20) -> None:
    """Let this process keep freed memory in its heap, up to four times most, and take arrays of up to most from there: fresh
    pages for each short-lived array cost more than what is computed in it. give_back() returns them."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, most)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 4 * most)  # M_TRIM_THRESHOLD


def give_back() -> None:
    """Return freed memory to the operating system, as far as the allocators let it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k) of X ~ Binomial(n, p), summed exactly term by term."""
    if k >= n:
        return 0.0
    top = None
    total = 0.0
    lp, lq = math.log(p), math.log1p(-p)
    for i in range(k, -1, -1):
        t = math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq
        if top is None:
            top = t
            total = 1.0
            continue
        step = math.exp(t - top)
        total += step
        if step < 1e-17 * total and i < n * p:
            break
    return top + math.log(total)
