"""Byte-level BPE encoding and decoding with overlapping chunks.

A text longer than a chunk is cut into windows that overlap. Each window is split into pre-tokens on its own. Splitting
has no memory: what follows a boundary depends only on the text after it. So where a boundary of one window is also a
boundary of the next one, the second one's boundaries are right from there on, and the windows are stitched at the
first such position of their overlap. Where an overlap has none (one run longer than it), the overlap grows. The
pre-tokens are then encoded one by one; ids are kept as little-endian unsigned 32-bit integers. Decoding concatenates
the bytes of the ids.

A text of more than LONG code points is not one task's work: its windows become rows, split in parallel; the boundaries
near the windows' seams are joined to find where they agree; each part between two such places is a row that is encoded
on its own. Only ids come together again, text by text, to be digested.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscope.llm.common import Memo, materialise, per_process, slices, texts

#: Code points that a window needs beyond a boundary for the boundary to be certain.
LOOK_AHEAD = 8
CHUNK, OVERLAP = 1 << 16, 512
#: Code points of a text from which on its windows are dealt over tasks, and those of such a window and its overlap.
LONG, LONG_CHUNK, LONG_OVERLAP = 1 << 20, 1 << 18, 1 << 12


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _certain(pieces: list[str], begin: int, end: int, at_end: bool) -> list[int]:
    """Boundaries of pieces that start at begin, as far as a window that ends at end settles them."""
    marks = np.cumsum([begin, *map(len, pieces)])
    return (marks if at_end else marks[marks <= end - LOOK_AHEAD]).tolist()


def chunked_pieces(split, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """split(text), computed window by window."""
    n = len(text)
    if n <= chunk + overlap:
        return split(text)
    out: list[str] = []
    starts = list(range(0, n, chunk))
    true = 0  # a boundary of the whole text from which the current window goes on
    for i, s in enumerate(starts):
        last = i + 1 == len(starts)
        following = n if last else starts[i + 1]
        if true >= following and not last:
            continue  # the previous stitch already passed this whole window
        more = overlap
        while True:
            end = min(n, following + more)
            pieces = split(text[true:end])
            marks = _certain(pieces, true, end, end == n)
            if end == n:
                out += pieces
                return out
            stop = min(n, end + chunk)
            other = set(_certain(split(text[following:stop]), following, stop, stop == n))
            common = next((m for m in marks if m >= following and m in other), None)
            if common is not None:
                break
            more *= 4
        out += pieces[: marks.index(common)]
        true = common
    return out


class Codec:
    """Encoder and decoder of one rank table; the same ids as tiktoken's encode_ordinary()."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.single = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        # the tokenizer's engine takes White_Space for \s, which leaves out U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.chunk, self.overlap = chunk, overlap
        self.parts = Memo(lambda p: array("I", self.single(p.encode())).tobytes())
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, chunked_pieces(self.split, text, self.chunk, self.overlap)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


def key_of(ranks: dict[bytes, int], pattern: str) -> str:
    """Digest of a whole rank table and its pattern."""
    out = hashlib.sha256(pattern.encode())
    for b, r in sorted(ranks.items()):
        out.update(len(b).to_bytes(4, "little") + b + r.to_bytes(8, "little"))
    return out.hexdigest()


def codec(ranks: dict[bytes, int], pattern: str, key: str) -> Codec:
    """The codec of a table, made once in each process; key: that of key_of()."""
    return per_process(("bpe", key), lambda: Codec(ranks, pattern))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; a null text is empty and has no ids. Other columns are not read."""
    key = key_of(ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern, key)
        for batch in slices(batches, "t"):
            ids = [np.frombuffer(c.encode(x), "<i4") for x in texts(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(ids, pa.list_(pa.int32()))], ["i", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, f"i {kind}, ids array<int>").toDF(id_col, "ids")


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary): the concatenated bytes of each row's ids; null ids give empty bytes."""
    key = key_of(ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern, key)
        for batch in batches:
            out = [c.decode(array("I", x or []).tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(out, pa.binary())], ["i", "b"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(encoded[id_col].alias("i"), encoded[ids_col].alias("ids")).mapInArrow(run, f"i {kind}, b binary").toDF(id_col, "bytes")


def _windows(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, i, k, last, t): the windows of every text; window k begins at k * chunk and goes on for overlap into the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in slices(batches, "t"):
            for i, t in zip(batch.column("i"), texts(batch.column("t")), strict=True):
                starts = range(0, len(t), chunk)
                for k, s in enumerate(starts):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([i.as_py()], i.type), pa.array([k]), pa.array([k == len(starts) - 1]), pa.array([t[s : s + chunk + overlap]], pa.string())], ["row", "i", "k", "last", "t"])
                row += 1

    return long.mapInArrow(run, f"row long, i {long.schema['i'].dataType.simpleString()}, k long, last boolean, t string")


def _long_digests(long: DataFrame, ranks: dict[bytes, int], pattern: str, key: str, chunk: int, overlap: int) -> DataFrame:
    """(i, n, a, b) of encode_digests(), for the rows (i, t) of long texts."""
    windows = materialise(_windows(long, chunk, overlap), "bpe-windows").repartition("row", "k")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern, key)
        for batch in batches:
            head, tail = [], []
            for k, last, t in zip(batch.column("k").to_pylist(), batch.column("last").to_pylist(), texts(batch.column("t")), strict=True):
                found = _certain(c.split(t), k * chunk, k * chunk + len(t), last)
                head.append([m for m in found if m <= k * chunk + overlap] if k else [])
                tail.append([m for m in found if m >= (k + 1) * chunk] if not last else [])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], ["row", "k", "head", "tail"])

    seams = materialise(windows.select("row", "k", "last", "t").mapInArrow(marks, "row long, k long, head array<long>, tail array<long>"), "bpe-seams")
    following = seams.where("k > 0").select("row", (F.col("k") - 1).alias("k"), "head")
    # the windows' first common boundary behind the seam; where there is none, the whole text is encoded in one task
    met = seams.drop("head").join(following, ["row", "k"]).select("row", "k", F.array_min(F.array_intersect("head", "tail")).alias("end"))
    met = materialise(met, "bpe-met")
    alone = met.where("end is null").select("row").distinct()
    begins = met.select("row", (F.col("k") + 1).alias("k"), F.col("end").alias("begin"))
    parts = windows.join(alone, "row", "left_anti").join(met, ["row", "k"], "left").join(begins, ["row", "k"], "left")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern, key)
        for batch in batches:
            ids = []
            for k, t, begin, end in zip(batch.column("k").to_pylist(), texts(batch.column("t")), batch.column("begin").to_pylist(), batch.column("end").to_pylist(), strict=True):
                at = k * chunk
                ids.append(c.encode(t[(begin or 0) - at if k else 0 : None if end is None else end - at]))
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("row", "i", "k")], pa.array(ids, pa.binary())], ["row", "i", "k", "ids"])

    kind = long.schema["i"].dataType.simpleString()
    done = parts.select("row", "i", "k", "t", "begin", "end").mapInArrow(encoded, f"row long, i {kind}, k long, ids binary")

    def digested(table: pa.Table) -> pa.Table:
        c = codec(ranks, pattern, key)
        table = table.sort_by("k")
        n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
        for x in table.column("ids"):
            e = x.as_py()
            n += len(e) // 4
            ids.update(e)
            back.update(c.decode(e))
        return pa.table([table.column("i")[:1], pa.array([n], pa.int64()), pa.array([ids.hexdigest()]), pa.array([back.hexdigest()])], ["i", "n", "a", "b"])

    def whole(table: pa.Table) -> pa.Table:
        c = codec(ranks, pattern, key)
        table = table.sort_by("k")
        text = "".join(t if last else t[:chunk] for t, last in zip(texts(table.column("t").combine_chunks()), table.column("last").to_pylist(), strict=True))
        e = c.encode(text)
        return pa.table([table.column("i")[:1], pa.array([len(e) // 4], pa.int64()), pa.array([hashlib.sha256(e).hexdigest()]), pa.array([hashlib.sha256(c.decode(e)).hexdigest()])], ["i", "n", "a", "b"])

    form = f"i {kind}, n long, a string, b string"
    return done.groupBy("row").applyInArrow(digested, form).unionByName(windows.join(alone, "row", "left_semi").groupBy("row").applyInArrow(whole, form))


def encode_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, long_chunk: int = LONG_CHUNK, long_overlap: int = LONG_OVERLAP) -> DataFrame:
    """(id, n_tokens long, ids_sha256, decoded_sha256) of every row: encoded, decoded and digested in one pass.

    One row for each row of docs, repeated ones too; a null text is empty. A null id stays null. No shuffle, except for the
    windows of texts of more than `long` code points; long, long_chunk and long_overlap choose between ways to the same ids.
    """
    key = key_of(ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern, key)
        for batch in slices(batches, "t"):
            n, ids, back = [], [], []
            for x in texts(batch.column("t")):
                e = c.encode(x)
                n.append(len(e) // 4)
                ids.append(hashlib.sha256(e).hexdigest())
                back.append(hashlib.sha256(c.decode(e)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["i", "n", "a", "b"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    is_long = F.coalesce(F.length("t"), F.lit(0)) > long
    out = rows.where(~is_long).mapInArrow(run, f"i {kind}, n long, a string, b string")
    if rows.where(is_long).limit(1).count():
        out = out.unionByName(_long_digests(rows.where(is_long), ranks, pattern, key, long_chunk, long_overlap))
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")
