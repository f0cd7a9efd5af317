"""Near-duplicate documents by a MinHash LSH forest, confirmed on full shingle sets.

1. Each text becomes its set of word shingles, a digest of that set and a MinHash signature. Texts with equal sets form
   a class; only a class's representative, its smallest id, goes on. So exact copies cost one row each.
2. A forest of trees orders the signatures, each tree by a permutation of its own. Rows that agree in a tree's first
   DEPTH values are a region of that tree. A region of one row is dropped. In one of up to REGION rows all its rows are
   candidates of each other: their signatures are compared, as far as they are not joined yet. A more crowded region goes
   deeper: its rows are range-partitioned and sorted by the whole permuted signature, so that it spreads over partitions,
   and a row's candidates are the neighbours with the longest common prefix.
3. Candidates of the smaller regions whose signatures agree well enough are joined to tentative components.
4. A tentative component of few rows is searched exactly in one task, all its pairs, by an inverted index. Rows of larger
   ones and rows of crowded regions are searched together, however many they are: neighbours are confirmed first; then
   every pair that still crosses components and shares a shingle of both prefixes (rarest first) is compared. So what a
   crowd's neighbours miss is found there, and no link depends on REGION or on what a task may hold.
5. Confirmed links give the components; every member of a class has that of its representative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.llm.common import Memo, materialise, per_process, raw_texts, release, slices

#: Trees and values of a tree's own; the signature has TREES * DEPTH values.
TREES, DEPTH = 24, 4
VALUES = TREES * DEPTH
#: Rows of a region whose signatures are all compared; larger regions go deeper.
REGION = 256
#: Neighbours on a row's left in a crowded region of which the best is confirmed first; that only saves work.
NEAREST = 4
#: How far below the threshold the signatures' agreement may lie (over four standard deviations).
SLACK = 0.18
#: Rows and shingles of a tentative component that one task searches; larger ones are searched by all tasks.
TASK_ROWS, TASK_SHINGLES = 256, 1_000_000
#: Links that one task joins by a union-find.
LOCAL_EDGES = 200_000
#: Sets of one salt of a shingle's list, on average; and parts that any shingle's list is dealt into before it is sized.
MOST_LISTED, DEALT = 250, 16
#: Ids up to so many (32 bytes each with what is told of them) are broadcast to pick texts; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000

_rng = np.random.default_rng(20240101)
_FLIP = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)
_TIMES = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Order of the values in each tree: its own first.
_ORDERS = np.stack([np.concatenate([own := np.arange(DEPTH * t, DEPTH * (t + 1)), np.random.default_rng(t).permutation(np.setdiff1d(np.arange(VALUES), own))]) for t in range(TREES)])
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * _B
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes, width: int, memo: Memo) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text with fewer words has one shingle, one without words none."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    if n < width:
        out = np.full(1, np.uint64(n))
        for x in h:
            out = out * _A + x
        return _mixed(out)
    out = h[: n - width + 1].copy()
    for k in range(1, width):
        out = out * _A + h[k : n - width + 1 + k]
    return np.unique(_mixed(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):  # in blocks, so that a very long text needs no large matrix
        np.minimum(out, ((shingles[None, i : i + 4096] ^ _FLIP[:, None]) * _TIMES[:, None]).min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _memo() -> Memo:
    return per_process("shingle-words", lambda: Memo(xxhash.xxh3_64_intdigest, 150_000))


def _described(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n long, digest binary, c long, sig binary) of every row; the last three are null for an empty set. c: its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            n, digest, sig = [], [], []
            for t in raw_texts(batch.column("t")):
                s = shingle_set(t, width, _memo())
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            c = [None if d is None else int.from_bytes(d[:8], "little", signed=True) for d in digest]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(c, pa.int64()), pa.array(sig, pa.binary())], ["id", "n", "digest", "c", "sig"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("t")).mapInArrow(run, "id long, n long, digest binary, c long, sig binary")


def _tree_keys(reps: DataFrame) -> DataFrame:
    """(key long, id long, tree int): for each representative and tree the hash of the tree's own values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _signatures(batch.column("sig"))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for t in range(TREES):
                key = np.full(len(sig), np.uint64(t + 1))
                for k in _ORDERS[t, :DEPTH]:
                    key = _mixed(key * _A + sig[:, k])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids, pa.int64()), pa.array(np.full(len(ids), t, np.int32))], ["key", "id", "tree"])

    return reps.select("id", "sig").mapInArrow(run, "key long, id long, tree int")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, VALUES) if len(column) else np.zeros((0, VALUES), np.uint32)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width) if len(column) else np.zeros((0, width), np.uint8)


def _ordered(reps: DataFrame) -> DataFrame:
    """(id, low binary): the low byte of each value of a signature, which tells values apart as well as an estimate needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = _signatures(batch.column("sig")).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in low], pa.binary())], ["id", "low"])

    return reps.select("id", "sig").mapInArrow(run, "id long, low binary")


def _coded(rows: DataFrame) -> DataFrame:
    """(id, code) of rows (tree, id, low): the tree and the signature in the tree's order, as bytes that sort like them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = batch.column("tree").to_numpy(zero_copy_only=False)
            values = np.take_along_axis(_bytes(batch.column("low"), VALUES), _ORDERS[trees], 1)
            code = np.concatenate([trees.astype(np.uint8)[:, None], values], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in code], pa.binary())], ["id", "code"])

    return rows.select("tree", "id", "low").mapInArrow(run, "id long, code binary")


class _Sets:
    """Union-find over ids; the root is the smallest."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p] if p in up else p
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])


def _joined_regions(rows: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: links that join, in each region, all rows (key, id, low) whose signatures agree enough, directly or
    through others. rows are sorted by key, a region's in one partition; pairs that are joined already are not compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, low, label = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, VALUES), np.uint8), np.zeros(0, np.int64)
        named = 0
        for batch in batches:
            more = batch.num_rows
            new = len(key)
            key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
            ids = np.concatenate([ids, batch.column("id").to_numpy(zero_copy_only=False)])
            low = np.concatenate([low, _bytes(batch.column("low"), VALUES)])
            label = np.concatenate([label, np.arange(named, named + more)])
            named += more
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            begin = np.repeat(first, np.diff(np.append(first, len(key))))
            ends = np.repeat(np.append(first[1:], len(key)), np.diff(np.append(first, len(key))))
            right, found, away = np.arange(new, len(key)), [], 0
            while len(right):
                away += 1
                right = right[right - away >= begin[right]]
                apart = right[label[right] != label[right - away]]
                apart = apart[(low[apart] == low[apart - away]).mean(1) >= least]
                for x in apart.tolist():
                    if label[x] != label[x - away]:
                        part = label[begin[x] : ends[x]]
                        part[part == label[x]] = label[x - away]
                        found.append((x, x - away))
            if found:
                at, to = np.array(found).T
                yield _pairs(ids[at], ids[to])
            last = begin[-1] if len(key) else 0
            key, ids, low, label = key[last:], ids[last:], low[last:], label[last:]

    return rows.select("key", "id", "low").mapInArrow(run, "a long, b long")


def _nearest(rows: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: of each row of a crowd the neighbour on its left, in the sorted order (id, code) of any tree, that
    agrees best, if it agrees enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, code = np.zeros(0, np.int64), np.zeros((0, VALUES + 1), np.uint8)
        for batch in batches:
            new = len(ids)
            ids = np.concatenate([ids, batch.column("id").to_numpy(zero_copy_only=False)])
            code = np.concatenate([code, _bytes(batch.column("code"), VALUES + 1)])
            best, to = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            for away in range(1, min(NEAREST, len(ids) - 1) + 1):
                right = np.arange(max(new, away), len(ids))
                agree = (code[right, 1:] == code[right - away, 1:]).mean(1) * (code[right, : DEPTH + 1] == code[right - away, : DEPTH + 1]).all(1)
                better = agree > best[right]
                best[right[better]], to[right[better]] = agree[better], right[better] - away
            at = np.flatnonzero(best >= least)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[to[at]]), pa.array(best[at])], ["x", "y", "agreement"])
            ids, code = ids[-NEAREST:], code[-NEAREST:]

    found = rows.select("id", "code").mapInArrow(run, "x long, y long, agreement double")
    best = found.groupBy("x").agg(F.max(F.struct("agreement", "y")).alias("p"))
    return best.select(F.least("x", "p.y").alias("a"), F.greatest("x", "p.y").alias("b"))


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v): in each partition of edges (u, v) each id but the smallest of its component there, and that smallest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets()
        for batch in batches:
            for x, y in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                sets.join(x, y)
        found = np.array([(x, r) for x in list(sets.up) if (r := sets.root(x)) != x], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(links: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """(id, component): connected components of links (a, b), component being the smallest id; only linked ids are there.

    Links are counted first. Parts of up to `most` are joined by a union-find each; one part is all there is to do. More
    are joined by alternating large and small stars: each round is joins and minima over (id, id) rows, written to the
    shared folder.
    """
    links = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    parts = max(1, -(-links.count() // most))
    edges = materialise(_contracted(links.coalesce(1) if parts == 1 else links.repartition(parts)), "stars")
    release(links)
    seen = None
    while parts > 1:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        met = large.join(low, F.col("u") == F.col("w"))
        small = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        before, edges = edges, materialise(small.where("u <> v").distinct(), "stars")
        release(before)
        mark = tuple(edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _searched(members: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the members (tentative, id, s) of components that fit a task, from all their pairs' full sets."""

    def run(table: pa.Table) -> pa.Table:
        ids, order = np.unique(table.column("id").to_numpy(), return_index=True)  # a repeated row's set may come twice
        raw = table.column("s").to_pylist()
        sets = [np.frombuffer(raw[i], np.uint64) for i in order]
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        flat = np.concatenate(sets)
        by = np.argsort(flat, kind="stable")
        flat, owner = flat[by], owner[by]
        union = _Sets()
        for i, s in enumerate(sets):
            begin, end = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            n = end - begin
            # the places begin[k] .. end[k] of all k, one after the other
            at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
            inter = np.bincount(owner[at], minlength=len(sets))
            linked = np.flatnonzero(100 * inter >= percent * (size[i] + size - inter))
            for j in linked[linked > i].tolist():
                union.join(i, j)
        root = np.array([union.root(i) for i in range(len(ids))])
        return pa.table([pa.array(ids, pa.int64()), pa.array(ids[root], pa.int64())], ["id", "component"])

    return members.groupBy("tentative").applyInArrow(run, "id long, component long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough. A set travels once for each pair it is in."""
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * n >= percent * (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _crossing(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of sets of different groups (id, component) that may be similar enough, by a prefix filter.

    Two sets that are similar enough share one of the first n - ceil(n * percent / 100) + 1 shingles of each, all sets in
    one order, here the rarest first. Of a shingle's sets, those outside its largest group are held against all others,
    so a crowd that is one group already costs nothing. Long lists are salted, none is cut.

    Of the two sets, the one whose prefix ends first shares with the other's whole set no more of its prefix than both
    prefixes share, so they have at most those and the rest of that set, ceil(n * percent / 100) - 1, in common. Pairs for
    which that is too little go; so a few shingles in common, as any two texts of a crowd may have, make no candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column("id").to_pylist(), batch.column("s").to_pylist(), strict=True):
                h = np.frombuffer(x, np.int64)
                for k in range(0, len(h), 1 << 16):
                    part = h[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i)), pa.array(np.full(len(part), len(h))), pa.array(part)], ["id", "n", "h"])

    flat = materialise(sets.select("id", "s").mapInArrow(run, "id long, n long, h long"), "shingles")
    common = flat.groupBy("h").agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("c", "h"))
    least = F.expr(f"({percent} * n + 99) div 100")
    first = flat.join(common, "h").withColumn("place", place).where(F.col("place") <= F.col("n") - least + 1)
    first = materialise(first.where("c > 1").join(groups, "id", "left").select("id", "n", "h", F.coalesce("component", "id").alias("g")), "prefixes")
    release(flat)
    met = first.groupBy("h", "g").agg(F.count("*").alias("m")).groupBy("h").agg(F.max_by("g", F.struct("m", "g")).alias("top"), F.sum("m").alias("m"), F.count("*").alias("gs")).where("gs > 1")
    met = met.select("h", "top", F.ceil(F.col("m") / MOST_LISTED).cast("long").alias("salts"), F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("deal"))
    rows = first.withColumn("deal", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(DEALT)).cast("int")).join(met, ["h", "deal"]).drop("deal")
    few = rows.where("g <> top").select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("g").alias("gx"), "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    every = rows.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("g").alias("gy"), (F.col("g") == F.col("top")).alias("top"), "h", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"))
    likely = (F.col("gx") != F.col("gy")) & (F.col("top") | (F.col("x") < F.col("y"))) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    # each shingle that both prefixes hold gives one row of the pair
    pairs = few.join(every, ["h", "salt"]).where(likely).groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = pairs.agg(F.count("*").alias("m"), F.first(F.col("nx") + F.col("ny")).alias("both"), F.first(F.greatest("nx", "ny")).alias("n"))
    return pairs.where((F.col("m") + least - 1) * (100 + percent) >= percent * F.col("both")).select("a", "b")


def _large_components(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the linked ones of the sets (id, s), however many they are.

    pairs (a, b) only save work: sets that they already join need no comparing.
    """
    sets = sets.dropDuplicates(["id"])  # a repeated row's set may come twice
    links = materialise(_confirmed(pairs.distinct(), sets, percent), "confirmed")
    first = materialise(components(links), "first")
    return components(links.unionByName(_confirmed(_crossing(sets, first, percent), sets, percent)))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", region: int = REGION, task_rows: int = TASK_ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of docs.

    Two rows are linked where 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    smallest id that a row reaches by links, itself included, and kept holds where it is the row's own id. Null or empty
    texts, and texts without words, have the empty set and are linked with nothing. A row without an id has no
    component and is kept. Rows that repeat an id are each judged by their own text, so equal ones are kept together.
    region and task_rows choose between ways to the same links.
    """
    rows = materialise(_described(docs, id_col, text_col, width), "signatures")
    full = rows.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    reps = materialise(full.groupBy("digest").agg(F.min("id").alias("doc"), F.first("c").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "representatives")
    keys = _tree_keys(reps)
    met = keys.groupBy("key").count().where("count > 1").select("key", (F.col("count") > region).alias("crowded"))
    alive = materialise(keys.join(met, "key").join(_ordered(reps), "id").select("key", "tree", "id", "low", "crowded"), "met")
    least = percent / 100 - SLACK
    near = _joined_regions(alive.where("not crowded").repartition("key").sortWithinPartitions("key"), least)
    near = materialise(near, "neighbours")
    crowd = materialise(alive.where("crowded").select("id").distinct(), "crowd")
    nearest = None
    if crowd.limit(1).count():
        nearest = materialise(_nearest(_coded(alive.where("crowded")).repartitionByRange("code").sortWithinPartitions("code"), least), "nearest")
    release(alive)
    tentative = components(near)
    lone = crowd.join(tentative.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    placed = tentative.unionByName(lone).join(reps.select("id", "doc", "n"), "id").join(crowd.withColumn("crowded", F.lit(True)), "id", "left")
    placed = materialise(placed.select("id", "doc", "n", "component", F.coalesce("crowded", F.lit(False)).alias("crowded")), "placed")
    sized = placed.groupBy(F.col("component").alias("tentative")).agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.max("crowded").alias("any"))
    fits = (F.col("shingles") <= TASK_SHINGLES) & (F.col("members") <= task_rows) & ~F.col("any")
    places = materialise(placed.join(sized, F.col("component") == F.col("tentative")).select("id", "doc", "tentative", fits.alias("fits")), "places")
    sets = materialise(_shingle_sets(docs, places, id_col, text_col, width), "sets")
    found = _searched(sets.where("fits").select("tentative", "id", "s"), percent)
    large = places.where(~F.col("fits")).select("id")
    if large.limit(1).count():
        inside = near.join(large.select(F.col("id").alias("a")), "a")
        inside = inside if nearest is None else inside.unionByName(nearest)
        found = found.unionByName(_large_components(inside, sets.where(~F.col("fits")).select("id", "s"), percent))
    found = materialise(found.distinct(), "components")
    for table in (near, crowd, placed, places, sets):
        release(table)
    named = reps.select("id", "doc", "digest").join(found, "id", "left").select("doc", "digest", F.coalesce("component", "id").alias("group"))
    least_id = named.groupBy("group").agg(F.min("doc").alias("component"))
    out = rows.join(named.join(least_id, "group").select("digest", "component"), "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _shingle_sets(docs: DataFrame, places: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, tentative, fits, s binary): the places (id, doc, tentative, fits) of classes, each with its sorted full set, from
    the text of its document read again. An id may be several documents' and so several classes'; each has its own set."""
    rows = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("t"))
    small = F.broadcast if places.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else (lambda x: x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            found = [shingle_set(t, width, _memo()).tobytes() for t in raw_texts(batch.column("t"))]
            own = [bool(s) and int.from_bytes(xxhash.xxh3_128_digest(s)[:8], "little", signed=True) == i for s, i in zip(found, batch.column("id").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tentative"), batch.column("fits"), pa.array(found, pa.binary())], ["id", "tentative", "fits", "s"])
            yield out.filter(pa.array(own, pa.bool_()))

    met = rows.join(small(places), "doc").select("id", "tentative", "fits", "t")
    return met.mapInArrow(run, "id long, tentative long, fits boolean, s binary")
