"""Exact top-k inner products with a ball tree for each shard.

Vectors are integers. The candidates are dealt to the nearest of a bounded number of centres, which a pilot of candidates
gives, and the rows of a centre into shards of bounded size. A shard's task builds its ball tree and searches it for the
queries that come to it, visiting the child with the greater upper bound q.c + |q| r first and leaving out a query where
the bound of a node does not reach its kth score. That kth score is shared: the pilot starts it, a first search in one
shard of the centre with the greatest bound raises it, and a query then goes only to centres whose bound reaches it; within
a shard it rises as leaves are scored. Queries stream through a shard, so memory holds its rows only. Each shard gives k
rows for a query, and the shards' rows are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.llm.common import materialise

SHARD_ROWS, PILOT_ROWS, LEAF_ROWS = 8192, 1024, 128
#: Queries of a block. A shard's rows are copied for each block of queries, so few are, and a crowded shard's queries spread.
BLOCK_ROWS = 1 << 17
#: Queries that are searched at once: a leaf visit computes at most SEARCH_ROWS * LEAF_ROWS products.
SEARCH_ROWS = 4096
#: Centres at most, and groups of (shard, block) that have a partition of their own.
MOST_CENTRES, MOST_PARTITIONS = 256, 1 << 14


class BallTree:
    """Nodes (centre, radius, least id, rows or children) over integer vectors, held as doubles."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS) -> None:
        self.x, self.ids, self.leaf = x.astype(np.float64), ids, leaf
        self.nodes: list[tuple] = []
        if len(ids):
            self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> int:
        stack: list[tuple[np.ndarray, int, int]] = [(rows, -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            centre = self.x[rows].mean(0)
            away = np.sqrt(((self.x[rows] - centre) ** 2).sum(1))
            number = len(self.nodes)
            children: list[int] = [-1, -1]
            self.nodes.append((centre, float(away.max()), int(self.ids[rows].min()), rows, children))
            if parent >= 0:
                self.nodes[parent][4][side] = number
            if len(rows) <= self.leaf:
                continue
            a = self.x[rows[away.argmax()]]
            far = ((self.x[rows] - a) ** 2).sum(1)
            b = self.x[rows[far.argmax()]]
            along = self.x[rows] @ (b - a)
            order = np.argsort(along, kind="stable")
            half = len(rows) // 2
            # equal vectors split by position, so that a leaf is bounded whatever repeats
            stack.append((rows[order[:half]], number, 0))
            stack.append((rows[order[half:]], number, 1))
        return 0

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (rows: queries, best first, ties to smaller ids) of the k best rows whose id is not the query's own.

        floor: a score that at least k other rows are known to reach; absent places hold score -inf.
        """
        q = q.astype(np.float64)
        length = np.sqrt((q * q).sum(1))
        best = np.full((len(q), k), -np.inf)
        who = np.full((len(q), k), np.iinfo(np.int64).max)
        if not self.nodes:
            return best, who

        def bound(node: tuple, at: np.ndarray) -> np.ndarray:
            return _raised(q[at] @ node[0] + length[at] * node[1])

        stack = [(0, np.arange(len(q)), bound(self.nodes[0], np.arange(len(q))))]
        while stack:
            number, at, top = stack.pop()
            _, _, least, rows, children = self.nodes[number]
            # the bound must reach the kth score; where it only equals it, a smaller id must be possible
            kth = best[at, -1]
            alive = (np.floor(top) > kth) | ((np.floor(top) == kth) & (least < who[at, -1]))
            alive &= np.floor(top) >= floor[at]
            at = at[alive]
            if not len(at):
                continue
            if children[0] < 0:
                score = q[at] @ self.x[rows].T
                score[own[at][:, None] == self.ids[rows][None, :]] = -np.inf
                score = np.concatenate([best[at], score], axis=1)
                names = np.concatenate([who[at], np.broadcast_to(self.ids[rows], (len(at), len(rows)))], axis=1)
                order = np.lexsort((names, -score), axis=1)[:, :k]
                best[at] = np.take_along_axis(score, order, 1)
                who[at] = np.take_along_axis(names, order, 1)
                continue
            bounds = [bound(self.nodes[c], at) for c in children]
            first = int(bounds[1].sum() > bounds[0].sum())
            stack.append((children[1 - first], at, bounds[1 - first]))
            stack.append((children[first], at, bounds[first]))
        return best, who


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, v array<int>): floor(256 * x) of each component; rows with a null or non-finite one, and null ids, are left out."""
    v = df[vector_col]
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.where(df[id_col].isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return rows.select(df[id_col].cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a column as rows of doubles, short ones padded with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.float64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _centres(x: np.ndarray, number: int, rounds: int = 4) -> np.ndarray:
    """At most `number` centres of the rows of x: far ones first, then moved to the means of the rows nearest to them."""
    away = np.full(len(x), np.inf)
    at = [0]
    while len(at) <= number:
        away = np.minimum(away, ((x - x[at[-1]]) ** 2).sum(1))
        if len(at) == number or away.max() == 0:
            break
        at.append(int(away.argmax()))
    centres = x[at]
    for _ in range(rounds):
        near = _nearest(x, centres)
        there = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(there[:, None] > 0, sums / np.maximum(there, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)


def _raised(x: np.ndarray) -> np.ndarray:
    """Bounds above what rounding may take away."""
    return x + 1e-9 * (1.0 + np.abs(x))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank int, id, score long): for each row whose id is divisible by `every` the k rows of greatest inner product.

    Ties go to the smaller id. Rows that repeat a query's id are the query itself and no candidates; a query id that
    repeats is asked once, with its smallest vector. Other repeated vectors are candidates each. Fewer than k candidates
    give fewer rows; an empty table none. Vectors of differing lengths are compared over the longest, short ones padded
    with zeros. Scores are exact while sums stay below 2^53.
    """
    rows = materialise(quantised(vectors, id_col, vector_col), "vectors")
    width, total, asked = rows.select(F.max(F.size("v")), F.count("*"), F.count(F.when(F.col("id") % every == 0, 1))).first()
    if not asked:
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    # a bounded pilot, the same for all: any candidates give each query a kth score to start from. They are drawn by
    # their hash; ordering all rows by it would send every partition's first rows to one task
    drawn = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, PILOT_ROWS / total)))
    pilot_rows = rows.where(drawn).limit(4 * PILOT_ROWS).toArrow().combine_chunks()
    pilot = _matrix(pilot_rows.column("v").combine_chunks(), width), pilot_rows.column("id").to_numpy().astype(np.int64)
    centres = _centres(pilot[0], min(MOST_CENTRES, -(-total // shard_rows))) if len(pilot[1]) else np.zeros((1, width))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            near = _nearest(x, centres)
            away = np.sqrt(((x - centres[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near), pa.array(away), pa.array(number + np.arange(len(x)))], ["id", "v", "centre", "away", "number"])
            number += len(x)

    placed = rows.mapInArrow(place, "id long, v array<long>, centre long, away double, number long")
    counts, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for at, n, away in placed.groupBy("centre").agg(F.count("*"), F.max("away")).collect():
        counts[at], radius[at] = n, away
    parts = -(-counts // shard_rows)
    low = np.cumsum(parts) - parts
    of_centre = F.element_at(F.array(*[F.struct(F.lit(int(a)).alias("low"), F.lit(int(b)).alias("parts")) for a, b in zip(low, parts, strict=True)]), F.col("centre").cast("int") + 1)
    shards, blocks = int(parts.sum()), -(-asked // block_rows)
    # rows are dealt by their number, not their id, so that repeated ids spread too
    shard = of_centre["low"] + F.pmod(F.xxhash64("number"), of_centre["parts"])
    candidates = placed.select(shard.cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "id", "v", F.lit(0.0).alias("floor"))

    def reached(x: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores at each centre's rows."""
        bound = _raised(x @ centres.T + np.sqrt((x * x).sum(1))[:, None] * radius)
        bound[:, counts == 0] = -np.inf
        return bound

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = BallTree(*pilot, leaf_rows)
        for batch in batches:
            own, x = batch.column("id").to_numpy(), _matrix(batch.column("v"), width)
            best, _ = tree.search(x, own, k, np.full(len(own), -np.inf))
            centre = reached(x).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(best[:, -1]), pa.array(low[centre] + own % parts[centre], pa.int32())], ["id", "v", "floor", "shard"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.floor(reached(_matrix(batch.column("v"), width))) >= batch.column("floor").to_numpy()[:, None]
            ends = pa.array(np.append(0, np.cumsum(wanted.sum(1))), pa.int32())
            at = np.nonzero(wanted)[1]
            spans = pa.StructArray.from_arrays([pa.array(low[at], pa.int32()), pa.array(low[at] + parts[at] - 1, pa.int32())], ["low", "high"])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("floor"), pa.ListArray.from_arrays(ends, spans)], ["id", "v", "floor", "spans"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, tree = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("shard", "block", "kind")], 1).reshape(-1, 3)
            cuts = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(key)) if len(key) else np.zeros(1, int)
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if here != tuple(key[begin][:2]):
                    here, held, tree = tuple(key[begin][:2]), [], None
                for i in range(begin, end, SEARCH_ROWS):
                    part = batch.slice(i, min(SEARCH_ROWS, end - i))
                    x, ids = _matrix(part.column("v"), width), part.column("id").to_numpy()
                    if not key[begin][2]:
                        held.append((x, ids.copy()))
                        continue
                    if tree is None:
                        xs, names = zip(*held, strict=True) if held else ((np.zeros((0, width)),), (np.zeros(0, np.int64),))
                        tree, held = BallTree(np.concatenate(xs), np.concatenate(names), leaf_rows), []
                    best, who = tree.search(x, ids, k, part.column("floor").to_numpy())
                    there = np.isfinite(best)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, there.sum(1))), pa.array(who[there]), pa.array(best[there].astype(np.int64))], ["query_id", "id", "score"])

    def searched(queries: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int").alias("block")
        both = candidates.unionByName(queries.select("shard", block, F.lit(1).alias("kind"), "id", "v", "floor"))
        spread = both.repartitionById(min(shards * blocks, MOST_PARTITIONS), (F.col("shard") * blocks + F.col("block")) % MOST_PARTITIONS)
        return spread.sortWithinPartitions("shard", "block", "kind").mapInArrow(search, "query_id long, id long, score long")

    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).mapInArrow(start, "id long, v array<long>, floor double, shard int")
    queries = materialise(queries, "queries") if shards > 1 else queries
    if shards > 1:  # one shard is searched once
        kth = searched(queries).groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("kth"))
        queries = queries.join(kth, "id", "left").select("id", "v", F.greatest("floor", F.coalesce("kth", F.lit(float("-inf")))).alias("floor"))
    queries = queries.select("id", "v", "floor").mapInArrow(route, "id long, v array<long>, floor double, spans array<struct<low: int, high: int>>")
    queries = queries.select("id", "v", "floor", F.explode("spans").alias("s")).select("id", "v", "floor", F.explode(F.sequence("s.low", "s.high")).alias("shard"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return searched(queries).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
