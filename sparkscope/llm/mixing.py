"""Mixing sources to target weights by capped water-filling.

Sources share the corpus's size by weight. A source's target stops at most_epochs times its own size; what is cut off
is shared again by weight among the others until no target is above its cap. The mix then takes each source in whole
repetitions and one fractional repetition: the documents in a seeded order, up to the word at which the target is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.llm.common import WORD_PATTERN, materialise

#: Sources up to this many are broadcast with their targets; more are joined by a shuffle.
MOST_BROADCAST = 50_000
#: Bits of the hash that are dropped at each level of the search for the place where the fractional repetition ends: two
#: levels look at 4096 slices of a source each, the last one at the hashes themselves.
LEVELS = (52, 40, 0)
_GOAL = "source string, source_size long, target double, whole long, part long"


def water_fill(sizes: list[int], weights: list[float], most_epochs: float, total: int | None = None) -> list[float]:
    """Targets by weight, at most most_epochs times each size, that sum up to total (all sizes, if None) or to all caps."""
    total = sum(sizes) if total is None else total
    caps = [most_epochs * s for s in sizes]
    targets = [0.0] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        rest = total - sum(caps[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i] for i in free)
        over = {i for i in free if rest * weights[i] / weight > caps[i]}
        if not over:
            for i in free:
                targets[i] = rest * weights[i] / weight
            break
        for i in over:
            targets[i] = float(caps[i])
        free -= over
    return targets


def source_goals(sizes: DataFrame, weights: tuple[float, ...], most_epochs: float) -> list[tuple]:
    """(source, source_size, target, whole repetitions, words of the fractional one), null last; weights repeat in code-point order.

    The number of sources is what reaches the driver.
    """
    rows = [tuple(r) for r in sizes.orderBy(F.col("source").asc_nulls_last()).collect()]
    targets = water_fill([n for _, n in rows], [weights[i % len(weights)] for i in range(len(rows))], most_epochs)
    return [(s, n, t, *(divmod(round(t), n) if n else (0, 0))) for (s, n), t in zip(rows, targets, strict=True)]


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) of every row of docs: the words that the mix takes of it, repeats counted.

    size: words of the text, 0 if it is null or empty; such a row takes nothing. A null source is a source. A source's
    taken words sum up to its target, rounded. Within a source rows follow the hash of id, text and seed; rows equal in
    both share what they take in an order that cannot show. Reruns agree.

    The texts are read once. Within a source, the end of the fractional repetition is found level by level over sums of
    slices of the hash, so no task ever holds a source: a source of any size contributes few sums to a level.
    """
    return _mixed(docs, weights, most_epochs, seed, id_col, text_col, source_col, []).withColumnRenamed("id", id_col)


def mixture(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, each repeated as often as mix() takes it, columns as in docs.

    A row that is taken in part holds its first words, single spaces between them. Rows without words are not taken. The
    texts are read twice and neither shuffled nor copied between.
    """
    columns = docs.columns
    taken = _mixed(docs, weights, most_epochs, seed, id_col, text_col, source_col, columns).where("taken > 0")
    copy = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))
    text = F.col(f"k{columns.index(text_col)}")
    words = F.col("taken") - (F.col("copy") - 1) * F.col("size")  # left for this copy
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)), F.lit(1), words.cast("int")), " ")
    out = taken.withColumn("copy", copy).withColumn("part", F.when(words < F.col("size"), part).otherwise(text))
    return out.select(*[(F.col("part") if c == text_col else F.col(f"k{i}")).alias(c) for i, c in enumerate(columns)])


def _attached(rows: DataFrame, small: list[tuple], schema: str) -> DataFrame:
    """rows with the other columns of a table of sources, by source; rows of other sources are dropped."""
    other = rows.sparkSession.createDataFrame(small, schema).withColumnRenamed("source", "of_source")
    if len(small) <= MOST_BROADCAST:
        other = F.broadcast(other)
    return rows.join(other, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")


def _edges(rows: DataFrame, goals: list[tuple]) -> list[tuple]:
    """(source, edge, left, rows): of each source the hash in whose rows the fractional repetition ends, the words that are
    left for those rows, and their number. A source without a fractional repetition has none."""
    found, above = [(s, 0, part, 0) for s, _, _, _, part in goals if part], None
    for shift in LEVELS:
        inside = _attached(rows, found, "source string, edge long, left long, rows long")
        if above is not None:
            inside = inside.where(F.shiftright("h", above) == F.col("edge"))
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("slice")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.first("left").alias("left"))
        before = F.sum("n").over(Window.partitionBy("source").orderBy("slice")) - F.col("n")
        sums = sums.withColumn("before", before).where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("n") > F.col("left")))
        found, above = [tuple(r) for r in sums.select("source", "slice", F.col("left") - F.col("before"), "rows").collect()], shift
    return found


def _ranked(ties: DataFrame) -> DataFrame:
    """ties with rank, a number from 0 in each source: rows are numbered in each of their partitions, then partitions are added up."""
    ties = materialise(ties.withColumn("u", F.monotonically_increasing_id()).withColumn("partition", F.shiftright("u", 33)), "mix-ties")
    sizes = ties.groupBy("source", "partition").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("source").orderBy("partition")) - F.col("n")
    sizes = sizes.select(F.col("source").alias("of_source"), F.col("partition").alias("of_partition"), ahead.alias("ahead"))
    own = F.row_number().over(Window.partitionBy("source", "partition").orderBy("u")) - 1
    placed = ties.withColumn("own", own).join(sizes, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("partition") == F.col("of_partition")))
    return placed.withColumn("rank", F.col("own") + F.col("ahead"))


def _mixed(docs: DataFrame, weights: tuple[float, ...], most_epochs: int, seed: int, id_col: str, text_col: str, source_col: str, keep: list[str]) -> DataFrame:
    """Columns id, size, source_size, target and taken of mix(), then the columns keep of docs as k0, k1, ..."""
    kept = [f"k{i}" for i in range(len(keep))]
    text = F.coalesce(docs[text_col], F.lit(""))
    computed = docs.select(
        *[docs[c].alias(k) for c, k in zip(keep, kept, strict=True)],
        docs[id_col].alias("id"),
        docs[source_col].cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"),
        F.xxhash64(F.coalesce(docs[id_col].cast("string"), F.lit("\x00")), text, F.lit(seed)).alias("h"),
    )
    narrow = materialise(computed.select("id", "source", "size", "h"), "mix")
    goals = source_goals(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_epochs)
    edges = {s: (e, left, n) for s, e, left, n in _edges(narrow, goals)}
    schema = _GOAL + ", edge long, left long, tied boolean"
    table = [(*g, *(edges[g[0]][:2] if g[0] in edges else (None, 0)), g[0] in edges and edges[g[0]][2] > 1) for g in goals]
    rows = _attached(computed if keep else narrow, table, schema)
    out = [*kept, "id", "size", "source_size", "target"]
    whole = F.col("whole") * F.col("size")

    def taken(left: Column) -> Column:
        inside = F.greatest(F.lit(0), F.least("size", left))
        return (whole + F.when(F.col("h") < F.col("edge"), F.col("size")).when(F.col("h") == F.col("edge"), inside).otherwise(0)).cast("long").alias("taken")

    if not any(x[-1] for x in table):
        return rows.select(*out, taken(F.col("left")))
    tied = F.coalesce(F.col("tied") & (F.col("h") == F.col("edge")), F.lit(False))
    alone = rows.where(~tied).select(*out, taken(F.col("left")))
    return alone.unionByName(_ranked(rows.where(tied)).select(*out, taken(F.col("left") - F.col("rank") * F.col("size"))))
