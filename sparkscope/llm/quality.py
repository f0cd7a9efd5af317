"""Quality rules whose cutoffs carry a risk guarantee.

Each rule rejects a text whose measure lies above a cutoff. In each stratum one half of the labelled texts, by a hash of
the id, lays out a path: from no rejection on, step by step the one cutoff is lowered that rejects the most bad texts
for the good ones it costs, as long as that pays. The other half certifies how far to go. Steps only add rejections, so
they are tested from the first on, in fixed sequence: each test asks, by the exact binomial tail, whether all rules
together reject fewer than the allowed share of good texts. The first test that fails ends the sequence, so within a
stratum no further correction is due; across strata the level is divided by their number (Bonferroni). With confidence
1 - delta, then, in every stratum at once the rules together reject at most the share alpha of good texts. A stratum with
too few labels for the first test rejects nothing by learned rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.llm.common import log_binomial_cdf, materialise, raw_texts, slices

#: Rules: name and grid of cutoffs, strictest first.
RULES: dict[str, list[float]] = {
    "symbol_share": [i / 200 for i in range(1, 101)],
    "punctuation_share": [i / 100 for i in range(5, 101)],
    "upper_share": [i / 100 for i in range(5, 100)],
    "dup_line_share": [i / 50 for i in range(1, 50)],
    "repeat_word_share": [i / 100 for i in range(2, 100)],
    "mean_word_chars": [6.0 + i / 2 for i in range(80)],
}
#: A step of a path must reject so many times more of the bad texts than of the good ones, as shares.
PAYS = 20.0
#: Strata up to this many (some 2 KB each) are broadcast with their cutoffs; more are joined by a shuffle.
MOST_BROADCAST = 10_000

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Number of words that lie in a window of width words which the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    key = ids[:n].copy()
    for k in range(1, width):
        # the keys so far are renumbered, so a product of two word counts never overflows
        if k > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(names) + ids[k : n + k]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words), bool)
    for k in range(width):
        cover[k : n + k] |= twice
    return int(cover.sum())


def measures(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, punctuation, upper case, letters."""
    words = text.split()
    word_chars = len(text.translate(None, _SPACE + _CONTINUATION))
    symbols = sum(map(text.count, (_SYMBOLS[i : i + 1] for i in range(len(_SYMBOLS)))))
    seen: set[bytes] = set()
    lines = dups = 0
    for line in text.split(b"\n"):
        if line and line.translate(None, _SPACE):
            lines += 1
            dups += line in seen
            seen.add(line)
    letters = len(text) - len(text.translate(None, _LETTERS))
    return len(words), word_chars, symbols, dups, repeated_words(words), lines, len(text) - len(text.translate(None, _PUNCT)), len(text) - len(text.translate(None, _UPPER)), letters


def rule_values(m: tuple) -> list[float]:
    words, chars, symbols, dups, repeats, lines, punct, upper, letters = m
    if not words:
        return [0.0] * len(RULES)
    return [symbols / chars, punct / chars, upper / letters if letters else 0.0, dups / lines, repeats / words, chars / words]


def measure(docs: DataFrame, stratum_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stratum, counts..., bins array<int>): bins hold for each rule the number of its cutoffs below the text's value.

    A null text counts as empty: all counts 0. One row for each row of docs; no shuffle.
    """
    grids = [np.array(g) for g in RULES.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            found = [measures(x) for x in raw_texts(batch.column("t"))]
            values = np.array([rule_values(m) for m in found])
            bins = np.stack([np.searchsorted(g, values[:, k], "left") for k, g in enumerate(grids)], axis=1).astype(np.int32)
            counts = [pa.array([m[k] for m in found], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("g"), *counts, pa.array(list(bins), pa.list_(pa.int32()))], ["i", "g", "w", "c", "s", "d", "r", "b"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("i"), docs[stratum_col].cast("string").alias("g"), docs[text_col].alias("t"))
    return rows.mapInArrow(run, f"i {kind}, g string, w long, c long, s long, d long, r long, b array<int>").toDF("id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "bins")


def path(good: list[list[int]], bad: list[list[int]]) -> list[tuple[int, int]]:
    """Steps (rule, cutoff index), each of which lowers a rule's cutoff; from the counts of texts by rule and bin.

    Greedy: the step with the most bad texts for its good ones, as shares; ties go to the first rule, then the smaller step.
    """
    total_good, total_bad = max(map(sum, good), default=0), max(map(sum, bad), default=0)
    now = [len(x) - 1 for x in bad]
    steps: list[tuple[int, int]] = []
    while total_bad:
        best, step = PAYS, None
        for rule, top in enumerate(now):
            cost = gain = 0
            for cut in range(top - 1, -1, -1):  # bins above cut, up to top, would be rejected too
                cost, gain = cost + good[rule][cut + 1], gain + bad[rule][cut + 1]
                pays = gain / total_bad * (total_good + 1) / (cost + 1)
                if bad[rule][cut + 1] and pays > best:
                    best, step = pays, (rule, cut)
        if step is None:
            break
        now[step[0]] = step[1]
        steps.append(step)
    return steps


def certified_steps(rejected: list[int], n: int, allowed: float, level: float) -> int:
    """Number of steps, of a path, that are certified. rejected[i]: good texts, of n, that steps 0 to i reject (rising in i)."""
    for i, x in enumerate(rejected):
        if n == 0 or log_binomial_cdf(x, n, allowed) > math.log(level):
            return i
    return len(rejected)


def _paths(labelled: DataFrame) -> DataFrame:
    """(stratum, steps int, first array<array<int>>): the length of each stratum's path, and for each rule and bin the first
    step, from 1, that rejects it; steps + 1 if none does. labelled: (stratum, bins, good 0/1).

    Counts are aggregated before, so a stratum's rows are one for each rule and bin, however many texts it has.
    """
    cells = labelled.select("stratum", "good", F.posexplode("bins").alias("rule", "bin")).groupBy("stratum", "rule", "bin").agg(F.sum("good").alias("good"), F.count("*").alias("n"))

    def run(table: pa.Table) -> pa.Table:
        good, bad = ([[0] * (len(g) + 1) for g in RULES.values()] for _ in range(2))
        for rule, b, g, n in zip(*(table.column(c).to_pylist() for c in ("rule", "bin", "good", "n")), strict=True):
            good[rule][b], bad[rule][b] = g, n - g
        steps = path(good, bad)
        first = [[len(steps) + 1] * len(x) for x in good]
        for k, (rule, cut) in reversed(list(enumerate(steps))):
            for b in range(cut + 1, len(first[rule])):
                first[rule][b] = k + 1
        return pa.table([table.column("stratum")[:1], pa.array([len(steps)], pa.int32()), pa.array([first], pa.list_(pa.list_(pa.int32())))], ["stratum", "steps", "first"])

    return cells.groupBy("stratum").applyInArrow(run, "stratum string, steps int, first array<array<int>>")


def _first_step(bins: Column, first: Column) -> Column:
    """The first step that rejects a text."""
    return F.array_min(F.zip_with(bins, first, lambda b, f: F.get(f, b)))


def _joined(rows: DataFrame, paths: DataFrame, few: bool) -> DataFrame:
    other = paths.withColumnRenamed("stratum", "of_stratum")
    return rows.join(F.broadcast(other) if few else other, F.col("stratum").eqNullSafe(F.col("of_stratum")), "left").drop("of_stratum")


def certify(labelled: DataFrame, alpha: float, delta: float) -> tuple[DataFrame, bool]:
    """(stratum, first, taken): the path of each stratum that has labels, and the number of its certified steps; and whether
    they are few enough to broadcast. labelled: (id, stratum, bins, good 0/1). One number, that of strata, reaches the driver.
    """
    half = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(29)), F.lit(2))
    paths = materialise(_paths(labelled.where(half == 0)), "quality-paths")
    strata = paths.count()
    level = delta / max(1, strata)
    tested = _joined(labelled.where((half == 1) & (F.col("good") == 1)), paths, strata <= MOST_BROADCAST).where("steps > 0")
    counts = tested.groupBy("stratum", "steps", _first_step(F.col("bins"), F.col("first")).alias("step")).count()

    def run(table: pa.Table) -> pa.Table:
        steps = table.column("steps")[0].as_py()
        by = dict(zip(table.column("step").to_pylist(), table.column("count").to_pylist(), strict=True))
        rejected = np.cumsum([by.get(k + 1, 0) for k in range(steps)]).tolist()
        return pa.table([table.column("stratum")[:1], pa.array([certified_steps(rejected, sum(by.values()), alpha, level)], pa.int32())], ["stratum", "taken"])

    taken = counts.groupBy("stratum").applyInArrow(run, "stratum string, taken int").withColumnRenamed("stratum", "s")
    out = paths.join(taken, F.col("stratum").eqNullSafe(F.col("s")), "left").select("stratum", "first", F.coalesce("taken", F.lit(0)).alias("taken"))
    return out, strata <= MOST_BROADCAST


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.06, delta: float = 0.05, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", good_col: str = "quality") -> DataFrame:
    """Base measures of every row of docs and the verdict of the certified rules.

    labels (id, good 0/1): a label of several rows is good if any is; null ids or labels are left out. The guarantee is
    that of the module's text, by stratum_col (null is a stratum of its own). Texts: null is empty, so it fails the base
    rule. A value equal to a cutoff is not rejected. One row for each row of docs, repeated rows too; empty docs or labels
    give no row, or no learned cutoff.
    """
    rows = materialise(measure(docs, stratum_col, id_col, text_col), "quality")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = labels.where(labels[id_col].isNotNull() & labels[good_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.max((labels[good_col] == 1).cast("int")).alias("good"))
    labelled = materialise(rows.where(~base).select("id", "stratum", "bins").join(known, "id"), "quality-labelled")
    paths, few = certify(labelled, alpha, delta)
    out = _joined(rows, paths, few)
    rejected = F.coalesce(_first_step(F.col("bins"), F.col("first")) <= F.col("taken"), F.lit(False))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~rejected).alias("kept"))
