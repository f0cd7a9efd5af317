"""Language-model scores from a log-bilinear model with noise-contrastive estimation.

A word is known by a 64-bit hash. Units are the end of a text, its beginning, every word whose training count is at least
the root of the number of training tokens over ROOT_SHARE, and units that the rarer words share by the hash of their
endings, so that a shared unit's words are alike in language and form. The vocabulary with vectors of its own grows with
the corpus, about as the root of its tokens. The model predicts the next unit from the
two before it: the prediction vector is the sum of each context unit's vector, scaled by a vector for its place. Units are
grouped by frequency into classes; P(unit) is P(class) P(unit | class), and each factor is a softmax of inner products
with output vectors plus biases, normalised exactly over few terms. A word of a shared unit has, within it, its smoothed
share of the unit's training count.

Every training text's unit triples are counted, in shards by their contexts, so that a triple's whole count is in one
shard. A shard's task takes noise-contrastive gradients over all of its triples, each weighted by its count: a pass takes
every training token once, none is drawn or left out. Few tokens are passed more often, see LEAST_STEPS. Shards start from the same
parameters, and theirs are averaged, in a few rounds. The
log-probability of a word outside the most frequent ones needs its count, which is joined: no vocabulary of unbounded size
is broadcast.
"""

from __future__ import annotations

import copy
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope.llm.common import give_back, hold_pages, materialise, release, slices

#: Units: end, begin, those that rare words share, then words of their own.
END_UNIT, BEGIN_UNIT, SHARED_UNITS = 0, 1, 256
FIRST_WORD = 2 + SHARED_UNITS
#: A word has a unit of its own from a count of sqrt(training tokens) / ROOT_SHARE on, at least two.
ROOT_SHARE = 16
DIMENSIONS = 24
#: Noise classes of a batch of triples, and noise words of each class in it.
NOISE_CLASSES, NOISE_WORDS = 64, 16
#: Rows of a training step, training tokens that a row stands for at most, and steps at least of a shard where there are
#: eight; of more shards each takes at least its part of as many. A triple of count n has ceil(n / TOKENS_A_DRAW) rows or more.
BATCH, TOKENS_A_DRAW, LEAST_STEPS = 16384, 6, 64
#: Shards of each round of training, by the shard's number modulo 8.
ROUNDS = ((0,), (1, 2, 3), (4, 5, 6, 7))
#: Counts of so many words (16 bytes each) go to every task; the counts of all others are joined.
FREQUENT = 1 << 18
#: Rows of a parameter that are averaged over a round's shards at once: 24 KB of each shard.
CHUNK = 256
#: Bytes of texts whose tokens a task holds at once.
BATCH_BYTES = 3 << 20
END = -(1 << 62) + 12345  # stands for the end of a text among the hashes
#: Tokens whose counts a task holds before it hands them on, and those of a shard at least.
MOST_PENDING, SHARD_TOKENS = 1 << 21, 1 << 20


def _digest(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


#: A word of up to SHORT bytes hashes to the sum of its bytes' values, each times a power by its place; longer ones by xxhash.
#: So many bytes are hashed at once, or the words that begin in them.
SHORT, BYTES_AT_ONCE = 256, 1 << 16
IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
VALUES = np.array([_digest(bytes([b])) for b in LOWER], np.uint64)
POWER = _digest(b"power") | 1
POWERS = np.multiply.accumulate(np.array([1] + [POWER] * (BYTES_AT_ONCE + SHORT), np.uint64))
BACK = np.multiply.accumulate(np.array([1] + [pow(POWER, -1, 1 << 64)] * BYTES_AT_ONCE, np.uint64))
SPREAD = np.uint64(_digest(b"spread") | 1)


@functools.cache
def _endings() -> np.ndarray:
    """The lowest bits of a word's hash by its last two bytes, 256 * first + second; first is 256 for a word of one byte."""
    names = [bytes([a, b]) for a in range(256) for b in range(256)] + [bytes([b]) for b in range(256)]
    return np.array([_digest(x) & (SHARED_UNITS - 1) for x in names], np.uint64)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word data[start:end], A-Z as a-z; its lowest bits are those of its ending, so that words which share
    a unit are alike in form.

    Powers count from the first byte of a stretch: a word's sum is the difference of two running sums, exact modulo 2**64,
    taken back to the word's own first byte.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = int(np.searchsorted(starts, low + BYTES_AT_ONCE))
        s, e = starts[i:j], ends[i:j]
        high = min(e[-1], s[-1] + SHORT)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(VALUES[data[low:high]] * POWERS[: high - low], out=sums[1:])
        h = (sums[np.minimum(e, s + SHORT) - low] - sums[s - low]) * BACK[s - low]
        for k in np.flatnonzero(e - s > SHORT):
            h[k] = _digest(data[s[k] : e[k]].tobytes().lower())
        h = (h ^ (h >> np.uint64(29))) * SPREAD
        before = np.where(e - s > 1, LOWER[data[e - 2]].astype(np.int64), 256)
        out[i:j] = (h ^ (h >> np.uint64(32))) & np.uint64(2**64 - SHARED_UNITS) | _endings()[256 * before + LOWER[data[e - 1]]]
        i = j
    return out.view(np.int64)


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts (null: empty), each text's end included, and the number of tokens of each text."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    limits = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[limits[0] : limits[-1]] if len(column) else np.zeros(0, np.uint8)
    limits = limits - limits[0] if len(limits) else np.zeros(1, np.int64)
    word = ~IS_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = limits[(limits > 0) & (limits < len(data))]  # texts lie side by side: a word ends where its text does
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(first)
    before = np.searchsorted(starts, limits)
    sizes = np.diff(before) + 1
    out = np.full(len(starts) + len(sizes), END, np.int64)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = _word_hashes(data, starts, np.flatnonzero(last) + 1)
    return out, sizes


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    names, place = np.unique(k, return_inverse=True)
    return names, np.bincount(place, weights=c, minlength=len(names)).astype(np.int64)


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(h long, c long): the count of each distinct token of all texts, ends included; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_pages()
        keys, counts, pending = [], [], 0
        for batch in slices(batches, "t", BATCH_BYTES):
            h, _ = _hashes(batch.column("t"))
            names, n = np.unique(h, return_counts=True)
            keys.append(names)
            counts.append(n)
            pending += len(names)
            if pending > MOST_PENDING:
                k, c = _summed(keys, counts)
                if len(k) > MOST_PENDING // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["h", "c"])
                    keys, counts, pending = [], [], 0
                else:
                    keys, counts, pending = [k], [c], len(k)
        if keys:
            k, c = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["h", "c"])

    return docs.select(docs[text_col].alias("t")).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _frequent(words: DataFrame, own_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words with the greatest counts, falling: all down to a count, at most FREQUENT words, and
    all that have a unit of their own.

    The count is found from the number of words in each of a few thousand classes of counts, so no task sorts them all.
    """
    level = F.floor(F.log2("c") * 64).cast("int")
    sizes = sorted(((r[0], r[1]) for r in words.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, total = None, 0
    for at, n in sizes:
        if total + n > FREQUENT:
            break
        least, total = at, total + n
    rows = words.where((level >= least if least is not None else F.lit(False)) | (F.col("c") >= own_count)).toArrow()
    h, c = rows.column("h").to_numpy(), rows.column("c").to_numpy()
    order = np.lexsort((h, -c))
    return h[order], c[order]


class Vocabulary:
    """The most frequent tokens, by hash: their counts and units."""

    def __init__(self, h: np.ndarray, c: np.ndarray, own_count: int) -> None:
        """h: hashes by falling count, without the end; c: their counts; those of own_count and more have units."""
        own = int((c >= own_count).sum())
        unit = np.full(len(h), -1, np.int64)
        unit[:own] = np.arange(FIRST_WORD, FIRST_WORD + own)
        order = np.argsort(h)
        self.h, self.c, self.unit, self.units_in_all = h[order], c[order], unit[order], FIRST_WORD + own

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there."""
        if not len(self.h):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        names, back = np.unique(hashes, return_inverse=True)  # a text's words repeat, and sorted ones are found faster
        at = np.minimum(np.searchsorted(self.h, names), len(self.h) - 1)
        return at[back], (self.h[at] == names)[back]

    def units(self, hashes: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        out = 2 + hashes % SHARED_UNITS  # as pmod() in SQL
        if len(self.h):
            own = np.where(there, self.unit[at], -1)
            out = np.where(own >= 0, own, out)
        out[hashes == END] = END_UNIT
        return out


def _contexts(units: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit before last and last unit of each token; texts start after two begins."""
    starts = np.cumsum(sizes) - sizes
    one = np.roll(units, 1)
    two = np.roll(units, 2)
    one[starts] = BEGIN_UNIT
    two[starts] = BEGIN_UNIT
    second = (starts + 1)[sizes > 1]
    two[second] = BEGIN_UNIT
    return two, one


def triple_counts(docs: DataFrame, text_col: str, vocabulary, shards: int) -> DataFrame:
    """(shard int, cells binary, n binary): counts of unit triples, in pieces; a shard is that of a hash of their context.

    A piece's cells rise; what is stored is how far each lies behind the one before, which compresses.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_pages()
        v = vocabulary.value
        u = v.units_in_all
        held: list[list] = [[] for _ in range(shards)]
        pending = 0

        def pieces() -> Iterator[pa.RecordBatch]:
            for k, parts in enumerate(held):
                if parts:
                    cells, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.diff(cells, prepend=0).tobytes()], pa.binary()), pa.array([n.astype(np.int32).tobytes()], pa.binary())], ["shard", "cells", "n"])
                    parts.clear()

        for batch in slices(batches, "t", BATCH_BYTES):
            h, sizes = _hashes(batch.column("t"))
            if not len(h):
                continue
            w = v.units(h, *v.find(h))
            two, one = _contexts(w, sizes)
            context = two * u + one
            mixed = context.view(np.uint64) * SPREAD
            shard = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
            cells = (context * u + w)[order]
            ends = np.searchsorted(shard[order], np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(ends)):
                held[k].append(cells[ends[k] : ends[k + 1]].copy())
            pending += len(cells)
            if pending > MOST_PENDING:
                yield from pieces()
                pending = 0
        yield from pieces()
        give_back()

    return docs.select(docs[text_col].alias("t")).mapInArrow(run, "shard int, cells binary, n binary")


class Model:
    """Parameters over units; classes are ranges of units: the end, each shared unit, then words by falling count."""

    def __init__(self, counts: np.ndarray, seed: int = 3) -> None:
        """counts: training count of each unit."""
        units, rng = len(counts), np.random.default_rng(seed)
        base = counts + 0.5
        word = np.sqrt(base[FIRST_WORD:])
        number = math.ceil(math.sqrt(2 * len(word)))
        at = ((np.cumsum(word) - word / 2) / max(word.sum(), 1e-30) * number).astype(np.int64)
        at = np.unique(at, return_inverse=True)[1] + SHARED_UNITS + 1
        self.of = np.concatenate([[0, 0], np.arange(1, SHARED_UNITS + 1), at]).astype(np.int64)
        classes = int(self.of.max()) + 1
        self.low = np.searchsorted(self.of, np.arange(classes))
        self.high = np.append(self.low[1:], units)
        self.high[0] = 1
        base[BEGIN_UNIT] = 0  # never predicted
        mass = np.bincount(self.of, weights=base)
        self.class_share = mass / mass.sum()
        self.share = base / mass[self.of]  # of a unit in its class
        log = lambda x: np.log(np.maximum(x, 1e-30)).astype(np.float32)
        self.log_class, self.log_share = log(self.class_share), log(self.share)
        self.summed_class, self.summed = np.cumsum(self.class_share), np.cumsum(self.share)  # c to c + 1 over class c
        d = DIMENSIONS
        self.p = {
            "r": rng.normal(0, 0.3, (units, d)).astype(np.float32), "c": np.ones((2, d), np.float32),
            "qc": np.zeros((classes, d), np.float32), "bc": self.log_class[:, None].copy(), "q": np.zeros((units, d), np.float32), "b": self.log_share[:, None].copy(),
        }

    def context(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.p["c"][0] * self.p["r"].take(u, 0) + self.p["c"][1] * self.p["r"].take(v, 0)

    def log_probability(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, block: int = 512) -> np.ndarray:
        """Natural-log P(w | u, v), normalised over all units but the beginning.

        A context's classes are normalised once, however many of the rows have it; blocks stay in the processor's cache.
        """
        units, outputs = len(self.of), self._outputs()
        contexts, at = np.unique(u * units + v, return_inverse=True)
        x = np.ones((len(contexts), DIMENSIONS + 1), np.float32)
        for i in range(0, len(x), 16 * block):
            some = contexts[i : i + 16 * block]
            x[i : i + 16 * block, :-1] = self.context(some // units, some % units)
        q = np.ascontiguousarray(outputs["qc"].T)
        norm = np.empty(len(x), np.float32)
        z = np.empty((block, q.shape[1]), np.float32)
        for i in range(0, len(x), block):
            part = x[i : i + block]
            norm[i : i + block] = _log_sum_exp(part, q, np.matmul(part, q, out=z[: len(part)]))
        out = np.empty(len(w))
        for c, rows in _groups(self.of[w], np.ones(len(self.low), bool)):
            low, high = self.low[c], self.high[c]
            q = np.ascontiguousarray(outputs["q"][low:high].T)
            for i in range(0, len(rows), 2 * block):
                part = rows[i : i + 2 * block]
                xs = x.take(at[part], 0)
                found = xs @ outputs["qc"][c] - norm[at[part]]
                if high - low > 1:
                    z_in = xs @ q
                    found += z_in[np.arange(len(part)), w[part] - low]
                    found -= _log_sum_exp(xs, q, z_in)
                out[part] = found
        return out

    def _outputs(self) -> dict[str, np.ndarray]:
        """Copies of the output vectors, each with its bias as a last term."""
        return {name: np.concatenate([self.p[name], self.p[bias]], axis=1) for name, bias in (("qc", "bc"), ("q", "b"))}

    def train(self, cells: np.ndarray, n: np.ndarray, seed: int, least: int = LEAST_STEPS, rate: float = 0.1) -> None:
        """Noise-contrastive steps, at least so many, over distinct cells and their counts n: every cell has rows, which
        share its count, and every row is in one step."""
        rng, units = np.random.default_rng(seed), len(self.of)
        p = {"r": self.p["r"], "c": self.p["c"]} | self._outputs()
        squares = {name: np.full_like(x, 1e-6) for name, x in p.items()}
        rows = -(-n.astype(np.int64) // TOKENS_A_DRAW)
        more = least * BATCH - int(rows.sum())
        if more > 0:
            rows += np.diff((np.cumsum(n / n.sum()) * more).round().astype(np.int64), prepend=0)
        share = (n / rows).astype(np.float32)
        steps = max(least, int(rows.sum()) // BATCH)
        at = rng.permutation(np.repeat(np.arange(len(cells)), rows))
        for step, part in enumerate(np.array_split(at, steps)):
            t = cells[part]
            self._step(t // (units * units), t // units % units, t % units, share[part], rng, p, squares, rate * (1 - step / (steps + 1)))
        for name, bias in (("qc", "bc"), ("q", "b")):
            self.p[name][:], self.p[bias][:] = p[name][:, :-1], p[name][:, -1:]

    def _step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, weight: np.ndarray, rng: np.random.Generator, p: dict, squares: dict, rate: float) -> None:
        """One step on the parameters p, whose output vectors hold their biases; it takes the rows by rising target, so that
        the rows of a target and of a class lie side by side."""
        order = _order(w)
        u, v, w, weight = u[order], v[order], w[order], weight[order].astype(np.float32)
        c0, c1 = p["c"].copy()
        ru, rv = p["r"].take(u, 0), p["r"].take(v, 0)
        x = np.ones((len(w), DIMENSIONS + 1), np.float32)
        np.add(c0 * ru, c1 * rv, out=x[:, :-1])
        k = self.of[w]
        noise = np.searchsorted(self.summed_class, rng.random(NOISE_CLASSES)).clip(0, len(self.low) - 1)
        moved = []
        gx, index, g = _contrast(x, p["qc"], k, np.array([0]), noise[None], self.log_class, weight)
        moved.append(("qc", index, g))
        inner = np.flatnonzero((self.high - self.low > 1)[k])
        if len(inner):
            first = _firsts(k[inner])
            classes = k[inner[first]]
            low, high = self.low[classes, None], self.high[classes, None]
            drawn = np.searchsorted(self.summed, classes[:, None] + rng.random((len(classes), NOISE_WORDS))).clip(low, high - 1)
            more, index, g = _contrast(x[inner], p["q"], w[inner], first, drawn, self.log_share, weight[inner])
            gx[inner] += more
            moved.append(("q", index, g))
        gx = gx[:, :-1]
        by_column = np.concatenate([gx.T * c0[:, None], gx.T * c1[:, None]], axis=1)
        moved.append(("r", np.concatenate([u, v]), by_column.T))
        moved.append(("c", np.arange(2), np.stack([np.einsum("nd,nd->d", gx, ru), np.einsum("nd,nd->d", gx, rv)])))
        for name, index, g in moved:
            index, g = _row_sums(index, g, len(p[name]))
            more = squares[name].take(index, 0) + g * g
            squares[name][index] = more
            p[name][index] -= np.float32(rate) * g / np.sqrt(more)


def _order(index: np.ndarray) -> np.ndarray:
    """The stable order of up to 2**20 numbers; sorting them with their places as low bits is faster than argsort."""
    key = index.astype(np.int64) << 20 | np.arange(len(index))
    key.sort()
    return key & ((1 << 20) - 1)


def _row_sums(index: np.ndarray, g: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in index, all below most, and the sum of the rows of g of each."""
    there = np.zeros(most, bool)
    there[index] = True
    names = np.flatnonzero(there)
    place = np.empty(most, np.int64)
    place[names] = np.arange(len(names))
    place = place[index]
    out = np.empty((len(names), g.shape[1]), np.float32)
    for j in range(g.shape[1]):
        out[:, j] = np.bincount(place, weights=g[:, j], minlength=len(names))
    return names, out


def _firsts(rising: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, rising[1:] != rising[:-1]))


def _contrast(x: np.ndarray, q: np.ndarray, target: np.ndarray, first: np.ndarray, noise: np.ndarray, log_share: np.ndarray, weight: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the noise-contrastive loss: in x, and in the rows of q that are named (a row may be more than once).

    Targets rise. Row i of noise is shared by the rows of x from first[i] on; what is computed of all noise for all rows
    goes by blocks, which stay in the processor's cache.
    """
    shift = log_share + np.float32(math.log(noise.shape[1]))
    drawn = q.take(noise, 0)
    back = -drawn
    back[:, :, -1] += shift[noise]
    gx, gn = np.empty_like(x), np.zeros_like(drawn)
    z = np.empty((min(block, len(x)), noise.shape[1]), np.float32)
    with np.errstate(over="ignore"):
        for i, (low, high) in enumerate(zip(first, [*first[1:], len(x)], strict=True)):
            for a in range(low, high, block):
                b = min(a + block, high)
                xs, part = x[a:b], z[: b - a]
                np.matmul(xs, back[i].T, out=part)
                np.exp(part, out=part)
                part += 1
                np.divide(weight[a:b, None], part, out=part)  # weight times sigmoid
                np.matmul(part, drawn[i], out=gx[a:b])
                gn[i] += part.T @ xs
        qt = q.take(target, 0)
        own = weight / (1 + np.exp(shift[target] - np.einsum("nd,nd->n", x, qt))) - weight
    own = own.astype(np.float32)[:, None]
    qt *= own
    gx += qt
    return gx, np.concatenate([target, noise.ravel()]), np.concatenate([own * x, gn.reshape(-1, x.shape[1])])


def _log_sum_exp(x: np.ndarray, q: np.ndarray, z: np.ndarray) -> np.ndarray:
    """log of the sum of exp of each row of z, which is x @ q and is overwritten; what is not finite without scaling is
    computed again, scaled by the row's largest value."""
    with np.errstate(over="ignore", divide="ignore"):
        np.exp(z, out=z)
        out = np.log(z @ np.ones(z.shape[1], np.float32))
    odd = ~np.isfinite(out)
    if odd.any():
        z = x[odd] @ q
        top = z.max(1)
        out[odd] = np.log(np.exp(z - top[:, None]).sum(1)) + top
    return out


def _groups(k: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each wanted class in k and the rows that have it."""
    order = np.argsort(k.astype(np.uint16) if len(wanted) < 1 << 16 else k, kind="stable")
    ends = np.searchsorted(k[order], np.arange(len(wanted) + 1))
    for c in np.flatnonzero(wanted & (np.diff(ends) > 0)):
        yield c, order[ends[c] : ends[c + 1]]


def _merged(cells: tuple[np.ndarray, ...], n: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of all pieces, rising, and the sums of their counts."""
    cells, n = np.concatenate(cells), np.concatenate(n)
    order = np.argsort(cells, kind="stable")
    cells, n = cells[order], n[order]
    first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    return cells[first], np.add.reduceat(n, first, dtype=np.int64)


def fit(spark: SparkSession, pieces: DataFrame, model: Model, shards: int) -> Model:
    """The model trained on the pieces of all shards, each shard once; the parameters of a round's shards are averaged."""
    least = math.ceil(8 * LEAST_STEPS / shards)
    for of_round in ROUNDS:
        start = spark.sparkContext.broadcast(model)

        def run(table: pa.Table) -> pa.Table:
            hold_pages()
            shard = table.column("shard")[0].as_py()
            # pieces arrive in any order; their sums do not depend on it
            parts = [(np.cumsum(np.frombuffer(c.as_buffer(), np.int64)), np.frombuffer(m.as_buffer(), np.int32)) for c, m in zip(table.column("cells"), table.column("n"), strict=True)]
            cells, n = _merged(*zip(*parts, strict=True))
            del table, parts
            own = copy.deepcopy(start.value)  # noqa: B023
            own.train(cells, n, shard, least)
            del cells, n
            give_back()
            names, places, values = [], [], []
            for name, x in own.p.items():
                for i in range(0, len(x), CHUNK):
                    names.append(name)
                    places.append(i)
                    values.append(x[i : i + CHUNK].tobytes())
            return pa.table([pa.array(names), pa.array(places, pa.int64()), pa.array(values, pa.binary())], ["name", "place", "x"])

        def mean(table: pa.Table) -> pa.Table:
            total = 0.0
            for x in sorted(table.column("x").to_pylist()):
                total = total + np.frombuffer(x, np.float32).astype(np.float64)
            x = (total / table.num_rows).astype(np.float32).tobytes()
            return pa.table([table.column("name")[:1], table.column("place")[:1], pa.array([x], pa.binary())], ["name", "place", "x"])

        found = pieces.where((F.col("shard") % 8).isin(*of_round)).groupBy("shard").applyInArrow(run, "name string, place long, x binary")
        found = materialise(found, "lm-parameters")
        for r in found.groupBy("name", "place").applyInArrow(mean, "name string, place long, x binary").collect():
            into = model.p[r["name"]]
            into[r["place"] : r["place"] + CHUNK] = np.frombuffer(r["x"], np.float32).reshape(-1, into.shape[1])
        release(found)
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Rows whose crc32 of the id as text, mod folds, is not 1 teach; a null id is not held out. A null or empty text has
    one token, its end. base_score: smoothed unigram log10 probability; score: the model's. Without training rows N and
    V are 0. Repeated rows get a row each, and each teaches. Three passes over the texts; the shuffles hold hashes and
    numbers only: counts summed in each task, unit triples, parameters, and the tokens outside the FREQUENT words, once
    for each text.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % folds == 1, F.lit(False))
    train = docs.where(~held)
    counts = materialise(word_counts(train, text_col), "lm-counts")
    total, distinct, ends = counts.select(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("h") == END, F.col("c"))), F.lit(0))).first()
    words = counts.where(F.col("h") != END)
    own_count = max(2, math.ceil(math.sqrt(total) / ROOT_SHARE))
    top_h, top_c = _frequent(words, own_count)
    own = Vocabulary(top_h, top_c, own_count)
    vocabulary = spark.sparkContext.broadcast(own)
    # what each shared unit holds, without the words that have units of their own
    shared = F.pmod("h", F.lit(SHARED_UNITS)).cast("int")
    unit_totals = np.zeros((SHARED_UNITS, 2))
    for unit, c, n in words.where(F.col("c") < own_count).groupBy(shared.alias("unit")).agg(F.sum("c"), F.count("*")).collect():
        unit_totals[unit] = c, n
    # a shard's table and the parameters that it sends are of like size
    shards = 8 * math.ceil(max(total, 1) / (8 * max(SHARD_TOKENS, 128 * math.sqrt(total))))
    fitted = Model(np.concatenate([[ends, 0], unit_totals[:, 0], top_c[: own.units_in_all - FIRST_WORD]]).astype(np.float64))
    pieces = materialise(triple_counts(train, text_col, vocabulary, shards), "lm-triples")
    fitted = fit(spark, pieces, fitted, shards)
    release(pieces)
    model = spark.sparkContext.broadcast((fitted, np.log10(unit_totals[:, 0] + 0.5 * (unit_totals[:, 1] + 1))))
    norm = math.log10(total + 0.5 * (distinct + 1))
    end_log = math.log10(ends + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_pages()
        v, (lm_model, unit_norm) = vocabulary.value, model.value
        frequent_log = np.log10(v.c + 0.5)
        row = TaskContext.get().partitionId() << 36
        for batch in slices(batches, "t", BATCH_BYTES):
            h, sizes = _hashes(batch.column("t"))
            at, there = v.find(h)
            end = h == END
            there &= ~end
            units = v.units(h, at, there)
            starts = np.cumsum(sizes) - sizes
            log_c = np.where(there, frequent_log[at] if len(v.h) else 0.0, np.where(end, end_log, 0.0))
            known = there | (end & (ends > 0))
            lm = lm_model.log_probability(*_contexts(units, sizes), units) / math.log(10)
            inside = (units >= 2) & (units < FIRST_WORD)  # of a shared unit
            within = np.where(inside, log_c - unit_norm[np.where(inside, units - 2, 0)], 0.0)
            rare = ~there & ~end
            text_of = np.repeat(np.arange(len(sizes)), sizes)
            pairs = np.stack([text_of[rare], h[rare]]) if rare.any() else np.zeros((2, 0), np.int64)
            by = np.lexsort((pairs[1], pairs[0]))
            pairs = pairs[:, by]
            new = np.ones(pairs.shape[1], bool)
            new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(0)
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, pairs.shape[1]))
            offsets = np.searchsorted(pairs[0, first], np.arange(len(sizes) + 1))
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, kind))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("i"), batch.column("held"), pa.array(row + np.arange(len(sizes))), pa.array(sizes), pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                    pa.array(np.add.reduceat(log_c, starts)), pa.array(np.add.reduceat(lm + within, starts)), lists(pairs[1, first], pa.int64()), lists(times, pa.int64()),
                ],
                ["i", "held", "row", "n", "known", "base", "lm", "h", "times"],
            )
            row += len(sizes)
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("i"), held.alias("held"), docs[text_col].alias("t"))
    rows = materialise(rows.mapInArrow(run, f"i {kind}, held boolean, row long, n long, known long, base double, lm double, h array<long>, times array<long>"), "lm-rows")
    rare = rows.select("row", F.explode(F.arrays_zip("h", "times")).alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.times").alias("times"))
    c = F.coalesce(F.col("c"), F.lit(0))
    met = rare.join(words, "h", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"))
    more = F.coalesce(F.col("more"), F.lit(0.0))
    out = rows.drop("h", "times").join(met, "row", "left")
    return out.select(
        F.col("i").alias(id_col),
        F.col("held").alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce(F.col("more_known"), F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n") * F.lit(norm)).alias("base_score"),
        (F.col("lm") + more).alias("score"),
    )
