"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For each bit a linear classifier over hashed character n-grams of the text
decides between the languages whose bit is 1 and the others. Decoding weighs the loss of each bit by how reliable that
bit was on the part of the sample that the fit left out, takes the codeword with the least total, and flags a text as
ambiguous where the second codeword is hardly worse.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscope.llm.common import give_back, per_process, slices, texts

DIMENSIONS = 1 << 12
UNDETERMINED = "und"
#: Bounds of the fit: labelled texts that are drawn of each language, and of all together; every language gets LEAST_DRAWN.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS, LEAST_DRAWN = 500, 30_000, 20
#: Rows whose features are held as 32-bit numbers at once.
FIT_BLOCK = 512

#: ASCII that is no letter becomes a space, before n-grams are taken.
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(text: str) -> np.ndarray | None:
    """Counts of hashed byte n-grams (1 to 3) of the lower-cased letters, scaled to length 1; None without a letter."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b" ", np.uint8)
    if len(raw) < 3:
        return None
    x = raw.astype(np.uint32)
    out = np.bincount((x[:-2] * 40503 + x[1:-1] * 1566083941 + x[2:] * 2654435761) >> 20, minlength=DIMENSIONS).astype(np.float32)
    out += np.bincount((x[:-1] * 2246822519 + x[1:] * 3266489917) >> 20, minlength=DIMENSIONS)
    np.sqrt(out, out)
    return out / np.sqrt(out @ out)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1, far from each other: all splits of few languages, else the best of seeded random tables."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        splits = range(1, 1 << (n - 1))
        return np.array([[1 if (s >> k) & 1 else -1 for s in splits] for k in range(n)], np.int8)
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(50):
        table = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        off = (table.astype(np.int32) @ table.T) - np.eye(n, dtype=np.int32) * (3 * bits)
        distance = (bits - off.max()) // 2
        if distance > far and (np.abs(table.sum(0)) < n).all():
            best, far = table, distance
    return best


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 80) -> dict:
    """Weights of the bits' classifiers (regularised logistic loss, full-batch momentum) and the bits' reliabilities.

    x may hold 16-bit numbers; it is widened block by block.
    """
    codes = codewords(len(languages))
    hold = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    target = codes[y].astype(np.float32)
    share = 1.0 / np.bincount(y, minlength=len(languages)).clip(1)[y].astype(np.float32)
    fitted = np.flatnonzero(~hold)
    share /= share[fitted].sum()
    w = np.zeros((x.shape[1], codes.shape[1]), np.float32)
    bias = np.zeros(codes.shape[1], np.float32)
    move, move_bias = np.zeros_like(w), np.zeros_like(bias)
    for _ in range(rounds):
        slope, slope_bias = 1e-5 * w, np.zeros_like(bias)
        for i in range(0, len(fitted), FIT_BLOCK):
            rows = fitted[i : i + FIT_BLOCK]
            a, t = x[rows].astype(np.float32), target[rows]
            g = -t * share[rows, None] / (1 + np.exp(np.clip(t * (a @ w + bias), -30, 30)))
            slope += a.T @ g
            slope_bias += g.sum(0)
        move = 0.9 * move - 12.0 * slope
        move_bias = 0.9 * move_bias - 2.0 * slope_bias
        w += move
        bias += move_bias
    reliable = np.ones(codes.shape[1])
    if hold.any():
        right = ((x[hold].astype(np.float32) @ w + bias) * target[hold] > 0).mean(0)
        reliable = np.clip(np.log((right + 0.01) / (1.01 - right)), 0.1, None)
    return {"languages": languages, "codes": codes, "w": w, "bias": bias, "reliable": (reliable / reliable.sum()).astype(np.float32)}


def decode(model: dict, scores: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language's index, its score (0 to 1) and the margin to the second, of rows of bit scores.

    A bit's loss, log(1 + exp(-score * bit)), has two values only, so a codeword's total is a sum of two products.
    """
    ones = (model["codes"] > 0).astype(np.float32).T
    best, score, margin = np.empty(len(scores), np.int64), np.empty(len(scores)), np.empty(len(scores))
    for i in range(0, len(scores), block):
        s = scores[i : i + block].astype(np.float32)
        loss = (np.logaddexp(0, -s) * model["reliable"]) @ ones + (np.logaddexp(0, s) * model["reliable"]) @ (1 - ones)
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best[i : i + block] = p.argmax(1)
        score[i : i + block] = p.max(1)
        top = np.partition(p, -2, axis=1)[:, -2] if p.shape[1] > 1 else 0
        margin[i : i + block] = p.max(1) - top
    return best, score, margin


def learn(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """Model from a bounded sample of labelled rows of every language: of each at most SAMPLE_PER_LANGUAGE, or fewer where all
    would be over SAMPLE_ROWS, but LEAST_DRAWN. Rows are drawn by the hash of their id and text, so ids that are null or
    repeat don't tie them; rows equal in both teach once.

    Rows without a language, text or letter teach nothing. None if nothing is left.
    """
    labelled = docs.where(docs[lang_col].isNotNull() & docs[text_col].rlike(r"\p{L}")).select(docs[lang_col].alias("l"), docs[text_col].alias("t"), F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("i"))
    sizes = [tuple(r) for r in labelled.groupBy("l").count().collect()]
    if not sizes:
        return None
    most = min(SAMPLE_PER_LANGUAGE, max(LEAST_DRAWN, SAMPLE_ROWS // len(sizes)))
    drawn = F.pmod(F.xxhash64("i", "t", F.lit(11)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    # somewhat more than wanted by the hash, so that few texts go on, then the first of them
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, (most + 4 * most**0.5 + 8) / n)) for lang, n in sizes], "of string, share double")
    sample = labelled.join(F.broadcast(shares), F.col("l") == F.col("of")).where(drawn < F.col("share")).select("l", "t", drawn.alias("u"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches, "t"):
            kept = []
            for lang, t, u in zip(batch.column("l").to_pylist(), texts(batch.column("t")), batch.column("u").to_pylist(), strict=True):
                if (lang, u) not in seen:
                    seen.add((lang, u))
                    if has_letter(t) and (x := features(t)) is not None:
                        kept.append((lang, x.astype(np.float16).tobytes(), u))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.binary()), pa.array([k[2] for k in kept], pa.float64())], ["l", "x", "u"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit_drawn(((v.to_pylist() for v in (batch.column("l"), batch.column("u"), batch.column("x"))) for batch in batches), most)
        give_back()
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # one task fits, so that the driver holds the model only, not the sample
    found = sample.mapInArrow(described, "l string, x binary, u double").repartition(1).mapInArrow(fitted, "model binary").collect()
    if not found:
        return None
    model = pickle.loads(found[0]["model"])
    model["key"] = hashlib.sha256(model["w"].tobytes()).hexdigest()
    return model


def fit_drawn(batches: Iterable[Iterable[list]], most: int) -> dict | None:
    """fit() over batches of (languages, places in the draw, features as bytes): of each language the first `most` rows, one a
    place. The order in which rows come does not matter. None if there are none."""
    drawn: dict[str, dict[float, bytes]] = {}
    for batch in batches:
        for lang, u, v in zip(*batch, strict=True):
            own = drawn.setdefault(lang, {})
            own[u] = min(v, own.get(u, v))
            if len(own) >= 2 * most:
                drawn[lang] = {k: own[k] for k in sorted(own)[:most]}
    if not drawn:
        return None
    languages = sorted(drawn)
    rows = sorted((place, y, u) for y, lang in enumerate(languages) for place, u in enumerate(sorted(drawn[lang])[:most]))
    x = np.empty((len(rows), DIMENSIONS), np.float16)
    for i, (_, y, u) in enumerate(rows):
        x[i] = np.frombuffer(drawn[languages[y]].pop(u), np.float16)
    drawn.clear()
    return fit(x, np.array([y for _, y, _ in rows]), languages)


def predict(docs: DataFrame, model: dict | None, keep: list[str], text_col: str = "text", ambiguous_below: float = 0.05) -> DataFrame:
    """Columns keep of docs, then lang_pred, score and ambiguous, of every row. No shuffle.

    A null text, one without a letter, or any text where there is no model: `und`, score 0, not ambiguous.
    """
    inner = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[docs[c].alias(k) for c, k in zip(keep, inner, strict=True)], docs[text_col].alias("t"))
    kinds = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(keep, inner, strict=True))
    slim = None if model is None else {**model, "w": model["w"].astype(np.float16)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if slim is None else per_process(("ecoc", slim["key"]), lambda: {**slim, "w": slim["w"].astype(np.float32)})
        for batch in slices(batches, "t"):
            lang, score, doubt = [UNDETERMINED] * batch.num_rows, [0.0] * batch.num_rows, [False] * batch.num_rows
            found, at = [], []
            for i, t in enumerate(texts(batch.column("t"))):
                if own is not None and has_letter(t):
                    x = features(t)
                    # letters beyond ASCII alone always leave n-grams, so x is there
                    found.append(x @ own["w"] + own["bias"])
                    at.append(i)
            if at:
                best, p, margin = decode(own, np.stack(found))
                for i, b, v, m in zip(at, best.tolist(), p.tolist(), margin.tolist(), strict=True):
                    lang[i], score[i], doubt[i] = own["languages"][b], min(1.0, max(0.0, v)), m < ambiguous_below
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in inner], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())], [*inner, "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean").toDF(*keep, "lang_pred", "score", "ambiguous")


def held_out(docs: DataFrame, id_col: str = "doc_id", folds: int = 3):
    """Column: whether a row's fold (crc32 of the id as text) is 1; a null id is not held out."""
    return F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % folds == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3) -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous) of every row of docs, learned from the rows that are not held out.

    Repeated rows get a row each. A null id stays null and is not held out; see predict() for texts without letters.
    """
    out = held_out(docs, id_col, folds)
    model = learn(docs.where(~out), lang_col, id_col, text_col)
    marked = docs.select(docs[id_col].alias("id"), out.alias("held"), docs[text_col].alias("text"))
    found = predict(marked, model, ["id", "held"])
    return found.toDF(id_col, "held_out", "lang_pred", "score", "ambiguous")
