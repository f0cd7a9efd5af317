"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists, for each end position, every vocabulary piece that ends there. Dynamic programming
carries the best score and the number of pieces of the best path, never the path itself. Ties are broken as the
SentencePiece unigram encoder breaks them: among equal scores the candidate with the earliest start, that is the
longest last piece, stays. A character that no one-character piece covers costs the least piece score less 10 and
counts as its UTF-8 bytes where the vocabulary has byte pieces, else as one unknown piece.

A text is cut where no piece can cross (before a word mark that follows another character), so scores are sums over
short segments and exact for integral scores however long the text is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkscope.llm.common import Memo, per_process, slices, texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
NORMAL, USER_DEFINED, BYTE = 1, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """Number, wire type and value of each field of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i += 1
            shift += 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                n, i = varint(i)
            value = data[i : i + n]
            i += n
        yield key >> 3, kind, value


def read_vocabulary(path: str) -> dict:
    """pieces [(text, score)], whether unknown characters fall back to bytes, and whether a word mark is put first."""
    import struct

    pieces, bytes_there, dummy = [], False, True
    with open(path, "rb") as f:
        model = f.read()
    for number, _, value in _fields(model):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for k, _, v in _fields(value):
                if k == 1:
                    text = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            bytes_there |= kind == BYTE
            if kind in (NORMAL, USER_DEFINED):
                pieces.append((text, score))
        elif number == 3:
            for k, _, v in _fields(value):
                if k == 3:
                    dummy = bool(v)
    return {"pieces": pieces, "byte_fallback": bytes_there, "dummy_prefix": dummy}


class UnigramCounter:
    """Counts of one vocabulary; see the module's text for the rules."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True, dummy_prefix: bool = True) -> None:
        self.machine = ahocorasick.Automaton()
        for text, score in pieces:
            if text:
                self.machine.add_word(text, (len(text), score))
        self.any = len(self.machine) > 0
        if self.any:
            self.machine.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback, self.dummy = byte_fallback, dummy_prefix
        inner = re.compile(f"[^{MARK}]{MARK}")
        self.cut_words = not any(inner.search(t) for t, _ in pieces)
        self.cut_lines = not any("\n" in t for t, _ in pieces)
        self.line_end = complex(1, self.unknown)
        self.words = Memo(lambda w: self._segment(MARK + w), 400_000)
        self.runs = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def _segment(self, s: str) -> complex:
        """Number of pieces and, as the imaginary part, score of the best path through s."""
        n = len(s)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        done = 0  # ends before this one are settled
        single = False
        top = None
        pieces = 0
        for end, (length, score) in self.machine.iter(s) if self.any else ():
            if end >= done:  # the first, longest match of a new end
                while done <= end:
                    if done and not single:
                        self._unknown(s, done - 1, best, count, top, pieces)
                    elif done:
                        best[done], count[done] = top, pieces
                    done += 1
                    single, top = False, None
            x = best[end + 1 - length] + score
            if top is None or x > top:
                top, pieces = x, count[end + 1 - length] + 1
            if length == 1:
                single = True
        while done <= n:
            if done and not single:
                self._unknown(s, done - 1, best, count, top, pieces)
            elif done:
                best[done], count[done] = top, pieces
            done += 1
            single, top = False, None
        return complex(count[n], best[n])

    def _unknown(self, s: str, e: int, best: list[float], count: list[int], top: float | None, pieces: int) -> None:
        """Settle the end of the character at e, which no piece of one character covers."""
        x = best[e] + self.unknown
        if top is None or x > top:
            top, pieces = x, count[e] + (len(s[e].encode()) if self.byte_fallback else 1)
        best[e + 1], count[e + 1] = top, pieces

    def count(self, text: str) -> tuple[int, float]:
        """Number of tokens of a text and the score of its best path; (0, 0.0) if it is empty."""
        if not text:
            return 0, 0.0
        if not self.cut_words:
            x = self._segment((MARK if self.dummy else "") + text.replace(" ", MARK))
            return int(x.real), x.imag
        total = 0j
        lines = text.split("\n") if self.cut_lines else [text]
        for i, line in enumerate(lines):
            if i:
                total += self.line_end
            if "  " in line or MARK in line or line[:1] == " " or (i == 0 and not self.dummy):
                line = line.replace(" ", MARK)
                for run in self.runs.findall((MARK if i == 0 and self.dummy else "") + line):
                    total += self._segment(run)
                continue
            words = line.split(" ")
            if i and words[0]:
                total += self._segment(words[0])
            total += sum(map(self.words.__getitem__, words[1:] if i else words))
        return int(total.real), total.imag


def token_counts(docs: DataFrame, vocabulary: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, best_score double) of every row of docs.

    One row for each row of docs, repeated ones too; a null text counts as empty: 0 tokens, score 0. A null id stays
    null. Other columns are not read. No shuffle: one pass over the scan's partitions.
    """
    key = ("unigram", hashlib.sha256(repr(sorted(vocabulary.items())).encode()).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_process(key, lambda: UnigramCounter(**vocabulary))
        for batch in slices(batches, "t"):
            found = [counter.count(x) for x in texts(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64())], ["i", "n", "s"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, f"i {kind}, n long, s double")
    return out.toDF(id_col, "n_tokens", "best_score")
