"""Personal data by weak supervision, with DataFrame functions only.

Candidates are the matches of strict patterns (the base: email, ip, card, phone) and of looser ones (obfuscated email
addresses, national phone numbers, social-security numbers, and, as possible secrets, long runs of mixed letters and
digits). Five labelers vote yes, no or nothing on each: the strict pattern itself, a gazetteer of the kind, cue words on
the left, the shape, and the neighbouring characters.
Expectation maximisation over the counts of vote patterns estimates how often each labeler votes how for true and false
spans; its posteriors are the soft labels of the final classifier, a naive Bayes model over features of the span. Base
spans always stay; the classifier decides on the others.

Only counts of vote and feature patterns reach the driver: at most 3**5 patterns of votes times the features' codes,
whatever the corpus's size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.llm.common import materialise

KINDS = ("email", "ip", "card", "phone", "secret", "ssn")
BASE = KINDS[:4]

_LOCAL, _RUN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9_/+-]"
#: Strict patterns. They match what the plain ones match, leftmost and without overlap, but never look at a run twice:
#: a match can begin only where a run begins or where the previous match ended.
STRICT = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns, by the kind they add to.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "phone": r"(?<![0-9+.-])(?<![0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "secret": rf"(?<!{_RUN})(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z]){_RUN}{{20,}}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text is searched for a kind only if this holds, which each of its matches implies.
HINTS = {
    ("email", True): lambda t: F.contains(t, F.lit("@")),
    ("ip", True): lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ("card", True): lambda t: t.rlike(STRICT["card"]),
    ("phone", True): lambda t: t.rlike(r"\+[0-9]"),
    ("email", False): lambda t: t.rlike(r"[(\[{]at[)\]}]"),
    ("phone", False): lambda t: t.rlike(r"[0-9][.-][0-9]{4}"),
    ("secret", False): lambda t: t.rlike(rf"(?<!{_RUN})(?=[A-Za-z_/+-]*+[0-9]){_RUN}{{20}}"),
    ("ssn", False): lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"),
}
#: Gazetteers and cues of the labelers (fixed values of this operator).
GAZETTEER = {
    "email": (r"(?:\.|dot[)\]}])\x20?(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk)$", None),
    "ip": (r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.", r"^0+\."),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6)", r"^[0179]"),
    "phone": (r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])", r"^\(?[01]"),
    "secret": ("^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[a-z]_.*|sk-.*|xox[a-z]-.*|eyJ.*|(?:[0-9a-f]{8}){4,16}|(?:[0-9A-F]{8}){4,16})$", "^[0-9/+-]*[a-z]+(?:[/+-][a-z]*[0-9]*)*$"),
    "ssn": ("^(?!000|666|9)", "^(?:000|666|9)"),
}
CUES = {
    "email": "mail|contact|write|address", "ip": "ip|host|server|address|login", "card": "card|visa|master|credit|pay",
    "phone": "phone|tel|call|fax|mobile|contact", "secret": "(?:key|secret|token|passw|pwd|auth|bearer|credential)[a-z_]*\\W*$", "ssn": "ssn|social|security",
}
#: Kinds of which a candidate without a cue speaks against itself.
NEEDS_CUE = ("secret",)
AGAINST = r"(?:version|isbn|order|invoice|serial|part)\W*$"
LABELERS, ROUNDS, CONTEXT = 5, 40, 24
#: Items of a block of a running sum.
BLOCK = 256
#: Spans of a text up to which each is found from the text's start when it is replaced.
FEW = 64


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)
    digit = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    add = lambda s, i: s + F.when((n - i) % 2 == 1, twice(digit(i))).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


VALID = {
    "ip": lambda h: ~h.rlike(r"(?:^|\.)0*(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2}|[1-9][0-9]{3,})(?:\.|$)"),
    "card": lambda h: _luhn(_digits(h)),
    "phone": lambda h: F.length(_digits(h)).between(10, 15),
}
_SPAN = "struct<s:int,e:int,k:int,base:boolean,hit:string,left:string,right:string>"


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it, also inside other functions' arguments."""
    return F.transform(F.array(value), use)[0]


def _running(items: Column, value, combine, zero: int) -> Column:
    """Array of the running combinations (a sum or the like) of value(x) over an array, block by block: appending to one
    array for each item would copy it each time, so a text with very many spans would take time in their square."""
    empty = F.array().cast("array<int>")

    def within(x: Column) -> Column:
        block = lambda b: F.aggregate(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)), empty, lambda acc, i: F.array_append(acc, combine(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(zero)), value(i))))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), block)
        return _bound(blocks, joined)

    def joined(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(F.lit(zero)), lambda acc, b: F.array_append(acc, combine(F.element_at(acc, -1), F.element_at(b, -1))))
        return _bound(before, lambda p: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda v: combine(F.get(p, i), v)))))

    return _bound(items, lambda x: F.when(F.size(x) > 0, within(x)).otherwise(empty))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _found(text: Column, kind: str, strict: bool) -> Column:
    """Array of the spans of one pattern: offsets in code points from the lengths of what lies between the matches."""
    pattern = (STRICT if strict else LOOSE)[kind]
    valid = VALID.get(kind, lambda h: F.lit(True)) if strict else (lambda h: F.lit(True))

    def spans(gaps: Column) -> Column:
        parts = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))).alias("after"))
        return _bound(parts, placed)

    def placed(parts: Column) -> Column:
        ends = _running(parts, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)), _sum, 0)
        hits = F.filter(F.arrays_zip(parts.alias("x"), ends.alias("e")), lambda y: y["x"]["hit"].isNotNull() & valid(y["x"]["hit"]))
        return F.transform(hits, span)

    def span(y: Column) -> Column:
        x = y["x"]
        return F.struct((y["e"] - F.length(x["hit"])).alias("s"), y["e"].alias("e"), F.lit(KINDS.index(kind)).alias("k"), F.lit(strict).alias("base"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(CONTEXT)).alias("left"), F.left(x["after"], F.lit(1)).alias("right"))

    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(HINTS[kind, strict](text), _bound(F.split(text, pattern, -1), spans).cast(f"array<{_SPAN}>")).otherwise(none)


def _apart(base: Column, loose: Column) -> Column:
    """The loose spans that overlap none of the base ones: after sorting, by the end of the base before and the start of the one behind."""
    ordered = F.array_sort(F.transform(F.concat(base, loose), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"), x.alias("x"))))
    far = (1 << 31) - 1

    def kept(rows: Column) -> Column:
        ends = _running(rows, lambda x: F.when(x["base"], x["e"]).otherwise(0), F.greatest, 0)
        starts = F.reverse(_running(F.reverse(rows), lambda x: F.when(x["base"], x["s"]).otherwise(far), F.least, far))
        free = lambda y: ~y["x"]["base"] & (y["a"] <= y["x"]["s"]) & (y["b"] >= y["x"]["e"])
        return F.transform(F.filter(F.arrays_zip(rows.alias("x"), ends.alias("a"), starts.alias("b")), free), lambda y: y["x"]["x"])

    return F.when((F.size(loose) > 0) & (F.size(base) > 0), _bound(ordered, kept)).otherwise(loose)


def _by_kind(k: Column, of: dict[str, Column], rest: Column) -> Column:
    out = None
    for kind, value in of.items():
        test = k == KINDS.index(kind)
        out = F.when(test, value) if out is None else out.when(test, value)
    return rest if out is None else out.otherwise(rest)


def _vote(yes: Column, no: Column) -> Column:
    """2 for yes, 0 for no, 1 for nothing."""
    return F.when(yes, 2).when(no, 0).otherwise(1)


def _votes(x: Column) -> list[Column]:
    """The labelers' votes on a span."""
    hit, left = x["hit"], F.lower(F.coalesce(x["left"], F.lit("")))
    never = F.lit(False)
    listed = _by_kind(x["k"], {k: _vote(hit.rlike(a), hit.rlike(b) if b else never) for k, (a, b) in GAZETTEER.items()}, F.lit(1))
    cued = _by_kind(x["k"], {k: _vote(left.rlike(c), F.lit(True) if k in NEEDS_CUE else left.rlike(AGAINST)) for k, c in CUES.items()}, F.lit(1))
    varied = F.size(F.array_distinct(F.split(hit, "")))
    plain = hit.rlike(r"^[^0-9]*([0-9])(?:[^0-9]*\1)+[^0-9]*$")  # one digit again and again
    shape = _by_kind(x["k"], {"email": _vote(hit.rlike("[A-Za-z]"), ~hit.rlike("[A-Za-z]")), "secret": _vote(varied >= 10, varied < 7)}, _vote(~plain, plain))
    joined = F.right(left, F.lit(1)).rlike("[a-z0-9]") | F.coalesce(x["right"], F.lit("")).rlike("[A-Za-z0-9]")
    return [F.when(x["base"], 2).otherwise(1), listed, cued, shape, _vote(~joined, joined)]


def _features(x: Column) -> list[tuple[int, Column]]:
    """Number of values and value of each feature of the final classifier."""
    votes = _votes(x)
    side = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[A-Za-z0-9]"), 2).otherwise(3)
    size = F.least(F.floor(F.length(x["hit"]) / 6), F.lit(5)).cast("int")
    return [(len(KINDS), x["k"]), (3, votes[1]), (3, votes[2]), (3, votes[3]), (6, size), (4, side(F.right(x["left"], F.lit(1)))), (4, side(x["right"]))]


FEATURE_SIZES = [6, 3, 3, 3, 6, 4, 4]


def _code(parts: list[tuple[int, Column]]) -> Column:
    out, times = F.lit(0), 1
    for n, c in parts:
        out = out + c * times
        times *= n
    return out.cast("int")


def _decoded(code: int, sizes: list[int]) -> list[int]:
    out = []
    for n in sizes:
        out.append(code % n)
        code //= n
    return out


def estimate(patterns: dict[int, float]) -> dict[int, float]:
    """Posterior that a span with a pattern of votes is true, by expectation maximisation over the patterns' counts."""
    votes = {p: _decoded(p, [3] * LABELERS) for p in patterns}
    prior = 0.5
    true, false = [[0.15, 0.25, 0.6]] * LABELERS, [[0.5, 0.35, 0.15]] * LABELERS
    posterior: dict[int, float] = {}
    for _ in range(ROUNDS):
        for p, v in votes.items():
            a = prior * math.prod(true[i][x] for i, x in enumerate(v))
            b = (1 - prior) * math.prod(false[i][x] for i, x in enumerate(v))
            posterior[p] = a / (a + b)
        yes = sum(n * posterior[p] for p, n in patterns.items())
        no = sum(patterns.values()) - yes
        prior = (yes + 1) / (yes + no + 2)

        def shares(weight, total):
            rows = []
            for i in range(LABELERS):
                sums = [1.0] * 3
                for p, v in votes.items():
                    sums[v[i]] += weight(p)
                rows.append([s / (total + 3) for s in sums])
            return rows

        true = shares(lambda p: patterns[p] * posterior[p], yes)
        false = shares(lambda p: patterns[p] * (1 - posterior[p]), no)
    return posterior


def train(counts: list[tuple[int, int, int]], sizes: list[int]) -> tuple[float, list[list[float]]]:
    """Log odds: the prior's and that of each feature's values, from (votes, features, n) rows; smoothed by one."""
    patterns: dict[int, float] = {}
    for v, _, n in counts:
        patterns[v] = patterns.get(v, 0) + n
    posterior = estimate(patterns) if patterns else {}
    yes = [[1.0] * n for n in sizes]
    no = [[1.0] * n for n in sizes]
    total = [1.0, 1.0]
    for v, f, n in counts:
        p = posterior[v]
        total = [total[0] + n * p, total[1] + n * (1 - p)]
        for i, x in enumerate(_decoded(f, sizes)):
            yes[i][x] += n * p
            no[i][x] += n * (1 - p)
    return math.log(total[0] / total[1]), [[math.log(a / sum(y) * sum(z) / b) for a, b in zip(y, z, strict=True)] for y, z in zip(yes, no, strict=True)]


def candidates(text: Column) -> tuple[Column, Column]:
    """The base spans of a text, and the looser ones."""
    base = F.concat(*[_found(text, k, True) for k in BASE])
    loose = F.concat(*[_found(text, k, False) for k in LOOSE])
    return base, loose


def label_spans(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns keep of every row of docs and spans, array<struct<s, e, k, base>>: sorted by start, then kind; k indexes KINDS.

    Null texts are empty and have none. Offsets are code points, ends exclusive. The texts are read once; what is written
    between are the candidates. Rows stay in their partitions: the only shuffle holds counts of patterns.
    """
    inner = [f"keep{i}" for i in range(len(keep))]
    rows = docs.select(*[docs[c].alias(k) for c, k in zip(keep, inner, strict=True)], F.coalesce(docs[text_col], F.lit("")).alias("text"))
    base, loose = candidates(F.col("text"))
    rows = rows.select(*inner, base.alias("base"), loose.alias("loose"))
    rows = rows.select(*inner, F.concat("base", _apart(F.col("base"), F.col("loose"))).alias("all"))
    coded = lambda x: F.struct(
        x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["base"].alias("base"), _code([(3, v) for v in _votes(x)]).alias("votes"), _code(_features(x)).alias("features")
    )
    rows = materialise(rows.select(*inner, F.when(F.size("all") > 0, F.transform("all", coded)).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,base:boolean,votes:int,features:int>>")).alias("all")), "spans")
    counts = rows.select(F.explode("all").alias("x")).groupBy("x.votes", "x.features").count().collect()
    prior, weights = train([tuple(r) for r in counts], FEATURE_SIZES)

    def odds(x: Column) -> Column:
        total, times = F.lit(prior), 1
        for n, w in zip(FEATURE_SIZES, weights, strict=True):
            total = total + F.element_at(F.array(*map(F.lit, w)), (F.floor(x["features"] / times) % n + 1).cast("int"))
            times *= n
        return total

    taken = F.array_sort(F.transform(F.filter("all", lambda x: x["base"] | (odds(x) > 0)), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["base"].alias("base"))))
    return rows.select(*inner, taken.alias("spans")).toDF(*keep, "spans")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added) of every row of docs; repeated rows get a row each.

    The counts by kind are those of the base; n_added is the number of the spans that the classifier added to them, n_spans
    that of all.
    """
    found = label_spans(docs, [id_col], text_col)
    base = F.filter("spans", lambda x: x["base"])

    def number(k: int) -> Column:
        return F.size(F.filter(base, lambda x: x["k"] == k)).cast("long")

    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select(id_col, *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_added"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of its texts replaced by its kind in angle brackets; overlapping spans become one, named by the first.

    A null text stays null. Columns and rows are those of docs.
    """
    columns = docs.columns
    # positions for names, so none can clash with the spans'
    own = [f"own{i}" for i in range(len(columns))]
    found = label_spans(docs.toDF(*own), own, own[columns.index(text_col)])
    text = F.col(own[columns.index(text_col)])
    names = F.array(*map(F.lit, KINDS))

    def replaced(between) -> Column:
        """between(a, b): the text from code point a on up to b."""

        def joined(rows: Column) -> Column:
            # a span that begins before an earlier one ends is part of that one
            shown = F.filter(rows, lambda y: y["x"]["s"] >= y["to"])
            parts = F.transform(shown, lambda y: F.concat(between(y["to"], y["x"]["s"]), F.lit("<"), F.upper(F.element_at(names, y["x"]["k"] + 1)), F.lit(">")))
            end = F.greatest(F.element_at(rows, -1)["to"], F.element_at(rows, -1)["x"]["e"])
            return F.concat(F.array_join(parts, ""), between(end, F.length(text)))

        ends = _running(F.col("spans"), lambda x: x["e"], F.greatest, 0)
        before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size("spans") - 1))
        return _bound(F.arrays_zip(F.col("spans").alias("x"), before.alias("to")), joined)

    # finding a place counts code points from the text's start, so a text with many spans is taken apart first
    few = replaced(lambda a, b: F.substring(text, a + 1, b - a))
    many = _bound(F.split(text, ""), lambda c: replaced(lambda a, b: F.array_join(F.slice(c, a + 1, b - a), "")))
    whole = F.when(F.size("spans") <= FEW, few).otherwise(many)
    text = F.when(F.size("spans") > 0, whole).otherwise(text)
    return found.select(*[(text if c == text_col else F.col(o)).alias(c) for c, o in zip(columns, own, strict=True)])
