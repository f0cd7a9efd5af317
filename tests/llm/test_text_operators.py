"""Token counts, BPE, language ID, quality rules: against libraries and brute force, with odd inputs."""

import array
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from sparkscope.llm import bpe, langid, quality, token_counts

P = pytest.importorskip("public_tokenizers")
ODD = "ab \n\t'sre1.é \x1c\x1f\x85　\U0001f600中́<|>"


def odd_texts(n, longest, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ODD[: r.randint(1, len(ODD))]) for _ in range(r.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.read_vocabulary(P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "the quick brown fox", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "x" * 30000, "en", None), (5, "der Hund und die Katze", "de", "b"), (5, "der Hund und die Katze", "de", "b"), (None, "le chat et le chien", "fr", "b"), (7, "12 34 !!", "en", "a")]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    # columns that clash with those the operators make
    return out.selectExpr("*", "1 AS n_tokens", "'x' AS size", "0.5 AS score", "true AS kept", "1 AS i", "'t' AS t", "3 AS id", "4 AS row", "5 AS stratum")


def brute_unigram(pieces, unknown, s):
    best = [(0.0, 0)]
    for e in range(1, len(s) + 1):
        top = None
        for b in range(max(0, e - 20), e):
            if s[b:e] in pieces:
                x = best[b][0] + pieces[s[b:e]]
                if top is None or x > top[0]:
                    top = (x, best[b][1] + 1)
        if s[e - 1] not in pieces:
            x = best[e - 1][0] + unknown
            if top is None or x > top[0]:
                top = (x, best[e - 1][1] + len(s[e - 1].encode()))
        best.append(top)
    return best[-1][1], best[-1][0]


def test_unigram_is_viterbi(vocabulary):
    counter, pieces = token_counts.UnigramCounter(**vocabulary), dict(vocabulary["pieces"])
    for s in [*odd_texts(300, 60, 1), "the cat", " the  cat ", "▁x", "a\nb", ""]:
        assert counter.count(s) == (brute_unigram(pieces, counter.unknown, "▁" + s.replace(" ", "▁")) if s else (0, 0.0)), repr(s)


def test_unigram_as_the_library_counts(vocabulary):
    from tokenizers import Tokenizer, models

    library = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary["pieces"], *[(f"<0x{i:02X}>", -1.0) for i in range(256)]], 0, True))
    counter = token_counts.UnigramCounter(**vocabulary)
    for s in [x for x in odd_texts(300, 80, 2) if "<" not in x]:
        assert counter.count(s)[0] == len(library.encode("▁" + s.replace(" ", "▁")).ids if s else []), repr(s)


def test_unigram_ties():
    counter = token_counts.UnigramCounter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁", 0.0)], byte_fallback=False)
    assert counter.count("ab") == (2, -2.0)  # the piece with the earliest start wins a tie
    assert counter.count("aba") == (2, -3.0)
    assert counter.count("é")[0] == 2


def test_token_counts_frame(docs, vocabulary):
    found = token_counts.token_counts(docs, vocabulary)
    rows = found.collect()
    assert found.columns == ["doc_id", "n_tokens", "best_score"] and len(rows) == 8
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[2] == 0 and sum(r["doc_id"] == 5 for r in rows) == 2
    assert token_counts.token_counts(docs.where("false"), vocabulary).count() == 0


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


def test_chunks_are_stitched(ranks):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for chunk, overlap in ((64, 16), (300, 16), (1 << 16, 512)):
        codec = bpe.Codec(ranks, P.PATTERN, chunk, overlap)
        for s in [*odd_texts(200, 1500, 3), "a" * 5000, " " * 3000 + "x", "<|endoftext|>", "it's we'll I'd" * 200]:
            ids = codec.encode(s)
            assert list(array.array("I", ids)) == library.encode_ordinary(s), repr(s[:40])
            assert codec.decode(ids) == s.encode()


def test_bpe_frames(docs, ranks):
    rows = bpe.encode_digests(docs, ranks, P.PATTERN).collect()
    assert len(rows) == 8
    for r in rows:
        if r["doc_id"] in (2, 3):
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())
    back = bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks, P.PATTERN).where("doc_id = 1").first()
    assert bytes(back["bytes"]) == b"the quick brown fox"
    assert bpe.encode_digests(docs.where("false"), ranks, P.PATTERN).count() == 0


def library_digests(ranks, texts):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for i, t in texts:
        ids = array.array("I", library.encode_ordinary(t or ""))
        out[i] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    return out


def test_long_texts_are_dealt_over_tasks(spark, ranks):
    texts = [*enumerate(odd_texts(30, 3000, 8)), (50, "a" * 5000), (51, " " * 3000 + "x"), (52, "it's we'll I'd " * 300), (53, None), (54, ""), (55, ("word " * 40 + "x" * 90) * 20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS `row`", "2 AS k", "'x' AS t").repartition(3)
    wanted = library_digests(ranks, texts)
    for chunk, overlap in ((200, 64), (1000, 32)):
        found = bpe.encode_digests(docs, ranks, P.PATTERN, long=300, long_chunk=chunk, long_overlap=overlap).collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in found} == wanted and len(found) == len(texts)
    assert {r["doc_id"]: tuple(r)[1:] for r in bpe.encode_digests(docs, ranks, P.PATTERN).collect()} == wanted


def test_tables_of_equal_size_are_told_apart(spark):
    one = {bytes([b]): b for b in range(256)}
    two = {bytes([b]): 255 - b for b in range(256)}
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string").coalesce(1)
    ids = [bpe.encode(docs, t, P.PATTERN).first()["ids"] for t in (one, two, one)]
    assert ids == [[97, 98], [158, 157], [97, 98]]
    pieces = [("▁", -1.0), ("a", -1.0), ("b", -2.0), ("ab", -9.0)]
    vocabularies = [{"pieces": p, "byte_fallback": f, "dummy_prefix": True} for p, f in ((pieces, False), ([*pieces[:3], ("ab", -1.0)], False), (pieces, True))]
    texts = spark.createDataFrame([(1, "ab"), (2, "é")], "doc_id long, text string").coalesce(1)
    found = [[r["n_tokens"] for r in token_counts.token_counts(texts, v).orderBy("doc_id").collect()] for v in vocabularies]
    assert found == [[3, 2], [2, 2], [3, 3]]


def test_codewords():
    for n in (1, 2, 3, 4, 5, 6, 20):
        c = langid.codewords(n)
        assert len({tuple(x) for x in c}) == n
        if n > 2:
            assert min((a != b).sum() for i, a in enumerate(c) for b in c[:i]) >= (c.shape[1] + 1) // 2 - (n > 5) * c.shape[1] // 4
    assert (langid.codewords(7) == langid.codewords(7)).all()


WORDS = {"en": "the of and that house with for was this thing", "de": "der die und ein haus mit für war dieses ding", "fr": "le la et que maison avec pour était cette chose", "es": "el los y que casa con para era esta cosa"}


def language_docs(spark, n=160):
    r = random.Random(4)
    langs = list(WORDS)
    rows = [(i, " ".join(r.choices(WORDS[langs[i % 4]].split(), k=r.randint(5, 40))), langs[i % 4]) for i in range(n)]
    return spark.createDataFrame([*rows, (1000, None, "en"), (1001, "", "en"), (1002, "12 -- 3", "de"), (None, "der und die das", "de"), (1003, "the thing " * 20000, None)], "doc_id long, text string, lang string")


def test_language_id(spark):
    docs = language_docs(spark)
    found = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(found) == 165
    for i in range(160):
        assert found[i]["lang_pred"] == list(WORDS)[i % 4] and 0 <= found[i]["score"] <= 1
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    for i in (1000, 1001, 1002):
        assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0)
    assert found[None]["lang_pred"] == "de" and found[1003]["lang_pred"] == "en"


def test_language_id_without_labels(spark):
    docs = language_docs(spark).selectExpr("doc_id", "text", "cast(null AS string) AS lang")
    assert {r["lang_pred"] for r in langid.identify(docs).collect()} == {"und"}
    assert langid.identify(docs.where("false")).count() == 0
    one = language_docs(spark).where("lang = 'de'")
    assert {r["lang_pred"] for r in langid.identify(one).collect()} == {"de", "und"}


def test_language_id_of_odd_tables(spark):
    docs = language_docs(spark, 400)
    clash = docs.selectExpr("*", "1 AS l", "2 AS t", "'x' AS u", "3 AS held", "4 AS lang_pred", "5 AS score", "6 AS ambiguous", "7 AS id", "8 AS k0").unionByName(docs.where("doc_id < 4").selectExpr("*", "1 AS l", "2 AS t", "'x' AS u", "3 AS held", "4 AS lang_pred", "5 AS score", "6 AS ambiguous", "7 AS id", "8 AS k0"))
    assert langid.identify(clash).count() == clash.count()
    none = docs.where("doc_id < 400").selectExpr("cast(null AS long) AS doc_id", "text", "lang")
    assert {r["lang_pred"] for r in langid.identify(none).collect()} == set(WORDS)
    same = docs.where("doc_id < 400").selectExpr("8 AS doc_id", "text", "lang")
    assert {r["lang_pred"] for r in langid.identify(same).collect()} == set(WORDS)


def test_every_language_is_learned(spark):
    rows = [(7 * i + k, " ".join([f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" * 2] * 9), f"l{i}") for i in range(230) for k in range(7)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len({r["lang_pred"] for r in found}) > 220


def test_language_sample_stays_off_the_driver(spark):
    docs = language_docs(spark, 900)
    tracemalloc.start()
    try:
        model = langid.learn(docs)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 900 rows of features are 7 MB, the model 0.1 MB
    assert most < 900 * 2 * langid.DIMENSIONS / 4
    assert model["languages"] == sorted(WORDS) and model["w"].shape[0] == langid.DIMENSIONS
    assert langid.learn(docs.unionByName(docs).repartition(7))["key"] == model["key"]


def test_language_sample_is_the_first_of_each_language(monkeypatch):
    r = random.Random(5)
    rows = [(lang, r.random(), np.full(langid.DIMENSIONS, i, np.float16).tobytes()) for i, lang in enumerate("aaaaaaaaaaaaaaaaaaaabbbbbbbc")]
    monkeypatch.setattr(langid, "fit", lambda x, y, languages: (x[:, 0].tolist(), y.tolist(), languages))
    first = [sorted((x for x in rows if x[0] == lang), key=lambda x: x[1])[:3] for lang in "abc"]
    wanted = [(own[k], y) for k in range(3) for y, own in enumerate(first) if k < len(own)]
    for size in (1, 5, 100):
        again = r.sample(rows, len(rows)) + rows[:9]
        x, y, languages = langid.fit_drawn((zip(*again[i : i + size], strict=True) for i in range(0, len(again), size)), 3)
        assert languages == ["a", "b", "c"] and y == [y for _, y in wanted]
        assert x == [float(rows.index(row)) for row, _ in wanted]
    assert langid.fit_drawn(iter([]), 3) is None


def test_ambiguity_is_flagged():
    model = {"languages": ["a", "b"], "codes": np.array([[1], [-1]], np.int8), "reliable": np.ones(1, np.float32)}
    best, score, margin = langid.decode(model, np.array([[0.001], [5.0], [-5.0]], np.float32))
    assert best.tolist()[1:] == [0, 1] and margin[0] < 0.05 < margin[1]


def brute_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


def test_measures():
    r = random.Random(6)
    for _ in range(200):
        text = "".join(r.choice(["a", "b", "éa", " ", " ", "\n", "#", "|", "\t", " ", "\x1c"]) for _ in range(r.randint(0, 60)))
        raw, words = text.encode(), text.encode().split()
        n, chars, symbols, dups, repeats = quality.measures(raw)[:5]
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert (n, chars, symbols) == (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"))
        assert dups == len(lines) - len(set(lines)) and repeats == brute_repeats(words)


def test_certified_steps():
    assert quality.certified_steps([0, 0, 0], 10, 0.05, 0.05) == 0  # too few texts prove nothing
    assert quality.certified_steps([0, 0, 50], 1000, 0.01, 0.05) == 2
    assert quality.certified_steps([0, 50, 50], 1000, 0.01, 0.05) == 1  # a failed test ends the sequence
    # exact tail: P(X <= 0) = 0.99 ** n
    assert quality.certified_steps([0], 299, 0.01, 0.05) == 1 and quality.certified_steps([0], 298, 0.01, 0.05) == 0


def test_path_takes_what_pays():
    good, bad = [[500, 0, 0, 0], [400, 60, 40, 0]], [[10, 0, 30, 10], [25, 5, 0, 20]]
    steps = quality.path(good, bad)
    assert steps[0] == (0, 1) and (1, 2) in steps and (1, 0) not in steps
    assert quality.path([[5, 0]], [[0, 0]]) == [] and quality.path([], []) == []


def test_quality_verdict_is_that_of_a_plain_computation(spark):
    r = random.Random(17)
    rows, labels = [], {}
    for i in range(2400):
        bad = r.random() < 0.3
        words = [f"w{r.randint(0, 5000)}" + ("#" * r.randint(0, 3) if r.random() < (0.6 if bad else 0.02) else "") for _ in range(60)]
        rows.append((i, " ".join(words), r.choice(["aa", "bb", None])))
        if i % 5:
            labels[i] = int(not bad)
    rows += [(3000, "word " * 40000, "aa"), (3001, "", "bb"), (3002, None, "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    frame = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    found = {x["doc_id"]: x["kept"] for x in quality.quality_rules(docs, frame).collect()}
    half = {x[0]: x[1] for x in docs.selectExpr("doc_id", "pmod(xxhash64(cast(doc_id AS string), 29), 2)").collect()}
    grids = list(quality.RULES.values())
    bins, base = {}, {}
    for i, t, _ in rows:
        m = quality.measures((t or "").encode())
        bins[i] = [sum(c < v for c in g) for g, v in zip(grids, quality.rule_values(m), strict=True)]
        base[i] = m[0] < 50 or 2 * m[4] > m[0]
    for stratum in ("aa", "bb", None):
        mine = [i for i, _, s in rows if s == stratum]
        usable = [i for i in mine if i in labels and not base[i]]
        tune = [i for i in usable if half[i] == 0]
        count = lambda y: [[sum(bins[i][k] == b for i in tune if labels[i] == y) for b in range(len(g) + 1)] for k, g in enumerate(grids)]  # noqa: B023, E731
        steps = quality.path(count(1), count(0))
        test = [i for i in usable if half[i] == 1 and labels[i] == 1]
        taken = 0
        for n in range(1, len(steps) + 1):
            x = sum(any(bins[i][k] > c for k, c in steps[:n]) for i in test)
            tail = sum(math.comb(len(test), j) * 0.06**j * 0.94 ** (len(test) - j) for j in range(x + 1))
            if tail > 0.05 / 3:
                break
            taken = n
        assert taken > 0
        for i in mine:
            assert found[i] == (not base[i] and not any(bins[i][k] > c for k, c in steps[:taken])), (i, stratum)
    assert not found[3002] and not found[3001]


def test_quality_rules(spark):
    good = [(i, " ".join(f"w{(i * 31 + k * 7) % 997}" for k in range(60)), "en") for i in range(3000)]
    bad = [(5000 + i, " ".join(f"w{(i * 17 + k) % 997}***" for k in range(60)), "en") for i in range(50)]
    odd = [(9000, None, "en"), (9001, "", None), (9002, "a b c " * 30, "de"), (None, good[0][1], "en"), (1, good[1][1], "en")]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, lang string").selectExpr("*", "1 AS n_words", "2 AS bins", "'x' AS stratum", "0 AS id")
    labels = spark.createDataFrame([*[(i, 1) for i in range(3000)], *[(5000 + i, 0) for i in range(25)], (None, 1), (0, None)], "doc_id long, quality int")
    rows = quality.quality_rules(docs, labels).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == 3055
    assert all(found[i]["kept"] for i in range(3000)) and not any(found[5000 + i]["kept"] for i in range(50))
    assert found[9000]["base_failed"] and found[9001]["n_words"] == 0 and found[9002]["base_failed"] and found[None]["kept"]
    assert quality.quality_rules(docs, labels.where("false")).where("kept").count() == 3052
    assert quality.quality_rules(docs.where("false"), labels).count() == 0
