"""Queries opN_* : each corpus operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkscope.llm import bpe, dedup, langid, lm, mixing, pii, quality, token_counts, topk, warc
from sparkscope.llm.common import load, materialise

#: Kinds of vocabulary files; a cluster names its own paths here.
PIECES, RANKS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(load(spark, sf_dir, "documents"), token_counts.read_vocabulary(public_tokenizers.path(PIECES)))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(load(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), every=50, k=5)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(load(spark, sf_dir, "documents"), width=4, percent=80)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(load(spark, sf_dir, "documents"), bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(materialise(warc.archive(load(spark, sf_dir, "pages")), "warc"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(load(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_pii": op2_pii,
    "op3_language_id": op3_language_id,
    "op4_mixing": op4_mixing,
    "op5_exact_topk": op5_exact_topk,
    "op6_quality_rules": op6_quality_rules,
    "op7_near_dedup": op7_near_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_warc": op9_warc,
    "op10_lm_scores": op10_lm_scores,
}

#: SQL for what SQL can express exactly. The others depend on trained models, seeded hashes or tokenizers; tests hold
#: them against brute-force versions.
ORACLES: dict[str, str] = {
    "op5_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT vec_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM flat q JOIN flat c ON q.i = c.i WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach AS (SELECT a AS doc_id, b AS to_id FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.to_id = l.a),
c AS (SELECT doc_id, min(to_id) AS m FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(c.m, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id""",
    "op9_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (g * 5 + 1)::BIGINT, 5))::BIGINT >> k) & 31) + 1)::BIGINT, 1)), '')), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM d""",
}
