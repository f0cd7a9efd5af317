"""A corpus pipeline: language ID, near-duplicates, personal data, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and returns the columns of docs;
the last returns a row of digests for each document of the mix. The stages' results are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope.llm import bpe, dedup, langid, mixing, pii
from sparkscope.llm.common import bounded_batches, load, materialise, release
from sparkscope.llm.queries import RANKS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: those without a letter go, null texts too, and those whose two best languages are level.

    Where no document has a language to learn from, all with a letter stay. Rows are judged one by one, repeated ones too.
    """
    bounded_batches(spark)
    columns = docs.columns
    # the kept columns have positions for names, so none can clash with the prediction's
    named = docs.toDF(*[f"own{i}" for i in range(len(columns))])
    own = {c: f"own{i}" for i, c in enumerate(columns)}
    model = langid.learn(named, own["lang"], own["doc_id"], own["text"])
    if model is None:
        return docs.where(F.coalesce(docs["text"], F.lit("")).rlike(r"\p{L}"))
    found = langid.predict(named, model, list(own.values()), own["text"], ambiguous_below=0.02)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & ~F.col("ambiguous")).select(*[F.col(k).alias(c) for c, k in own.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    A document without an id stays, and so does one without words. Rows with the same id are one document: of those with
    the same text, too, one row is left, whatever their other columns hold.
    """
    bounded_batches(spark)
    found = dedup.near_duplicates(docs, width=5, percent=80)
    gone = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    gone = materialise(gone.where("not kept or n > 1"), "gone")
    drop = gone.where("not kept").select(F.col("doc_id").alias("gone_id"))
    if drop.limit(dedup.MOST_BROADCAST + 1).count() <= dedup.MOST_BROADCAST:
        drop = F.broadcast(drop)
    left = docs.join(drop, docs["doc_id"] == F.col("gone_id"), "left_anti")
    return left if not gone.where("kept").limit(1).count() else left.where("doc_id is null").unionByName(left.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by their kinds. A null text stays null, repeated rows stay."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, repeated in whole and in part to their sources' targets. Those without words are not taken; a null
    source is a source; repeated rows share what their source takes."""
    out = mixing.mixture(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, digest of the ids and digest of the decoded bytes of every document of the mix, one row for each
    copy. A null text is empty: no tokens."""
    bounded_batches(spark)
    import public_tokenizers

    return bpe.encode_digests(docs, bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixed_sources", mixed_sources), ("byte_bpe", byte_bpe)]

#: The stages' decisions (trained classifier, MinHash, seeded hashes, tokenizer) are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, name)
            if before is not None:
                release(before)
            before = docs
    return docs
