"""From raw documents to packed training sequences: five stages, each written and read again.

1. toxicity: documents that the ordinal model rejects go.
2. exact dedup: one row of each group of equal texts stays.
3. SimHash near-dedup: the document with the smallest id of each group stays.
4. decontamination: documents with a passage of a benchmark item go.
5. packing: the remaining documents become pieces of sequences of 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattsift.llm.common import documents, materialize, table, text_of
from wattsift.llm.decontaminate import contamination
from wattsift.llm.exact_dedup import exact_dedup, normalised
from wattsift.llm.packing import pack
from wattsift.llm.simhash_dedup import similar_groups
from wattsift.llm.toxicity import rejection, train


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the model does not reject; null and empty texts stay, repeated rows are judged alike, an empty table stays empty."""
    model = train(documents(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return docs.filter(~rejection(model)(F.col("text")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts; null and empty texts are one group, and a null doc_id stays only if all of its group are null.

    Rows that stay are found by id and digest; where a row repeats, one of its
    repeats with the most code points stays.
    """
    found = materialize(exact_dedup(docs).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "kept"), "verdicts")
    sha = F.lower(F.sha2(normalised(text_of(docs["text"])).cast("binary"), 256))
    kept = found.filter("kept").select("id", "sha")
    stay = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["id"]) & (sha == kept["sha"]), "left_semi")
    if found.groupBy("id", "sha").count().filter("count > 1").limit(1).count():
        stay = stay.dropDuplicates(["doc_id", "text"])
        longest = F.max(F.struct(F.length(text_of("text")).alias("n"), F.col("text").alias("text"))).alias("one")
        one = stay.select("doc_id", "text").groupBy("doc_id", F.sha2(normalised(text_of("text")).cast("binary"), 256).alias("sha")).agg(longest).select(F.col("doc_id").alias("id"), F.col("one.text").alias("best"))
        stay = stay.join(one, stay["doc_id"].eqNullSafe(one["id"]) & stay["text"].eqNullSafe(one["best"]), "left_semi")
    return stay


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; rows without doc_id stay, and texts without words are one group."""
    groups = similar_groups(docs)
    gone = groups.filter("doc_id != group_id").select(F.col("doc_id").alias("id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["id"], "left_anti")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose doc_id has no passage of a benchmark item; rows without doc_id count as one document, and empty texts stay."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("id")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["id"]), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences: null and empty texts are one end id, repeated rows are packed each, an empty table gives none."""
    return pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("decontamination", without_benchmarks),
    ("packing", packed),
]

#: No SQL: the toxicity model is trained, and packing depends on a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
