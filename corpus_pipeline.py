"""From documents to packed training sequences: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs; a text that loses lines gets its new n_chars.

Defined results, in every stage: a null text is the empty text (and stays null where a stage keeps the row as it is);
empty texts go with the quality rules, and stay if a stage is used by itself; very long texts are taken whole; repeated
rows are judged each on its own, except that near dedup keeps one of them; ties go to the smallest doc_id; an empty table
gives no rows; columns may have any names, also those that the operators use inside.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanspark.llm import decontam, linedup, neardup, packing, rules
from spanspark.llm.common import broadcast_up_to, checkpointed, quoted, remove, shared_folder, table, text_of, unused

#: Rows (of 25 bytes) of a table that is broadcast at most.
NAMED_ROWS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return docs.where(rules.verdict(docs).isNull())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a document with a smaller id holds too."""
    others = {c: f"other_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    own = docs.select("doc_id", "text", *(F.col(quoted(c)).alias(x) for c, x in others.items()))
    kept = linedup.kept_texts(own, carry=tuple(others.values()))
    if "n_chars" in others:
        kept = kept.withColumn(others["n_chars"], F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*(F.col(others.get(c, c)).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; documents without words belong to no group and stay."""
    doc, row, named_doc, named_row, stays, whole = unused(docs.columns, "key_doc", "key_row", "named_doc", "named_row", "named_stays", "kept_row")
    found = neardup.near_duplicates(docs).where("n_shingles > 0").groupBy("doc_id", "row").agg(F.first("first").alias("first"), F.count(F.lit(1)).alias("copies"))
    # Only rows that go, or of which one of several equal ones stays, are named; the others pass by.
    named = checkpointed(found.where("row <> first or copies > 1").select(F.col("doc_id").alias(named_doc), F.col("row").alias(named_row), (F.col("row") == F.col("first")).alias(stays)))
    keyed = docs.withColumn(doc, F.col("doc_id").cast("bigint")).withColumn(row, F.xxhash64(F.col(doc), text_of()))
    both = keyed.join(broadcast_up_to(named, NAMED_ROWS), F.col(doc).eqNullSafe(F.col(named_doc)) & (F.col(row) == F.col(named_row)), "left")
    columns = [F.col(quoted(c)) for c in docs.columns]
    single = both.where(F.col(stays)).groupBy(doc, row).agg(F.first(F.struct(*columns)).alias(whole))
    single = single.select(*(F.col(whole)[c].alias(c) for c in docs.columns))
    return both.where(F.col(stays).isNull()).select(*columns).unionByName(single)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, neither whole nor edited."""
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("best-fit packing", best_fit_packing)]

#: Alignment, near copies and packing have no SQL form; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each keeps stays in the cluster's shared checkpoint folder until the next has read it."""
    folder = f"{shared_folder(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
