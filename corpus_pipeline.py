"""The corpus pipeline: language ID, near-duplicate removal, suffix-array deduplication,
benchmark decontamination and tokenisation of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs; run() applies them all.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, decontaminate, language_id, near_dedup, suffix_dedup
from tidewell.llm.common import cut, null_safe_text

#: Columns that the stages use beside those of their documents.
KEPT, WHOLE, NUMBER = "__kept", "__whole", "__number"

def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` with columns that an operator might replace under other names."""
    return docs.select("text", *[F.col(f"`{c}`").alias(f"__{c}") for c in docs.columns if c != "text"])


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``found`` with the columns of ``docs``."""
    return found.select(*["text" if c == "text" else F.col(f"`__{c}`").alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; null texts and texts without a letter go. Where no
    language was learned (no row has one), every text with a letter stays."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.predict(_aside(docs), model)
    return _back(found.where(F.col("lang_pred") != language_id.UNDETERMINED), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the smallest doc_id stays.

    Different texts under one doc_id are documents of their own; of rows that repeat both,
    one stays. Rows with a null doc_id are classes of their own and stay.
    """
    columns = docs.columns
    unnamed = docs.where("doc_id is null")
    named = docs.where("doc_id is not null").withColumn(WHOLE, F.coalesce(F.sha2("text", 256), F.lit("")))
    if named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        stay = near_dedup.near_duplicates(named).where("doc_id = class_id").select("doc_id")
        return named.join(stay, "doc_id", "left_semi").select(*columns).unionByName(unnamed)
    # the first text of an id is numbered by the id, its others above all ids
    texts = cut(named.select("doc_id", WHOLE).distinct())
    first = texts.groupBy("doc_id").agg(F.min(WHOLE).alias(WHOLE))
    above = texts.agg(F.max("doc_id")).first()[0] + 1
    others = texts.join(first, ["doc_id", WHOLE], "left_anti").withColumn(NUMBER, F.lit(above) + F.monotonically_increasing_id())
    numbered = cut(first.withColumn(NUMBER, F.col("doc_id")).unionByName(others))
    classes = near_dedup.near_duplicates(named.join(numbered, ["doc_id", WHOLE]), NUMBER).select(F.col("doc_id").alias(NUMBER), "class_id").distinct()
    stay = numbered.join(classes, NUMBER).groupBy("class_id").agg(F.min(F.struct("doc_id", WHOLE)).alias("r")).select("r.*")
    kept = named.join(stay, ["doc_id", WHOLE], "left_semi").dropDuplicates(["doc_id", WHOLE])
    return kept.select(*columns).unionByName(unnamed)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that also start earlier go; characters that are cut in two go whole.

    Rows with a null doc_id take no part, and where rows of one doc_id differ, only its smallest text does.
    """
    columns = docs.columns
    removed = suffix_dedup.repeated_bytes(docs).select("doc_id", F.col("whole").alias(WHOLE), F.col("kept_text").alias(KEPT))
    joined = docs.withColumn(WHOLE, F.sha2(null_safe_text(), 256)).join(removed, ["doc_id", WHOLE], "left")
    if "n_chars" in columns:
        joined = joined.withColumn("n_chars", F.when(F.col(KEPT).isNotNull(), F.length(KEPT).cast("long")).otherwise(F.col("n_chars")))
    return joined.withColumn("text", F.coalesce(KEPT, "text")).select(*columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go, by the contamination rule of op4; null and empty texts hold none and stay."""
    found = decontaminate.find_benchmark(_aside(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _back(found.where("not contaminated"), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as token ids (little-endian unsigned 32-bit), with their number and digests, beside doc_id and, where the documents
    have them, lang and source; other columns stay behind. A null text has no tokens."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe(docs.select("doc_id", "text", *[c for c in ("lang", "source") if c in docs.columns]), path, public_tokenizers.PATTERN, with_ids=True, keep_text=False)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_strings),
    ("decontaminate", drop_contaminated),
    ("tokenize", tokenize),
]

#: None of the stages but decontamination can be stated in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
