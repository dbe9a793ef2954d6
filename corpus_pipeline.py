"""A training corpus from raw documents: toxic documents, repeated passages, near-duplicates and benchmark text go, the rest becomes tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of ``documents``; the last returns
doc_id, n_tokens, ids (the tokens, packed as little-endian unsigned 32-bit integers) and exact (they decode to the text again).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import bpe, decontaminate, line_dedup, near_dedup, queries, toxicity
from weir.llm.common import table, written

#: Words of a shingle and the least similarity, in percent, of near-duplicates.
SHINGLE, PERCENT = 5, 80
#: Texts and bytes that the tokenizer takes at a time: its worker lives on with what the stages before left in it.
TOKENIZED = {"rows": 256, "size": 1 << 20}


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = queries.toxicity_chain(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain, queries.CATEGORIES).where(~F.col("is_toxic")).select(*docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of repeated rows one stays; rows with a null id are no one's copy unless their text is the same."""
    kept = near_dedup.group(docs, k=SHINGLE, percent=PERCENT).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    out = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return out.withColumn("_th", F.xxhash64("text")).dropDuplicates(["doc_id", "_th"]).select(*docs.columns)


def remove_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(docs.select("doc_id", "text"), queries.BYTE_BPE, **TOKENIZED)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", remove_benchmark_text),
    ("bpe", tokenize),
]

#: SQL has no classifier chain, MinHash or tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
