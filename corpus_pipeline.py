"""A training corpus from raw documents, stage by stage.

Toxic documents go, then documents that fail the line rules (the others lose their
failed lines), then near-duplicates; sources are mixed to target weights, and the mix is
packed into training sequences. Each stage's result is written as Parquet and read again
as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.llm import line_rules, mixing, near_dedup, packing, toxicity
from urlrisk.llm.scratch import Scratch
from urlrisk.llm.texts import doubtful

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores below 0.5, as they are. It learns
    from all labels, and a document's own label decides nothing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, F.lit(True))
    return toxicity.score(docs, model, COLUMNS).where("score < 0.5").select(*COLUMNS)


def apply_line_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their failed lines."""
    judged = line_rules.clean_lines(docs, carry=["doc_id", "lang", "source", "n_chars"]).where("kept")
    length = F.when(F.col("lost_chars") > 0, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    return judged.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", length.alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word
    shingles, similarity 0.8 or more). Rows that share an id are one document, of which
    the least row stays; rows without an id all stay."""
    judged = near_dedup.near_duplicates(docs, near_dedup.Forest(words=5, percent=80))
    decided = judged.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("kept").alias("kept"))
    scratch = Scratch(spark, "near-duplicates")
    decided = scratch.put(decided, "decided")  # ids only
    rows, rest = docs.select(*COLUMNS), [c for c in COLUMNS if c != "doc_id"]
    # Texts that surely stay as they are do not move; only the others are joined with the decisions.
    judged = doubtful(rows, decided.where("n > 1 or not kept"), "doc_id", scratch)
    stay = judged.where("doc_id is null or not _doubtful").drop("_doubtful")
    single = judged.where("_doubtful").drop("_doubtful").join(decided.where("kept and n = 1"), "doc_id", "left_semi")
    many = doubtful(rows, decided.where("n > 1"), "doc_id", scratch).where("_doubtful").drop("_doubtful")
    repeated = many.join(decided.where("kept and n > 1"), "doc_id", "left_semi")  # only these texts are compared
    one = repeated.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("_r")).select("doc_id", "_r.*").select(*COLUMNS)
    return stay.unionByName(single).unionByName(one)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as its source's target asks for."""
    copies = mixing.times(docs.select(*COLUMNS), weights=(1, 2, 3), share=1.0, most=3).where("times > 0")
    return copies.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and places in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs, capacity=2048), capacity=2048, in_place=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_rules", apply_line_rules),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, hashed draws and tokenization are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in `sf_dir`; the last stage's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
