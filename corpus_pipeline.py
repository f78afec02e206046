"""From raw documents to a training mix: each stage works on all that the one before it kept.

1. toxicity: documents scored at 0.5 or more go. The model learns from the labelled documents outside the held-out fold.
2. line_dedup: lines of at least 20 characters that at least 3 documents hold stay in the document with the largest doc_id only; n_chars follows the text.
3. near_dedup: of documents connected by a similarity of 0.8 or more over five-word shingles, the one with the smallest doc_id stays.
4. decontaminate: documents with a window of a benchmark item go.
5. mix: source weights by temperature; no document goes, `copies` tells how often each is read and `blocks` in which blocks.

Defined cases: a null text is scored as an empty one and becomes an empty one at the second stage; documents without text are near copies of nothing and leak nothing. A null doc_id is below all others at the second stage; its row stays at the third and fourth. Rows that repeat
a doc_id are decided one by one but at the fourth stage, where they are one document. An empty table gives an empty result; without usable labels no document is toxic. Columns beside those of documents stay, whatever their names, but for those of the last stage's outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, line_dedup, minhash_dedup, mixing, toxicity
from millrace.llm.common import held_out, materialise, named, packed, table, unpacked


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), usable=~held_out("_id"))
    others = [c for c in docs.columns if c != "text"]  # the text goes through the stage by itself, once
    rows = toxicity.score(packed(docs, others, text=F.col("text")), model).where("score < 0.5")
    return unpacked(rows, others, text=F.col("text")).select(*map(named, docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c != "text"]
    rows = line_dedup.dedup_lines(packed(docs, others, doc_id=F.col("doc_id"), text=F.col("text")))
    return unpacked(rows, others, text=F.col("text"), n_chars=F.length("text").cast("long")).select(*map(named, docs.columns))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near), ("decontaminate", drop_leaks), ("mix", mix)]

#: SQL can't train the first stage's model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
