"""Logs of stages and documents that change, as streams over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_log(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (stage, line, event, text) from log files <stage>.log below a folder: each line is an event, and one of the form `exit N` ends the stage."""
    rows = spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").load(folder)
    return events(rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.log$", 1).alias("stage"), "value"))


def events(rows: DataFrame) -> DataFrame:
    """(stage, event, text, code) of log lines (stage, value)."""
    code = F.regexp_extract("value", r"^exit (-?\d+)\s*$", 1)
    done = code != ""
    return rows.select("stage", F.when(done, "exit").otherwise("line").alias("event"), F.when(~done, F.col("value")).alias("text"), F.when(done, code.cast("int")).alias("code"))


def chain(order: DataFrame, ended: DataFrame) -> DataFrame:
    """(stage, pos, state) of the stages `order` (stage, pos), given the exit codes `ended` (stage, code): done, failed, running (the first without a code), waiting, and stopped after one that failed. The stages of a chain are few."""
    j = order.join(ended.groupBy("stage").agg(F.max(F.abs("code")).alias("code")), "stage", "left")
    first = j.agg(F.min(F.when(F.col("code") != 0, F.col("pos"))).alias("bad"), F.min(F.when(F.col("code").isNull(), F.col("pos"))).alias("open"))
    state = F.when(F.col("pos") > F.col("bad"), "stopped").when(F.col("code") == 0, "done").when(F.col("code").isNotNull(), "failed").when(F.col("pos") == F.col("open"), "running").otherwise("waiting")
    return j.join(F.broadcast(first)).select("stage", "pos", state.alias("state"))


def changed(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """A stream of (path, at, digest, value) of whole documents in a folder, one for each version that is written: a poll of a document is a trigger of this stream. Versions with an equal digest come once."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob).load(folder)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"), F.sha2("value", 256).alias("digest"), "value")
    return rows.withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["digest"])
