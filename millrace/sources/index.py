"""Configuration, commit dates and the tables of an index folder."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.files import versioned


def config(spark: SparkSession, folder: str, name: str) -> dict:
    """A configuration document, a JSON object `name`.json in a folder that Spark can reach; {} where there is none. Documents are small and read on the driver."""
    try:
        rows = spark.read.text(f"{folder.rstrip('/')}/{name}.json", wholetext=True).take(2)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    value = json.loads(rows[0]["value"]) if rows else {}
    if not isinstance(value, dict):
        raise ValueError(f"{name}: not an object")
    return value


def config_table(spark: SparkSession, document: dict, key: str, schema: str) -> DataFrame:
    """A list of objects in a configuration document as a table; fields that an object lacks are null, ones that the schema lacks are an error."""
    wanted = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    rows = document.get(key, [])
    if extra := {k for r in rows for k in r} - set(wanted):
        raise ValueError(f"{key}: unknown fields {sorted(extra)}")
    return spark.createDataFrame([tuple(r.get(c) for c in wanted) for r in rows], schema)


def history(dates: DataFrame) -> DataFrame:
    """(path, first, last, commits) of commit dates (path, date), which come as a table: reading repositories is left to the caller. Paths without a date have no row."""
    rows = dates.where("date IS NOT NULL")
    return rows.groupBy("path").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("commits"))


@dataclass(frozen=True)
class Index:
    """The tables of an index: Parquet folders, each with a column that holds the version of its layout. Tables are opened for reading only; changes make new ones."""

    spark: SparkSession
    folder: str
    version: int
    column: str = "schema_version"

    def table(self, name: str) -> DataFrame:
        """A table without its version column; reading rows of another version fails."""
        rows = self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}")
        if self.column not in rows.columns:
            raise ValueError(f"{name} has no {self.column}")
        return versioned(rows, self.column, self.version).drop(self.column)

    def create(self, name: str, rows: DataFrame) -> None:
        """Write a new table; one that is there stays as it is, and that is an error."""
        rows.withColumn(self.column, F.lit(self.version)).write.mode("errorifexists").parquet(f"{self.folder.rstrip('/')}/{name}")

    def views(self, *names: str) -> None:
        for name in names:
            self.table(name).createOrReplaceTempView(name)
