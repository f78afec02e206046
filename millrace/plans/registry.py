"""The queries by name, and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "agg12_folder_overlap"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under `name`, with the SQL for its rows where SQL can state them."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("src06_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def src06_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
