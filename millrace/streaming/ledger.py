"""Resumable work: what to do again, what to reuse, and calls remembered in a cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import ship

#: Where work that was going on when a run ended starts again.
RESUME = {"listing": "pending", "processing": "listed", "downloading": "pending"}


def recovered(ledger: DataFrame) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in RESUME.items() for x in kv])
    return ledger.withColumn("status", F.coalesce(F.element_at(m, F.col("status")), F.col("status")))


def reopened(files: DataFrame, folders: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (id, folder, status) that failed or are lost (id) become pending, and done folders (folder, status) above them are listed again."""
    again = files.join(lost.select("id").distinct().withColumn("_l", F.lit(True)), "id", "left").withColumn("_again", (F.col("status") == "failed") | F.coalesce("_l", F.lit(False)))
    opened = again.where("_again").select("folder").distinct().withColumn("_o", F.lit(True))
    out = again.withColumn("status", F.when(F.col("_again"), "pending").otherwise(F.col("status"))).select(files.columns)
    parents = folders.join(opened, "folder", "left").withColumn("status", F.when(F.col("_o") & (F.col("status") == "done"), "listed").otherwise(F.col("status"))).select(folders.columns)
    return out, parents


def to_extract(content: DataFrame, stored: DataFrame, *, force: bool = False, retry_errors: bool = False) -> DataFrame:
    """Contents whose text isn't stored yet: each once, whatever the number of copies and runs."""
    done = stored if retry_errors is False else stored.where("status <> 'error'")
    rows = content.select("sha").distinct()
    return rows if force else rows.join(done.select("sha").distinct(), "sha", "left_anti")


def cached_calls(rows: DataFrame, cache: DataFrame, key: str, argument: str, call: Callable[[str], str]) -> DataFrame:
    """`rows` with `answer`: from the cache (key, answer) where it is, else by `call`, once for each key. A call that fails leaves one row without an answer."""
    ship(rows.sparkSession)

    @F.pandas_udf("answer string, error string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            got = []
            for text in s:
                try:
                    got.append((call(text), None))
                except Exception as e:  # noqa: BLE001  a row, not the run
                    got.append((None, str(e)))
            yield pd.DataFrame(got, columns=["answer", "error"])

    known = cache.select(F.col(key), F.col("answer").alias("_known"))
    missing = rows.join(known, key, "left_anti").groupBy(key).agg(F.min(argument).alias(argument)).withColumn("_a", ask(F.col(argument))).select(key, F.col("_a.answer").alias("_new"), F.col("_a.error").alias("error"))
    j = rows.join(known, key, "left").join(missing, key, "left")
    return j.withColumn("answer", F.coalesce("_known", "_new")).drop("_known", "_new")
