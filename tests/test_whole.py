"""Queries over whole tables: none of their rows and texts is left out for its length or number."""

from pyspark.sql import functions as F

from millrace.plans import catalogue, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_every_document_is_signed_and_quoted_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert registry.QUERIES["str04_simhash_md5"](spark, SF).count() == docs.count()
    quoted = registry.QUERIES["str22_quoted"](spark, SF).join(docs, "doc_id").where(F.length("quoted") < F.length("text") + 2)
    assert quoted.count() == 0 and docs.where(F.length("text") > 1500).count() > 0


def test_all_events_count_as_active(spark):
    days = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("date")).distinct().count()
    assert registry.QUERIES["agg26_longest_streak"](spark, SF).first().streak <= days
