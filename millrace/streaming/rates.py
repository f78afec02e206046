"""Sliding counts, windows, once-only rows and status machines: batch forms over tables and streaming forms over files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.session import shared_folder


def sliding_counts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Each event with the number of its key's events in the `seconds` up to it, both ends included."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n", F.count(F.lit(1)).over(w))


def shared_backoff(requests: DataFrame, penalties: DataFrame, ts: str = "ts", stretch: int = 3600) -> DataFrame:
    """`requests` (ts) with `wait`, the seconds (0 or more) until all may go on: the latest deadline that any of the penalties (ts, delay in seconds, reason) up to then has set, and its reason while there is a wait. The latest deadline runs over stretches of time first,
    so a task sees one stretch, and the stretches, which are few, are joined."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    due = F.struct((F.col("at") + F.col("delay") * 1_000_000).cast("long").alias("end"), F.col("reason").alias("reason"))
    rows = requests.withColumn("at", at).withColumn("_due", F.lit(None).cast("struct<end:bigint,reason:string>"))
    fines = penalties.withColumn("at", at).select("at", due.alias("_due"))
    cell = F.floor(F.col("at") / F.lit(stretch * 1_000_000))
    both = rows.withColumn("_ask", F.lit(True)).unionByName(fines, allowMissingColumns=True).withColumn("_cell", cell)
    own = both.withColumn("_run", F.max("_due").over(Window.partitionBy("_cell").orderBy("at")))
    past = fines.groupBy(cell.alias("_cell")).agg(F.max("_due").alias("_top"))
    cells = both.select("_cell").distinct().join(past, "_cell", "left")
    cells = cells.select("_cell", F.max("_top").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    last = F.greatest(F.col("_run"), F.col("_before"))
    wait = F.greatest(F.lit(0.0), (F.col("_last.end") - F.col("at")) / F.lit(1e6))
    out = own.where("_ask").join(cells, "_cell", "left").withColumn("_last", F.coalesce(last, F.col("_run"), F.col("_before")))
    return out.withColumn("wait", F.coalesce(wait, F.lit(0.0))).select(*requests.columns, "wait", F.when(F.col("wait") > 0, F.col("_last.reason")).alias("reason"))


def stream_of(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream over the Parquet files of a folder, with a timestamp that a watermark can use."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by type and tumbling window, late events dropped behind the watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def once(stream: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each key once, as long as the watermark remembers it."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def status_machine(stream: DataFrame, order: list[str]) -> DataFrame:
    """(user_id, status, steps): the furthest status that each user has reached; statuses only move forward."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, steps = state.get if state.exists else (-1, 0)
        for pdf in batches:
            for name in pdf.sort_values("ts")["event_type"]:
                new = order.index(name) if name in order else -1
                if new > at:
                    at, steps = new, steps + 1
        state.update((at, steps))
        yield pd.DataFrame({"user_id": [key[0]], "status": [order[at] if at >= 0 else None], "steps": [steps]})

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, status string, steps long", "at long, steps long", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there now and return its rows, written batch by batch into the shared folder beside its checkpoint; a batch that runs again replaces its own rows. In complete mode the last batch counts."""
    spark = stream.sparkSession
    folder, seen = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:10]}", []

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows-{n}")
        seen.append(n)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    kept = sorted(set(seen))[-1:] if mode == "complete" else sorted(set(seen))
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/rows-{n}" for n in kept]) if kept else spark.createDataFrame([], stream.schema)
