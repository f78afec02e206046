"""What the operators share: tables, the shared folder, folds and small column helpers."""

from __future__ import annotations

import re
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_folder, ship

#: The six ASCII whitespace characters that the contracts strip and split at.
ASCII_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest number of rows of two or three longs that a join may broadcast, once they have been counted (about 12 MB).
BROADCAST_ROWS = 500_000
#: Largest number of bytes of strings that such a table may hold besides.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, as the session's spark.checkpoint.dir names it."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it again: what follows has a short lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _made[id(out)] = (weakref.ref(out), path)
    return out


#: The path of each table that materialise() returned and that is still referred to.
_made: dict[int, tuple[weakref.ref, str]] = {}


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that materialise() returned, once everything made of them has been written itself."""
    for df in tables:
        ref, path = _made.pop(id(df), (None, ""))
        if ref is not None and ref() is df:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def held_out(doc_id: str) -> Column:
    """True for the fold that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is. Strings of ASCII only take the JVM's fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """`df`, marked for broadcast if it has few enough rows as counted; else as it is, for a shuffled join that adaptive execution splits where keys are hot."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def bounded(df: DataFrame) -> DataFrame:
    """`df` (written, so that counting is cheap), marked for broadcast if its rows and the bytes of its strings are few, both measured."""
    text = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() == "string"]
    m = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum(text, F.lit(0))), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if m["n"] <= BROADCAST_ROWS and m["b"] <= BROADCAST_BYTES else df


def named(column: str) -> Column:
    """A column by its exact name, dots and back-ticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, columns: list[str] | None = None, /, **own: Column) -> DataFrame:
    """The caller's columns (or those given) as one struct _row, beside columns of the operator's own: no name of the caller's can clash with them."""
    return df.select(F.struct(*[named(c) for c in columns or df.columns]).alias("_row"), *[c.alias(n) for n, c in own.items()])


def unpacked(df: DataFrame, columns: list[str], **made: Column) -> DataFrame:
    """The caller's columns again, those that the operator makes in their place if the caller has such a name, else behind them."""
    left = {n.lower(): (n, c) for n, c in made.items()}
    out = []
    for c in columns:
        name, new = left.pop(c.lower(), (c, F.col("_row")[c]))
        out.append(new.alias(name))
    return df.select(*out, *[c.alias(n) for n, c in left.values()])


def python_ready(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Before a Python operator: the package is on the workers, and Arrow batches have fewer rows and bytes than Spark's defaults, so that a batch of long texts fits beside the JVM. Smaller settings stay."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    units = {"b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", spark.conf.get(key, "64m").strip().lower()).groups()
    if not 0 < int(number) << units.get(unit, 0) <= size:
        spark.conf.set(key, f"{size}b")
