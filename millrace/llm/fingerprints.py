"""Document fingerprints: SimHash over weighted term hashes, and permuted block tables for search within a Hamming radius.

A term is a shingle of three words (runs of anything but ASCII whitespace, A-Z lower-cased); a text of fewer words is one term. A term weighs
1 + ln(its count), in units of 1/4096, and each of its 64 hash bits votes for or against with that weight. Texts without a word have fingerprint 0.

Search: the 64 bits are cut in `blocks` blocks. Two fingerprints within `radius` bits agree on at least blocks - radius whole blocks, so one table for each choice of that many blocks,
keyed by the bits chosen, finds every pair; candidates are checked by their number of different bits.

The edited text of a document ends in the beginning of the next document. Documents are dealt by ranges of doc_id (cut at quantiles), and the first document of every range
also goes, as a reader only, to the range before it; so each text moves once and no task sees more than its range. The ranges, three numbers each, are broadcast and searched in binary, so the plan doesn't grow with them.

Defined cases: null texts are empty; a null doc_id comes before all others; rows that repeat a doc_id are neighbours, ordered by text; a single row is its own next document.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialise, named, python_ready, small_side, table
from millrace.llm.text_arrays import flat, groups, mix, words_by_row

WORDS = 3


def simhash(texts: pa.Array) -> np.ndarray:
    """The fingerprints (uint64) of a string column."""
    data, at = flat(texts)
    out = np.zeros(len(texts), np.uint64)
    for i, j in groups(at):
        words, bounds = words_by_row(data, at, i, j)
        for r in range(j - i):
            own = words[bounds[r] : bounds[r + 1]]
            if not len(own):
                continue
            m = min(len(own), WORDS)
            terms = np.zeros(len(own) - m + 1, np.uint64)
            for k in range(m):
                terms += mix(own[k : len(own) - m + 1 + k], 40 + k)
            terms, n = np.unique(mix(terms, 50 + m), return_counts=True)
            weight = np.rint(4096 * (1 + np.log(n)))  # whole numbers, whose sums are exact in any order
            votes = np.zeros(64)
            for k in range(0, len(terms), 8192):
                bits = np.unpackbits(terms[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                votes += weight[k : k + 8192] @ bits.astype(np.float64)
            out[i + r] = np.packbits(2 * votes > weight.sum(), bitorder="little").view(np.uint64)[0]
    return out


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b) / 64.0


def _described(ids: list[int], texts: list[str], nexts: list[str], next_fps: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, nexts)]
    efps = simhash(pa.array(edited, pa.string()))
    cells = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([f"{int(x):016x}" for x in fps]),
        pa.array([f"{int(x):016x}" for x in efps]),
        pa.array(_likeness(fps, efps)),
        pa.array(_likeness(fps, next_fps)),
        pa.array(fps.view(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(cells, ["_o", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "_fp"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, reader, _o, text) in order: each that isn't a reader is described with the row after it."""
    held: tuple | None = None  # the last row: bucket, reader, id, text, fingerprint
    for batch in batches:
        bucket, reader, ids = (batch.column(c).to_pylist() for c in range(3))
        texts = batch.column(3).fill_null("")
        fps, texts = simhash(texts), texts.to_pylist()
        rows = [] if held is None else [held]
        rows += list(zip(bucket, reader, ids, texts, fps))
        held = rows[-1] if rows else None
        pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1] and x[0] == y[0]]
        if pairs:
            yield _described([x[2] for x, _ in pairs], [x[3] for x, _ in pairs], [y[3] for _, y in pairs], np.array([y[4] for _, y in pairs], np.uint64), np.array([x[4] for x, _ in pairs], np.uint64))


def describe(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, _fp) of each row."""
    spark = docs.sparkSession
    python_ready(spark)
    low = -(2**63)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.coalesce(named(doc_id).cast("long"), F.lit(low)).alias("_o"), named(text).alias("_text"))
    ranges = 4 * parts  # several to a task, so that tasks even out
    shares = ",".join(str(i / ranges) for i in range(1, ranges))  # one literal, however many ranges
    cuts = rows.select(F.expr(f"percentile_approx(_o, cast(split('{shares}', ',') AS array<double>), {max(10_000, 4 * ranges)})").alias("c")).first()["c"] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def ranged(o: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, o.to_numpy()))

    first = rows.groupBy(ranged("_o").alias("b")).agg(F.min("_o").alias("m")).toPandas().sort_values("b")
    least, before = np.full(len(cuts) + 1, low, np.int64), np.zeros(len(cuts) + 1, np.int32)
    least[first.b] = first.m
    before[first.b] = np.roll(first.b, 1)  # the range before; before the first comes the last
    shared = spark.sparkContext.broadcast((cuts, least, before))

    @F.pandas_udf("b int, p int")
    def placed(o: pd.Series) -> pd.DataFrame:
        cuts, least, before = shared.value
        at = np.searchsorted(cuts, o.to_numpy())
        return pd.DataFrame({"b": at, "p": np.where(least[at] == o.to_numpy(), before[at], -1)})

    to = [F.struct(F.col("_at.b").alias("b"), F.lit(False).alias("r")), F.when(F.col("_at.p") >= 0, F.struct(F.col("_at.p").alias("b"), F.lit(True).alias("r")))]
    rows = rows.select(placed("_o").alias("_at"), "_o", "_text")
    dealt = rows.select(F.explode(F.filter(F.array(*to), lambda x: x.isNotNull())).alias("_to"), "_o", "_text").select("_to.b", "_to.r", "_o", "_text")
    ordered = dealt.repartition(parts, "b").sortWithinPartitions("b", "r", "_o", "_text")
    schema = "_o long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, _fp long"
    return ordered.mapInArrow(_walk, schema).select(F.when(F.col("_o") != low, F.col("_o")).alias("doc_id"), *schema.replace(",", "").split()[2::2])


def masks(radius: int, blocks: int) -> list[int]:
    """For each choice of blocks - radius blocks, their bits, as signed 64-bit numbers."""
    edge = [64 * k // blocks for k in range(blocks + 1)]
    out = []
    for kept in itertools.combinations(range(blocks), blocks - radius):
        m = sum(((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in kept)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def within(fps: DataFrame, wanted: DataFrame, *, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(q, fp) for all q of `wanted` (q, distinct) and all fp of `fps` (fp, distinct) that differ in at most `radius` bits."""
    tables = F.array(*[F.lit(m) for m in masks(radius, blocks)])
    keyed = lambda c: F.posexplode(F.transform(tables, lambda m: F.col(c).bitwiseAND(m))).alias("t", "key")
    left = wanted.select("q", keyed("q"))
    return fps.select("fp", keyed("fp")).join(small_side(left, wanted.count() * len(masks(radius, blocks))), ["t", "key"]).where(F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius).select("q", "fp").distinct()


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_near: for the stated query set (doc_id divisible by 100) the number of other documents whose fingerprint is within three bits."""
    found = materialise(describe(table(spark, sf_dir, "documents")), "fingerprints")
    counts = found.groupBy(F.col("_fp").alias("fp")).agg(F.count(F.lit(1)).alias("_n"))
    asks = found.where(F.col("doc_id") % 100 == 0)
    near = within(counts, asks.select(F.col("_fp").alias("q")).distinct()).join(counts, "fp").groupBy("q").agg((F.sum("_n") - 1).alias("n_near"))
    near = materialise(near, "near")
    hit = asks.select("doc_id", F.col("_fp").alias("q")).join(small_side(near, near.count()), "q").select(F.col("doc_id").alias("_d"), "n_near").distinct()
    return found.join(small_side(hit, hit.count()), F.col("doc_id") == F.col("_d"), "left").drop("_fp", "_d")
