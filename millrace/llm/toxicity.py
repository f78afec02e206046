"""Toxicity: subword-bag embeddings, averaged over the text and fed to a linear softmax; both are trained together in numpy.

A text is the bag of the character n-grams (3 to 6, with word boundaries) of its lower-cased words, hashed into buckets. Its vector
is the mean of their embeddings, so a misspelling that was never seen, or an unknown ending, shares most of its n-grams with known words. As
the classifier is linear in the mean, scoring needs one number a bucket: the embedding times the difference of the two classes' weights.

The model learns from a bounded sample of the labelled rows: max_train_rows, a third of them toxic at most, chosen by a hash whatever their length. Whole texts become bags where they are; if
those of the sample together have more than max_train_cells buckets, a hash takes a smaller share of the rows. One task trains on them, and only the model, a number a bucket, comes to the driver. Every text is scored whole, long ones in pieces. Null, empty and letterless texts get the model's bias. Labels other than 0 and 1, and null
labels, aren't learned from; rows repeated in labels count once. With no labelled row, or one class only, every score is the share of label 1 (0 without any). Input columns named like the output are replaced, and all others stay.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import held_out, materialise, named, packed, python_ready, table, unpacked
from millrace.llm.text_arrays import BLOCK, code_points, pieces

BITS, SIZES, DIM = 18, (3, 4, 5, 6), 8
_M, _A = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def subwords(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size, the bucket of the n-gram that starts at each place, and whether it is one: inside a word, with the zero at either end as boundary."""
    zeros = np.concatenate(([0], np.cumsum(x == 0)))
    h = x.copy()
    for n in range(2, max(SIZES) + 1):
        if len(x) < n:
            return
        h = h[:-1] * _M + x[n - 1 :]
        if n in SIZES:
            m = len(h)
            valid = zeros[n - 1 : n - 1 + m] == zeros[1 : 1 + m]
            yield n, ((h ^ (h >> np.uint32(15))) * _A + np.uint32(n)) >> np.uint32(32 - BITS), valid


def places(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of pieces: their texts, the code points, and from where to where n-grams that start there are theirs; the boundary before a text is its first piece's."""
    for parts, skip, size, strings in pieces(texts, BLOCK, 1, max(SIZES) - 1):
        x, bounds = code_points(strings)
        low = bounds[:-1] + skip + (skip > 0)
        yield [k for k, _ in parts], x, low, bounds[:-1] + 1 + skip + size


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and how often each occurs."""
    total, found = None, []
    for _, x, low, high in places([text]):
        a, b = int(low[0]), int(high[0])
        found += [ids[a:b][ok[a:b]] for _, ids, ok in subwords(x)]
        if sum(map(len, found)) > 1 << BITS:  # a long text is added up piece by piece
            total = np.bincount(np.concatenate(found), minlength=1 << BITS) + (0 if total is None else total)
            found = []
    if total is None:
        ids, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0), np.zeros(0))
        return ids.astype(np.int32), counts.astype(np.int32)
    if found:
        total += np.bincount(np.concatenate(found), minlength=1 << BITS)
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), total[ids].astype(np.int32)


def coded(own: tuple[np.ndarray, np.ndarray]) -> bytes:
    """A bag in few bytes: the steps between buckets, then the counts."""
    ids, counts = own
    return zlib.compress(np.concatenate((np.diff(ids, prepend=np.int32(0)), counts)).astype(np.int32).tobytes(), 1)


def decoded(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = np.frombuffer(zlib.decompress(raw), np.int32).reshape(2, -1)
    return np.cumsum(steps, dtype=np.int32), counts


@dataclass
class Packed:
    """Bags in the order of `places`, unpacked one at a time."""

    column: pa.ChunkedArray
    places: list[int]

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return (decoded(self.column[k].as_py()) for k in self.places)


def _sample(rows: pa.Table) -> tuple[Packed, np.ndarray]:
    """Bags and labels of a table (draw, y, bag), in the same order on every run."""
    order = pc.sort_indices(rows, [("draw", "ascending"), ("y", "ascending")]).to_numpy()
    return Packed(rows.column("bag"), order.tolist()), rows.column("y").to_numpy()[order]


@dataclass
class Model:
    """weight: the embedding of each bucket times the difference of the classes' weights; bias: of their biases. pad: n-grams without meaning that are added to every text's mean, so that a few words don't decide."""

    weight: np.ndarray
    bias: float
    pad: int = 40

    def score(self, texts: list[str | None]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for owner, x, low, high in places(texts):
            for _, ids, ok in subwords(x):
                at = np.flatnonzero(ok)
                a, b = np.searchsorted(at, low), np.searchsorted(at, high)
                sums = np.concatenate(([0.0], np.cumsum(self.weight[ids[at]], dtype=np.float64)))
                np.add.at(total, owner, sums[b] - sums[a])
                np.add.at(count, owner, b - a)
        return 1 / (1 + np.exp(-np.clip(total / (count + self.pad) + self.bias, -30, 30)))


def train(bags: Iterable[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, steps: int = 3000, batch: int = 32, rate: float = 2.0, scale: float = 100.0, min_docs: int = 3, min_share: float = 0.005, decay: float = 3e-4, pad: int = 40, seed: int = 7) -> Model:
    """Gradient descent over the texts' bags, which are read twice, on the embeddings and the softmax weights together. `scale` multiplies the mean; buckets in fewer than min_docs texts, or less than min_share of them, are left out: they only learn single texts by heart."""
    size = 1 << BITS
    labels = np.asarray(labels, float)
    if len(labels) == 0 or labels.min() == labels.max():
        p = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(size, np.float32), float(np.clip(np.log((p + 1e-9) / (1 - p + 1e-9)), -20, 20)), pad)
    seen = np.zeros(size, np.int32)
    for ids, _ in bags:
        seen[ids] += 1
    used = np.flatnonzero(seen >= max(min_docs, min_share * len(labels)))
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    # memory is held by the sample: places and counts in as few bytes as they need, weights made when a text's turn comes
    docs, factor, kind = [], np.empty(len(labels)), np.uint16 if len(used) <= 1 << 16 else np.int32
    for k, (ids, n) in enumerate(bags):
        at = place[ids]
        own = n[at >= 0]
        docs.append((at[at >= 0].astype(kind), own.astype(np.uint16) if len(own) and own.max() < 1 << 16 else own))
        factor[k] = scale / (n.sum(dtype=np.int64) + pad)
    del bags
    rng = np.random.default_rng(seed)
    e = np.zeros((len(used), DIM), np.float32)
    u = (rng.normal(0, 1, DIM) / np.sqrt(DIM)).astype(np.float32)  # the difference of the classes' weights: all that a two-way softmax depends on
    b = float(np.log(labels.mean() / (1 - labels.mean())))
    epochs = int(min(150, max(12, steps * batch / len(docs))))
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        order = rng.permutation(len(docs))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            ids, w = np.concatenate([docs[r][0] for r in rows]), np.concatenate([(docs[r][1] * factor[r]).astype(np.float32) for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(docs[r][0]) for r in rows])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w * (e @ u)[ids], len(rows)) + b, -30, 30)))
            err = ((p - labels[rows]) / len(rows)).astype(np.float32)
            pull = np.bincount(ids, w * err[owner], len(used)).astype(np.float32)
            toward = pull @ e
            e *= 1 - lr * decay
            e -= (lr * pull)[:, None] * u
            u -= 0.1 * lr * np.clip(toward, -1, 1)
            b -= 0.1 * lr * float(err.sum())
    weight = np.zeros(size, np.float32)
    weight[used] = scale * (e @ u)
    del docs
    _give_back()
    return Model(weight, b, pad)


def _give_back() -> None:
    """Return freed memory to the system where the C library can: a worker lives on after training."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", usable: Column | None = None, max_train_rows: int = 8000, max_train_cells: int = 24_000_000) -> Model:
    """A model of a bounded sample of the labelled rows for which `usable` (a condition on the labels' doc_id, here `_id`) holds. A row's hash decides, so the sample is the same on every run."""
    python_ready(docs.sparkSession)
    rows = labels.select(named(doc_id).alias("_id"), named(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z")
    n = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {1: min(1.0, max_train_rows / 3 / max(1, n.get(1, 0)))}
    share[0] = min(1.0, (max_train_rows - min(n.get(1, 0), max_train_rows / 3)) / max(1, n.get(0, 0)))
    drawn = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1_000_000))
    rows = rows.where(drawn < F.when(F.col("_y") == 1, share[1] * 1e6).otherwise(share[0] * 1e6)).select("_id", "_y")
    found = docs.select(named(doc_id).alias("_id"), F.coalesce(named(text), F.lit("")).alias("_text"))

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = bag(batch.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([coded(own)], pa.binary()), batch.column(2).slice(k, 1), pa.array([len(own[0])], pa.int64())], ["draw", "bag", "y", "cells"])

    draw = F.xxhash64(F.lit(13), "_id", "_text").alias("draw")
    bags = materialise(found.join(F.broadcast(rows), "_id").select(draw, "_text", "_y").mapInArrow(bagged, "draw long, bag binary, y int, cells long"), "bags")
    cells = bags.agg(F.sum("cells").alias("c")).first()["c"] or 0
    if cells > max_train_cells:
        bags = bags.where(F.pmod("draw", F.lit(1_000_000)) < max_train_cells / cells * 1e6)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("draw", pa.int64()), ("y", pa.int32()), ("bag", pa.binary())])
        model = train(*_sample(pa.Table.from_batches([b.cast(schema) for b in batches], schema)))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(model.weight.tobytes(), 1)], pa.binary()), pa.array([model.bias])], ["weight", "bias"])

    # one task trains on the bounded sample, beside the executors' memory and not in the driver's; only the model comes here
    row = bags.select("draw", F.col("y").cast("int").alias("y"), "bag").repartition(1).mapInArrow(fitted, "weight binary, bias double").first()
    return Model(np.frombuffer(zlib.decompress(row["weight"]), np.float32), row["bias"]) if row is not None else train([], np.array([]))


def score(docs: DataFrame, model: Model, *, text: str = "text", to: str = "score") -> DataFrame:
    """`docs` with the score of each whole text in the column `to`."""
    python_ready(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model.score(s.tolist()))

    return unpacked(packed(docs, told=scored(named(text))), docs.columns, **{to: F.col("told")})


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), usable=~held_out("_id"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
