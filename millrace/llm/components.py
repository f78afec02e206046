"""Connected components of a link table: of few links in one task, else as a loop of joins; nothing but a count comes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_ROWS, forget, materialise, python_ready


def spread(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links u[i], v[i] and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _in_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in spread(*map(np.concatenate, zip(*held)))], ["node", "component"])


def components(links: DataFrame, in_one: int = BROADCAST_ROWS) -> DataFrame:
    """(node, component) for each node of `links` (a, b); the component is the smallest node reachable.

    At most `in_one` links, as counted, are spread by one task, a few MB whatever the input; a loop's rounds would cost them several shuffles each. More go through the loop:

    It alternates large-star and small-star steps: every step keeps the components, and the links end as stars around the smallest
    node after a number of rounds that grows with the logarithm of the size; the loop ends when a round changes nothing. A node keeps one link to its smallest neighbour, so
    hubs cost no more than their links; minima combine before the shuffle and are written, so that Spark knows their size and broadcasts them if they are few; else they are joined on their own, and adaptive execution can split the links of a hub.
    """
    edges = materialise(links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v").distinct(), "links")
    if edges.count() <= in_one:
        python_ready(links.sparkSession)
        return edges.coalesce(1).mapInArrow(_in_one, "node long, component long")
    last = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")), "low")
        large = both.join(low, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        low2 = materialise(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c"), "low")
        small = large.join(low2, F.col("u") == F.col("c"))
        old, edges = edges, materialise(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "stars")
        forget(old, low, large, low2)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.union(own.select(F.col("component").alias("node"), "component").distinct())
