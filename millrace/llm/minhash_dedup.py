"""Near-duplicate documents: a chosen-path set similarity join over minwise tokens, then exact confirmation on whole shingle sets.

1. Each whole text becomes its set of k-word shingles, of which leave: the size, a 128-bit sum that is equal for equal sets, and `TOKENS` minwise tokens.
   Documents with equal sets form one class with a number of its own; only classes go on.
2. Trees: a class enters `ROOTS` trees, each at the node named by one of its first tokens. A node of at most `SMALL` classes is compared exhaustively by
   the share of equal tokens. A larger one has a pivot, the most central of a few dozen of its classes. Those that estimate at ATTACH or more are attached to it, and so are in one candidate group. Those at CORE
   or more are done: by the triangle inequality of the Jaccard distance all that is as similar to them as the threshold is attached too. Those between, too much alike for branching to part them, are compared in blocks with
   the ones below ATTACH but not beyond REACH. All below ATTACH branch: the node selects BRANCHES of the other tokens by a hash of its own path, and each goes on to the children named by its values there. So a cluster leaves a
   node at once, documents that only share a passage scatter, and a class is in at most ROOTS * BRANCHES^level nodes of a level that have shrunk by more than that at each. What is still large after DEPTH levels is compared in blocks of SMALL.
   At similarity 0.8 a pair misses a root with probability 0.2 and is lost below it, with two branches, with at most 0.0625; so one tree loses it with at most 0.25 and all twelve with less than 1e-7.
3. What was found connected becomes a candidate group. Each set is first compared exactly with that of the group's hub, the class of most candidate links, which needs no copies of sets. Only classes that don't reach the threshold there
   are compared with each other and with the rest of the group, by counting along an inverted index, in cells of at most two blocks of BLOCK_DOCS sets; classes whose distance to the hub differs by more than the threshold allows don't meet.
   Integer arithmetic decides, and each cell returns the links of a spanning forest only.
4. Components of the confirmed links, as a loop of joins.

Defined cases: words are runs of anything but ASCII whitespace, A-Z lower-cased; fewer than k words are one shingle; null, empty or blank texts have no
shingle and are linked with nothing. Each row is a document of its own: rows that repeat a doc_id may be in different groups, and equal ones share their fate. Rows with a null doc_id stay; they have the component of equal texts, but link nothing.
Columns other than those named are not read, or given back as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bounded, forget, materialise, named, packed, python_ready, small_side, table, unpacked
from millrace.llm.components import components
from millrace.llm.text_arrays import flat, groups, mix, shingles, words_by_row

TOKENS, ROOTS, BRANCHES, DEPTH, SMALL, BLOCK_DOCS = 64, 12, 2, 8, 512, 512
ATTACH, CORE, REACH, CENTRAL = 0.45, 0.75, 0.08, 64
_ODD = (mix(np.arange(TOKENS, dtype=np.uint64), 3) | np.uint64(1))[None, :]
_XOR = mix(np.arange(TOKENS, dtype=np.uint64), 5)[None, :]


def tokens(s: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set of 64-bit hashes: under each of TOKENS orders the smallest element, as 32 bits."""
    out = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 2048):
        np.minimum(out, ((s[k : k + 2048, None] ^ _XOR) * _ODD).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _text_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    data, at = flat(batch.column(1))
    for i, j in groups(at):
        words, bounds = words_by_row(data, at, i, j)
        for r in range(j - i):
            yield i + r, shingles(words[bounds[r] : bounds[r + 1]], k)


def _sums(s: np.ndarray) -> tuple[int, np.uint64, np.uint64]:
    """The size of a set and 128 bits that are equal for equal sets."""
    return len(s), s.sum(dtype=np.uint64), mix(s, 9).sum(dtype=np.uint64)


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(named(text), F.lit("")))


def signatures(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(_id, t, n, f1, f2, sig) of each row; t is a hash of the text."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2 = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
            sig = np.zeros((batch.num_rows, TOKENS), np.int32)
            for row, s in _text_sets(batch, k):
                if len(s):
                    n[row], f1[row], f2[row], sig[row] = *_sums(s), tokens(s)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, TOKENS, dtype=np.int32)), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists], ["_id", "t", "n", "f1", "f2", "sig"])

    return docs.select(named(doc_id).cast("long").alias("_id"), named(text).alias("_text"), text_hash(text).alias("t")).mapInArrow(run, "_id long, t long, n long, f1 long, f2 long, sig array<int>")


def whole_sets(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(cid, n, _set) for `classes` (cid, n, f1, f2, rep), sets as sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in _text_sets(batch, k)]
            sums = [_sums(s) for s in sets]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            own = [pa.array(np.array([x[0] for x in sums], np.int64)), *(pa.array(np.array([x[c] for x in sums], np.uint64).view(np.int64)) for c in (1, 2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["_id", "n", "f1", "f2", "_set"])

    ids = classes.select(F.col("rep").alias("_id"))
    rows = docs.select(named(doc_id).cast("long").alias("_id"), named(text).alias("_text"))
    sets = rows.join(small_side(ids, ids.count()), "_id", "left_semi").mapInArrow(run, "_id long, n long, f1 long, f2 long, _set array<long>")
    # an id may stand on several rows: the sums tell which of them is the class's
    return sets.join(classes.withColumnRenamed("rep", "_id"), ["_id", "n", "f1", "f2"]).select("cid", "n", "_set").dropDuplicates(["cid"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one key after another, for batches sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[-1].column(0)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _ints(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def _forest(near: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each component of a boolean matrix, its first row and the others."""
    free = np.ones(len(near), bool)
    for first in range(len(near)):
        if not free[first]:
            continue
        free[first] = False
        edge, found = np.array([first]), []
        while len(edge):
            edge = np.flatnonzero(near[edge].any(axis=0) & free)
            free[edge] = False
            found.append(edge)
        if len(rest := np.concatenate(found)):
            yield first, rest


def _equal_tokens(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = np.zeros((len(a), len(b)), np.uint8)
    for c in range(TOKENS):
        same += a[:, c][:, None] == b[:, c][None, :]
    return same


def _node(table: pa.Table, at: int) -> np.ndarray:
    return _ints(pa.chunked_array([table.column(at).combine_chunks().flatten()])).reshape(-1, TOKENS)


def _edges(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x).astype(np.int64) for x in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Cells (cell, side, rep, n, sig), sorted by cell: stars (a, b) over what may be connected by pairs within five standard deviations of the threshold. side 0 and 1 are two blocks, of which only pairs between them are new; 2 compares all."""
    least = percent / 100 - 5 * float(np.sqrt(percent / 100 * (1 - percent / 100) / TOKENS))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for node in _runs(batches):
        side, rep, n, sig = _ints(node.column(1)), _ints(node.column(2)), _ints(node.column(3)), _node(node, 4)
        near = np.zeros((len(rep), len(rep)), bool)
        x, y = (np.arange(len(rep)),) * 2 if side.min() == 2 else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        near[np.ix_(x, y)] = (_equal_tokens(sig[x], sig[y]) >= least * TOKENS) & (100 * n[x][:, None] >= percent * n[y][None, :]) & (100 * n[y][None, :] >= percent * n[x][:, None])
        near |= near.T
        out += [(np.full(len(rest), rep[first]), rep[rest]) for first, rest in _forest(near)]
        if len(out) > 5000:
            yield _edges(out)
            out = []
    if out:
        yield _edges(out)


def central(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples (node, rep, sig), sorted by node: the document of each that has most tokens in common with the others."""
    for node in _runs(batches):
        sig = _node(node, 2)
        best = int(np.argmax(_equal_tokens(sig, sig).sum(axis=1, dtype=np.int64)))
        yield pa.RecordBatch.from_arrays([node.column(0).combine_chunks()[:1], node.column(1).combine_chunks()[best : best + 1], pa.array([sig[best].tolist()], pa.list_(pa.int32()))], ["node", "pivot", "psig"])


def confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Cells (cell, side, _id, _set), sorted by cell: links (a, b) of a spanning forest of the pairs that reach the threshold. side 0 and 1 are two blocks, of which only pairs between them are new; 2 compares all."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for cell in _runs(batches):
        side, ids = _ints(cell.column(1)), _ints(cell.column(2))
        lists = cell.column(3).combine_chunks()
        values, size = lists.flatten().to_numpy(zero_copy_only=False), _ints(pa.chunked_array([pa.compute.list_value_length(lists)])).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(size)))
        _, term = np.unique(values, return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), size)
        order = np.argsort(term, kind="stable")
        posting, length = owner[order], np.bincount(term)
        start = np.concatenate(([0], np.cumsum(length)))
        free, all_sides = np.ones(len(ids), bool), side.min() == 2
        for first in range(len(ids)):
            if not free[first]:
                continue
            free[first] = False
            wave = [first]
            while wave:
                x = wave.pop()
                own = term[ends[x] : ends[x + 1]]
                n = length[own]
                at = np.repeat(start[own] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                both = np.bincount(posting[at], minlength=len(ids))
                hit = free & (both > 0) & (100 * both >= percent * (size[x] + size - both))
                if not all_sides:
                    hit &= side != side[x]
                new = np.flatnonzero(hit)
                if len(new):
                    free[new] = False
                    wave += new.tolist()
                    out.append((np.full(len(new), ids[x]), ids[new]))
        if len(out) > 5000:
            yield _edges(out)
            out = []
    if out:
        yield _edges(out)


def _cells(blocks: Column, own: Column, *key: Column) -> Column:
    """For a row in block `own` of `blocks`: the cells in which it meets its own block (side 2) and each other one."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.xxhash64(*key, F.least(o, own), F.greatest(o, own)).alias("cell"), F.when(o == own, 2).when(o > own, 0).otherwise(1).alias("side")))


def _blocks(n: Column, size: int) -> Column:
    return F.ceil(n / size).cast("int")


def _across(rows: DataFrame, size: int, left: Column, right: Column, *by: str) -> DataFrame:
    """Cells in which each row of `left` meets each row of `right` with the same `by`, in blocks of `size` each; `rows` has a column rep. What has only one side is left out."""
    sizes = rows.groupBy(*by).agg(F.count(F.when(left, 1)).alias("nl"), F.count(F.when(right, 1)).alias("nr")).where("nl > 0 AND nr > 0")
    sizes = bounded(materialise(sizes, "sides"))
    met = rows.join(sizes, list(by))
    own = lambda n: F.pmod(F.xxhash64(F.lit(31), "rep"), _blocks(F.col(n), size)).cast("int")
    key = [F.lit(7), *map(F.col, by)]
    lefts = F.transform(F.sequence(F.lit(0), _blocks(F.col("nr"), size) - 1), lambda o: F.struct(F.xxhash64(*key, own("nl"), o).alias("cell"), F.lit(0).alias("side")))
    rights = F.transform(F.sequence(F.lit(0), _blocks(F.col("nl"), size) - 1), lambda o: F.struct(F.xxhash64(*key, o, own("nr")).alias("cell"), F.lit(1).alias("side")))
    return met.where(left | right).withColumn("c", F.explode(F.when(left, lefts).otherwise(rights)))


def candidates(reps: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) among `reps` (rep, n, sig) that connect whatever may reach the threshold, written."""
    used: list[DataFrame] = []

    def written(df: DataFrame, label: str) -> DataFrame:
        used.append(materialise(df, label))
        return used[-1]

    frontier = reps.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(ROOTS - 1)), lambda c: F.xxhash64(c, F.get(F.col("sig"), c)))).alias("node"))
    lists, cells, edges = [], [], []
    for level in range(DEPTH + 1):
        frontier = written(frontier.select("node", "rep"), f"nodes-{level}")
        big = written(frontier.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SMALL), f"sizes-{level}")
        n_big = big.count()
        rest = frontier.join(small_side(big, n_big), "node", "left_anti") if n_big else frontier
        lists.append(rest.groupBy("node").agg(F.array_sort(F.collect_list("rep")).alias("members")).select("members"))
        if not n_big:
            break
        large = written(frontier.join(small_side(big, n_big), "node"), f"large-{level}")
        if level == DEPTH:  # still large: in blocks
            own = F.pmod(F.xxhash64(F.lit(31), "rep"), _blocks(F.col("size"), SMALL)).cast("int")
            cells.append(large.select("rep", F.explode(_cells(_blocks(F.col("size"), SMALL), own, F.col("node"))).alias("c")))
            break
        held = reps.select("rep", "sig").join(small_side(large, large.count()), "rep")
        some = held.where(F.pmod(F.xxhash64("rep", "node"), F.col("size")) < CENTRAL).select("node", "rep", "sig")
        pivots = written(some.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(central, "node long, pivot long, psig array<int>"), f"pivots-{level}")
        known = held.join(small_side(pivots, 64 * pivots.count()), "node", "left")
        share = F.coalesce(F.size(F.filter(F.zip_with("sig", "psig", lambda x, y: x == y), lambda e: e)), F.lit(0)) / TOKENS
        branch = F.transform(F.sequence(F.lit(0), F.lit(BRANCHES - 1)), lambda j: F.lit(ROOTS) + F.pmod(F.xxhash64(F.col("node"), j), F.lit(TOKENS - ROOTS)).cast("int"))
        below = F.transform(branch, lambda c: F.xxhash64(F.col("node"), c, F.get(F.col("sig"), c)))
        known = written(known.select("node", "rep", "pivot", share.alias("share"), F.array_distinct(below).alias("below")), f"known-{level}")
        edges.append(known.where((F.col("share") >= ATTACH) & (F.col("rep") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
        cells.append(_across(known.select("node", "rep", "share"), SMALL, F.col("share").between(ATTACH, CORE - 1e-9), (F.col("share") < ATTACH) & (F.col("share") >= REACH), "node").select("rep", "c"))
        frontier = known.where(F.col("share") < ATTACH).select("rep", F.explode("below").alias("node"))
    small = reduce(DataFrame.unionAll, lists).where(F.size("members") > 1).dropDuplicates(["members"]).select(F.xxhash64("members").alias("cell"), F.lit(2).alias("side"), F.explode("members").alias("rep"))
    rows = reduce(DataFrame.unionAll, [small, *[c.select("c.cell", "c.side", "rep") for c in cells]])
    rows = rows.join(reps, "rep").select("cell", "side", "rep", "n", "sig").repartition("cell").sortWithinPartitions("cell")
    found = reduce(DataFrame.unionAll, [rows.mapInArrow(lambda it: compare(it, percent), "a long, b long"), *edges])
    out = materialise(found.distinct(), "candidates")
    forget(*used)
    return out


def confirmed(docs: DataFrame, classes: DataFrame, found: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """Links (a, b) of classes that connect exactly those that reach the threshold, among the candidates `found`; written."""
    group = materialise(components(found), "groups")
    ends = found.select(F.col("a").alias("node")).union(found.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    hubs = group.join(ends, "node").groupBy("component").agg(F.max(F.struct("links", (-F.col("node")).alias("first"))).alias("h")).select("component", (-F.col("h.first")).alias("hub"))
    hubs = materialise(hubs, "hubs")
    member = classes.join(small_side(group.withColumnRenamed("node", "cid"), group.count()), "cid")
    sets = whole_sets(docs, materialise(member.select("cid", "n", "f1", "f2", "rep"), "members"), doc_id, text, k)
    sets = materialise(sets.join(small_side(group.withColumnRenamed("node", "cid"), group.count()), "cid"), "sets")
    theirs = sets.join(small_side(hubs, hubs.count()).drop("component"), F.col("cid") == F.col("hub")).select("component", "hub", F.col("n").alias("hub_n"), F.col("_set").alias("hub_set"))
    both = F.size(F.array_intersect("_set", "hub_set")).cast("long")
    near = sets.join(theirs, "component").where("cid <> hub").select("component", "hub", F.col("cid").alias("rep"), "n", both.alias("both"), (F.col("n") + F.col("hub_n") - both).alias("all"))
    near = materialise(near.withColumn("linked", 100 * F.col("both") >= percent * F.col("all")), "hub-links")
    links = near.where("linked").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    if near.where("NOT linked").isEmpty():
        return links
    # pairs of two that the hub links are connected; of the others, only such at nearly the same distance from the hub can be linked
    far = near.where("NOT linked").groupBy("component").agg(F.min(1 - F.col("both") / F.col("all")).alias("least"), F.count(F.lit(1)).alias("size"))
    far = bounded(materialise(far, "far"))
    open_ = near.join(far, "component").where(~F.col("linked") | (1 - F.col("both") / F.col("all") >= F.col("least") - (1 - percent / 100) - 1e-9)).select("component", "rep", "linked", "size")
    open_ = materialise(open_, "open")
    own = F.pmod(F.xxhash64(F.lit(31), "rep"), _blocks(F.col("size"), BLOCK_DOCS)).cast("int")
    among = open_.where("NOT linked AND size > 1").select("rep", F.explode(_cells(_blocks(F.col("size"), BLOCK_DOCS), own, F.col("component"))).alias("c"))
    across = _across(open_.select("component", "rep", "linked"), BLOCK_DOCS, ~F.col("linked"), F.col("linked"), "component").select("rep", "c")
    rows = among.union(across).select("c.cell", "c.side", F.col("rep").alias("cid")).join(sets.select("cid", "_set"), "cid").select("cell", "side", "cid", "_set")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "cid")
    return materialise(links.union(rows.mapInArrow(lambda it: confirm(it, percent), "a long, b long")), "confirmed")


def grouped(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, t, n_shingles, component_id, kept), a row for each row of `docs`; t is a hash of its text."""
    sigs = materialise(signatures(docs, doc_id, text, k), "signatures")
    key = ["n", "f1", "f2"]
    classes = sigs.where("n > 0 AND _id IS NOT NULL").groupBy(*key).agg(F.min("_id").alias("rep"), F.first("sig").alias("sig"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = candidates(classes.select(F.col("cid").alias("rep"), "n", "sig"), percent)
    at = classes.select(*key, F.col("rep").alias("own"))
    if not found.isEmpty():
        links = confirmed(docs, classes.drop("sig"), found, doc_id, text, k, percent)
        if not links.isEmpty():
            joined = components(links).withColumnRenamed("node", "cid").join(classes.select("cid", "rep"), "cid")
            least = joined.groupBy("component").agg(F.min("rep").alias("least"))
            joined = materialise(joined.join(least, "component").select("cid", "least"), "joined")
            named_ = classes.join(small_side(joined, joined.count()), "cid", "left")
            at = named_.select(*key, F.coalesce("least", "rep").alias("own"))
    out = sigs.select("_id", "t", *key).join(at, key, "left")
    component = F.coalesce("own", "_id")
    return out.select(F.col("_id").alias("doc_id"), "t", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of `docs`; documents are linked if 100 * intersection >= percent * union."""
    return grouped(docs, doc_id=doc_id, text=text, k=k, percent=percent).drop("t")


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without the rows that have a smaller doc_id in their group."""
    gone = grouped(docs, doc_id=doc_id, text=text, k=k, percent=percent).where("NOT kept").select(F.col("doc_id").alias("gone"), F.col("t").alias("gone_t")).distinct()
    gone = materialise(gone, "near-copies")
    rows = packed(docs, id=named(doc_id).cast("long"), t=text_hash(text))
    return unpacked(rows.join(small_side(gone, gone.count()), (F.col("id") == F.col("gone")) & (F.col("t") == F.col("gone_t")), "left_anti"), docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)
