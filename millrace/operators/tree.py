"""Folders as trees: roll-ups, content hashes of whole subtrees, duplicates and partial overlap. All prefix relations are equi-joins on exploded ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.similarity import meet
from millrace.session import written


def up(files: DataFrame, folders: DataFrame, *cols: str) -> DataFrame:
    """(folder, rel, *cols): each file under each of its ancestors in `folders`, with its path from there."""
    path = F.concat_ws("/", "package", "relpath")
    rows = files.select(path.alias("_path"), F.explode(T.ancestors(F.col("folder"))).alias("folder"), *cols)
    rows = rows.join(folders.select("folder").distinct(), "folder", "left_semi")
    return rows.select("folder", F.substring("_path", F.length("folder") + 2, F.length("_path")).alias("rel"), *cols)


def subtree(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files, bytes and last change below each folder."""
    total = up(files, folders, "size", "mtime").groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("mtime").alias("last"))
    return folders.select("folder").distinct().join(total, "folder", "left").withColumns({"files": F.coalesce("files", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0))})


def _line(*cols: Column) -> Column:
    """sha256 of a line; its fields are separated by NUL."""
    return F.sha2(F.concat(*[x for i, c in enumerate(cols) for x in ([F.lit("\0")] if i else []) + [c.cast("string")]]), 256)


def multiset_hash(line: str) -> Column:
    """An aggregate that is equal for equal multisets of lines, given as the column of their sha256: the number of lines and, for nine groups of seven digits, their sums. It adds up before the shuffle, so a folder of any size is a row of fixed width everywhere."""
    words = [F.sum(F.conv(F.substring(line, 1 + 7 * i, 7), 16, 10).cast("long")).cast("string") for i in range(9)]
    return F.sha2(F.concat_ws(",", F.count(line).cast("string"), *words), 256)


def folder_hashes(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, state, files, tree_hash, set_hash): equal trees have equal tree hashes wherever they are, equal multisets of contents equal set hashes. State is error, empty, incomplete or hashed; only the last has hashes."""
    rows = up(files, folders, "sha", "status").select("folder", "sha", "status", _line(F.col("rel"), F.col("sha")).alias("_t"), _line(F.col("sha")).alias("_s"))
    made = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.bool_or(F.col("status") == "error").alias("bad"), F.bool_or(F.col("sha").isNull()).alias("open"), multiset_hash("_t").alias("t"), multiset_hash("_s").alias("s"))
    out = folders.select("folder").distinct().join(made, "folder", "left")
    state = F.when(F.col("bad"), "error").when(F.col("files").isNull(), "empty").when(F.col("open"), "incomplete").otherwise("hashed")
    known = state == "hashed"
    return out.select("folder", state.alias("state"), F.coalesce("files", F.lit(0)).alias("files"), F.when(known, F.col("t")).alias("tree_hash"), F.when(known, F.col("s")).alias("set_hash"))


def structural(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, signature): equal for equal multisets of (path, size, change) below a folder."""
    rows = up(files, folders, "size", "mtime").select("folder", _line(F.col("rel"), F.col("size"), F.col("mtime")).alias("_l"))
    return rows.groupBy("folder").agg(multiset_hash("_l").alias("signature"))


def duplicates(hashes: DataFrame) -> DataFrame:
    """(folder, duplicate_of): folders with a tree hash that another has; the canonical one has the smallest path, compared by components."""
    rows = hashes.where("tree_hash IS NOT NULL").withColumn("_k", F.split("folder", "/"))
    canon = rows.groupBy("tree_hash").agg(F.min_by("folder", "_k").alias("duplicate_of"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.join(canon, "tree_hash").where("folder <> duplicate_of").select("folder", "duplicate_of")


def topmost(dups: DataFrame) -> DataFrame:
    """Duplicate folders without a duplicate above them."""
    above = dups.select("folder", F.explode(T.ancestors(F.col("folder"), inclusive=False)).alias("_up"))
    inner = above.join(dups.select(F.col("folder").alias("_up")), "_up", "left_semi").select("folder").distinct()
    return dups.join(inner, "folder", "left_anti")


def inventory(files: DataFrame, content: DataFrame, dups: DataFrame) -> DataFrame:
    """Each file with its kind, its number of copies and what its nearest duplicate folder duplicates."""
    copies = files.where("sha IS NOT NULL").groupBy("sha").agg(F.count(F.lit(1)).alias("copies"))
    paths = files.select("folder").distinct().select("folder", F.explode(T.ancestors(F.col("folder"))).alias("_up"))
    near = paths.join(dups.select(F.col("folder").alias("_up"), "duplicate_of"), "_up").groupBy("folder").agg(F.max_by("duplicate_of", F.length("_up")).alias("duplicate_of"))
    return files.drop("text").join(content.select("sha", "kind"), "sha", "left").join(copies, "sha", "left").join(near, "folder", "left")


def common_counts(sets: DataFrame, max_folders: int | None = None, max_pairs: int | None = None) -> tuple[DataFrame | None, int]:
    """(a, b, common) for folders that share contents, of `sets` (folder, sha) without repeats, and the number of contents left out. None is left out unless max_folders or max_pairs is given: then contents that more folders hold are,
    and the result is None if it would count more pairs. Contents of the same folders are counted as one, and folders that share many meet block by block."""
    sizes = sets.groupBy("sha").agg(F.count(F.lit(1)).alias("n"))
    few, skipped = F.lit(True) if max_folders is None else F.col("n") <= max_folders, 0
    if max_folders is not None or max_pairs is not None:
        told = sizes.agg(F.sum(F.when(few, F.col("n") * (F.col("n") - 1) / 2)).alias("pairs"), F.count(F.when(~few, 1)).alias("skipped")).first()
        skipped = told["skipped"]
        if max_pairs is not None and (told["pairs"] or 0) > max_pairs:
            return None, skipped
    kept = sets.join(sizes.where((F.col("n") > 1) & few).select("sha"), "sha")
    alike = kept.groupBy("sha").agg(F.array_sort(F.collect_list("folder")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("w"))
    held = alike.select(F.sha2(F.array_join("f", "\0"), 256).alias("k"), "w", F.size("f").alias("n"), F.explode("f").alias("folder"))
    pairs = meet(held, ["k", "w"], "folder", F.col("n"), 256).groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("common"))
    return pairs, skipped


def most_specific(pairs: DataFrame) -> DataFrame:
    """Drop a pair if a pair below it (one side replaced by a descendant) has as many contents in common; decided on all pairs at once."""
    left = pairs.select(F.col("a"), F.col("b"), "common", F.explode(T.ancestors(F.col("a"), inclusive=False)).alias("_a"))
    right = pairs.select(F.col("a"), F.col("b"), "common", F.explode(T.ancestors(F.col("b"), inclusive=False)).alias("_b"))
    wider = left.select(F.least("_a", "b").alias("a"), F.greatest("_a", "b").alias("b"), "common").union(right.select(F.least("a", "_b").alias("a"), F.greatest("a", "_b").alias("b"), "common"))
    return pairs.join(wider.distinct(), ["a", "b", "common"], "left_anti")


def overlap(files: DataFrame, folders: DataFrame, dups: DataFrame, min_ratio: float = 0.5) -> DataFrame:
    """Folders that share at least min_ratio of the smaller one's contents: ancestors aside, then the threshold, then the most specific pairs, then without duplicate folders."""
    sets = written(up(files.where("sha IS NOT NULL"), folders, "sha").select("folder", "sha").distinct(), "folder-sets")
    sizes = sets.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    pairs, _ = common_counts(sets.join(sizes.select("folder"), "folder"))
    nested = F.col("b").startswith(F.concat("a", F.lit("/"))) | F.col("a").startswith(F.concat("b", F.lit("/")))
    met = pairs.where(~nested).join(sizes.select(F.col("folder").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("folder").alias("b"), F.col("n").alias("nb")), "b")
    met = met.withColumns({"ratio": F.round(F.col("common") / F.least("na", "nb"), 4), "jaccard": F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 4)}).where(F.col("common") / F.least("na", "nb") >= min_ratio)
    kept = most_specific(met)
    gone = dups.select("folder")
    return kept.join(gone.withColumnRenamed("folder", "a"), "a", "left_anti").join(gone.withColumnRenamed("folder", "b"), "b", "left_anti").select("a", "b", "common", "ratio", "jaccard")


def canonical_broken(dups: DataFrame) -> DataFrame:
    """Canonical folders that lie under a duplicate folder: none may."""
    up_ = dups.select("folder", "duplicate_of", F.explode(T.ancestors(F.col("duplicate_of"))).alias("_up"))
    return up_.join(dups.select(F.col("folder").alias("_up")), "_up", "left_semi").select("folder", "duplicate_of").distinct()


def chains(dups: DataFrame) -> DataFrame:
    """Duplicate folders whose canonical folder is itself a duplicate: none may be."""
    return dups.join(dups.select(F.col("folder").alias("duplicate_of")), "duplicate_of", "left_semi").select("folder", "duplicate_of")


def same_day(files: DataFrame, decisions: DataFrame, max_size: int = 20) -> DataFrame:
    """(folder, day, size, shas): groups of 2 to max_size contents of one folder and day, in folders with more than one day."""
    rows = files.where("sha IS NOT NULL").join(decisions.select("sha"), "sha", "left").select("folder", F.substring("mtime", 1, 10).alias("day"), "sha")
    group = rows.groupBy("folder", "day").agg(F.array_sort(F.collect_set("sha")).alias("shas"))
    days = Window.partitionBy("folder")
    return group.withColumns({"days": F.count(F.lit(1)).over(days), "size": F.size("shas")}).where((F.col("days") > 1) & (F.col("size") > 1) & (F.col("size") <= max_size)).select("folder", "day", "size", "shas")
