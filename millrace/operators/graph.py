"""Node and edge tables: links, filters, hierarchies."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return nodes.join(ends, "id", "left_anti")


def ghosts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Targets that aren't nodes, with how many refer to them."""
    return edges.join(nodes.select(F.col("id").alias("target")), "target", "left_anti").groupBy(F.lower(F.trim("target")).alias("id")).agg(F.min("target").alias("title"), F.count_distinct("source").alias("referrers"))


def parents(edges: DataFrame) -> DataFrame:
    """(child, parent): the first belongs_to edge of each child."""
    w = Window.partitionBy("source").orderBy("target")
    return edges.where("kind = 'belongs_to'").withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("source").alias("child"), F.col("target").alias("parent"))


def ancestor_pairs(parent: DataFrame) -> DataFrame:
    """(node, above, steps) for everything above each node of `parent` (child, parent), whatever the height: pairs are joined with themselves, so the number of rounds is the logarithm of the height.
    A node has one parent; on a cycle each other node is met once, by the fewest steps, and the loop ends as no round finds a new pair."""
    pairs = written(parent.select(F.col("child").alias("node"), F.col("parent").alias("above"), F.lit(1).alias("steps")).where("node <> above"), "above")
    reach = 1
    while True:
        far = pairs.where(F.col("steps") == reach).select("node", F.col("above").alias("_y"), F.col("steps").alias("_s"))
        more = far.join(pairs.select(F.col("node").alias("_y"), "above", "steps"), "_y").select("node", "above", (F.col("_s") + F.col("steps")).alias("steps")).where("node <> above")
        more = more.join(pairs.select("node", "above"), ["node", "above"], "left_anti")
        if more.isEmpty():
            return pairs
        pairs, reach = written(pairs.union(more), "above"), 2 * reach


def nearest_of_type(parent: DataFrame, nodes: DataFrame, type_: str) -> DataFrame:
    """(node, found): the nearest node of a type above each."""
    typed = nodes.where(F.col("type") == type_).select(F.col("id").alias("above"))
    return ancestor_pairs(parent).join(typed, "above").groupBy("node").agg(F.min_by("above", "steps").alias("found"))


def descendants(parent: DataFrame) -> DataFrame:
    return ancestor_pairs(parent).groupBy(F.col("above").alias("node")).agg(F.count(F.lit(1)).alias("descendants"))


def listed(children: DataFrame, parent: DataFrame) -> DataFrame:
    """(parent, child, status) of listed children (parent, child): `cycle` where a child is the folder that lists it or lies above it in `parent` (child, parent), so that it is never traversed, else `pending`."""
    above = ancestor_pairs(parent).select(F.col("node").alias("parent"), F.col("above").alias("child"), F.lit(True).alias("_up"))
    rows = children.select("parent", "child").distinct().join(above, ["parent", "child"], "left")
    return rows.select("parent", "child", F.when(F.col("_up") | (F.col("parent") == F.col("child")), "cycle").otherwise("pending").alias("status"))


def visible_edges(edges: DataFrame, kinds: list[str]) -> DataFrame:
    return edges.where(F.coalesce("kind", F.lit("link")).isin(kinds)) if kinds else edges


def visible_nodes(nodes: DataFrame, edges: DataFrame, *, types: list[str] = [], statuses: list[str] = [], levels: list[int] = [], connected_only: bool = False, kinds: list[str] = []) -> DataFrame:  # noqa: B006
    """Nodes that pass every dimension given; an empty one passes all."""
    rows = nodes
    for column, wanted in (("type", types), ("status", statuses), ("level", levels)):
        if wanted:
            rows = rows.where(F.coalesce(F.col(column).isin(wanted), F.lit(False)))
    if connected_only:
        ids = rows.select("id")
        drawn = visible_edges(edges, kinds).join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
        rows = rows.join(drawn.select(F.col("source").alias("id")).union(drawn.select("target")).distinct(), "id", "left_semi")
    return rows


def with_ancestors(nodes: DataFrame, parent: DataFrame, match: DataFrame) -> DataFrame:
    """Matches and all that lies above them; `root` where no kept parent is."""
    keep = match.select("id").union(ancestor_pairs(parent).join(match.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("above").alias("id"))).distinct()
    kept = nodes.join(keep, "id", "left_semi")
    up = parent.join(keep.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("id")).distinct().withColumn("_p", F.lit(True))
    return kept.join(up, "id", "left").withColumn("root", F.col("_p").isNull()).drop("_p")


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(source, target_text, id, tier, ambiguous) of `links` (source, target_text): by path, then stem, then alias of `notes` (id, path, stem, aliases), whatever the case; of several the first by id."""
    key = F.lower(F.trim("target_text"))
    path = F.regexp_replace(F.lower("path"), r"\.md$", "")
    keys = notes.select("id", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("tier"), path.alias("k")), F.struct(F.lit(1).alias("tier"), F.lower("stem").alias("k"))), F.transform("aliases", lambda a: F.struct(F.lit(2).alias("tier"), F.lower(a).alias("k"))))).alias("x")).select("id", "x.tier", "x.k").distinct()
    tiers = keys.groupBy("k", "tier").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    best = tiers.groupBy("k").agg(F.min(F.struct("tier", "id", "n")).alias("b"))
    j = links.withColumn("_k", F.regexp_replace(key, r"\.md$", "")).join(best, F.col("_k") == F.col("k"), "left")
    return j.select("source", "target_text", F.col("b.id").alias("id"), F.col("b.tier").alias("tier"), F.coalesce(F.col("b.n") > 1, F.lit(False)).alias("ambiguous"))


class LinkResolver(Protocol):
    """How links become nodes: any callable of links (source, target_text) and notes (id, path, stem, aliases) that returns (source, target_text, id, tier, ambiguous). `resolve` is the one used by default."""

    def __call__(self, links: DataFrame, notes: DataFrame) -> DataFrame: ...


class FrontMatterMapper(Protocol):
    """How front matter becomes fields: any callable of a map column and a path column that returns a struct with at least title, tags, aliases and relations."""

    def __call__(self, meta: Column, path: Column) -> Column: ...


def note_graph(notes: DataFrame, mapper: FrontMatterMapper, resolver: LinkResolver = resolve) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, title, type, category, level, status, tags, ghost) and edges (source, target, kind) of notes (path, meta, body): the fields as the mapper reads them, links in the body and relations in the front matter as the resolver finds them; what it doesn't find becomes a ghost."""
    from millrace.functions import text as T

    rows = notes.select(F.regexp_replace("path", r"\.md$", "").alias("id"), "path", "body", mapper(F.col("meta"), F.col("path")).alias("f"))
    known = rows.select("id", "path", F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"), F.col("f.aliases").alias("aliases"))
    links = rows.select(F.col("id").alias("source"), F.explode(T.wiki_links(F.col("body"))).alias("l")).select("source", F.col("l.target").alias("target_text"), F.lit("link").alias("kind")).where("target_text IS NOT NULL")
    told = rows.select(F.col("id").alias("source"), F.explode("f.relations").alias("r")).select("source", F.col("r.target").alias("target_text"), F.col("r.kind").alias("kind"))
    every = links.union(told).distinct()
    found = resolver(every.select("source", "target_text").distinct(), known).select("source", "target_text", "id")
    ghost = F.lower(F.trim("target_text"))
    edges = every.join(found, ["source", "target_text"], "left").select("source", F.coalesce("id", ghost).alias("target"), "kind", F.col("id").isNull().alias("ghost"), "target_text")
    nodes = rows.select("id", *[F.col(f"f.{c}").alias(c) for c in ("title", "type", "category", "level", "status", "tags")], F.lit(False).alias("ghost"))
    lost = edges.where("ghost").groupBy(F.col("target").alias("id")).agg(F.min("target_text").alias("title")).withColumn("ghost", F.lit(True))
    return nodes.unionByName(lost, allowMissingColumns=True), edges.select("source", "target", "kind").distinct()


def single_child_end(parent: DataFrame) -> DataFrame:
    """(node, end): where one comes from a node by going down while there is exactly one child."""
    only = parent.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("child")).where("n = 1")
    down = ancestor_pairs(only.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
    return down.groupBy("node").agg(F.max_by("above", "steps").alias("end"))


def merged_chains(folders: DataFrame, files: DataFrame) -> DataFrame:
    """(folder, label): the folders that hold files or don't have exactly one child, named from the nearest such folder above, so that chains of single children are one row."""
    from millrace.functions import text as T

    up = folders.select("folder", T.parent(F.col("folder")).alias("parent"))
    children = up.where("parent <> ''").groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    holds = files.select("folder").distinct().withColumn("_own", F.lit(True))
    kept = folders.select("folder").join(children.withColumnRenamed("parent", "folder"), "folder", "left").join(holds, "folder", "left").where(F.col("_own") | F.col("n").isNull() | (F.col("n") != 1)).select("folder")
    above = kept.select("folder", F.explode(T.ancestors(F.col("folder"), inclusive=False)).alias("a")).join(kept.select(F.col("folder").alias("a")), "a").groupBy("folder").agg(F.max(F.length("a")).alias("cut"))
    return kept.join(above, "folder", "left").select("folder", F.substring("folder", F.coalesce(F.col("cut") + 2, F.lit(1)), F.length("folder")).alias("label"))


def scope_options(nodes: DataFrame, types: list[str]) -> DataFrame:
    """(type, tag, parent, n) of `nodes` (id, type, tags, members): for each type but the finest, the tag of each node that no other node with the same coarser tags has and that isn't a tag of a coarser type; of several the one with the most members, the first on ties."""
    rank = F.array_position(F.array(*map(F.lit, types)), F.col("type"))
    tags = nodes.withColumn("rank", rank).where((F.col("rank") > 0) & (F.col("rank") < len(types))).select("id", "type", "rank", "members", F.posexplode("tags").alias("pos", "tag"))
    taken = tags.groupBy("tag").agg(F.min("rank").alias("first"))
    own = tags.join(taken, "tag").where("rank = first")
    unique = Window.partitionBy("type", "tag")
    best = own.withColumn("same", F.count(F.lit(1)).over(unique)).where("same = 1").groupBy("id", "type").agg(F.max_by(F.struct("tag", "members"), F.struct("members", (-F.col("pos")).alias("p"))).alias("b"))
    return best.select("id", "type", F.col("b.tag").alias("tag"), F.col("b.members").alias("n"))


def siblings(nodes: DataFrame, parent: DataFrame, types: list[str], collation: str = "pl") -> DataFrame:
    """(id, parent, pos) of `nodes` (id, type, title): the place among the children of one parent (null for roots), by the order of types (unknown ones last), then by title in the collation, then by id."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, types)), F.col("type")), F.lit(0)), F.lit(len(types) + 1))
    rows = nodes.select("id", rank.alias("_r"), "title").join(parent.select(F.col("child").alias("id"), "parent"), "id", "left")
    # a parent's children are ordered where they meet; roots, which have no parent, are dealt over ranks so that they don't all meet
    inside = Window.partitionBy("parent", "_r").orderBy(F.collate("title", collation), "id")
    sizes = rows.groupBy("parent", "_r").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("parent").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("parent").alias("_p"), F.col("_r").alias("_q"), before.alias("_before"))
    placed = rows.withColumn("_k", F.row_number().over(inside)).join(sizes, F.col("parent").eqNullSafe(F.col("_p")) & (F.col("_r") == F.col("_q")))
    return placed.select("id", "parent", (F.col("_before") + F.col("_k")).alias("pos"))


#: World units for each root of a weight, and the smallest ring.
SPACING, RING = 22.0, 120.0


def anchors(nodes: DataFrame, cells: int = 4096) -> DataFrame:
    """(id, x, y) of containers `nodes` (id, parent, weight): each on a ring around its parent, roots around the origin, an only child on its parent. Siblings, ordered by the md5 of their id, share the circle in proportion to the root of
    their weight, and the ring has room for all of them. Sums run over cells of that order first, so no task sees all children of one parent. A parent that is not in the table leaves its children as roots."""
    rows = nodes.select("id", "parent", (SPACING * F.sqrt(F.greatest("weight", F.lit(1)))).alias("w"))
    rows = rows.join(nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_in")), "parent", "left").select("id", F.when(F.col("_in"), F.col("parent")).alias("parent"), "w")
    key = F.md5("id")
    rows = rows.withColumns({"_key": key, "_cell": F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * cells / F.lit(1 << 32))})
    sums = rows.groupBy("parent", "_cell").agg(F.sum("w").alias("_s"), F.count(F.lit(1)).alias("_c"))
    whole, run = Window.partitionBy("parent"), Window.partitionBy("parent").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("parent").alias("_p"), F.col("_cell").alias("_q"), F.coalesce(F.sum("_s").over(run), F.lit(0.0)).alias("_before"), F.sum("_s").over(whole).alias("total"), F.sum("_c").over(whole).alias("kids"))
    inside = Window.partitionBy("parent", "_cell").orderBy("_key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = rows.withColumn("_run", F.sum("w").over(inside)).join(sums, F.col("parent").eqNullSafe(F.col("_p")) & (F.col("_cell") == F.col("_q")))
    angle = -F.pi() / 2 + 2 * F.pi() * (F.col("_before") + F.col("_run") - F.col("w") / 2) / F.col("total")
    ring = F.when(F.col("kids") == 1, 0.0).otherwise(F.greatest(F.lit(RING), F.col("total") / F.pi()))
    steps = written(at.select("id", "parent", (F.cos(angle) * ring).alias("dx"), (F.sin(angle) * ring).alias("dy")), "steps")
    placed = steps.where("parent IS NULL").select("id", F.col("dx").alias("x"), F.col("dy").alias("y"))
    out = level = written(placed, "anchors")
    while True:
        below = steps.join(level.select(F.col("id").alias("parent"), "x", "y"), "parent").select("id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
        level = written(below, "anchors")
        if level.isEmpty():
            return out
        out = out.union(level)


def vault(decisions: DataFrame, files: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, members) and edges (source, target, kind, confidence) of `decisions` (sha, semester, subject, category), the copies `files` (sha, package, relpath) and `relations` (src, tgt, type, confidence). Files belong to the group named after the folder of their first copy,
    if it holds at least two of the category's files but not all of them, else to the category; categories belong to subjects, subjects to semesters. Relations join files; the side without a decision is a ghost, and relations between two of those are left out."""
    first = files.where("sha IS NOT NULL").groupBy("sha").agg(F.min_by("relpath", F.struct("package", "relpath")).alias("_p"))
    folder = F.regexp_extract("_p", r"(?:^|/)([^/]+)/[^/]*$", 1)
    rows = decisions.select("sha", F.concat(F.lit("SEM"), F.col("semester").cast("string")).alias("sem"), "subject", F.coalesce("category", F.lit("inne")).alias("category")).join(first, "sha", "left")
    rows = rows.select("sha", "sem", F.concat_ws("/", "sem", "subject").alias("sub"), F.concat_ws("/", "sem", "subject", "category").alias("cat"), F.coalesce(folder, F.lit("")).alias("folder"))
    whole = rows.groupBy("cat").agg(F.count(F.lit(1)).alias("n"))
    groups = rows.where("folder <> ''").groupBy("cat", "folder").agg(F.count(F.lit(1)).alias("members")).join(whole, "cat").where("members >= 2 AND members < n")
    groups = groups.select("cat", "folder", F.concat_ws("/", "cat", "folder").alias("grp"), "members")
    at = rows.join(groups.select("cat", "folder", "grp"), ["cat", "folder"], "left")
    level = lambda kind, c: rows.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("members")).select("id", F.lit(kind).alias("kind"), "members")
    belongs = lambda df, a, b: df.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit("belongs_to").alias("kind"), F.lit(None).cast("double").alias("confidence")).distinct()
    mine = rows.select("sha", F.lit(True).alias("in_"))
    ends = relations.join(mine.toDF("src", "a"), "src", "left").join(mine.toDF("tgt", "b"), "tgt", "left").where("a OR b")
    # a relation belongs to its side in the vault
    told = ends.select(F.when(F.col("a"), F.col("src")).otherwise(F.col("tgt")).alias("source"), F.when(F.col("a"), F.col("tgt")).otherwise(F.col("src")).alias("target"), F.col("type").alias("kind"), "confidence")
    ghosts_ = told.select(F.col("target").alias("sha")).distinct().join(mine, "sha", "left_anti").select(F.col("sha").alias("id"), F.lit("ghost").alias("kind"), F.lit(0).cast("long").alias("members"))
    nodes = level("semester", "sem").unionByName(level("subject", "sub")).unionByName(level("category", "cat"))
    nodes = nodes.unionByName(groups.select(F.col("grp").alias("id"), F.lit("group").alias("kind"), "members")).unionByName(rows.select(F.col("sha").alias("id"), F.lit("file").alias("kind"), F.lit(1).cast("long").alias("members"))).unionByName(ghosts_)
    edges = belongs(rows, "sub", "sem").unionByName(belongs(rows, "cat", "sub")).unionByName(belongs(groups, "grp", "cat"))
    edges = edges.unionByName(belongs(at.withColumn("home", F.coalesce("grp", "cat")), "sha", "home")).unionByName(told)
    return nodes, edges
