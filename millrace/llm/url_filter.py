"""URL filter: rules for hosts and paths, and for all other pages a path-template tree with smoothed labelled purity.

A rule `host/path` fits its host and all subdomains if the url's path starts with the rule's; the longest rule that fits wins.

The tree of a host: a path's segments are typed (numbers, numbers with an extension, hex identifiers, dates). Then, from the top down,
- a segment becomes the wildcard * where its parent has more than max_children kinds of segments and this one less than min_share of the parent's pages;
- the branches below one parent are compared by the distribution of the shapes (the rest of the path) below them, whatever their labels. From the largest to the smallest, a branch is merged into the first
  larger one that it resembles: their total variation is at most merge_distance, or no more than the sampling error of two branches of their sizes. Branches without anything below them have no shape and stay.
Children of merged branches are pooled, and the next level goes on from there. After the wildcards a parent has at most max(max_children, 1 / min_share) kinds of segments and three typed ones, so a parent's branches can be compared pairwise.
A page's template is its path as the tree names it. A template is rejected if its smoothed purity, (blocked + strength * prior) / (labelled + strength), exceeds `reject`. Labels come from the pages that a rule decides, and flow
through the merges to pages that none does; prior is one half, so a template without labels is allowed.

Each level at which some path branches costs a few joins over the table of distinct typed paths; chains of single segments, however long, cost none. Pages are read twice and get their template by a join with that table: on (host, typed path),
broadcast if the table is measured to be small, else shuffled. DataFrame functions only.

Defined cases: a null url, or one without ://, has an empty host and path, fits no rule, and is a template of its own; repeated rows count each; columns of the input with the names of the outputs are replaced, any other stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, bounded, materialise, named, packed, table, unpacked

#: The rules of the query, as fixed by its contract.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def ruled(pages: DataFrame, rules: list[tuple[str, str]], *, url: str = "url") -> DataFrame:
    """(_row, host, path, rule, said) of `pages`: all of its columns in _row; rule and said (the rule's verdict) are null where none fits."""
    spark = pages.sparkSession
    rest = F.when(F.locate("://", F.col("u")) > 0, F.substr(F.col("u"), F.locate("://", F.col("u")) + 3)).otherwise(F.lit(""))
    parted = packed(pages, u=F.coalesce(named(url), F.lit(""))).select("_row", rest.alias("rest"))
    parted = parted.select("_row", ascii_lower(F.regexp_extract("rest", r"^[^/?#]*", 0)).alias("host"), F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    listed = spark.createDataFrame([(r.split("/", 1)[0].lower(), "/" + r.split("/", 1)[1], r, v) for v, r in rules], "rh string, rp string, rule string, said string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = parted.select("host").distinct().select("host", F.explode(suffixes).alias("rh")).join(F.broadcast(listed), "rh")
    fit = fit.groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("n"), "rule", "rp", "said")).alias("rules"))
    got = parted.join(bounded(materialise(fit, "host-rules")), "host", "left")
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["rp"])))
    return got.select("_row", "host", "path", best.alias("best")).select("_row", "host", "path", F.col("best.rule").alias("rule"), F.col("best.said").alias("said"))


TYPES = ["{date}", "{num}", "{hex}"]


def typed(s: Column) -> Column:
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("{date}"))
        .when(s.rlike(r"^\d+$"), F.lit("{num}"))
        .when(s.rlike(r"^\d+\.\w+$"), F.concat(F.lit("{num}"), F.regexp_extract(s, r"(\.\w+)$", 1)))
        .when(s.rlike(r"^[0-9a-fA-F-]{12,}$"), F.lit("{hex}"))
        .otherwise(s)
    )


def _at(level: int) -> tuple[Column, Column, Column]:
    """The parent's path and the segment of a level, and the segments below it."""
    return F.array_join(F.slice("segs", 1, level), "/"), F.get(F.col("segs"), F.lit(level)), F.slice("segs", F.lit(level + 2), F.size("segs"))


def _renamed(tree: DataFrame, level: int, to: DataFrame, label: str) -> DataFrame:
    """`tree` with the segments of a level as `to` (host, parent, seg, new) has them."""
    parent, seg, below = _at(level)
    rows = tree.withColumns({"parent": parent, "seg": seg}).join(bounded(materialise(to, f"names-{label}")), ["host", "parent", "seg"], "left")
    changed = F.when(F.col("new").isNotNull(), F.concat(F.slice("segs", 1, level), F.array("new"), below)).otherwise(F.col("segs"))
    return materialise(rows.select("host", "raw", "n", "lab", "blk", changed.alias("segs")), f"tree-{label}")


def widened(tree: DataFrame, level: int, max_children: int, min_share: float) -> DataFrame:
    """`tree` with the rare segments of a level as wildcards, where a parent has many kinds of them."""
    parent, seg, _ = _at(level)
    rows = tree.select("host", parent.alias("parent"), seg.alias("seg"), "n").where(F.col("seg").isNotNull() & ~F.col("seg").isin(*TYPES, "*"))
    kinds = rows.groupBy("host", "parent", "seg").agg(F.sum("n").alias("n"))
    full = kinds.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).where(F.col("kinds") > max_children)
    full = materialise(full, "wide")
    if full.isEmpty():
        return tree
    rare = kinds.join(bounded(full), ["host", "parent"]).where(F.col("n") < F.col("all") * min_share).select("host", "parent", "seg", F.lit("*").alias("new"))
    return _renamed(tree, level, rare, f"wide-{level}")


def merged(tree: DataFrame, level: int, distance: float) -> DataFrame:
    """`tree` with each branch of a level under the name of the larger one that it resembles."""
    parent, seg, below = _at(level)
    held = tree.where(F.size("segs") > level + 1).select("host", parent.alias("parent"), seg.alias("seg"), F.xxhash64(below).alias("shape"), "n")
    shapes = materialise(held.groupBy("host", "parent", "seg", "shape").agg(F.sum("n").alias("n")), f"shapes-{level}")
    sizes = shapes.groupBy("host", "parent", "seg").agg(F.sum("n").alias("size"))
    # a parent's kinds of segments are bounded by the wildcards, so its list is short
    family = sizes.groupBy("host", "parent").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "seg"))).alias("kids")).where(F.size("kids") > 1)
    family = materialise(family, f"families-{level}")
    if family.isEmpty():
        return tree
    of = bounded(materialise(family.select("host", "parent", F.explode("kids").alias("k")).select("host", "parent", F.col("k.seg").alias("seg"), (-F.col("k.order")).alias("size")), f"branches-{level}"))
    share = materialise(shapes.join(of, ["host", "parent", "seg"]).select("host", "parent", "shape", "seg", "size", (F.col("n") / F.col("size")).alias("p")), f"shares-{level}")
    key = ["host", "parent", "shape"]
    both = share.join(share.select(*key, F.col("seg").alias("other"), F.col("size").alias("size2"), F.col("p").alias("q")), key).where(F.col("seg") < F.col("other"))
    both = both.groupBy("host", "parent", "seg", "other", "size", "size2").agg(F.sum(F.least("p", "q")).alias("both"))
    limit = F.greatest(F.lit(float(distance)), F.sqrt(1 / F.col("size") + 1 / F.col("size2")) / 2) + 1e-9
    near = both.where(1 - F.col("both") <= limit).groupBy("host", "parent").agg(F.collect_list(F.struct(F.col("seg").alias("a"), F.col("other").alias("b"))).alias("near"))

    def joined(done: Column, kid: Column) -> Column:
        alike = F.filter(done, lambda d: (d["seg"] == d["new"]) & F.array_contains(F.col("near"), F.struct(F.least(d["seg"], kid["seg"]).alias("a"), F.greatest(d["seg"], kid["seg"]).alias("b"))))
        return F.concat(done, F.array(F.struct(kid["seg"].alias("seg"), F.coalesce(F.get(alike, F.lit(0))["seg"], kid["seg"]).alias("new"))))

    none = F.array().cast("array<struct<seg:string,new:string>>")
    names = family.join(near, ["host", "parent"]).select("host", "parent", F.explode(F.aggregate("kids", none, joined)).alias("x")).select("host", "parent", "x.seg", "x.new").where("seg <> new")
    return _renamed(tree, level, names, f"merged-{level}")


def template_tree(paths: DataFrame, max_children: int, min_share: float, merge_distance: float) -> DataFrame:
    """(host, raw, n, lab, blk, segs) for `paths` (host, raw, n, lab, blk): the typed path and the segments as the tree names them."""
    segs = F.when(F.col("raw") == "", F.array().cast("array<string>")).otherwise(F.split("raw", "/"))
    tree = materialise(paths.select("host", "raw", "n", "lab", "blk", segs.alias("segs")), "paths")
    # a parent has no more kinds of segments than its host has at that level, so no other level can change
    kinds = tree.select("host", F.posexplode("segs").alias("level", "seg")).groupBy("host", "level").agg(F.count_distinct("seg").alias("kinds"), F.count_distinct(F.when(~F.col("seg").isin(TYPES), F.col("seg"))).alias("plain"))
    told = kinds.groupBy("level").agg(F.max("kinds").alias("kinds"), F.max("plain").alias("plain")).where("kinds > 1").orderBy("level").collect()
    for r in told:
        if r["plain"] > max_children:
            tree = widened(tree, r["level"], max_children, min_share)
    for r in told:
        if r["plain"] > max_children:  # children of merged branches are pooled
            tree = widened(tree, r["level"], max_children, min_share)
        tree = merged(tree, r["level"], merge_distance)
    return tree


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, *, url: str = "url", max_children: int = 20, min_share: float = 0.05, merge_distance: float = 0.2, strength: float = 2.0, reject: float = 0.75) -> DataFrame:
    """`pages` with host, path, rule, verdict, template and purity."""
    raw = F.array_join(F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), typed), "/")
    known = ruled(pages, rules, url=url).withColumn("raw", raw)
    paths = known.groupBy("host", "raw").agg(F.count(F.lit(1)).alias("n"), F.count("said").alias("lab"), F.count(F.when(F.col("said") == "block", 1)).alias("blk"))
    tree = template_tree(paths, max_children, min_share, merge_distance)
    named_ = tree.select("host", "raw", "lab", "blk", F.concat(F.col("host"), F.lit("/"), F.array_join("segs", "/")).alias("template"))
    purity = (F.sum("blk") + F.lit(strength / 2)) / (F.sum("lab") + F.lit(strength))
    stats = named_.groupBy("template").agg(purity.alias("purity"))
    told = materialise(named_.select("host", "raw", "template").join(stats, "template"), "templates")
    out = known.join(bounded(told), ["host", "raw"], "left")
    verdict = F.coalesce(F.col("said"), F.when(F.col("purity") > reject, F.lit("block")).otherwise(F.lit("allow")))
    return unpacked(out, pages.columns, host=F.col("host"), path=F.col("path"), rule=F.col("rule"), verdict=verdict, template=F.col("template"), purity=F.col("purity"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
