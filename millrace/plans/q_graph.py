"""Queries over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import graph as G
from millrace.plans.fixtures import frame, sql
from millrace.plans.registry import query

TREE = """WITH RECURSIVE p AS (SELECT source AS child, min(target) AS parent FROM edges WHERE kind = 'belongs_to' GROUP BY source),
up AS (SELECT child AS node, parent AS above, 1 AS steps FROM p UNION ALL SELECT node, parent, steps + 1 FROM up JOIN p ON p.child = above)"""


def both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    made: dict = {}
    return frame(spark, d, "nodes", made), frame(spark, d, "edges", made)


@query("gra02_orphans", sql("nodes edges", "SELECT id, title FROM nodes WHERE id NOT IN (SELECT source FROM edges) AND id NOT IN (SELECT target FROM edges)"))
def gra02(spark: SparkSession, d: str) -> DataFrame:
    return G.orphans(*both(spark, d)).select("id", "title")


@query("gra03_backlinks", sql("edges", "SELECT target, count(*) AS incoming FROM edges GROUP BY target"))
def gra03(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "edges").groupBy("target").agg(F.count(F.lit(1)).alias("incoming"))


@query("gra04_nearest_region", sql("nodes edges", TREE + " SELECT node, arg_min(above, steps) AS found FROM up JOIN nodes ON nodes.id = above AND type = 'region' GROUP BY node"))
def gra04(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    return G.nearest_of_type(G.parents(e), n, "region")


@query("gra07_search_tree", sql("nodes edges", TREE + ", m AS (SELECT id FROM nodes WHERE type = 'customer' AND level = 3 AND status = 'done'), k AS (SELECT id FROM m UNION SELECT above FROM up WHERE node IN (SELECT id FROM m)) SELECT n.id, NOT EXISTS (SELECT 1 FROM p WHERE p.child = n.id AND p.parent IN (SELECT id FROM k)) AS root FROM nodes n WHERE n.id IN (SELECT id FROM k)"))
def gra07(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    return G.with_ancestors(n, G.parents(e), n.where("type = 'customer' AND level = 3 AND status = 'done'")).select("id", "root")


@query("gra08_descendants", sql("edges", TREE + " SELECT above AS node, count(*) AS descendants FROM up GROUP BY above"))
def gra08(spark: SparkSession, d: str) -> DataFrame:
    return G.descendants(G.parents(frame(spark, d, "edges")))


@query("gra12_hash_nodes", sql("content", "SELECT substr(sha, 1, 8) AS suffix, count(*) AS n, min(sha) AS sha FROM content GROUP BY 1"))
def gra12(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "content").groupBy(F.substring("sha", 1, 8).alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.min("sha").alias("sha"))


def _ring(level: str, above: str) -> str:
    """Anchors of one level of the tree, around those of the level above."""
    return f"""{level} AS (SELECT id, x + CASE WHEN kids = 1 THEN 0 ELSE cos(a) * greatest(120, total / pi()) END AS x, y + CASE WHEN kids = 1 THEN 0 ELSE sin(a) * greatest(120, total / pi()) END AS y FROM (
  SELECT w.id, p.x, p.y, count(*) OVER g AS kids, sum(w) OVER g AS total, -pi() / 2 + 2 * pi() * (sum(w) OVER o - w / 2) / sum(w) OVER g AS a FROM w JOIN {above} p ON p.id IS NOT DISTINCT FROM w.parent WINDOW g AS (PARTITION BY w.parent), o AS (PARTITION BY w.parent ORDER BY md5(w.id), w.id ROWS UNBOUNDED PRECEDING)) q)"""


@query("gra13_hierarchy_anchors", sql("nodes edges", f"""{TREE}, n AS (SELECT id, parent, coalesce(c, 0) AS c FROM nodes LEFT JOIN p ON child = id LEFT JOIN (SELECT above, count(*) AS c FROM up GROUP BY 1) q ON above = id),
w AS (SELECT id, parent, 22 * sqrt(greatest(c, 1)) AS w FROM n), o AS (SELECT NULL::VARCHAR AS id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y), {_ring("l0", "o")}, {_ring("l1", "l0")}, {_ring("l2", "l1")}
SELECT id, round(x, 4) AS x, round(y, 4) AS y FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) z"""))
def gra13(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    p = G.parents(e)
    weight = n.select("id").join(G.descendants(p).withColumnRenamed("node", "id"), "id", "left").join(p.withColumnRenamed("child", "id"), "id", "left")
    return G.anchors(weight.select("id", "parent", F.coalesce("descendants", F.lit(0)).alias("weight"))).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))

@query("agg29_ghosts", sql("nodes edges", "SELECT lower(trim(target)) AS id, min(target) AS title, count(DISTINCT source) AS referrers FROM edges WHERE target NOT IN (SELECT id FROM nodes) GROUP BY 1"))
def agg29(spark: SparkSession, d: str) -> DataFrame:
    return G.ghosts(*both(spark, d))


@query("agg24_27_graph_dashboard", sql("nodes", "SELECT type, coalesce(status, '—') AS status, count(*) AS n FROM nodes GROUP BY ALL"))
def agg24(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "nodes").groupBy("type", F.coalesce("status", F.lit("—")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("fil15_visible_nodes", sql("nodes edges", "WITH k AS (SELECT id FROM nodes WHERE type IN ('customer', 'nation')), e AS (SELECT * FROM edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)) SELECT id FROM k WHERE id IN (SELECT source FROM e) OR id IN (SELECT target FROM e)"))
def fil15(spark: SparkSession, d: str) -> DataFrame:
    return G.visible_nodes(*both(spark, d), types=["customer", "nation"], connected_only=True).select("id")


@query("fil16_visible_edges", sql("edges", "SELECT source, target FROM edges WHERE coalesce(kind, 'link') = 'link'"))
def fil16(spark: SparkSession, d: str) -> DataFrame:
    return G.visible_edges(frame(spark, d, "edges"), ["link"]).select("source", "target")


@query("fil17_real_nodes", sql("nodes", "SELECT id FROM nodes WHERE status = 'done' AND level = 2"))
def fil17(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    return G.visible_nodes(n, e, statuses=["done"], levels=[2]).select("id")


@query("fil18_default_types", sql("nodes", "WITH t AS (SELECT type, count(*) AS n FROM nodes GROUP BY type) SELECT type FROM t WHERE (SELECT sum(n) FROM t) <= 600 OR type <> (SELECT arg_max(type, n) FROM t)"))
def fil18(spark: SparkSession, d: str) -> DataFrame:
    t = frame(spark, d, "nodes").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    whole = t.agg(F.sum("n").alias("s"), F.max_by("type", "n").alias("finest"))
    return t.join(F.broadcast(whole), (F.col("s") <= 600) | (F.col("type") != F.col("finest"))).select("type")


@query("fil19_known_values", sql("nodes", "SELECT DISTINCT status FROM nodes WHERE status IN ('done', 'gone', 'in-progress')"))
def fil19(spark: SparkSession, d: str) -> DataFrame:
    known = frame(spark, d, "nodes").agg(F.collect_set("status").alias("s"))
    return known.select(F.explode(F.array_intersect("s", F.array(*map(F.lit, ("done", "gone", "in-progress"))))).alias("status"))


@query("top04_next_nodes", sql("nodes", "SELECT id, status FROM nodes WHERE status IN ('in-progress', 'not-started') ORDER BY (status <> 'in-progress'), level NULLS FIRST, id LIMIT 3"))
def top04(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "nodes").where(F.col("status").isin("in-progress", "not-started")).orderBy(F.col("status") != "in-progress", F.col("level").asc_nulls_first(), "id").limit(3).select("id", "status")


@query("top07_sibling_order", sql("nodes edges", TREE.split(",\nup AS")[0] + " SELECT id, parent, row_number() OVER (PARTITION BY parent ORDER BY CASE type WHEN 'region' THEN 0 WHEN 'nation' THEN 1 ELSE 2 END, title, id) AS pos FROM nodes LEFT JOIN p ON child = id"))
def top07(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    return G.siblings(n, G.parents(e), ["region", "nation"])

@query("win12_first_parent", sql("edges", "SELECT source AS child, min(target) AS parent FROM edges WHERE kind = 'belongs_to' GROUP BY source"))
def win12(spark: SparkSession, d: str) -> DataFrame:
    return G.parents(frame(spark, d, "edges"))


@query("joi17_link_resolution", sql("nodes edges", """WITH k AS (SELECT id, 0 AS tier, lower(type || '/' || title) AS k FROM nodes UNION SELECT id, 1, lower(title) FROM nodes UNION SELECT id, 2, lower(id) FROM nodes),
t AS (SELECT k, tier, min(id) AS id, count(*) AS n FROM k GROUP BY ALL), b AS (SELECT k, arg_min({'id': id, 'n': n, 'tier': tier}, tier) AS b FROM t GROUP BY k)
SELECT source, target AS target_text, b.id AS id, b.tier AS tier, coalesce(b.n > 1, false) AS ambiguous FROM edges LEFT JOIN b ON b.k = lower(trim(target))"""))
def joi17(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    notes = n.select("id", F.concat_ws("/", "type", F.concat("title", F.lit(".md"))).alias("path"), F.col("title").alias("stem"), F.array("id").alias("aliases"))
    return G.resolve(e.select("source", F.col("target").alias("target_text")), notes)


_VAULT = """fi AS (SELECT sha, regexp_extract(arg_min(relpath, {'a': package, 'b': relpath}), '(?:^|/)([^/]+)/[^/]*$', 1) AS folder FROM files WHERE sha IS NOT NULL GROUP BY sha),
v AS (SELECT d.sha, 'SEM' || semester AS sem, 'SEM' || semester || '/' || subject AS sub, 'SEM' || semester || '/' || subject || '/' || coalesce(category, 'inne') AS cat, coalesce(folder, '') AS folder FROM decisions d LEFT JOIN fi USING (sha)),
gr AS (SELECT cat, folder, cat || '/' || folder AS grp, members FROM (SELECT cat, folder, count(*) AS members FROM v WHERE folder <> '' GROUP BY ALL) g JOIN (SELECT cat, count(*) AS n FROM v GROUP BY cat) w USING (cat) WHERE members >= 2 AND members < n),
re AS (SELECT r.*, src IN (SELECT sha FROM v) AS a, tgt IN (SELECT sha FROM v) AS b FROM relations r),
told AS (SELECT CASE WHEN a THEN src ELSE tgt END AS source, CASE WHEN a THEN tgt ELSE src END AS target, type AS kind, confidence FROM re WHERE a OR b)"""


@query("joi25_set09_vault_nodes", sql("decisions files relations", f"WITH {_VAULT} SELECT sem AS id, 'semester' AS kind, count(*) AS members FROM v GROUP BY 1 UNION ALL SELECT sub, 'subject', count(*) FROM v GROUP BY 1 UNION ALL SELECT cat, 'category', count(*) FROM v GROUP BY 1 UNION ALL SELECT grp, 'group', members FROM gr UNION ALL SELECT sha, 'file', 1 FROM v UNION ALL SELECT DISTINCT target, 'ghost', 0 FROM told WHERE target NOT IN (SELECT sha FROM v)"))
def joi25(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return G.vault(*(frame(spark, d, n, made) for n in ("decisions", "files", "relations")))[0]


@query("joi25_vault_edges", sql("decisions files relations", f"WITH {_VAULT} SELECT DISTINCT sub AS source, sem AS target, 'belongs_to' AS kind, NULL::DOUBLE AS confidence FROM v UNION ALL SELECT DISTINCT cat, sub, 'belongs_to', NULL FROM v UNION ALL SELECT grp, cat, 'belongs_to', NULL FROM gr UNION ALL SELECT sha, coalesce(grp, v.cat), 'belongs_to', NULL FROM v LEFT JOIN gr ON gr.cat = v.cat AND gr.folder = v.folder UNION ALL SELECT source, target, kind, confidence FROM told"))
def joi25_edges(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return G.vault(*(frame(spark, d, n, made) for n in ("decisions", "files", "relations")))[1]

@query("joi18_failed_items", sql("files", "SELECT 'file' AS kind, file_id::VARCHAR AS id FROM files WHERE status = 'error' UNION ALL SELECT DISTINCT 'folder', folder FROM files WHERE status = 'error'"))
def joi18(spark: SparkSession, d: str) -> DataFrame:
    bad = frame(spark, d, "files").where("status = 'error'")
    return bad.select(F.lit("file").alias("kind"), F.col("file_id").cast("string").alias("id")).union(bad.select(F.lit("folder"), "folder").distinct())


@query("gra11_cycles", sql("nodes edges", TREE + ", l AS (SELECT DISTINCT n.id AS parent, c.id AS child FROM nodes n JOIN nodes c ON c.type = 'region' AND n.type IN ('region', 'nation') AND (length(n.title) + length(c.title)) % 2 = 0) SELECT parent, child, CASE WHEN parent = child OR EXISTS (SELECT 1 FROM up WHERE node = l.parent AND above = l.child) THEN 'cycle' ELSE 'pending' END AS status FROM l"))
def gra11(spark: SparkSession, d: str) -> DataFrame:
    n, e = both(spark, d)
    shortcuts = n.where("type IN ('region', 'nation')").select(F.col("id").alias("parent"), F.length("title").alias("a")).join(F.broadcast(n.where("type = 'region'").select(F.col("id").alias("child"), F.length("title").alias("b"))), (F.col("a") + F.col("b")) % 2 == 0)
    return G.listed(shortcuts, G.parents(e))

_UP = "list_transform(range(1, len(string_split({0}, '/'))), lambda k: array_to_string(string_split({0}, '/')[1:k], '/'))"


@query("gra05_specific_pairs", sql("files", f"""WITH up AS (SELECT DISTINCT array_to_string(list_slice(string_split(folder, '/'), 1, k), '/') AS folder, sha FROM (SELECT *, unnest(range(1, len(string_split(folder, '/')) + 1)) AS k FROM files WHERE sha IS NOT NULL) x),
pairs AS (SELECT x.folder AS a, y.folder AS b, count(*) AS common FROM up x JOIN up y ON x.sha = y.sha AND x.folder < y.folder GROUP BY ALL),
wide AS (SELECT DISTINCT least(w, o) AS a, greatest(w, o) AS b, common FROM (SELECT unnest({_UP.format("a")}) AS w, b AS o, common FROM pairs UNION ALL SELECT unnest({_UP.format("b")}), a, common FROM pairs) z)
SELECT a, b, common FROM pairs ANTI JOIN wide USING (a, b, common)"""))
def gra05(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import tree

    made: dict = {}
    sets = tree.up(frame(spark, d, "files", made).where("sha IS NOT NULL"), frame(spark, d, "folders", made), "sha").select("folder", "sha").distinct()
    pairs, _ = tree.common_counts(sets)
    return tree.most_specific(pairs)
