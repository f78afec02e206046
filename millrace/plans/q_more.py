"""Queries over trees on disk, reports, ranking and guarded changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import parse
from millrace.functions import text as T
from millrace.operators import graph as G
from millrace.operators import planning as P
from millrace.operators import ranking
from millrace.operators import reports as R
from millrace.operators import tree
from millrace.plans.fixtures import frame, sql
from millrace.plans.q_items import CLEAN_HASHES, dups
from millrace.plans.q_sources import scratch
from millrace.plans.registry import query
from millrace.sources import files as S
from millrace.sources import sinks
from millrace.streaming import rates


def _tree(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "tree")
    frame(spark, d, "files").select("package", F.concat_ws("/", "relpath", "filename").alias("value")).write.partitionBy("package").text(path)
    return path


@query("src01_packages", sql("files", "SELECT DISTINCT 'package=' || package AS package FROM files"))
def src01(spark: SparkSession, d: str) -> DataFrame:
    return S.packages(spark, _tree(spark, d))[0]


@query("src02_tree_scan", sql("files", "SELECT 'package=' || package AS folder, true AS has_files FROM files GROUP BY package"))
def src02(spark: SparkSession, d: str) -> DataFrame:
    return S.scan(spark, _tree(spark, d))[1].select("folder", (F.col("files") > 0).alias("has_files"))


@query("src09_sniffed", "SELECT page_id, page_id % 5 <> 0 AS is_text FROM pages")
def src09(spark: SparkSession, d: str) -> DataFrame:
    raw = frame(spark, d, "pages").select("page_id", F.concat(F.encode("html", "UTF-8"), F.when(F.col("page_id") % 5 == 0, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("20")))).alias("raw"), F.lit("text").alias("kind"))
    return S.extracted(raw, "raw", "kind", 10_000_000).select("page_id", F.col("text").isNotNull().alias("is_text"))


@query("snk03_inventory", sql("files content folders", f"WITH {CLEAN_HASHES} SELECT f.file_id, c.kind FROM files f LEFT JOIN content c ON c.sha = f.sha"))
def snk03(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    path = scratch(spark, "inventory")
    sinks.jsonl(tree.inventory(frame(spark, d, "files", made), frame(spark, d, "content", made), dups(spark, d, made)), path, ["file_id"])
    return S.jsonl(spark, path, "file_id long, kind string")


@query("snk04_05_reports", None)
def snk04(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    f = frame(spark, d, "files", made)
    parts = {"Duplicates": R.dedup_summary(f), "Packages": R.exclusivity(f).orderBy(F.desc("bytes"), "package"), "Largest": R.top_waste(f)}
    return spark.createDataFrame([("markdown", sinks.report(parts)), ("html", sinks.html_report(parts))], "format string, text string")


@query("snk10_snapshot", sql("decisions", """SELECT '{"plan_hash":"h","sha":"' || sha || '","action":"' || action || '"}' AS value FROM decisions"""))
def snk10(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "snapshot")
    sinks.snapshot(frame(spark, d, "decisions").select("sha", "action"), path, "h")
    return spark.read.text(path)


@query("agg28_scope_options", sql("nodes edges", """WITH RECURSIVE p AS (SELECT source AS child, min(target) AS parent FROM edges WHERE kind = 'belongs_to' GROUP BY source),
up AS (SELECT child AS node, parent AS above FROM p UNION ALL SELECT node, parent FROM up JOIN p ON p.child = above), c AS (SELECT above, count(*) AS n FROM up GROUP BY 1),
t AS (SELECT id, type, CASE type WHEN 'region' THEN 1 WHEN 'nation' THEN 2 ELSE 3 END AS rank, coalesce(n, 0) AS members, unnest([0, 1]) AS pos, unnest([lower(title), substr(lower(title), 1, 2)]) AS tag FROM nodes LEFT JOIN c ON above = id),
o AS (SELECT * FROM t JOIN (SELECT tag, min(rank) AS first FROM t WHERE rank < 3 GROUP BY 1) f USING (tag) WHERE rank = first AND rank < 3),
u AS (SELECT *, count(*) OVER (PARTITION BY type, tag) AS same FROM o)
SELECT id, type, arg_max(tag, {'m': members, 'p': -pos}) AS tag, max(members) AS n FROM u WHERE same = 1 GROUP BY id, type"""))
def agg28(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    n, e = frame(spark, d, "nodes", made), frame(spark, d, "edges", made)
    below = G.descendants(G.parents(e)).withColumnRenamed("node", "id")
    rows = n.join(below, "id", "left").select("id", "type", F.array(F.lower("title"), F.substring(F.lower("title"), 1, 2)).alias("tags"), F.coalesce("descendants", F.lit(0)).alias("members"))
    return G.scope_options(rows, ["region", "nation", "customer"])


@query("set07_disk_against_plan", sql("decisions applied", "SELECT 'only_disk' AS side, count(*) AS n FROM (SELECT lower(target) FROM applied EXCEPT SELECT lower(target) FROM decisions) a UNION ALL SELECT 'only_plan', count(*) FROM (SELECT lower(target) FROM decisions EXCEPT SELECT lower(target) FROM applied) b"))
def set07(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    a, p = (frame(spark, d, n, made).select(F.lower("target").alias("k")) for n in ("applied", "decisions"))
    one = lambda x, y, n: x.subtract(y).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("side"), "n")
    return one(a, p, "only_disk").union(one(p, a, "only_plan"))


@query("str24_json_inside", "SELECT event_id, '{\"k\":' || (props->>'k') || '}' AS found FROM events")
def str24(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.concat(F.lit("The answer is {not json: "), F.lit("```json\n"), "props", F.lit("\n``` and {more}"))
    return frame(spark, d, "events").select("event_id", parse.json_inside(noisy).alias("found"))


@query("str26_ranked_search", None)
def str26(spark: SparkSession, d: str) -> DataFrame:
    notes = frame(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("body"))
    return ranking.search(notes, "theti onsh blerea")


@query("str29_differences", None)
def str29(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    t = frame(spark, d, "files", made).where("sha IS NOT NULL").groupBy("sha").agg(F.min("text").alias("text"))
    r = frame(spark, d, "relations", made).select("src", "tgt")
    j = r.join(t.toDF("src", "a"), "src").join(t.toDF("tgt", "b"), "tgt")
    return j.select("src", "tgt", parse.differences(F.col("a"), F.col("b")).alias("diff"))


@query("gra09_single_child_descent", sql("folders", "WITH RECURSIVE p AS (SELECT folder AS child, regexp_replace(folder, '/[^/]*$', '') AS parent FROM folders WHERE contains(folder, '/')), o AS (SELECT parent, min(child) AS child FROM p GROUP BY parent HAVING count(*) = 1), w AS (SELECT parent AS node, child AS e, 1 AS s FROM o UNION ALL SELECT node, o.child, s + 1 FROM w JOIN o ON o.parent = e WHERE s < 16) SELECT node, arg_max(e, s) AS \"end\" FROM w GROUP BY node"))
def gra09(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d, "folders").where(F.col("folder").contains("/"))
    return G.single_child_end(f.select(F.col("folder").alias("child"), T.parent(F.col("folder")).alias("parent")))


@query("gra10_merged_chains", sql("files folders", """WITH c AS (SELECT regexp_replace(folder, '/?[^/]*$', '') AS folder, count(*) AS n FROM folders GROUP BY 1),
k AS (SELECT f.folder FROM folders f LEFT JOIN c ON c.folder = f.folder WHERE f.folder IN (SELECT folder FROM files) OR n IS NULL OR n <> 1)
SELECT folder, substr(folder, coalesce((SELECT max(length(a.folder)) FROM k a WHERE starts_with(k.folder, a.folder || '/')) + 2, 1)) AS label FROM k"""))
def gra10(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return G.merged_chains(frame(spark, d, "folders", made), frame(spark, d, "files", made))


@query("stm07_shared_backoff", """WITH p AS (SELECT epoch_us(ts) AS us, epoch_us(ts) + (event_id % 900) * 1000000 AS due, 'e' || event_id AS reason FROM events WHERE event_type = 'error'),
b AS (SELECT event_id, epoch_us(ts) AS us, NULL AS due, NULL AS reason FROM events UNION ALL SELECT NULL, us, due, reason FROM p),
r AS (SELECT event_id, us, max(CASE WHEN due IS NOT NULL THEN {'d': due, 'r': reason} END) OVER (ORDER BY us) AS top FROM b)
SELECT event_id, greatest(0, coalesce(top.d - us, 0)) / 1e6 AS wait, CASE WHEN top.d > us THEN top.r END AS reason FROM r WHERE event_id IS NOT NULL""")
def stm07(spark: SparkSession, d: str) -> DataFrame:
    e = frame(spark, d, "events")
    fines = e.where("event_type = 'error'").select("ts", (F.col("event_id") % 900).alias("delay"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("reason"))
    return rates.shared_backoff(e.select("event_id", "ts"), fines).select("event_id", "wait", "reason")

@query("dml02_natural_keys", sql("files decisions relations", "SELECT 'files' AS \"table\", count(*) AS n FROM (SELECT 1 FROM files GROUP BY package, relpath HAVING count(*) > 1) a UNION ALL SELECT 'decisions', count(*) FROM (SELECT 1 FROM decisions GROUP BY sha HAVING count(*) > 1) b UNION ALL SELECT 'relations', count(*) FROM (SELECT 1 FROM relations GROUP BY src, tgt, type HAVING count(*) > 1) c"))
def dml02(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    keys = {"files": ["package", "relpath"], "decisions": ["sha"], "relations": ["src", "tgt", "type"]}
    return P.key_violations({n: (frame(spark, d, n, made), k) for n, k in keys.items()})


@query("dml08_package_rename", sql("folders", "SELECT CASE WHEN folder = 'src1' OR starts_with(folder, 'src1/') THEN 'new/src' || substr(folder, 5) ELSE folder END AS folder FROM folders"))
def dml08(spark: SparkSession, d: str) -> DataFrame:
    return P.renamed(frame(spark, d, "folders").select("folder"), "folder", "src1", "new/src")


@query("dml09_apply_dry_run", sql("files decisions applied", "SELECT sha, target, 'would copy' AS action FROM decisions WHERE action = 'copy' AND sha IN (SELECT sha FROM files) AND lower(target) NOT IN (SELECT lower(target) FROM applied)"))
def dml09(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    p = frame(spark, d, "decisions", made).withColumns({"_t": F.col("target"), "target": F.lower("target")})
    states = P.operations(p, frame(spark, d, "files", made).where("sha IS NOT NULL"), frame(spark, d, "applied", made).select(F.lower("target").alias("target"), "sha"))
    out = P.applied_rows(states, 0, "2025-01-01T00:00:00Z", "h")
    return out.join(p.select("sha", "_t"), "sha").select("sha", F.col("_t").alias("target"), "action")


@query("dml03_migration", sql("decisions", "SELECT sha, coalesce(method, 'llm') AS method FROM decisions"))
def dml03(spark: SparkSession, d: str) -> DataFrame:
    old = frame(spark, d, "decisions").select("sha", F.col("method").alias("how"))
    return P.migrated(old, 1, {1: lambda x: x.withColumnRenamed("how", "method"), 2: lambda x: x.withColumn("method", F.coalesce("method", F.lit("llm")))}, 3)
