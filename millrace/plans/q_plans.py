"""Queries over decisions, plans, relations and table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import planning as P
from millrace.operators import similarity as S
from millrace.operators.items import noise
from millrace.plans.fixtures import frame, sql
from millrace.plans.q_items import multiset
from millrace.plans.registry import query

#: Several decisions for a content: its own, and one by another method for every third.
ROWS = "rows AS (SELECT sha, method, id AS ord FROM decisions UNION ALL SELECT sha, CASE id % 2 WHEN 0 THEN 'heuristic' ELSE 'manual' END, id + 5000000 FROM decisions WHERE id % 3 = 0)"
#: Plan rows with sources, and collisions on purpose.
PLAN = """plan AS (SELECT d.sha, d.action, 'SEM' || d.semester || '/' || d.subject || '/cat/name_' || (d.id % 60) || '.txt' AS target, f.package || '/' || f.relpath AS source, d.confidence, d.needs_review, 'SEM' || d.semester || '/' || d.subject AS subject_dir
  FROM decisions d JOIN (SELECT sha, arg_min(package, file_id) AS package, arg_min(relpath, file_id) AS relpath FROM files WHERE sha IS NOT NULL GROUP BY sha) f ON f.sha = d.sha)"""


def plan(spark: SparkSession, d: str, made: dict) -> DataFrame:
    f = frame(spark, d, "files", made).where("sha IS NOT NULL").groupBy("sha").agg(F.min_by(F.concat_ws("/", "package", "relpath"), "file_id").alias("source"))
    dec = frame(spark, d, "decisions", made).withColumn("subject_dir", F.concat(F.lit("SEM"), F.col("semester").cast("string"), F.lit("/"), "subject"))
    return dec.join(f, "sha").select("sha", "action", F.concat("subject_dir", F.lit("/cat/name_"), (F.col("id") % 60).cast("string"), F.lit(".txt")).alias("target"), "source", "confidence", "needs_review", "subject_dir")


@query("win01_best_decision", sql("decisions", f"WITH {ROWS} SELECT sha, method, n - 1 AS dropped FROM (SELECT *, count(*) OVER (PARTITION BY sha) AS n, row_number() OVER (PARTITION BY sha ORDER BY CASE coalesce(method, 'llm') WHEN 'manual' THEN 0 WHEN 'deterministic' THEN 1 WHEN 'heuristic' THEN 2 WHEN 'llm' THEN 3 ELSE 99 END, ord) AS k FROM rows) x WHERE k = 1"))
def win01(spark: SparkSession, d: str) -> DataFrame:
    dec = frame(spark, d, "decisions")
    more = dec.where("id % 3 = 0").select("sha", F.when(F.col("id") % 2 == 0, "heuristic").otherwise("manual").alias("method"), (F.col("id") + 5000000).alias("ord"))
    return P.best_decision(dec.select("sha", "method", F.col("id").alias("ord")).union(more), "ord").select("sha", "method", "dropped")


@query("win03_first_per_content", sql("files", "SELECT sha, min(file_id) AS file_id FROM files WHERE sha IS NOT NULL GROUP BY sha"))
def win03(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "files").where("sha IS NOT NULL").groupBy("sha").agg(F.min("file_id").alias("file_id"))


@query("win05_best_name", sql("files", r"""WITH s AS (SELECT sha, filename, regexp_replace(filename, '\.[^.]*$', '') AS st FROM files WHERE sha IS NOT NULL)
SELECT sha, arg_min(filename, {'a': regexp_matches(st, '(?i)^(?:Kop(?:i)?a |Copy of )|\([1-9][0-9]*\)$| - (?:kopia|Copy)$'), 'b': regexp_matches(st, '(?i)^(IMG[-_ ]?[0-9]+|DSC[-_ ]?[0-9]+|scan[-_ ]?[0-9]*$)'),
  'c': -len(list_filter(regexp_split_to_array(st, '[_\s.-]+'), lambda p: p <> '')), 'd': -length(st), 'e': filename}) AS best FROM s GROUP BY sha"""))
def win05(spark: SparkSession, d: str) -> DataFrame:
    return P.best_name(frame(spark, d, "files").where("sha IS NOT NULL"), "sha", "filename")


@query("win06_numbered_names", sql("files", r"SELECT file_id, CASE WHEN n = 1 THEN filename ELSE regexp_extract(filename, '^(.*?)(\.[^.]*)?$', 1) || '__dup' || (n - 1) || regexp_extract(filename, '(\.[^.]*)$', 1) END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY package, filename ORDER BY file_id) AS n FROM files) x"))
def win06(spark: SparkSession, d: str) -> DataFrame:
    return P.numbered_names(frame(spark, d, "files"), ["package"], "filename", "file_id").select("file_id", "unique_name")


@query("win07_numbered_slugs", sql("files", "SELECT file_id, s || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS slug FROM (SELECT file_id, s, row_number() OVER (PARTITION BY s ORDER BY file_id) AS n FROM (SELECT file_id, trim(regexp_replace(lower(filename), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM files) y) x"))
def win07(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "files").select("file_id", T.slug(F.col("filename")).alias("s"))
    n = F.row_number().over(Window.partitionBy("s").orderBy("file_id"))
    return rows.withColumn("n", n).select("file_id", F.concat("s", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise("")).alias("slug"))


@query("win08_disambiguation", sql("files decisions", f"""WITH {PLAN},
c AS (SELECT target FROM plan WHERE action IN ('copy', 'media') GROUP BY target HAVING count(DISTINCT sha) > 1),
p AS (SELECT plan.*, action IN ('copy', 'media') AND plan.target IN (SELECT target FROM c) AS clash, string_split(regexp_replace(source, '/?[^/]*$', ''), '/') AS f, regexp_replace(target, '/[^/]*$', '') AS h, regexp_extract(target, '[^/]*$') AS nm FROM plan),
q AS (SELECT *, h || '/' || array_to_string(f[greatest(len(f), 1):], '/') || '/' || nm AS p1, h || '/' || array_to_string(f[greatest(len(f) - 1, 1):], '/') || '/' || nm AS p2, h || '/' || array_to_string(f[greatest(len(f) - 2, 1):], '/') || '/' || nm AS p3 FROM p),
u AS (SELECT target, count(*) AS n, count(DISTINCT p1) AS u1, count(DISTINCT p2) AS u2, count(DISTINCT p3) AS u3 FROM q WHERE clash GROUP BY target)
SELECT sha, CASE WHEN NOT clash THEN q.target WHEN u1 = n THEN p1 WHEN u2 = n THEN p2 WHEN u3 = n THEN p3 ELSE h || '/' || substr(sha, 1, 8) || '_' || nm END AS target, clash AS disambiguated FROM q LEFT JOIN u ON u.target = q.target"""))
def win08(spark: SparkSession, d: str) -> DataFrame:
    return P.disambiguated(plan(spark, d, {})).select("sha", "target", "disambiguated")


@query("win09_latest_run", sql("decisions", "SELECT subject, arg_max(run_id, {'a': decided_at, 'b': sha}) AS run_id FROM decisions WHERE run_id IS NOT NULL GROUP BY subject"))
def win09(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "decisions").where("run_id IS NOT NULL").groupBy("subject").agg(F.max_by("run_id", F.struct("decided_at", "sha")).alias("run_id"))


@query("win10_undo_last", sql("manual", "SELECT sha, kind FROM manual WHERE NOT (decided_by = 'u1' AND sha = (SELECT arg_max(sha, {'a': decided_at, 'b': sha}) FROM manual WHERE decided_by = 'u1'))"))
def win10(spark: SparkSession, d: str) -> DataFrame:
    return P.undo_last(frame(spark, d, "manual"), "u1").select("sha", "kind")


@query("win11_first_relation", sql("relations", "SELECT src, arg_min(tgt, {'a': (type <> 'older_version')::INT, 'b': -confidence, 'c': tgt}) AS tgt FROM relations GROUP BY src"))
def win11(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "relations").groupBy("src").agg(F.min_by("tgt", F.struct((F.col("type") != "older_version").alias("a"), (-F.col("confidence")).alias("b"), F.col("tgt").alias("c"))).alias("tgt"))


#: The operations of the plan, as a table `ops` (sha, target, state).
OPS = """l AS (SELECT target, min(sha) AS has FROM (SELECT replace(lower(target), 'file_', 'name_') AS target, sha FROM applied UNION ALL SELECT target, sha FROM plan WHERE substr(sha, 1, 1) = 'a') y GROUP BY target),
ops AS (SELECT p.sha, p.target, CASE WHEN NOT EXISTS (SELECT 1 FROM files f WHERE f.sha = p.sha AND f.status <> 'error') THEN 'missing_source' WHEN has = p.sha THEN 'present' WHEN has IS NOT NULL THEN 'conflict' ELSE 'new' END AS state FROM plan p LEFT JOIN l ON l.target = p.target WHERE action = 'copy')"""


def plan_operations(spark: SparkSession, d: str, made: dict) -> DataFrame:
    p = plan(spark, d, made)
    listing = frame(spark, d, "applied", made).select(F.replace(F.lower("target"), F.lit("file_"), F.lit("name_")).alias("target"), "sha").union(p.where("substring(sha, 1, 1) = 'a'").select("target", "sha"))
    return P.operations(p, frame(spark, d, "files", made).where("status <> 'error'"), listing)


@query("joi14_operations", sql("files decisions applied", f"WITH {PLAN}, {OPS} SELECT * FROM ops"))
def joi14(spark: SparkSession, d: str) -> DataFrame:
    return plan_operations(spark, d, {})


@query("joi15_plan_conflicts", sql("decisions applied", """WITH p AS (SELECT lower(target) AS key, list(DISTINCT sha) AS want FROM decisions WHERE action = 'copy' GROUP BY 1), a AS (SELECT lower(target) AS key, list(DISTINCT sha) AS has FROM applied GROUP BY 1)
SELECT key, CASE WHEN has IS NOT NULL AND len(list_filter(want, lambda w: NOT list_contains(has, w))) > 0 THEN 'applied' WHEN len(want) > 1 THEN 'plan' END AS kind, len(want) AS contents FROM p LEFT JOIN a USING (key) WHERE len(want) > 1 OR (has IS NOT NULL AND len(list_filter(want, lambda w: NOT list_contains(has, w))) > 0)"""))
def joi15(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return P.conflicts(frame(spark, d, "decisions", made).where("action = 'copy'"), frame(spark, d, "applied", made))


@query("joi16_attach_relations", sql("decisions relations", """WITH b AS (SELECT src AS sha, tgt AS other, type, confidence, 0 AS r FROM relations WHERE type = 'older_version' UNION ALL SELECT src, tgt, type, confidence, 1 FROM relations WHERE type <> 'older_version' UNION ALL SELECT tgt, src, type, confidence, 1 FROM relations WHERE type <> 'older_version'),
f AS (SELECT sha, other, type FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY r, confidence DESC, other, type) AS k FROM b) x WHERE k = 1)
SELECT d.sha, f.other AS related_to, f.type AS relation FROM decisions d LEFT JOIN f ON f.sha = d.sha"""))
def joi16(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    rows = frame(spark, d, "decisions", made).select("sha", F.lit(None).cast("string").alias("related_to"), F.lit(None).cast("string").alias("relation"))
    return S.attach(rows, frame(spark, d, "relations", made))


@query("joi21_scoped_relations", sql("decisions relations", "SELECT src, tgt, type FROM relations WHERE src IN (SELECT sha FROM decisions WHERE subject = 'S1') OR tgt IN (SELECT sha FROM decisions WHERE subject = 'S1')"))
def joi21(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    mine = frame(spark, d, "decisions", made).where("subject = 'S1'").select("sha")
    r = frame(spark, d, "relations", made)
    ends = r.join(mine.withColumnRenamed("sha", "src"), "src", "left_semi").select("src", "tgt", "type").union(r.join(mine.withColumnRenamed("sha", "tgt"), "tgt", "left_semi").select("src", "tgt", "type"))
    return ends.distinct()


@query("joi22_protected_replace", sql("decisions", "WITH s AS (SELECT * FROM decisions WHERE subject = 'S2') SELECT sha, run_id FROM decisions WHERE subject <> 'S2' OR run_id = 'ground_truth' UNION ALL SELECT sha, 'run9' FROM s WHERE run_id IS NULL OR run_id <> 'ground_truth'"))
def joi22(spark: SparkSession, d: str) -> DataFrame:
    t = frame(spark, d, "decisions").select("sha", "subject", "run_id")
    truth = t.where("run_id = 'ground_truth'")
    return P.replace_slice(t, F.col("subject") == "S2", t.where("subject = 'S2'").withColumn("run_id", F.lit("run9")), truth).select("sha", "run_id")


@query("joi23_own_slice_replace", sql("relations content", "SELECT src, tgt, method FROM relations WHERE NOT starts_with(method, 'near_dupe:') UNION ALL SELECT src, tgt, 'near_dupe:new' FROM relations WHERE type = 'related'"))
def joi23(spark: SparkSession, d: str) -> DataFrame:
    r = frame(spark, d, "relations").select("src", "tgt", "type", "method")
    return r.where(~F.col("method").startswith("near_dupe:")).unionByName(r.where("type = 'related'").withColumn("method", F.lit("near_dupe:new"))).select("src", "tgt", "method")


@query("joi26_item_detail", sql("content files relations manual", """SELECT c.sha, (SELECT string_agg(DISTINCT filename, ',' ORDER BY filename) FROM files f WHERE f.sha = c.sha) AS names, (SELECT count(*) FROM files f WHERE f.sha = c.sha) AS copies,
  (SELECT count(*) FROM relations r WHERE r.src = c.sha OR r.tgt = c.sha) AS relations, (SELECT min(kind) FROM manual m WHERE m.sha = c.sha) AS decision FROM content c"""))
def joi26(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    c, f, r, m = (frame(spark, d, n, made) for n in ("content", "files", "relations", "manual"))
    names = f.where("sha IS NOT NULL").groupBy("sha").agg(F.array_join(F.array_sort(F.collect_set("filename")), ",").alias("names"), F.count(F.lit(1)).alias("copies"))
    ends = r.select(F.explode(F.array_distinct(F.array("src", "tgt"))).alias("sha")).groupBy("sha").agg(F.count(F.lit(1)).alias("relations"))
    return c.select("sha").join(names, "sha", "left").join(ends, "sha", "left").join(m.groupBy("sha").agg(F.min("kind").alias("decision")), "sha", "left").na.fill(0, ["copies", "relations"])


@query("joi27_pair_comparison", sql("content relations", "SELECT r.src, r.tgt, CASE WHEN a.kind IN ('text', 'code') AND b.kind IN ('text', 'code') THEN 'text' ELSE 'meta' END AS mode, r.type FROM relations r JOIN content a ON a.sha = r.src JOIN content b ON b.sha = r.tgt"))
def joi27(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    c, r = frame(spark, d, "content", made).select("sha", "kind"), frame(spark, d, "relations", made)
    j = r.join(c.toDF("src", "ka"), "src").join(c.toDF("tgt", "kb"), "tgt")
    return j.select("src", "tgt", F.when(F.col("ka").isin("text", "code") & F.col("kb").isin("text", "code"), "text").otherwise("meta").alias("mode"), "type")


#: The findings of the plan, as a table `found` (level, code, sha, target).
FOUND = """m AS (SELECT *, action IN ('copy', 'media') AS moved FROM plan),
g AS (SELECT lower(target) AS t FROM m WHERE moved GROUP BY 1 HAVING count(DISTINCT sha) > 1), gt AS (SELECT replace(lower(target), '/file_', '/cat/name_') AS t, min(sha) AS s FROM applied GROUP BY 1),
found AS (SELECT 'error' AS level, 'collision' AS code, sha, target FROM m WHERE moved AND lower(target) IN (SELECT t FROM g)
UNION ALL SELECT 'error', 'overwrites_ground_truth', m.sha, m.target FROM m JOIN gt ON gt.t = lower(m.target) WHERE moved AND s <> m.sha
UNION ALL SELECT 'warning', 'low_confidence', sha, target FROM m WHERE confidence < 0.1)"""


def plan_findings(spark: SparkSession, d: str, made: dict) -> DataFrame:
    truth = frame(spark, d, "applied", made).select(F.replace(F.lower("target"), F.lit("/file_"), F.lit("/cat/name_")).alias("target"), "sha")
    return P.findings(plan(spark, d, made), truth)


@query("rul04_plan_findings", sql("files decisions applied", f"WITH {PLAN}, {FOUND} SELECT * FROM found"))
def rul04(spark: SparkSession, d: str) -> DataFrame:
    return plan_findings(spark, d, {})


@query("rul05_gate", sql("files decisions applied", f"WITH {PLAN}, {FOUND}, c AS (SELECT count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warning') AS warnings FROM found) SELECT errors, warnings, errors AS blocking, errors + warnings AS blocking_strict FROM c"))
def rul05(spark: SparkSession, d: str) -> DataFrame:
    return P.blocking(plan_findings(spark, d, {}))


@query("agg36_worst_level", sql("files decisions applied", f"WITH {PLAN}, {FOUND} SELECT subject, CASE WHEN bool_or(level = 'error') THEN 'error' WHEN bool_or(level = 'warning') THEN 'warning' ELSE 'info' END AS level FROM found JOIN decisions USING (sha) GROUP BY subject"))
def agg36(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return P.worst(plan_findings(spark, d, made).join(frame(spark, d, "decisions", made).select("sha", "subject"), "sha"), "subject")

CHANGES = "seen AS (SELECT package || '/' || relpath AS path, min(size + CASE WHEN file_id % 11 = 0 THEN 1 ELSE 0 END) AS size, min(mtime) AS mtime FROM files WHERE file_id % 13 <> 0 GROUP BY 1), known AS (SELECT package || '/' || relpath AS path, min(size) AS size, min(mtime) AS mtime FROM files WHERE file_id % 17 <> 0 GROUP BY 1)"


@query("stm01_scan_changes", sql("files", f"WITH {CHANGES} SELECT coalesce(k.path, s.path) AS path, CASE WHEN k.path IS NULL THEN 'new' WHEN s.path IS NULL THEN 'missing' WHEN k.size = s.size AND k.mtime = s.mtime THEN 'unchanged' ELSE 'changed' END AS change FROM known k FULL JOIN seen s ON s.path = k.path"))
def stm01(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d, "files").withColumn("path", F.concat_ws("/", "package", "relpath"))
    best = lambda x: x.groupBy("path").agg(F.min("size").alias("size"), F.min("mtime").alias("mtime"))
    return P.scan_changes(best(f.where("file_id % 17 <> 0")), best(f.where("file_id % 13 <> 0").withColumn("size", F.col("size") + F.when(F.col("file_id") % 11 == 0, 1).otherwise(0))))


@query("rul07_source_state", sql("files", f"WITH {CHANGES} SELECT CASE WHEN s.path IS NULL THEN 'missing' WHEN k.size <> s.size THEN 'size' WHEN k.mtime <> s.mtime THEN 'mtime' ELSE 'same' END AS state, count(*) AS n FROM known k LEFT JOIN seen s USING (path) GROUP BY 1"))
def rul07(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d, "files").withColumn("path", F.concat_ws("/", "package", "relpath"))
    k = f.where("file_id % 17 <> 0").groupBy("path").agg(F.min("size").alias("s0"), F.min("mtime").alias("m0"))
    s = f.where("file_id % 13 <> 0").withColumn("size", F.col("size") + F.when(F.col("file_id") % 11 == 0, 1).otherwise(0)).groupBy("path").agg(F.min("size").alias("s1"), F.min("mtime").alias("m1"))
    state = F.when(F.col("s1").isNull(), "missing").when(F.col("s0") != F.col("s1"), "size").when(F.col("m0") != F.col("m1"), "mtime").otherwise("same")
    return k.join(s, "path", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("set02_gone_paths", sql("files", f"WITH {CHANGES} SELECT path FROM known EXCEPT SELECT path FROM seen"))
def set02(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d, "files").withColumn("path", F.concat_ws("/", "package", "relpath"))
    return f.where("file_id % 17 <> 0").select("path").distinct().join(f.where("file_id % 13 <> 0").select("path"), "path", "left_anti")


@query("stm02_transitions", sql("files", "WITH o AS (SELECT unnest(['discovered', 'hashed', 'extracted', 'classified', 'planned', 'applied', 'verified']) AS s, unnest(range(7)) AS i) SELECT file_id, CASE WHEN nw = 'error' OR nw = 'discovered' THEN true WHEN status = 'error' THEN false ELSE b.i > a.i END AS allowed FROM (SELECT file_id, status, CASE file_id % 3 WHEN 0 THEN 'planned' WHEN 1 THEN 'error' ELSE 'hashed' END AS nw FROM files) x LEFT JOIN o a ON a.s = status LEFT JOIN o b ON b.s = nw"))
def stm02(spark: SparkSession, d: str) -> DataFrame:
    new = F.when(F.col("file_id") % 3 == 0, "planned").when(F.col("file_id") % 3 == 1, "error").otherwise("hashed")
    return frame(spark, d, "files").select("file_id", P.transition(F.col("status"), new).alias("allowed"))


@query("dml01_upsert", sql("decisions", "SELECT coalesce(d.sha, c.sha) AS sha, CASE WHEN c.sha IS NOT NULL THEN c.category ELSE d.category END AS category, d.action FROM decisions d FULL JOIN (SELECT sha, CASE WHEN id % 4 = 0 THEN NULL ELSE 'new' END AS category FROM decisions WHERE id % 5 = 0 UNION ALL SELECT 'x1', 'added') c ON c.sha = d.sha"))
def dml01(spark: SparkSession, d: str) -> DataFrame:
    t = frame(spark, d, "decisions").select("sha", "category", "action", "id")
    c = t.where("id % 5 = 0").select("sha", F.when(F.col("id") % 4 != 0, "new").alias("category")).union(spark.createDataFrame([("x1", "added")], "sha string, category string"))
    return P.upsert(t.drop("id"), c, ["sha"], ["category"])


@query("dml04_manual_decisions", sql("decisions manual", "SELECT d.sha, CASE WHEN m.sha IS NULL THEN d.method ELSE 'manual' END AS method, CASE WHEN m.sha IS NULL THEN d.confidence ELSE 1.0 END AS confidence FROM decisions d LEFT JOIN (SELECT sha FROM manual WHERE kind <> 'accept' AND sha NOT IN (SELECT sha FROM decisions WHERE run_id = 'ground_truth')) m ON m.sha = d.sha"))
def dml04(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    dec = frame(spark, d, "decisions", made)
    truth = dec.where("run_id = 'ground_truth'").select("sha")
    m = frame(spark, d, "manual", made).where("kind <> 'accept'").join(truth, "sha", "left_anti").select("sha", F.lit("manual").alias("method"), F.lit(1.0).alias("confidence"))
    return P.upsert(dec.select("sha", "method", "confidence"), m.join(dec.select("sha"), "sha", "left_semi"), ["sha"], ["method", "confidence"])


@query("dml05_rename_guard", sql("decisions applied", "SELECT d.sha, EXISTS (SELECT 1 FROM applied a WHERE lower(a.target) = lower(d.target) AND a.sha <> d.sha) AS taken FROM decisions d"))
def dml05(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    dec, app = frame(spark, d, "decisions", made), frame(spark, d, "applied", made)
    a = app.groupBy(F.lower("target").alias("k")).agg(F.min("sha").alias("lo"), F.max("sha").alias("hi"))
    return dec.join(a, F.lower("target") == F.col("k"), "left").select("sha", F.coalesce((F.col("lo") != F.col("sha")) | (F.col("hi") != F.col("sha")), F.lit(False)).alias("taken"))


@query("dml06_merge", sql("decisions relations", "SELECT d.sha, CASE WHEN r.sha IS NULL THEN d.action ELSE 'skip' END AS action FROM decisions d LEFT JOIN (SELECT DISTINCT tgt AS sha FROM relations WHERE type = 'near_duplicate' AND confidence > 0.8) r ON r.sha = d.sha"))
def dml06(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    absorbed = frame(spark, d, "relations", made).where("type = 'near_duplicate' AND confidence > 0.8").select(F.col("tgt").alias("sha")).distinct()
    dec = frame(spark, d, "decisions", made).select("sha", "action")
    return P.upsert(dec, absorbed.join(dec.select("sha"), "sha", "left_semi").withColumn("action", F.lit("skip")), ["sha"], ["action"])


@query("dml07_set10_ordered_pairs", sql("links", "SELECT least(folder_b, folder_a) AS a, greatest(folder_a, folder_b) AS b FROM links"))
def dml07(spark: SparkSession, d: str) -> DataFrame:
    both = S.symmetric(frame(spark, d, "links"), "folder_a", "folder_b")
    return both.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")).distinct()


@query("dml10_duplicate_update", sql("files folders", "SELECT folder, CASE WHEN package = 'src1_copy' AND folder <> package AND EXISTS (SELECT 1 FROM folders g WHERE g.folder = 'src1' || substr(f.folder, 10)) THEN 'src1' || substr(folder, 10) END AS duplicate_of FROM folders f"))
def dml10(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d, "folders").select("folder", "package")
    new = f.where("package = 'src1_copy' AND folder <> package").select("folder", F.concat(F.lit("src1"), F.substring("folder", 10, 1000)).alias("duplicate_of"))
    new = new.join(f.select(F.col("folder").alias("duplicate_of")), "duplicate_of", "left_semi")
    return P.upsert(f.select("folder", F.lit(None).cast("string").alias("duplicate_of")), new.select("folder", "duplicate_of"), ["folder"], ["duplicate_of"])


PLAN_HASH = "(SELECT " + multiset("h") + """ FROM (SELECT sha256('{"action":' || to_json(action)::VARCHAR || ',"sha":' || to_json(sha)::VARCHAR || ',"target":' || to_json(target)::VARCHAR || '}') AS h FROM """


@query("agg13_plan_hash", sql("decisions", f"SELECT {PLAN_HASH} decisions) y) AS plan_hash"))
def agg13(spark: SparkSession, d: str) -> DataFrame:
    return P.plan_hash(frame(spark, d, "decisions"), "sha", "action", "target")

#: Of several decisions for a content the best one, with the number of those that lost.
MERGED = """merged AS (SELECT sha, dropped FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY CASE coalesce(method, 'llm') WHEN 'manual' THEN 0 WHEN 'deterministic' THEN 1 WHEN 'heuristic' THEN 2 WHEN 'llm' THEN 3 ELSE 99 END, ord) AS k, count(*) OVER (PARTITION BY sha) - 1 AS dropped FROM rows) x WHERE k = 1)"""


@query("agg30_build_meta", sql("files decisions relations", f"""WITH {ROWS}, {MERGED}, {PLAN},
c AS (SELECT target FROM plan WHERE action IN ('copy', 'media') GROUP BY target HAVING count(DISTINCT sha) > 1),
related AS (SELECT src AS sha FROM relations UNION SELECT tgt FROM relations WHERE type <> 'older_version')
SELECT count(*) AS items, count(*) FILTER (WHERE action = 'copy') AS n_copy, count(*) FILTER (WHERE action = 'media') AS n_media, count(*) FILTER (WHERE action = 'quarantine') AS n_quarantine, count(*) FILTER (WHERE action = 'skip') AS n_skip,
  count(*) FILTER (WHERE needs_review = 1) AS needs_review, count(*) FILTER (WHERE dropped > 0) AS conflicts, count(*) FILTER (WHERE sha IN (SELECT sha FROM related)) AS with_relation,
  count(*) FILTER (WHERE action IN ('copy', 'media') AND target IN (SELECT target FROM c)) AS disambiguated, {PLAN_HASH} plan) y) AS plan_hash FROM plan JOIN merged USING (sha)"""))
def agg30(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    p = plan(spark, d, made)
    dec = frame(spark, d, "decisions", made)
    rows = dec.select("sha", "method", F.col("id").alias("ord")).union(dec.where("id % 3 = 0").select("sha", F.when(F.col("id") % 2 == 0, "heuristic").otherwise("manual"), F.col("id") + 5000000))
    decided = p.join(P.best_decision(rows, "ord").select("sha", "dropped"), "sha")
    attached = S.attach(p.select("sha", F.lit(None).cast("string").alias("related_to"), F.lit(None).cast("string").alias("relation")), frame(spark, d, "relations", made))
    return P.build_meta(decided, F.col("dropped") > 0, attached, P.disambiguated(p))


@query("agg32_overview", sql("files decisions applied", f"""WITH {PLAN}, {FOUND}, {OPS}, f AS (SELECT target FROM plan WHERE action IN ('copy', 'media') AND coalesce(target, '') <> ''),
n AS (SELECT count(*) AS items, count(*) FILTER (WHERE needs_review = 1) AS needs_review, (SELECT count(*) FROM found WHERE level = 'error') AS errors, (SELECT count(*) FROM found WHERE level = 'warning') AS warnings, (SELECT count(*) FROM f) AS files, (SELECT count(DISTINCT regexp_replace(target, '/?[^/]*$', '')) FROM f) AS folders FROM plan),
o AS (SELECT count(*) FILTER (WHERE state = 'new') AS "new", count(*) FILTER (WHERE state = 'present') AS present, count(*) FILTER (WHERE state = 'conflict') AS conflict, count(*) FILTER (WHERE state = 'missing_source') AS missing_source, count(*) FILTER (WHERE state = 'outside') AS outside FROM ops)
SELECT n.*, o.*, errors AS blocking, errors = 0 AND conflict + missing_source + outside = 0 AS can_apply, CASE WHEN errors > 0 THEN 'findings' WHEN conflict + missing_source + outside > 0 THEN 'operations' ELSE '' END AS reason FROM n, o"""))
def agg32(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return P.overview(plan(spark, d, made), plan_findings(spark, d, made), plan_operations(spark, d, made))


@query("agg34_tree_diff", sql("files decisions", f"WITH {PLAN}, f AS (SELECT target AS path FROM plan WHERE action IN ('copy', 'media') AND target <> '') SELECT 'file' AS part, path FROM f UNION ALL SELECT DISTINCT 'folder', CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END FROM f"))
def agg34(spark: SparkSession, d: str) -> DataFrame:
    return P.tree_diff(plan(spark, d, {}))


@query("agg35_state_counts", sql("decisions applied", """WITH a AS (SELECT lower(target) AS k, min(sha) AS has FROM applied GROUP BY 1),
st AS (SELECT CASE WHEN a.has IS NULL THEN 'missing' WHEN a.has = d.sha THEN 'ok' ELSE 'mismatch' END AS state FROM decisions d LEFT JOIN a ON a.k = lower(d.target) WHERE action = 'copy'
  UNION ALL SELECT 'extra' FROM (SELECT k FROM a EXCEPT SELECT lower(target) FROM decisions WHERE action = 'copy') e)
SELECT s AS state, count(st.state) AS n FROM (SELECT unnest(['ok', 'missing', 'mismatch', 'extra', 'never']) AS s) x LEFT JOIN st ON st.state = s GROUP BY s"""))
def agg35(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.reports import domain_counts
    from millrace.plans.q_sources import rul08

    made: dict = {}
    extra = frame(spark, d, "applied", made).select(F.lower("target")).subtract(frame(spark, d, "decisions", made).where("action = 'copy'").select(F.lower("target"))).select(F.lit("extra").alias("state"))
    return domain_counts(rul08(spark, d).select("state").union(extra), "state", ["ok", "missing", "mismatch", "extra", "never"])


@query("agg37_cluster_strength", sql("relations", """WITH RECURSIVE e AS (SELECT src, tgt FROM relations WHERE type IN ('near_duplicate', 'older_version') UNION SELECT tgt, src FROM relations WHERE type IN ('near_duplicate', 'older_version')),
r AS (SELECT src AS node, src AS c FROM e UNION SELECT e.tgt, r.c FROM r JOIN e ON e.src = r.node), m AS (SELECT node, min(c) AS cluster FROM r GROUP BY node)
SELECT cluster, count(DISTINCT node) AS size, max(confidence) AS strength, bool_or(type = 'older_version') AS has_versions FROM m JOIN (SELECT src AS s, confidence, type FROM relations WHERE type IN ('near_duplicate', 'older_version') UNION ALL SELECT tgt, confidence, type FROM relations WHERE type IN ('near_duplicate', 'older_version')) k ON k.s = m.node GROUP BY cluster"""))
def agg37(spark: SparkSession, d: str) -> DataFrame:
    r = frame(spark, d, "relations").where("type <> 'related'")
    c = S.clusters(r.select("src", "tgt"))
    ends = r.select(F.col("src").alias("node"), "confidence", "type").union(r.select("tgt", "confidence", "type"))
    return c.join(ends, "node").groupBy("cluster").agg(F.count_distinct("node").alias("size"), F.max("confidence").alias("strength"), F.bool_or(F.col("type") == "older_version").alias("has_versions"))


@query("gra01_clusters", sql("relations", """WITH RECURSIVE e AS (SELECT src, tgt FROM relations WHERE type IN ('near_duplicate', 'older_version') UNION SELECT tgt, src FROM relations WHERE type IN ('near_duplicate', 'older_version')),
r AS (SELECT src AS node, src AS c FROM e UNION SELECT e.tgt, r.c FROM r JOIN e ON e.src = r.node) SELECT node, min(c) AS cluster FROM r GROUP BY node"""))
def gra01(spark: SparkSession, d: str) -> DataFrame:
    return S.clusters(frame(spark, d, "relations").where("type <> 'related'").select("src", "tgt"))


@query("fil13_noise_clusters", sql("files relations", "SELECT src, tgt FROM relations WHERE src NOT IN (SELECT sha FROM files WHERE sha IS NOT NULL AND regexp_matches(relpath, '^.*/doc_1[^/]*$')) AND tgt NOT IN (SELECT sha FROM files WHERE sha IS NOT NULL AND regexp_matches(relpath, '^.*/doc_1[^/]*$'))"))
def fil13(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    bad = frame(spark, d, "files", made).where("sha IS NOT NULL").where(noise(F.col("relpath"), ["*/doc_1*"])).select("sha").distinct()
    r = frame(spark, d, "relations", made)
    return r.join(bad.withColumnRenamed("sha", "src"), "src", "left_anti").join(bad.withColumnRenamed("sha", "tgt"), "tgt", "left_anti").select("src", "tgt")


SIG = """sig AS (SELECT sha, 'h' || (id % 40) AS text_hash, sha2x AS simhash, id FROM (SELECT sha, id, substr(md5((id // 3)::VARCHAR), 1, 14) || lpad(to_hex(id % 4), 2, '0') AS sha2x FROM content) x)"""


def signatures(spark: SparkSession, d: str, made: dict) -> DataFrame:
    base = F.substring(F.md5(F.floor(F.col("id") / 3).cast("long").cast("string")), 1, 14)
    return frame(spark, d, "content", made).select("sha", F.concat(F.lit("h"), (F.col("id") % 40).cast("string")).alias("text_hash"), F.concat(base, F.lpad(F.lower(F.hex(F.col("id") % 4)), 2, "0")).alias("simhash"), "id")


@query("joi06_equal_signatures", sql("content", f"WITH {SIG} SELECT a.sha AS \"left\", b.sha AS \"right\" FROM sig a JOIN sig b ON a.text_hash = b.text_hash AND a.sha < b.sha"))
def joi06(spark: SparkSession, d: str) -> DataFrame:
    return S.equal_pairs(signatures(spark, d, {}), "text_hash")


@query("joi07_hamming_pairs", sql("content", f"WITH {SIG} SELECT a.sha AS \"left\", b.sha AS \"right\", bit_count(xor(('0x' || a.simhash)::UBIGINT, ('0x' || b.simhash)::UBIGINT))::INT AS distance FROM sig a JOIN sig b ON a.sha < b.sha WHERE bit_count(xor(('0x' || a.simhash)::UBIGINT, ('0x' || b.simhash)::UBIGINT)) <= 3"))
def joi07(spark: SparkSession, d: str) -> DataFrame:
    return S.distance_pairs(signatures(spark, d, {}), "simhash", 3)[0]


def _near(a: str, b: str) -> str:
    return f"bit_count(xor(('0x' || a.{a})::UBIGINT, ('0x' || b.{b})::UBIGINT))::INT"


_D, _H = _near("simhash", "simhash"), _near("phash", "phash")
_CONF = "round(1 - {} / (2.0 * {}), 4)"
RELATED = f"""WITH {SIG}, fo AS (SELECT sha, list(DISTINCT folder) AS folders, max(length(text)) AS chars FROM files WHERE sha IS NOT NULL GROUP BY sha),
s AS (SELECT sig.sha, text_hash || 'x' || simhash AS text_hash, simhash, CASE WHEN id % 5 = 2 THEN substr(md5((id // 15)::VARCHAR), 1, 15) || to_hex(id % 16) END AS phash, CASE WHEN id % 2 = 0 THEN (2020 + id % 3)::VARCHAR END AS year, folders, chars FROM sig JOIN fo USING (sha)),
p AS (SELECT a.sha AS l, b.sha AS r, a.text_hash = b.text_hash AS eq, {_D} AS d, CASE WHEN a.phash IS NOT NULL AND b.phash IS NOT NULL THEN {_H} END AS h, len(list_intersect(a.folders, b.folders)) > 0 AS shared, a.year AS ly, b.year AS ry, a.chars >= 40 AND b.chars >= 40 AS usable FROM s a JOIN s b ON a.sha < b.sha),
k AS (SELECT *, 0 AS layer, 1.0 AS conf, 'text_hash' AS m FROM p WHERE eq UNION ALL SELECT *, 1, {_CONF.format("d", 4)}, 'simhash' FROM p WHERE d <= 3 UNION ALL SELECT *, 2, round({_CONF.format("d", 9)} * 0.6, 4), 'related' FROM p WHERE d > 3 AND d <= 8 AND shared
  UNION ALL SELECT *, 3, {_CONF.format("h", 9)}, 'phash' FROM p WHERE h <= 8 AND NOT (usable AND d > 12)),
t AS (SELECT *, layer <> 2 AND ly IS NOT NULL AND ry IS NOT NULL AND ly <> ry AS dated, round(least(conf + CASE WHEN shared THEN 0.05 ELSE 0 END, 1.0), 4) AS confidence FROM k),
o AS (SELECT CASE WHEN dated AND ly > ry THEN r ELSE l END AS src, CASE WHEN dated AND ly > ry THEN l ELSE r END AS tgt, CASE WHEN layer = 2 THEN 'related' WHEN dated THEN 'older_version' ELSE 'near_duplicate' END AS type, confidence::DOUBLE AS confidence, 'near_dupe:' || m AS method, layer FROM t)
SELECT src, tgt, type, confidence, method FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt, type ORDER BY confidence DESC, layer) AS n FROM o) x WHERE n = 1"""


@query("joi09_relations", sql("files content", RELATED))
def joi09(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    sig = signatures(spark, d, made)
    image = F.when(F.col("id") % 5 == 2, F.concat(F.substring(F.md5(F.floor(F.col("id") / 15).cast("long").cast("string")), 1, 15), F.lower(F.hex(F.col("id") % 16))))
    folders = frame(spark, d, "files", made).where("sha IS NOT NULL").groupBy("sha").agg(F.collect_set("folder").alias("folders"), F.max(F.length("text")).alias("chars"))
    year = F.when(F.col("id") % 2 == 0, (2020 + F.col("id") % 3).cast("string"))
    return S.relations(sig.join(folders, "sha").select("sha", F.concat("text_hash", F.lit("x"), "simhash").alias("text_hash"), "simhash", image.alias("phash"), year.alias("year"), "folders", "chars"))


@query("joi10_shared_folder", sql("relations files", "SELECT r.src, r.tgt, (SELECT min(a.folder) FROM files a JOIN files b ON a.folder = b.folder WHERE a.sha = r.src AND b.sha = r.tgt) AS shared FROM relations r"))
def joi10(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    f = frame(spark, d, "files", made).where("sha IS NOT NULL").groupBy("sha").agg(F.collect_set("folder").alias("fs"))
    r = frame(spark, d, "relations", made).select("src", "tgt")
    return r.join(f.toDF("src", "a"), "src").join(f.toDF("tgt", "b"), "tgt").select("src", "tgt", F.array_min(F.array_intersect("a", "b")).alias("shared"))


@query("joi13_ground_truth", sql("decisions", "SELECT sha, target FROM decisions WHERE run_id = 'ground_truth' AND coalesce(target, '') <> ''"))
def joi13(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "decisions").where((F.col("run_id") == "ground_truth") & (F.coalesce("target", F.lit("")) != "")).select("sha", "target")


@query("joi24_signature_assembly", sql("files", "SELECT sha, arg_min(extension, {'a': package, 'b': relpath}) AS first_ext, min(substr(mtime, 1, 4)) AS year, count(DISTINCT folder) AS folders FROM files WHERE sha IS NOT NULL GROUP BY sha"))
def joi24(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "files").where("sha IS NOT NULL").groupBy("sha").agg(F.min_by("extension", F.struct("package", "relpath")).alias("first_ext"), F.min(F.substring("mtime", 1, 4)).alias("year"), F.count_distinct("folder").alias("folders"))


#: Files of a curated tree, of which every fifth changed since the last scan, every seventh is new, and every eleventh known one is gone.
SEEN = """seen AS (SELECT 'SEM' || (1 + file_id % 7) || '/S' || (file_id % 5) || '/' || relpath AS path, min(size) AS size, min(mtime) AS mtime, min(sha) AS sha, min(file_id) AS id FROM files WHERE sha IS NOT NULL AND file_id % 11 <> 0 GROUP BY 1),
known AS (SELECT path, upper(sha) AS sha, 'ground_truth:' || (size + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END) || ':' || mtime AS stamp FROM seen WHERE id % 7 <> 0),
r AS (SELECT s.path, CASE WHEN k.stamp = 'ground_truth:' || s.size || ':' || s.mtime THEN k.sha ELSE s.sha END AS sha, coalesce(k.stamp = 'ground_truth:' || s.size || ':' || s.mtime, false) AS reused FROM seen s LEFT JOIN known k USING (path))"""


def ingested(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    made: dict = {}
    f = frame(spark, d, "files", made).where("sha IS NOT NULL AND file_id % 11 <> 0")
    path = F.concat(F.lit("SEM"), (1 + F.col("file_id") % 7).cast("string"), F.lit("/S"), (F.col("file_id") % 5).cast("string"), F.lit("/"), "relpath")
    seen = f.groupBy(path.alias("path")).agg(F.min("size").alias("size"), F.min("mtime").alias("mtime"), F.min("sha").alias("content"), F.min("file_id").alias("id"))
    stamp = F.concat_ws(":", F.lit("ground_truth"), (F.col("size") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).cast("string"), "mtime")
    known = seen.where("id % 7 <> 0").select("path", F.upper("content").alias("sha"), stamp.alias("stamp"))
    gone = spark.createDataFrame([("SEM1/gone/x", "0", "ground_truth:1:x")], known.schema)
    return P.ground_truth(seen, known.union(gone), frame(spark, d, "decisions", made), F.col("content"))


@query("src05_ground_truth_files", sql("files", f"WITH {SEEN} SELECT path, sha, reused FROM r"))
def src05_files(spark: SparkSession, d: str) -> DataFrame:
    return ingested(spark, d)[0].select("path", "sha", "reused")


@query("src05_ground_truth_ingest", sql("files decisions", f"""WITH {SEEN}, c AS (SELECT sha, min(string_split(path, '/')) AS p FROM r GROUP BY sha)
SELECT sha, array_to_string(p, '/') AS path, substr(p[1], 4)::INT AS semester, p[2] AS subject, array_to_string(p[3:], '/') AS rest FROM c WHERE sha NOT IN (SELECT sha FROM decisions WHERE method = 'manual' AND coalesce(run_id, '') <> 'ground_truth')"""))
def src05(spark: SparkSession, d: str) -> DataFrame:
    return ingested(spark, d)[1]

@query("set01_extras", sql("decisions applied", "SELECT lower(target) AS k FROM applied EXCEPT SELECT lower(target) FROM decisions WHERE action = 'copy'"))
def set01(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return frame(spark, d, "applied", made).select(F.lower("target").alias("k")).subtract(frame(spark, d, "decisions", made).where("action = 'copy'").select(F.lower("target")))


@query("set05_target_taken", sql("decisions applied", "WITH e AS (SELECT lower(target) AS k, min(target) AS lo, max(target) AS hi FROM (SELECT target FROM applied UNION ALL SELECT target FROM decisions) x GROUP BY 1) SELECT w AS target, coalesce(lo <> w OR hi <> w, false) AS taken FROM (SELECT DISTINCT upper(target) AS w FROM decisions UNION SELECT target FROM applied UNION SELECT 'free/' || target FROM applied) d LEFT JOIN e ON e.k = lower(w)"))
def set05(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    dec, app = frame(spark, d, "decisions", made).select("target"), frame(spark, d, "applied", made).select("target")
    wanted = dec.select(F.upper("target").alias("target")).union(app).union(app.select(F.concat(F.lit("free/"), "target")))
    return P.taken(wanted, app, dec)

@query("set03_unambiguous_labels", sql("decisions", "SELECT semester, subject FROM (SELECT DISTINCT semester, subject FROM decisions WHERE category = 'laby') x WHERE subject NOT IN (SELECT subject FROM decisions y WHERE y.semester <> x.semester AND y.category = 'kolokwia' AND y.outdated AND y.confidence > 0.9)"))
def set03(spark: SparkSession, d: str) -> DataFrame:
    dec = frame(spark, d, "decisions")
    mine = dec.where("category = 'laby'").select("semester", "subject").distinct()
    other = dec.where("category = 'kolokwia' AND outdated AND confidence > 0.9").groupBy(F.col("subject").alias("s")).agg(F.min("semester").alias("lo"), F.max("semester").alias("hi"))
    return mine.join(other, (F.col("subject") == F.col("s")) & ((F.col("lo") != F.col("semester")) | (F.col("hi") != F.col("semester"))), "left_anti")


@query("top03_decision_history", sql("manual", "SELECT sha, decided_at FROM manual WHERE decided_by = 'u2' ORDER BY decided_at DESC, sha LIMIT 15 OFFSET 5"))
def top03(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "manual").where("decided_by = 'u2'").orderBy(F.desc("decided_at"), "sha").offset(5).limit(15).select("sha", "decided_at")


@query("top06_first_copies", sql("files", "SELECT sha, file_id, total FROM (SELECT sha, file_id, row_number() OVER (PARTITION BY sha ORDER BY file_id) AS k, count(*) OVER (PARTITION BY sha) AS total FROM files WHERE sha IS NOT NULL) x WHERE k <= 2 AND total > 1"))
def top06(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d, "files").where("sha IS NOT NULL")
    k = f.withColumn("k", F.row_number().over(Window.partitionBy("sha").orderBy("file_id"))).where("k <= 2")
    return k.join(f.groupBy("sha").agg(F.count(F.lit(1)).alias("total")).where("total > 1"), "sha").select("sha", "file_id", "total")


@query("top09_review_lists", sql("decisions", "SELECT sha, confidence, target FROM decisions WHERE needs_review = 1 ORDER BY confidence NULLS FIRST, target, sha LIMIT 30"))
def top09(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "decisions").where("needs_review = 1").orderBy(F.col("confidence").asc_nulls_first(), "target", "sha").limit(30).select("sha", "confidence", "target")
