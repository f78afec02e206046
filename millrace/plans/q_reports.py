"""Queries over folders, duplicates and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import reports as R
from millrace.operators import tree
from millrace.plans.fixtures import frame, sql
from millrace.plans.q_items import CLEAN, CLEAN_HASHES, HASHES, clean, dups, multiset
from millrace.plans.registry import query

PER = "per AS (SELECT sha, min(size) AS size, count(*) AS copies, min(package || '/' || relpath) AS first_path, min(size) <> max(size) AS mixed FROM files WHERE sha IS NOT NULL GROUP BY sha)"


@query("agg01_per_content", sql("files", f"WITH {PER} SELECT * FROM per"))
def agg01(spark: SparkSession, d: str) -> DataFrame:
    return R.per_content(frame(spark, d, "files"))


@query("agg02_dedup_summary", sql("files", """WITH g AS (SELECT sha, min(size) AS s, count(*) AS n FROM files WHERE sha IS NOT NULL AND status <> 'error' GROUP BY sha)
SELECT (SELECT count(*) FROM files WHERE status = 'error') AS error, (SELECT count(*) FROM files WHERE status <> 'error' AND sha IS NOT NULL) AS hashed, (SELECT count(*) FROM files WHERE status <> 'error' AND sha IS NULL) AS pending,
  count(*) AS "unique", sum(s)::BIGINT AS unique_bytes, sum(n - 1)::BIGINT AS dup_copies, sum((n - 1) * s)::BIGINT AS dup_bytes, round(100.0 * sum((n - 1) * s) / sum(n * s), 4) AS dup_percent FROM g"""))
def agg02(spark: SparkSession, d: str) -> DataFrame:
    return R.dedup_summary(frame(spark, d, "files"))


@query("agg03_exclusivity", sql("files", """WITH p AS (SELECT sha, package, count(*) AS n, min(size) AS size FROM files WHERE sha IS NOT NULL GROUP BY ALL), k AS (SELECT sha, count(*) AS c FROM p GROUP BY sha)
SELECT package, count(*) FILTER (WHERE c = 1) AS exclusive, count(*) FILTER (WHERE c > 1) AS shared, sum(n - 1)::BIGINT AS copies, sum(size)::BIGINT AS bytes FROM p JOIN k USING (sha) GROUP BY package"""))
def agg03(spark: SparkSession, d: str) -> DataFrame:
    return R.exclusivity(frame(spark, d, "files"))


@query("agg04_duplicate_folders", sql("files", f"WITH {CLEAN_HASHES}, top AS (SELECT * FROM dups d WHERE NOT EXISTS (SELECT 1 FROM dups u WHERE starts_with(d.folder, u.folder || '/'))) SELECT count(*) AS folders, count(DISTINCT duplicate_of) AS canonical, (SELECT sum(files)::BIGINT FROM hashes JOIN top USING (folder)) AS files FROM top"))
def agg04(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    h = tree.folder_hashes(clean(spark, d, made), frame(spark, d, "folders", made))
    top = tree.topmost(tree.duplicates(h))
    return top.join(h.select("folder", "files"), "folder").agg(F.count(F.lit(1)).alias("folders"), F.count_distinct("duplicate_of").alias("canonical"), F.sum("files").alias("files"))


@query("agg05_kind_totals", sql("files content", f"WITH {PER} SELECT coalesce(kind, 'other') AS kind, count(*) AS \"unique\", sum(size)::BIGINT AS bytes, sum(copies)::BIGINT AS copies FROM per LEFT JOIN content USING (sha) GROUP BY 1"))
def agg05(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return R.kind_totals(frame(spark, d, "files", made), frame(spark, d, "content", made))


@query("agg06_07_11_folder_hashes", sql("files folders", f"WITH {HASHES} SELECT folder, coalesce(state, 'empty') AS state, coalesce(files, 0) AS files, tree_hash, set_hash FROM (SELECT folder FROM folders) x LEFT JOIN hashes USING (folder)"))
def agg06(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return tree.folder_hashes(frame(spark, d, "files", made), frame(spark, d, "folders", made))


@query("agg08_subtree_rollup", sql("files folders", f"WITH {HASHES.split('rolled AS')[0].rstrip().rstrip(',')} SELECT folder, count(path) AS files, coalesce(sum(size), 0)::BIGINT AS bytes, max(mtime) AS last FROM (SELECT folder FROM folders) x LEFT JOIN up ON anc = folder GROUP BY folder"))
def agg08(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return tree.subtree(frame(spark, d, "files", made), frame(spark, d, "folders", made))


@query("agg09_inventory", sql("files content folders", f"""WITH {CLEAN_HASHES}
SELECT f.file_id, c.kind, n.copies, (SELECT arg_max(duplicate_of, length(d.folder)) FROM dups d WHERE f.folder = d.folder OR starts_with(f.folder, d.folder || '/')) AS duplicate_of
FROM files f LEFT JOIN content c ON c.sha = f.sha LEFT JOIN (SELECT sha, count(*) AS copies FROM files WHERE sha IS NOT NULL GROUP BY sha) n ON n.sha = f.sha"""))
def agg09(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return tree.inventory(frame(spark, d, "files", made), frame(spark, d, "content", made), dups(spark, d, made)).select("file_id", "kind", "copies", "duplicate_of")


@query("agg10_structural_signature", sql("files", f"WITH {HASHES.split('rolled AS')[0].rstrip().rstrip(',')} SELECT anc AS folder, {multiset('l')} AS signature FROM (SELECT *, sha256(substr(path, length(anc) + 2) || chr(0) || size || chr(0) || mtime) AS l FROM up) x GROUP BY anc"))
def agg10(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return tree.structural(frame(spark, d, "files", made), frame(spark, d, "folders", made))


SETS = "sets AS (SELECT DISTINCT anc AS folder, sha FROM up WHERE sha IS NOT NULL), sizes AS (SELECT folder, count(*) AS n FROM sets GROUP BY folder HAVING count(*) >= 2)"


@query("joi08_common_counts", sql("files", f"WITH {HASHES.split('rolled AS')[0].rstrip().rstrip(',')}, {SETS}, s AS (SELECT folder, sha FROM sets JOIN sizes USING (folder)) SELECT x.folder AS a, y.folder AS b, count(*) AS common FROM s x JOIN s y ON x.sha = y.sha AND x.folder < y.folder GROUP BY ALL"))
def joi08(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    sets = tree.up(frame(spark, d, "files", made).where("sha IS NOT NULL"), frame(spark, d, "folders", made), "sha").select("folder", "sha").distinct()
    sizes = sets.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("folder")
    pairs, _ = tree.common_counts(sets.join(sizes, "folder"))
    return pairs


@query("agg12_folder_overlap", sql("files folders", f"""WITH {CLEAN_HASHES}, {SETS},
s AS (SELECT folder, sha FROM sets JOIN sizes USING (folder)),
pairs AS (SELECT x.folder AS a, y.folder AS b, count(*) AS common FROM s x JOIN s y ON x.sha = y.sha AND x.folder < y.folder GROUP BY ALL),
met AS (SELECT a, b, common, round(common / least(p.n, q.n), 4) AS ratio, round(common / (p.n + q.n - common), 4) AS jaccard FROM pairs JOIN sizes p ON p.folder = a JOIN sizes q ON q.folder = b
  WHERE NOT starts_with(b, a || '/') AND NOT starts_with(a, b || '/') AND common / least(p.n, q.n) >= 0.5)
SELECT a, b, common, ratio, jaccard FROM met m
WHERE NOT EXISTS (SELECT 1 FROM met n WHERE n.common = m.common AND ((starts_with(n.a, m.a || '/') AND n.b = m.b) OR (starts_with(n.b, m.b || '/') AND n.a = m.a) OR (starts_with(n.a, m.b || '/') AND n.b = m.a) OR (starts_with(n.b, m.a || '/') AND n.a = m.b)))
  AND a NOT IN (SELECT folder FROM dups) AND b NOT IN (SELECT folder FROM dups)""".replace("(SELECT *, unnest(range(1, len(string_split(folder, '/')) + 1)) AS k FROM clean)", "(SELECT *, unnest(range(1, len(string_split(folder, '/')) + 1)) AS k FROM clean)")))
def agg12(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return tree.overlap(clean(spark, d, made), frame(spark, d, "folders", made), dups(spark, d, made))


@query("win02_duplicate_folders", sql("files", f"WITH {CLEAN_HASHES} SELECT folder, duplicate_of FROM dups"))
def win02(spark: SparkSession, d: str) -> DataFrame:
    return dups(spark, d, {})


@query("joi03_duplicate_chain", sql("files", f"WITH {CLEAN_HASHES} SELECT d.folder, d.duplicate_of FROM dups d JOIN dups t ON t.folder = d.duplicate_of"))
def joi03(spark: SparkSession, d: str) -> DataFrame:
    return tree.chains(dups(spark, d, {}))


@query("gra06_canonical_not_under_duplicate", sql("files", f"WITH {CLEAN_HASHES} SELECT DISTINCT d.folder, d.duplicate_of FROM dups d JOIN dups u ON d.duplicate_of = u.folder OR starts_with(d.duplicate_of, u.folder || '/')"))
def gra06(spark: SparkSession, d: str) -> DataFrame:
    return tree.canonical_broken(dups(spark, d, {}))


@query("agg14_subject_status", sql("decisions", """SELECT semester, subject, count(*) FILTER (WHERE run_id = 'ground_truth') AS ground_truth, count(*) FILTER (WHERE run_id IS NULL OR run_id <> 'ground_truth') AS planned,
  count(*) FILTER (WHERE (run_id IS NULL OR run_id <> 'ground_truth') AND needs_review = 1) AS needs_review, count(*) FILTER (WHERE (run_id IS NULL OR run_id <> 'ground_truth') AND action = 'copy') AS copy,
  max(decided_at) AS latest, arg_max(coalesce(run_id, '-'), {'a': decided_at, 'b': sha}) AS latest_run FROM decisions GROUP BY ALL"""))
def agg14(spark: SparkSession, d: str) -> DataFrame:
    return R.subject_status(frame(spark, d, "decisions").withColumn("run_id", F.coalesce("run_id", F.lit("-")))).select("semester", "subject", "ground_truth", "planned", "needs_review", "copy", "latest", "latest_run")


@query("agg15_16_dashboard", sql("decisions", """WITH cat AS (SELECT semester, 'S' || n AS subject FROM range(1, 9) t(semester), range(0, 6) u(n)),
s AS (SELECT semester, subject, count(*) FILTER (WHERE run_id = 'ground_truth') AS g, count(*) FILTER (WHERE run_id IS NULL OR run_id <> 'ground_truth') AS p, count(*) FILTER (WHERE (run_id IS NULL OR run_id <> 'ground_truth') AND needs_review = 1) AS r FROM decisions GROUP BY ALL)
SELECT semester, subject, CASE WHEN p > 0 AND r = 0 THEN 'plan gotowy' WHEN p > 0 THEN 'plan do przeglądu' WHEN g > 0 THEN 'tylko ground truth' ELSE 'nietknięty' END AS stage FROM cat LEFT JOIN s USING (semester, subject)"""))
def agg16(spark: SparkSession, d: str) -> DataFrame:
    cat = spark.range(1, 9).select(F.col("id").alias("semester"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda n: F.concat(F.lit("S"), n.cast("string")))).alias("subject"))
    return R.dashboard(cat, frame(spark, d, "decisions")).select("semester", "subject", "stage")


@query("agg17_subject_detail", sql("decisions", "SELECT semester, subject, coalesce(category, '—') AS category, count(*) AS n, count(*) FILTER (WHERE needs_review = 1) AS needs_review, min(confidence) AS lowest, count(*) FILTER (WHERE outdated) AS outdated FROM decisions WHERE run_id <> 'ground_truth' GROUP BY ALL"))
def agg17(spark: SparkSession, d: str) -> DataFrame:
    return R.subject_detail(frame(spark, d, "decisions"))


@query("agg18_live_statistics", sql("decisions", "SELECT 'method' AS dimension, coalesce(method, '—') AS value, count(*) AS n FROM decisions GROUP BY ALL UNION ALL SELECT 'category', coalesce(category, '—'), count(*) FROM decisions GROUP BY ALL UNION ALL SELECT 'action', action, count(*) FROM decisions GROUP BY ALL"))
def agg18(spark: SparkSession, d: str) -> DataFrame:
    return R.histogram(frame(spark, d, "decisions"), {c: F.col(c) for c in ("method", "category", "action")})


STATES = ["discovered", "hashed", "extracted", "classified", "planned", "applied", "verified", "error", "cancelled"]


@query("agg19_status_counts", sql("files", f"SELECT s AS status, count(f.status) AS n FROM (SELECT unnest({STATES}) AS s) x LEFT JOIN files f ON f.status = s GROUP BY s"))
def agg19(spark: SparkSession, d: str) -> DataFrame:
    return R.domain_counts(frame(spark, d, "files"), "status", STATES)


@query("agg20_same_day", sql("files", """WITH g AS (SELECT folder, substr(mtime, 1, 10) AS day, list_sort(list(DISTINCT sha)) AS shas FROM files WHERE sha IS NOT NULL GROUP BY ALL), n AS (SELECT folder FROM g GROUP BY folder HAVING count(*) > 1)
SELECT folder, day, len(shas) AS size, array_to_string(shas, ',') AS shas FROM g JOIN n USING (folder) WHERE len(shas) > 1 AND len(shas) <= 20"""))
def agg20(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return tree.same_day(frame(spark, d, "files", made), frame(spark, d, "decisions", made)).select("folder", "day", F.col("size").cast("long").alias("size"), F.array_join("shas", ",").alias("shas"))


@query("agg21_download_tree", sql("files", "SELECT folder, count(*) AS total, count(*) FILTER (WHERE status IN ('verified', 'applied')) AS ok, count(*) FILTER (WHERE status = 'error') AS failed, count(*) FILTER (WHERE status = 'discovered') AS pending, count(*) FILTER (WHERE status IN ('extracted', 'classified')) AS running FROM files GROUP BY folder"))
def agg21(spark: SparkSession, d: str) -> DataFrame:
    return R.download_tree(frame(spark, d, "files"))


@query("agg22_done_bytes", sql("files", "SELECT status, count(*) AS n, sum(CASE WHEN status IN ('verified', 'applied') THEN size ELSE 0 END)::BIGINT AS done_bytes FROM files GROUP BY status"))
def agg22(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "files").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("status").isin("verified", "applied"), F.col("size")).otherwise(0)).alias("done_bytes"))


@query("agg23_coverage_matrix", sql("decisions", "SELECT subject, coalesce(category, '—') AS category, count(*) AS count, count(*) FILTER (WHERE action IN ('copy', 'media')) AS planned, count(*) FILTER (WHERE needs_review = 1) AS needs_human FROM decisions GROUP BY ALL"))
def agg23(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "decisions").select("subject", F.coalesce("category", F.lit("—")).alias("category"), F.col("action").isin("copy", "media").alias("planned"), (F.col("needs_review") == 1).alias("needs_human"))
    return R.coverage(rows)


@query("agg25_heat_map", """WITH days AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), s AS (SELECT DATE '2024-01-27' - INTERVAL 181 DAY AS b), st AS (SELECT (b - INTERVAL (dayofweek(b)) DAY)::DATE AS s FROM s),
c AS (SELECT unnest(generate_series(s, DATE '2024-01-27', INTERVAL 1 DAY))::DATE AS day, s FROM st), j AS (SELECT c.day, s, coalesce(n, 0) AS n FROM c LEFT JOIN days USING (day))
SELECT strftime(day, '%Y-%m-%d') AS day, ((day - s) // 7)::INT AS week, dayofweek(day)::INT AS weekday, n, round(n / (SELECT max(n) FROM j), 4) AS level FROM j""")
def agg25(spark: SparkSession, d: str) -> DataFrame:
    days = frame(spark, d, "events").select(F.col("ts").cast("date").alias("day"))
    return R.heat_map(days, "2024-01-27").withColumn("day", F.col("day").cast("string"))


@query("agg26_longest_streak", "WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events), g AS (SELECT day - (row_number() OVER (ORDER BY day))::INT AS k FROM d) SELECT coalesce(max(n), 0) AS streak FROM (SELECT count(*) AS n FROM g GROUP BY k) x")
def agg26(spark: SparkSession, d: str) -> DataFrame:
    return R.longest_streak(frame(spark, d, "events").select(F.col("ts").cast("date").alias("day")))


@query("agg33_target_tree", sql("decisions applied", "WITH t AS (SELECT lower(target) AS k, 'plan' AS state, 0 AS r FROM decisions WHERE action = 'copy' UNION ALL SELECT lower(target), 'ground_truth', 1 FROM applied), u AS (SELECT k, arg_min(state, r) AS state FROM t GROUP BY k) SELECT regexp_replace(k, '/[^/]*$', '') AS parent, state, count(*) AS n FROM u GROUP BY ALL"))
def agg33(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    t = frame(spark, d, "decisions", made).where("action = 'copy'").select(F.lower("target").alias("k"), F.lit("plan").alias("state"), F.lit(0).alias("r"))
    t = t.union(frame(spark, d, "applied", made).select(F.lower("target"), F.lit("ground_truth"), F.lit(1)))
    return t.groupBy("k").agg(F.min_by("state", "r").alias("state")).groupBy(T.parent(F.col("k")).alias("parent"), "state").agg(F.count(F.lit(1)).alias("n"))


@query("agg38_kind_drift", sql("files content", "WITH f AS (SELECT sha, arg_min(CASE lower(extension) WHEN '.txt' THEN 'text' WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.png' THEN 'image' WHEN '.py' THEN 'code' WHEN '.zip' THEN 'archive' WHEN '.mp4' THEN 'media' ELSE 'other' END, file_id) AS becomes FROM files WHERE sha IS NOT NULL GROUP BY sha) SELECT kind AS was, becomes, count(*) AS n FROM content JOIN f USING (sha) WHERE kind <> becomes GROUP BY ALL"))
def agg38(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return R.kind_drift(frame(spark, d, "files", made), frame(spark, d, "content", made), T.kind_of(F.col("extension")))


@query("agg39_ledger_totals", sql("files", "SELECT count(*) AS discovered, count(*) FILTER (WHERE status <> 'discovered') AS traversed, count(*) FILTER (WHERE status IN ('applied', 'verified')) AS ok, count(*) FILTER (WHERE status = 'error') AS failed, count(*) FILTER (WHERE status IN ('applied', 'verified', 'error')) AS handled FROM files"))
def agg39(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    one = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return frame(spark, d, "files").agg(F.count(F.lit(1)).alias("discovered"), one(s != "discovered", "traversed"), one(s.isin("applied", "verified"), "ok"), one(s == "error", "failed"), one(s.isin("applied", "verified", "error"), "handled"))


@query("top02_top_waste", sql("files", f"WITH {PER} SELECT sha, copies, size * (copies - 1) AS wasted FROM per WHERE copies > 1 ORDER BY wasted DESC, sha LIMIT 20"))
def top02(spark: SparkSession, d: str) -> DataFrame:
    return R.top_waste(frame(spark, d, "files"))


@query("joi04_rul06_integrity", sql("files content folders applied", f"""WITH {CLEAN_HASHES}
SELECT 'file_without_content' AS "check", count(*) AS n FROM files WHERE sha IS NOT NULL AND sha NOT IN (SELECT sha FROM content) UNION ALL SELECT 'content_without_file', count(*) FROM content WHERE sha NOT IN (SELECT sha FROM files WHERE sha IS NOT NULL) AND sha NOT IN (SELECT sha FROM applied)
UNION ALL SELECT 'file_without_folder', count(*) FROM files WHERE folder NOT IN (SELECT folder FROM folders) UNION ALL SELECT 'duplicate_of_duplicate', count(*) FROM dups d WHERE EXISTS (SELECT 1 FROM dups t WHERE t.folder = d.duplicate_of)
UNION ALL SELECT 'negative_size', count(*) FROM files WHERE size < 0 UNION ALL SELECT 'unknown_status', 0 UNION ALL SELECT 'hashed_without_hash', count(*) FROM files WHERE status = 'hashed' AND sha IS NULL"""))
def joi04(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.planning import integrity

    made: dict = {}
    f, c, o, a = (frame(spark, d, n, made) for n in ("files", "content", "folders", "applied"))
    return integrity(f, c, o, dups(spark, d, made), a)


@query("joi05_prefix_anti_join", sql("files links", "SELECT file_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM (SELECT folder_a AS p FROM links WHERE contains(folder_a, '/en/')) d WHERE f.folder = p OR starts_with(f.folder, p || '/'))"))
def joi05(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.items import under_any

    made: dict = {}
    roots = frame(spark, d, "links", made).where(F.col("folder_a").contains("/en/")).select(F.col("folder_a").alias("p"))
    return under_any(frame(spark, d, "files", made), "folder", roots, "p", keep=False).select("file_id")


@query("joi19_link_partners", sql("links", "SELECT folder_a AS node, folder_b AS partner FROM links UNION SELECT folder_b, folder_a FROM links"))
def joi19(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.similarity import symmetric

    return symmetric(frame(spark, d, "links"), "folder_a", "folder_b")


@query("joi20_prefix_semi_join", sql("files folders", "SELECT folder FROM folders d WHERE EXISTS (SELECT 1 FROM files f WHERE f.status = 'error' AND (f.folder = d.folder OR starts_with(f.folder, d.folder || '/')))"))
def joi20(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    above = frame(spark, d, "files", made).where("status = 'error'").select(F.explode(T.ancestors(F.col("folder"))).alias("folder")).distinct()
    return frame(spark, d, "folders", made).join(above, "folder", "left_semi").select("folder")
