"""Queries over items: filters, projections, listings, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.parse import prompt, resource
from millrace.operators import items as I
from millrace.operators import tree
from millrace.plans.fixtures import frame, sql
from millrace.plans.registry import query

ITEMS = """items AS (
  SELECT c.sha, c.kind, d.semester, d.subject, d.category, d.action, d.confidence, d.needs_review, d.run_id, f.file_id, f.filename, f.relpath, f.status, f.size, coalesce(n.copies, 0) AS copies
  FROM content c LEFT JOIN decisions d ON d.sha = c.sha
  LEFT JOIN files f ON f.sha = c.sha AND f.file_id = (SELECT min(g.file_id) FROM files g WHERE g.sha = c.sha)
  LEFT JOIN (SELECT sha, count(*) AS copies FROM files WHERE sha IS NOT NULL GROUP BY sha) n ON n.sha = c.sha)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return I.items(*[frame(spark, d, n, made) for n in ("content", "decisions", "files")])


@query("fil01_item_filter", sql("content decisions files", f"WITH {ITEMS} SELECT sha, semester, subject, confidence FROM items WHERE semester = 3 AND action = 'copy' AND coalesce(needs_review, 0) = 0 AND confidence >= 0.2 AND confidence <= 0.8 AND (run_id IS NULL OR run_id <> 'ground_truth')"))
def fil01(spark: SparkSession, d: str) -> DataFrame:
    return I.item_filter(_items(spark, d), semester=3, action="copy", needs_review=False, confidence=(0.2, 0.8), ground_truth=False).select("sha", "semester", "subject", "confidence")


@query("fil02_canonical_items", sql("content decisions files", f"WITH {ITEMS} SELECT sha, kind, semester, file_id, filename, copies FROM items"))
def fil02(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("sha", "kind", "semester", "file_id", "filename", "copies")


@query("fil03_confidence_bucket", sql("decisions", "SELECT sha, CASE WHEN confidence IS NULL THEN 'brak' WHEN confidence >= 0.9 THEN 'auto' WHEN confidence >= 0.7 THEN 'review' ELSE 'unresolved' END AS bucket FROM decisions"))
def fil03(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "decisions").select("sha", I.confidence_bucket(F.col("confidence")).alias("bucket"))


@query("fil04_search", sql("content decisions files", f"WITH {ITEMS} SELECT sha, filename FROM items WHERE filename ILIKE '%oc_1%' OR relpath ILIKE '%oc_1%' OR category ILIKE '%oc_1%' OR sha ILIKE '%oc_1%' ORDER BY sha LIMIT 50"))
def fil04(spark: SparkSession, d: str) -> DataFrame:
    return I.search(_items(spark, d), "oc_1").select("sha", "filename")


@query("fil05_items_by_folder", sql("files", "SELECT sha, file_id, folder FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY folder, relpath, file_id) AS n FROM files WHERE sha IS NOT NULL AND (folder = 'src1/en/0' OR starts_with(relpath, 'src1/en/0/') OR folder = 'src1_copy/en/0')) x WHERE n = 1"))
def fil05(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    links = frame(spark, d, "links", made)
    from millrace.operators.similarity import symmetric

    partners = symmetric(links, "folder_a", "folder_b").where("node = 'src1/en/0'").select(F.col("partner").alias("folder"))
    return I.by_folder(frame(spark, d, "files", made), "src1/en/0", partners).select("sha", "file_id", "folder")


@query("fil06_folder_listing", sql("folders links", """WITH both AS (SELECT folder_a AS f, folder_b AS p FROM links UNION SELECT folder_b, folder_a FROM links)
SELECT folder, own_files, array_to_string(list_sort(list(p) FILTER (WHERE p IS NOT NULL)), ',') AS linked FROM (SELECT * FROM folders WHERE folder ILIKE '%en%' AND package IN ('src1', 'src1_copy') ORDER BY folder LIMIT 20 OFFSET 1) x LEFT JOIN both ON f = folder GROUP BY folder, own_files""".replace("both", "pairs")))
def fil06(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.similarity import symmetric

    made: dict = {}
    rows = frame(spark, d, "folders", made).where(F.col("folder").ilike("%en%") & F.col("package").isin("src1", "src1_copy")).orderBy("folder").offset(1).limit(20)
    pairs = symmetric(frame(spark, d, "links", made), "folder_a", "folder_b")
    got = rows.join(pairs, F.col("folder") == F.col("node"), "left").groupBy("folder", "own_files").agg(F.array_sort(F.collect_set("partner")).alias("l"))
    return got.select("folder", "own_files", F.when(F.size("l") > 0, F.array_join("l", ",")).alias("linked"))


def multiset(line: str) -> str:
    """The hash of a multiset of lines, given as their sha256: their number and nine sums."""
    return "sha256(concat_ws(',', count(" + line + "), " + ", ".join(f"sum(('0x' || substr({line}, {1 + 7 * i}, 7))::BIGINT)" for i in range(9)) + "))"


HASHES = """up AS (
  SELECT array_to_string(list_slice(string_split(folder, '/'), 1, k), '/') AS anc, package || '/' || relpath AS path, sha, size, mtime, status
  FROM (SELECT *, unnest(range(1, len(string_split(folder, '/')) + 1)) AS k FROM files) x),
rolled AS (
  SELECT anc AS folder, count(*) AS files, bool_or(status = 'error') AS bad, bool_or(sha IS NULL) AS open,
    TREE AS t, SET AS s FROM (SELECT *, sha256(substr(path, length(anc) + 2) || chr(0) || sha) AS lt, sha256(sha) AS ls FROM up) z GROUP BY anc),
hashes AS (
  SELECT folder, CASE WHEN bad THEN 'error' WHEN open THEN 'incomplete' ELSE 'hashed' END AS state, files, CASE WHEN NOT bad AND NOT open THEN t END AS tree_hash, CASE WHEN NOT bad AND NOT open THEN s END AS set_hash FROM rolled),
canon AS (SELECT tree_hash, min(string_split(folder, '/')) AS k FROM hashes WHERE tree_hash IS NOT NULL GROUP BY tree_hash HAVING count(*) > 1),
dups AS (SELECT folder, array_to_string(k, '/') AS duplicate_of FROM hashes JOIN canon USING (tree_hash) WHERE folder <> array_to_string(k, '/'))""".replace("TREE AS", multiset("lt") + " AS").replace("SET AS", multiset("ls") + " AS")
#: Files without the fixture's errors, so that whole subtrees can be equal.
CLEAN = "clean AS (SELECT * FROM files WHERE status <> 'error' AND sha IS NOT NULL)"
CLEAN_HASHES = CLEAN + ",\n" + HASHES.replace("FROM files)", "FROM clean)")


def clean(spark: SparkSession, d: str, made: dict) -> DataFrame:
    return frame(spark, d, "files", made).where("status <> 'error' AND sha IS NOT NULL")


def dups(spark: SparkSession, d: str, made: dict) -> DataFrame:
    return tree.duplicates(tree.folder_hashes(clean(spark, d, made), frame(spark, d, "folders", made)))


@query("fil07_stage_pending", sql("files folders", f"WITH {CLEAN_HASHES} SELECT file_id, folder FROM files f WHERE status = 'hashed' AND NOT EXISTS (SELECT 1 FROM dups d WHERE f.folder = d.folder OR starts_with(f.folder, d.folder || '/'))"))
def fil07(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return I.pending(frame(spark, d, "files", made), "extracted", dups(spark, d, made)).select("file_id", "folder")


IGNORE = [".xyz", ".tmp"]


@query("fil08_build_artifact", sql("files", "SELECT file_id, ends_with(lower(filename), '.xyz') OR ends_with(lower(filename), '.tmp') OR list_contains(string_split(lower(folder), '/'), '3') AS ignored FROM files"))
def fil08(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "files").select("file_id", I.artifact(F.concat_ws("/", "package", "relpath"), IGNORE, ["3"]).alias("ignored"))


@query("fil09_all_copies_ignored", sql("files", "SELECT sha, bool_and(ends_with(lower(filename), '.xyz') OR ends_with(lower(filename), '.tmp') OR list_contains(string_split(lower(folder), '/'), '3')) AS skip FROM files WHERE sha IS NOT NULL GROUP BY sha"))
def fil09(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "files").where("sha IS NOT NULL").groupBy("sha").agg(F.bool_and(I.artifact(F.concat_ws("/", "package", "relpath"), IGNORE, ["3"])).alias("skip"))


_ODD = "CASE id % 9 WHEN 0 THEN '' WHEN 1 THEN '/' || target WHEN 2 THEN 'a/../' || target WHEN 3 THEN 'a\\b' WHEN 4 THEN 'x//' || target WHEN 5 THEN 'con.txt' WHEN 6 THEN 'dir./a?b' ELSE target END"


@query("fil10_11_path_safety", sql("decisions", f"SELECT sha, CASE WHEN p = '' THEN 'empty' WHEN contains(p, '\\') THEN 'backslash' WHEN starts_with(p, '/') OR regexp_matches(p, '^[A-Za-z]:') THEN 'absolute' WHEN len(list_filter(string_split(p, '/'), lambda s: s IN ('', '.', '..'))) > 0 THEN 'segment' END AS problem FROM (SELECT sha, {_ODD} AS p FROM decisions) x"))
def fil11(spark: SparkSession, d: str) -> DataFrame:
    odd = _ODD.replace("'a\\b'", "'a\\\\b'")
    return frame(spark, d, "decisions").select("sha", F.expr(odd).alias("p")).select("sha", T.path_problem(F.col("p")).alias("problem"))


@query("fil12_windows_lint", sql("decisions", f"""SELECT sha, array_to_string(list_filter([CASE WHEN length(p) > 240 THEN 'too_long' END, CASE WHEN len(list_filter(s, lambda x: regexp_matches(x, '[. ]$'))) > 0 THEN 'ends_in_dot_or_space' END,
  CASE WHEN len(list_filter(s, lambda x: regexp_matches(x, '[<>:"\\\\|?*]'))) > 0 THEN 'forbidden_character' END, CASE WHEN len(list_filter(s, lambda x: split_part(lower(x), '.', 1) IN ('con', 'prn', 'aux', 'nul'))) > 0 THEN 'reserved_name' END], lambda z: z IS NOT NULL), ',') AS codes
  FROM (SELECT sha, p, string_split(p, '/') AS s FROM (SELECT sha, {_ODD} AS p FROM decisions) y) x"""))
def fil12(spark: SparkSession, d: str) -> DataFrame:
    odd = _ODD.replace("'a\\b'", "'a\\\\b'")
    return frame(spark, d, "decisions").select("sha", F.expr(odd).alias("p")).select("sha", F.array_join(T.windows_problems(F.col("p")), ",").alias("codes"))


@query("fil14_review_rows", sql("files content manual decisions", "SELECT sha, file_id FROM (SELECT f.sha, f.file_id, row_number() OVER (PARTITION BY f.sha ORDER BY f.file_id) AS n FROM files f JOIN decisions d ON d.sha = f.sha WHERE d.needs_review = 1 AND f.sha NOT IN (SELECT sha FROM manual)) x WHERE n = 1"))
def fil14(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    rows = frame(spark, d, "files", made).select("sha", "file_id").join(frame(spark, d, "decisions", made).select("sha", (F.col("needs_review") == 1).alias("needs_review")), "sha").withColumn("ord", F.col("file_id"))
    return I.review_rows(rows, frame(spark, d, "manual", made)).select("sha", "file_id")


@query("fil20_hash_prefix", sql("content", "SELECT sha FROM content WHERE starts_with(sha, '3f')"))
def fil20(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "content").where((F.col("sha") >= "3f") & (F.col("sha") < "3g")).select("sha")


@query("fil21_homeless", sql("decisions", "SELECT sha, action FROM decisions WHERE action IN ('skip', 'quarantine') OR needs_review = 1"))
def fil21(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "decisions").where(F.col("action").isin("skip", "quarantine") | (F.coalesce("needs_review", F.lit(0)) == 1)).select("sha", "action")


@query("fil22_review_queue", sql("content decisions files", f"WITH {ITEMS} SELECT sha, confidence FROM items WHERE coalesce(needs_review, 0) = 1 ORDER BY confidence ASC NULLS FIRST, sha LIMIT 1"))
def fil22(spark: SparkSession, d: str) -> DataFrame:
    return I.page(I.item_filter(_items(spark, d), needs_review=True), 1).select("sha", "confidence")


@query("top01_item_page", sql("content decisions files", f"WITH {ITEMS} SELECT sha, needs_review, confidence FROM items ORDER BY coalesce(needs_review, 0) DESC, confidence ASC NULLS FIRST, sha LIMIT 40 OFFSET 20"))
def top01(spark: SparkSession, d: str) -> DataFrame:
    return I.page(_items(spark, d), 40, 20).select("sha", "needs_review", "confidence")


@query("prj01_kind_map", sql("files", "SELECT file_id, CASE lower(extension) WHEN '.txt' THEN 'text' WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.png' THEN 'image' WHEN '.py' THEN 'code' WHEN '.zip' THEN 'archive' WHEN '.mp4' THEN 'media' ELSE 'other' END AS kind FROM files"))
def prj01(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "files").select("file_id", T.kind_of(F.col("extension")).alias("kind"))


@query("prj02_folder_path", sql("files", "SELECT file_id, package || '/' || regexp_replace(relpath, '/[^/]*$', '') AS folder FROM files"))
def prj02(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "files").select("file_id", F.when(T.parent(F.col("relpath")) == "", F.col("package")).otherwise(F.concat_ws("/", "package", T.parent(F.col("relpath")))).alias("folder"))


@query("prj03_manifest", sql("files folders", f"""WITH {CLEAN_HASHES},
m AS (SELECT sha, package || '/' || relpath AS path, contains(relpath, 'en/') AS matched, size, NOT EXISTS (SELECT 1 FROM dups d WHERE f.folder = d.folder OR starts_with(f.folder, d.folder || '/')) AS healthy FROM files f WHERE sha IS NOT NULL)
SELECT sha, count(DISTINCT path) AS n_paths, count(DISTINCT CASE WHEN matched THEN path END) AS n_matched, arg_min(CASE WHEN healthy THEN path END, {{'m': NOT matched, 'p': string_split(path, '/')}}) FILTER (WHERE healthy) AS source_path, min(size) AS size FROM m GROUP BY sha"""))
def prj03(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    rows = I.manifest(frame(spark, d, "files", made), dups(spark, d, made), F.col("relpath").contains("en/"))
    return rows.select("sha", F.size("paths").cast("long").alias("n_paths"), F.size("matched_paths").cast("long").alias("n_matched"), "source_path", "size")


TEMPLATE = 'Semester {{SEMESTER}}, {{SUBJECT}} {"sha": "{{SHA}}"}\nAllowed: {{CATEGORIES}}\n{{FILENAME}} ({{EXTENSION}}, {{KIND}}, {{SIZE}} bytes)\nAt: {{PATHS}}\nWhy: {{REASONS}}\n{{HEAD}}{{OTHER}}'


@query("prj05_prompt", sql("files content decisions", r"""WITH f AS (SELECT sha, list_sort(list(package || '/' || relpath))[1:10] AS p, arg_min(filename, file_id) AS filename, min(size) AS size, arg_min(text, file_id) AS t FROM files WHERE sha IS NOT NULL GROUP BY sha)
SELECT d.sha, concat('Semester ', semester, ', ', subject, ' {"sha": "', d.sha, '"}', chr(10), 'Allowed: wyklady, laby', chr(10), filename, ' (', coalesce(nullif(lower(regexp_extract(filename, '\.[^.]*$')), ''), '(none)'), ', ', kind, ', ', size, ' bytes)', chr(10), 'At: ', array_to_string(p, ', '), chr(10),
  'Why: ', CASE WHEN needs_review = 1 THEN 'review' ELSE '(none)' END, chr(10), coalesce(nullif(substr(t, 1, 200), ''), '(none)'), '{{OTHER}}') AS prompt FROM decisions d JOIN f ON f.sha = d.sha JOIN content c ON c.sha = d.sha"""))
def prj05(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    path = F.concat_ws("/", "package", "relpath")
    f = frame(spark, d, "files", made).where("sha IS NOT NULL").groupBy("sha").agg(F.slice(F.array_sort(F.collect_list(path)), 1, 10).alias("p"), F.min_by("filename", "file_id").alias("filename"), F.min("size").alias("size"), F.min_by(F.substring("text", 1, 200), "file_id").alias("head"))
    rows = frame(spark, d, "decisions", made).join(f, "sha").join(frame(spark, d, "content", made).select("sha", "kind"), "sha")
    values = {
        "SEMESTER": F.col("semester"), "SUBJECT": F.col("subject"), "SHA": F.col("sha"), "CATEGORIES": F.lit("wyklady, laby"), "FILENAME": F.col("filename"), "EXTENSION": F.lower(F.regexp_extract("filename", r"\.[^.]*$", 0)),
        "KIND": F.col("kind"), "SIZE": F.col("size"), "PATHS": F.array_join("p", ", "), "REASONS": F.when(F.col("needs_review") == 1, "review"), "HEAD": F.col("head"),
    }
    return rows.select("sha", prompt(TEMPLATE, values).alias("prompt"))

#: Addresses of every shape.
_SHAPES = "CASE page_id % 10 WHEN 0 THEN 'https://docs.example/document/d/' || i || '/edit' WHEN 1 THEN 'https://docs.example/spreadsheets/d/' || i WHEN 2 THEN 'x/presentation/d/' || i || '#s' WHEN 3 THEN 'https://d.example/embeddedfolderview?x=1&id=' || i WHEN 4 THEN 'https://d.example/drive/folders/' || i || '?usp=1' WHEN 5 THEN 'https://d.example/file/d/' || i || '/view' WHEN 6 THEN 'https://d.example/uc?id=' || i WHEN 7 THEN 'https://d.example/open?id=' || i WHEN 8 THEN ' ' || i || ' ' ELSE url END"


@query("prj07_url_parts", f"SELECT page_id, CASE WHEN r < 9 THEN ['doc', 'sheet', 'slide', 'folder', 'folder', 'file', 'file', 'unknown', 'unknown'][r + 1] ELSE 'unknown' END AS kind, nullif(regexp_extract(t, '([-0-9A-Za-z_]*' || page_id || ')($|[^-0-9A-Za-z_])', 1), CASE WHEN r = 9 THEN regexp_extract(t, '([-0-9A-Za-z_]*' || page_id || ')($|[^-0-9A-Za-z_])', 1) ELSE '' END) AS id FROM (SELECT page_id, page_id % 10 AS r, trim({_SHAPES}) AS t FROM (SELECT *, 'ab-C_' || lpad(page_id::VARCHAR, 20, 'z') AS i FROM pages) x) y")
def prj07(spark: SparkSession, d: str) -> DataFrame:
    p = frame(spark, d, "pages").withColumn("i", F.concat(F.lit("ab-C_"), F.lpad(F.col("page_id").cast("string"), 20, "z")))
    return p.select("page_id", resource(F.expr(_SHAPES)).alias("r")).select("page_id", "r.kind", "r.id")

@query("src03_skip_filter", sql("files", "SELECT file_id, CASE WHEN starts_with(n, '.') THEN 'hidden' WHEN lower(n) IN ('thumbs.db', 'desktop.ini') OR starts_with(n, '~$') THEN 'ignored' WHEN file_id % 50 = 7 THEN 'symlink' END AS reason FROM (SELECT file_id, CASE file_id % 10 WHEN 0 THEN '.' || filename WHEN 1 THEN 'Thumbs.db' WHEN 2 THEN '~$' || filename ELSE filename END AS n FROM files) x"))
def src03(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("CASE file_id % 10 WHEN 0 THEN '.' || filename WHEN 1 THEN 'Thumbs.db' WHEN 2 THEN '~$' || filename ELSE filename END")
    return frame(spark, d, "files").select("file_id", I.skip_reason(name, F.col("file_id") % 50 == 7).alias("reason"))


@query("src04_target_skip", sql("files", "SELECT file_id, CASE WHEN file_id % 3 = 0 AND starts_with(n, '.') THEN 'hidden' WHEN file_id % 3 <> 0 AND n IN ('.gitkeep', '.DS_Store') THEN 'hidden' END AS reason FROM (SELECT file_id, CASE file_id % 10 WHEN 0 THEN '.' || filename WHEN 1 THEN '.gitkeep' WHEN 2 THEN '.DS_Store' ELSE filename END AS n FROM files) x"))
def src04(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("CASE file_id % 10 WHEN 0 THEN '.' || filename WHEN 1 THEN '.gitkeep' WHEN 2 THEN '.DS_Store' ELSE filename END")
    return frame(spark, d, "files").select("file_id", I.target_skip_reason(name, F.col("file_id") % 3 == 0).alias("reason"))


@query("src24_cache_key", sql("files", "SELECT file_id, sha256('classify|local|m1|' || sha256('File ' || filename)) AS cache_key FROM files"))
def src24(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "files").select("file_id", F.sha2(F.concat_ws("|", F.lit("classify"), F.lit("local"), F.lit("m1"), F.sha2(F.concat(F.lit("File "), "filename"), 256)), 256).alias("cache_key"))


@query("src15_html_links", r"SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS href FROM pages WHERE contains(html, '<title>')")
def src15(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "pages").where(F.col("html").contains("<title>")).select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(1))).alias("href"))
