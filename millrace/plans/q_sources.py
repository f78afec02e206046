"""Queries over readers, writers, rules and streams."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import graph as G
from millrace.operators import planning as P
from millrace.operators import rules as R
from millrace.plans.fixtures import frame, sql
from millrace.plans.registry import query
from millrace.session import shared_folder, ship
from millrace.sources import files as S
from millrace.sources import index, sinks
from millrace.streaming import ledger, logs, rates


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:10]}"


@query("src08_plain_text", "SELECT doc_id, sha256(text) AS h FROM documents")
def src08(spark: SparkSession, d: str) -> DataFrame:
    raw = frame(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    return raw.select("doc_id", F.sha2(S.decoded(F.col("raw")), 256).alias("h"))


@query("src07_html_text", r"SELECT page_id, 'html' AS method, substr(trim(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), 1, 20000) AS text FROM pages")
def src07(spark: SparkSession, d: str) -> DataFrame:
    raw = frame(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("raw"), F.lit("text").alias("kind"))
    return S.extracted(raw, "raw", "kind").select("page_id", "method", "text")


def packed_office(texts: list[str], kind: str) -> bytes:
    """A small office file with a line for each text, or a row of them."""
    from xml.sax.saxutils import escape

    parts = {
        "docx": {"word/document.xml": "<w:document xmlns:w='w'><w:body>" + "".join(f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>" for t in texts) + "</w:body></w:document>"},
        "pptx": {f"ppt/slides/slide{k + 1}.xml": f"<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></p:sld>" for k, t in enumerate(texts)},
        "xlsx": {
            "xl/workbook.xml": "<workbook><sheets><sheet name='One'/></sheets></workbook>",
            "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{escape(t)}</t></si>" for t in texts) + "</sst>",
            "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row>" + "".join(f"<c t='s'><v>{k}</v></c>" for k in range(len(texts))) + "<c><v>7</v></c></row></sheetData></worksheet>",
        },
        "odf": {"content.xml": "<office:body xmlns:office='o' xmlns:text='t'>" + "".join(f"<text:p>{escape(t[:3])}<text:span>{escape(t[3:])}</text:span></text:p>" for t in texts) + "</office:body>"},
    }[kind]
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return b.getvalue()


@query("src07_rich_text", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'docx' WHEN 1 THEN 'pptx' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'odf' WHEN 4 THEN 'pdf' ELSE 'none' END AS method,
  CASE page_id % 6 WHEN 2 THEN 'One' || chr(10) || url || ' | second | 7' WHEN 4 THEN 'read ' || page_id WHEN 5 THEN NULL ELSE url || chr(10) || 'second' END AS text FROM pages""")
def src07_rich(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)

    @F.pandas_udf("binary")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, urls in batches:
            yield pd.Series([packed_office([u, "second"], ("docx", "pptx", "xlsx", "odf")[i % 6]) if i % 6 < 4 else b"%PDF-" + str(i).encode() if i % 6 == 4 else b"PK broken" for i, u in zip(ids, urls)])

    kind = F.when(F.col("page_id") % 6 == 1, "pptx").when(F.col("page_id") % 6 == 2, "xlsx").when(F.col("page_id") % 6 == 4, "pdf").otherwise("docx")
    raw = frame(spark, d, "pages").select("page_id", made("page_id", "url").alias("raw"), kind.alias("kind"))
    return S.extracted(raw, "raw", "kind", readers={"pdf": lambda b: "read " + b[5:].decode()}).select("page_id", "method", "text")


@query("src10_archive_listing", sql("files", "SELECT folder, len(n) AS n_names, array_to_string(list_sort(n)[1:5], ',') AS head FROM (SELECT folder, list(DISTINCT filename) AS n FROM files GROUP BY folder) x"))
def src10(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)

    @F.pandas_udf("binary")
    def zipped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for names in s:
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    for n in names:
                        z.writestr(n, b"x")
                out.append(buffer.getvalue())
            yield pd.Series(out)

    names = frame(spark, d, "files").groupBy("folder").agg(F.collect_set("filename").alias("n"))
    got = S.archives(names.select("folder", zipped("n").alias("raw")), "raw", 5)
    return got.select("folder", "n_names", F.array_join("names", ",").alias("head"))


@query("src11_snk01_jsonl", "SELECT doc_id, lang, sha256(text) AS h FROM documents")
def src11(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    sinks.jsonl(frame(spark, d, "documents").select("doc_id", "lang", "text"), path)
    return S.jsonl(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.sha2("text", 256).alias("h"))


@query("snk02_csv", sql("files", "SELECT folder, n, printf('%.4f', share) AS share FROM (SELECT folder, count(*) AS n, round(count(sha) / count(*), 4) AS share FROM files GROUP BY folder) x"))
def snk02(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    rows = frame(spark, d, "files").groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.round(F.count("sha") / F.count(F.lit(1)), 4).alias("share"))
    sinks.csv(rows, path, ["share"])
    return spark.read.schema("folder string, n long, share string").option("header", "true").csv(path)


@query("snk06_graph_json", sql("nodes", """SELECT id AS ord, '{"id":"' || id || '","level":' || level || CASE WHEN status IS NOT NULL THEN ',"status":"' || status || '"' ELSE '' END || ',"title":"' || title || '","type":"' || type || '"}' AS json FROM nodes"""))
def snk06(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return sinks.graph_json(frame(spark, d, "nodes", made), frame(spark, d, "edges", made)).where("part = 'node'").select("ord", "json")


@query("snk07_search_index", sql("nodes", """SELECT id, '{"id":"' || id || '","title":"' || title || '","body":"' || type || '"}' AS json FROM nodes"""))
def snk07(spark: SparkSession, d: str) -> DataFrame:
    return sinks.search_index(frame(spark, d, "nodes").withColumn("body", F.col("type")))


@query("snk09_manual_roundtrip", sql("manual", "SELECT sha, kind, decided_by FROM manual"))
def snk09(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "manual")
    m = frame(spark, d, "manual").select("sha", "kind", "decided_by")
    sinks.jsonl(m, path, ["sha"])
    return P.upsert(m.where("1 = 0"), S.jsonl(spark, path, "sha string, kind string, decided_by string"), ["sha"], ["kind", "decided_by"])


@query("snk08_src18_front_matter", sql("nodes", "SELECT id, title, type FROM nodes"))
def src18(spark: SparkSession, d: str) -> DataFrame:
    raw = frame(spark, d, "nodes").select(F.concat(F.lit("---\nid: "), "id", F.lit("\ntitle: \""), "title", F.lit("\"\ntype: "), "type", F.lit("\n---\n# Body")).alias("raw"))
    m = raw.select(S.front_matter(F.col("raw")).alias("m"))
    return m.select(F.element_at("m", "id").alias("id"), F.element_at("m", "title").alias("title"), F.element_at("m", "type").alias("type"))


@query("src13_catalogue", sql("decisions", "SELECT semester, subject AS code, 'Name ' || subject AS name, min(coalesce(category, 'x')) AS \"group\" FROM decisions GROUP BY ALL"))
def src13(spark: SparkSession, d: str) -> DataFrame:
    dec = frame(spark, d, "decisions").select("semester", F.coalesce("category", F.lit("x")).alias("group"), F.struct(F.col("subject").alias("code"), F.concat(F.lit("Name "), "subject").alias("name")).alias("s"))
    groups = dec.groupBy("semester", "group").agg(F.collect_set("s").alias("subjects")).withColumn("ord", F.col("group"))
    return S.catalogue(groups)


@query("src14_catalogue_lookup", sql("decisions", "SELECT DISTINCT semester, lower(subject) AS key, subject AS code FROM decisions UNION ALL SELECT DISTINCT semester, 'alias' || substr(subject, 2), subject FROM decisions UNION ALL SELECT DISTINCT semester, 'none', NULL FROM decisions"))
def src14(spark: SparkSession, d: str) -> DataFrame:
    cat = frame(spark, d, "decisions").select("semester", F.col("subject").alias("code"), F.concat(F.lit("Alias"), F.substring("subject", 2, 9)).alias("alias"), F.lit("g").alias("group")).distinct()
    wanted = cat.select("semester", F.lower("code").alias("key")).union(cat.select("semester", F.lower("alias"))).union(cat.select("semester", F.lit("none"))).distinct()
    return S.find(cat, wanted).select("semester", "key", "code")


@query("src16_win13_curriculum", """WITH l AS (SELECT n_regionkey AS doc, n_nationkey AS line, CASE WHEN n_nationkey < 5 THEN 'Semestr ' || (1 + n_nationkey) ELSE n_name || ' of Things;' || (n_nationkey % 3) || ';0;' || (n_nationkey % 2) || ';0' END AS value FROM nation),
c AS (SELECT *, max(CASE WHEN starts_with(value, 'Semestr') THEN line END) OVER (PARTITION BY doc ORDER BY line) AS h FROM l)
SELECT c.doc, c.line, regexp_extract(h.value, '([0-9]+)', 1)::INT AS semester, CASE WHEN c.line % 3 > 0 THEN 'W' ELSE '' END || CASE WHEN c.line % 2 > 0 THEN 'L' ELSE '' END AS forms FROM c JOIN l h ON h.doc = c.doc AND h.line = c.h WHERE contains(c.value, ';')""")
def src16(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    lines = frame(spark, d, "nation").select(F.col("n_regionkey").alias("doc"), k.alias("line"), F.when(k < 5, F.concat(F.lit("Semestr "), (1 + k).cast("string"))).otherwise(F.concat("n_name", F.lit(" of Things;"), (k % 3).cast("string"), F.lit(";0;"), (k % 2).cast("string"), F.lit(";0"))).alias("value"))
    return S.curriculum(lines).select("doc", "line", "semester", "forms")


@query("src22_demo_index", None)
def src22(spark: SparkSession, d: str) -> DataFrame:
    return S.demo_files(spark, 5000)


@query("src23_version_gate", sql("nodes", "SELECT id FROM nodes"))
def src23(spark: SparkSession, d: str) -> DataFrame:
    return S.versioned(frame(spark, d, "nodes").withColumn("v", F.lit(4)), "v", 4).select("id")


@query("src25_existing_files", sql("files", "SELECT file_id FROM files WHERE package || '/' || relpath IN (SELECT package || '/' || relpath FROM files WHERE status = 'verified')"))
def src25(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d, "files").withColumn("p", F.concat_ws("/", "package", "relpath"))
    return f.join(f.where("status = 'verified'").select("p").distinct(), "p", "left_semi").select("file_id")


@query("prj04_text_head", "SELECT doc_id, octet_length(encode(text)) > 500 AS cut FROM documents")
def prj04(spark: SparkSession, d: str) -> DataFrame:
    h = frame(spark, d, "documents").select("doc_id", "text", S.byte_head(F.col("text"), 500).alias("h"))
    return h.select("doc_id", F.when(F.col("text").startswith(F.col("h")) & (F.octet_length("h") <= 500), F.octet_length("text") > 500).alias("cut"))


@query("prj06_preview", sql("files content", "SELECT c.sha, CASE WHEN kind IN ('image', 'pdf') THEN 'image' WHEN length(f.text) > 0 THEN 'text' ELSE 'none' END AS preview FROM content c JOIN files f ON f.file_id = c.id"))
def prj06(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    f = frame(spark, d, "files", made).select(F.col("file_id").alias("id"), "text")
    return frame(spark, d, "content", made).join(f, "id").select("sha", S.preview(F.col("kind"), F.col("text"), F.array().cast("array<string>")).alias("preview"))


RULES = [("wyklady", "the", [], 10), ("laby", "erth", [], 20), ("kolokwia", "doc", ["K"], 30), ("projekty", "onan", [], 40)]


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "category string, keyword string, forms array<string>, priority int")


_FOLDED = "lower(strip_accents(replace(replace({}, 'ł', 'l'), 'Ł', 'L')))"
SIGNALS = f"""fi AS (SELECT sha, arg_min(package || '/' || relpath, file_id) AS path, arg_min(substr(text, 1, 300), file_id) AS head FROM files WHERE sha IS NOT NULL GROUP BY sha),
se AS (SELECT sha, n, generate_subscripts(p, 1) - 1 AS i, unnest(p) AS s FROM (SELECT sha, len(string_split(path, '/')) AS n, list_append(list_transform(string_split(path, '/'), lambda x: {_FOLDED.format("x")}), {_FOLDED.format("coalesce(head, '')")}) AS p FROM fi)),
ru AS (SELECT unnest(['wyklady', 'laby', 'projekty']) AS category, unnest(['the', 'erth', 'onan']) AS keyword, unnest([10, 20, 40]) AS priority),
hi AS (SELECT sha, category, priority, i, n FROM se JOIN ru ON regexp_matches(s, '(^|[^a-z0-9])' || keyword || '[a-z]*')),
de AS (SELECT sha, max(i) AS deep FROM hi WHERE i < n - 1 GROUP BY sha),
si AS (SELECT sha, category, round(max(CASE WHEN i = n THEN 0.74 WHEN i = n - 1 THEN 0.95 WHEN i = deep THEN 0.9 ELSE 0.78 END), 4)::DOUBLE AS weight, min(priority) AS priority FROM hi LEFT JOIN de USING (sha) GROUP BY sha, category)"""


@query("rul02_win04_signals", sql("files", f"WITH {SIGNALS} SELECT * FROM si"))
def rul02(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d, "files").where("sha IS NOT NULL").groupBy("sha").agg(F.min_by(F.struct(F.concat_ws("/", "package", "relpath").alias("path"), F.substring("text", 1, 300).alias("text_head")), "file_id").alias("x"))
    return R.signals(f.select("sha", "x.path", "x.text_head", F.array(F.lit("W")).alias("forms")), _rules(spark))


@query("rul01_classification", sql("files content decisions", f"""WITH {SIGNALS},
w AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY weight DESC, priority, category) AS k, count(*) OVER (PARTITION BY sha, weight) AS same FROM si),
b AS (SELECT sha, category AS cat, CASE WHEN same > 1 THEN least(round(weight - 0.12, 4), 0.89) ELSE weight END AS conf FROM w WHERE k = 1),
j AS (SELECT c.sha, CASE WHEN d.sha IS NOT NULL THEN coalesce(d.category, 'inne') END AS gt, c.id % 19 = 0 AS ignored, c.id % 23 <> 0 AS healthy, c.kind = 'image' AS media, cat, conf FROM content c LEFT JOIN (SELECT sha, category FROM decisions WHERE run_id = 'ground_truth') d ON d.sha = c.sha LEFT JOIN b ON b.sha = c.sha)
SELECT sha, CASE WHEN gt IS NOT NULL THEN 'copy' WHEN ignored THEN 'skip' WHEN NOT healthy THEN 'quarantine' WHEN media THEN 'media' WHEN coalesce(conf, 0) < 0.7 THEN 'quarantine' ELSE 'copy' END AS action,
  CASE WHEN gt IS NOT NULL THEN gt WHEN NOT ignored AND healthy AND NOT media AND coalesce(conf, 0) >= 0.7 THEN cat END AS category,
  CASE WHEN gt IS NOT NULL THEN 1.0 WHEN ignored OR media THEN 0.99 WHEN NOT healthy THEN 0.0 ELSE coalesce(conf, 0.0) END::DOUBLE AS confidence, CASE WHEN gt IS NOT NULL THEN 'manual' WHEN conf IS NOT NULL THEN 'heuristic' ELSE 'unknown' END AS method FROM j"""))
def rul01(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    c = frame(spark, d, "content", made)
    dec = frame(spark, d, "decisions", made).where("run_id = 'ground_truth'").select("sha", F.coalesce("category", F.lit("inne")).alias("ground_truth"))
    rows = c.join(dec, "sha", "left").select("sha", "ground_truth", (F.col("id") % 19 == 0).alias("ignored"), (F.col("id") % 23 != 0).alias("healthy"), (F.col("kind") == "image").alias("media"))
    return R.decide(rows, rul02(spark, d))


@query("rul03_model_output", sql("decisions", "SELECT sha, least(greatest(coalesce(c, 0), 0), 1) AS confidence, (category IS NULL OR category NOT IN ('wyklady', 'laby') OR least(greatest(coalesce(c, 0), 0), 1) < 0.7) AS bad FROM (SELECT sha, category, confidence * 1.5 - 0.2 AS c FROM decisions) x"))
def rul03(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "decisions").select("sha", "category", "action", (F.col("confidence") * 1.5 - 0.2).alias("confidence")).where("1 = 1")
    out = R.normalised_model_output(rows.withColumn("action", F.lit("copy")), ["wyklady", "laby"])
    return out.select("sha", "confidence", (F.col("action") == "quarantine").alias("bad"))


@query("rul08_verify", sql("decisions applied", "SELECT d.sha, CASE WHEN a.has IS NULL THEN 'missing' WHEN a.has = d.sha THEN 'ok' ELSE 'mismatch' END AS state FROM decisions d LEFT JOIN (SELECT lower(target) AS k, min(sha) AS has FROM applied GROUP BY 1) a ON a.k = lower(d.target) WHERE action = 'copy'"))
def rul08(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    a = frame(spark, d, "applied", made).groupBy(F.lower("target").alias("k")).agg(F.min("sha").alias("has"))
    j = frame(spark, d, "decisions", made).where("action = 'copy'").join(a, F.lower("target") == F.col("k"), "left")
    return j.select("sha", F.when(F.col("has").isNull(), "missing").when(F.col("has") == F.col("sha"), "ok").otherwise("mismatch").alias("state"))


@query("rul09_node_checks", sql("nodes", "SELECT id, (status IS NULL OR status IN ('done', 'in-progress', 'not-started')) AND regexp_matches(id, '^[a-z0-9-]+$') AND level >= 1 AS ok FROM nodes"))
def rul09(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status").isNull() | F.col("status").isin("done", "in-progress", "not-started")
    return frame(spark, d, "nodes").select("id", (s & F.col("id").rlike("^[a-z0-9-]+$") & (F.col("level") >= 1)).alias("ok"))


#: Ambiguous codes, several semesters, groups and words that leave a path out.
_PATHS = "CASE id % 6 WHEN 0 THEN 'old/SEM ' || cast(semester AS string) || '/' || subject || ' notes/' || sha WHEN 1 THEN 'x/grp' || cast(id % 2 AS string) || '/' || subject || '/lab.txt' WHEN 2 THEN 'magisterskie/' || subject || '/a' WHEN 3 THEN 'sem3/semestr_IV/Subject ' || subject || '/b.pdf' WHEN 4 THEN 'grp0/grp1/' || subject || '.doc' ELSE 'sem' || cast(semester AS string) || '/dep' || cast(id % 2 AS string) || '/nick ' || subject || ' ' || subject END"


def matched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    paths = frame(spark, d, "decisions").select(F.expr(_PATHS).alias("path")).distinct()
    n, g = F.col("n"), (F.col("n") % 2).cast("string")
    subjects = spark.range(1, 8).select(F.col("id").cast("int").alias("semester"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n"))
    subjects = subjects.select("semester", F.concat(F.lit("S"), n.cast("string")).alias("code"), F.concat(F.lit("Subject S"), n.cast("string")).alias("name"), F.array(F.concat(F.lit("Nick S"), n.cast("string"))).alias("aliases"), F.concat(F.lit("grp"), g).alias("group"), F.concat(F.lit("dep"), g).alias("department"))
    return R.match_subjects(paths, subjects)


_SUBJECTS = r"""pa AS (SELECT DISTINCT PATHS AS path FROM decisions),
su AS (SELECT sem AS semester, 'S' || n AS code, 'grp' || (n % 2) AS grp, n FROM (SELECT unnest(range(1, 8))::INT AS sem), (SELECT unnest(range(5)) AS n)),
co AS (SELECT path, generate_subscripts(p, 1) AS i, unnest(p) AS c FROM (SELECT path, list_transform(string_split(regexp_replace(path, '\.[^./]*$', ''), '/'), lambda x: array_to_string(regexp_extract_all(lower(x), '[a-z0-9]+'), ' ')) AS p FROM pa WHERE NOT contains(path, 'magisterskie'))),
se AS (SELECT path, list(DISTINCT CASE v WHEN 'iv' THEN 4 ELSE v::INT END) AS s FROM (SELECT path, unnest(regexp_extract_all(c, '(?:^|[^a-z0-9])sem(?:estr)?[ ]?([1-7]|iv)(?:[^a-z0-9]|$)', 1)) AS v FROM co) GROUP BY path),
la AS (SELECT semester, code, grp, unnest(['subject s' || n, 's' || n, 'nick s' || n]) AS k, unnest([3, 2, 1]) AS score FROM su),
hi AS (SELECT path, i, semester, code, grp, score FROM co JOIN la ON contains(' ' || c || ' ', ' ' || k || ' ') LEFT JOIN se USING (path) WHERE s IS NULL OR list_contains(s, semester)),
sn AS (SELECT DISTINCT path, i AS j, semester, grp AS g FROM co JOIN su ON semester >= 5 AND (c = grp OR c = 'dep' || (n % 2))),
be AS (SELECT h.path, h.i, h.semester, list(DISTINCT g) AS gs FROM (SELECT DISTINCT path, i, semester FROM hi) h JOIN sn ON sn.path = h.path AND sn.semester = h.semester AND j < i GROUP BY ALL),
ok AS (SELECT hi.*, gs FROM hi LEFT JOIN be USING (path, i, semester) WHERE gs IS NULL OR list_contains(gs, grp)),
fo AS (SELECT path, semester, code AS subject, grp AS "group", max(score) AS score FROM ok JOIN (SELECT path, i, semester, max(score) AS best FROM ok GROUP BY ALL) USING (path, i, semester) WHERE score = best GROUP BY ALL)"""
_SUBJECTS = _SUBJECTS.replace("PATHS", _PATHS.replace("string", "varchar"))


@query("joi11_subject_match", sql("decisions", f"WITH {_SUBJECTS} SELECT * FROM fo"))
def joi11(spark: SparkSession, d: str) -> DataFrame:
    return matched(spark, d)[0]


@query("joi11_match_reasons", sql("decisions", f"""WITH {_SUBJECTS} SELECT path, concat_ws(',', CASE WHEN s IS NULL THEN 'missing_semester' WHEN len(s) > 1 THEN 'conflicting_semesters' END, CASE WHEN path IN (SELECT path FROM ok WHERE len(gs) > 1) THEN 'conflicting_groups' END, CASE WHEN (SELECT count(*) FROM fo WHERE fo.path = x.path) > 1 THEN 'ambiguous_subject' END) AS reasons
FROM (SELECT DISTINCT path FROM co) x LEFT JOIN se USING (path)"""))
def joi11_reasons(spark: SparkSession, d: str) -> DataFrame:
    return matched(spark, d)[1].select("path", F.array_join("reasons", ",").alias("reasons"))

@query("joi12_target_path", sql("decisions", "SELECT DISTINCT 'SEM' || semester || '/grp/(' || subject || ')_Name/' || CASE WHEN outdated THEN 'outdated/' ELSE '' END || coalesce(category, 'x') || '/f' AS path, semester::INT AS semester, CASE WHEN subject <> 'S4' THEN subject END AS subject, CASE WHEN subject <> 'S4' THEN coalesce(category, 'x') END AS category, outdated FROM decisions"))
def joi12(spark: SparkSession, d: str) -> DataFrame:
    dec = frame(spark, d, "decisions")
    paths = dec.select(F.concat(F.lit("SEM"), F.col("semester").cast("string"), F.lit("/grp/("), "subject", F.lit(")_Name/"), F.when(F.col("outdated"), "outdated/").otherwise(""), F.coalesce("category", F.lit("x")), F.lit("/f")).alias("path")).distinct()
    subjects = dec.where("subject <> 'S4'").select(F.col("semester").cast("int").alias("semester"), F.col("subject").alias("code")).distinct()
    return R.target_of(paths, subjects)


@query("stm04_once_per_content", sql("files content", "SELECT DISTINCT sha FROM files WHERE sha IS NOT NULL AND sha NOT IN (SELECT sha FROM content WHERE id % 2 = 0)"))
def stm04(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return ledger.to_extract(frame(spark, d, "files", made).where("sha IS NOT NULL"), frame(spark, d, "content", made).where("id % 2 = 0"))


@query("stm05_recovered_ledger", sql("files", "SELECT file_id, CASE s WHEN 'listing' THEN 'pending' WHEN 'processing' THEN 'listed' WHEN 'downloading' THEN 'pending' ELSE s END AS status FROM (SELECT file_id, CASE file_id % 5 WHEN 0 THEN 'listing' WHEN 1 THEN 'processing' WHEN 2 THEN 'downloading' WHEN 3 THEN 'done' ELSE 'failed' END AS s FROM files) x"))
def stm05(spark: SparkSession, d: str) -> DataFrame:
    s = F.expr("CASE file_id % 5 WHEN 0 THEN 'listing' WHEN 1 THEN 'processing' WHEN 2 THEN 'downloading' WHEN 3 THEN 'done' ELSE 'failed' END")
    return ledger.recovered(frame(spark, d, "files").select("file_id", s.alias("status")))


@query("stm06_reopened_folders", sql("files", "SELECT folder, CASE WHEN bool_or(file_id % 10 = 4 OR file_id % 10 = 7) THEN 'listed' ELSE 'done' END AS status FROM files GROUP BY folder"))
def stm06(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d, "files")
    rows = f.select(F.col("file_id").alias("id"), "folder", F.when(F.col("file_id") % 10 == 4, "failed").otherwise("done").alias("status"))
    folders = f.select("folder", F.lit("done").alias("status")).distinct()
    return ledger.reopened(rows, folders, rows.where("id % 10 = 7"))[1]


@query("udf01_03_cached_calls", sql("content", "SELECT sha, CASE WHEN id % 2 = 0 THEN 'known' WHEN id % 3 = 0 THEN NULL ELSE upper(kind) END AS answer FROM content"))
def udf01(spark: SparkSession, d: str) -> DataFrame:
    c = frame(spark, d, "content").withColumn("arg", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("kind")))

    def call(text: str) -> str:
        if not text:
            raise ValueError("nothing to ask")
        return text.upper()

    cache = c.where("id % 2 = 0").select("sha", F.lit("known").alias("answer"))
    return ledger.cached_calls(c, cache, "sha", "arg", call).select("sha", "answer")


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, d: str) -> DataFrame:
    found = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(d)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_tumbling_hours", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_hours(spark: SparkSession, d: str) -> DataFrame:
    out = rates.drain(rates.windowed(events(spark, d)), f"hours_{uuid.uuid4().hex[:8]}", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("stream_once", "SELECT event_id FROM events")
def stream_once(spark: SparkSession, d: str) -> DataFrame:
    return rates.drain(rates.once(events(spark, d)), f"once_{uuid.uuid4().hex[:8]}", "append").select("event_id")


@query("stream_status_machine", "WITH s AS (SELECT user_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS i FROM events) SELECT user_id, CASE max(i) WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' END AS status FROM s GROUP BY user_id")
def stream_status(spark: SparkSession, d: str) -> DataFrame:
    out = rates.drain(rates.status_machine(events(spark, d).select("user_id", "ts", "event_type"), ["view", "click", "purchase"]), f"status_{uuid.uuid4().hex[:8]}", "update")
    return out.groupBy("user_id").agg(F.max_by("status", "steps").alias("status"))


@query("set08_09_levels", sql("nodes", "SELECT type AS kind, id, status FROM nodes UNION ALL SELECT 'level', level::VARCHAR, NULL FROM nodes GROUP BY level"))
def set08(spark: SparkSession, d: str) -> DataFrame:
    n = frame(spark, d, "nodes")
    levels = [n.where(F.col("type") == t).select(F.lit(t).alias("kind"), "id", "status") for t in ("region", "nation", "customer")]
    levels.append(n.select(F.lit("level").alias("kind"), F.col("level").cast("string").alias("id")).distinct())
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out

@query("set04_shared_forms", sql("decisions", "SELECT sha, id % 3 = 0 OR len(list_intersect(['W', 'L'], CASE WHEN id % 2 = 0 THEN ['W'] ELSE ['P'] END)) > 0 AS fits FROM decisions"))
def set04(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    forms = F.when(i % 3 == 0, F.array().cast("array<string>")).when(i % 2 == 0, F.array(F.lit("W"))).otherwise(F.array(F.lit("P")))
    return frame(spark, d, "decisions").select("sha", ((F.size(forms) == 0) | F.arrays_overlap(F.array(F.lit("W"), F.lit("L")), forms)).alias("fits"))


@query("top08_known_order", sql("decisions", "SELECT category, row_number() OVER (ORDER BY CASE category WHEN 'wyklady' THEN 0 WHEN 'laby' THEN 1 ELSE 2 END, category) AS pos FROM (SELECT DISTINCT category FROM decisions WHERE category IS NOT NULL) x"))
def top08(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    c = frame(spark, d, "decisions").where("category IS NOT NULL").select("category").distinct()
    rank = F.when(F.col("category") == "wyklady", 0).when(F.col("category") == "laby", 1).otherwise(2)
    return c.select("category", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(rank, "category")).alias("pos"))


@query("top05_cluster_order", sql("files", "SELECT sha, sum(size)::BIGINT AS size FROM files WHERE sha IS NOT NULL GROUP BY sha ORDER BY size DESC, sha LIMIT 25"))
def top05(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "files").where("sha IS NOT NULL").groupBy("sha").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "sha").limit(25)


@query("agg31_counters", sql("decisions", "SELECT count(*) AS rows, count(*) FILTER (WHERE needs_review = 1) AS review, count(*) FILTER (WHERE action = 'media') AS media, count(*) FILTER (WHERE outdated) AS outdated, count(DISTINCT subject) AS subjects FROM decisions"))
def agg31(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return frame(spark, d, "decisions").agg(F.count(F.lit(1)).alias("rows"), one(F.col("needs_review") == 1, "review"), one(F.col("action") == "media", "media"), one(F.col("outdated"), "outdated"), F.count_distinct("subject").alias("subjects"))


@query("joi01_02_files_decisions", sql("files decisions", "SELECT f.file_id, d.semester, d.action FROM files f LEFT JOIN decisions d ON d.sha = f.sha"))
def joi02(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    return frame(spark, d, "files", made).select("file_id", "sha").join(frame(spark, d, "decisions", made).select("sha", "semester", "action"), "sha", "left").select("file_id", "semester", "action")


#: Notes on the nations: a title for some, links by name, relations and links that lead nowhere.
def vault(spark: SparkSession, d: str) -> DataFrame:
    n = frame(spark, d, "nation")
    key = F.col("n_nationkey")
    meta = F.concat(F.lit("---\ntype: nation\nlevel: "), F.col("n_regionkey").cast("string"), F.when(key % 2 == 0, F.concat(F.lit("\ntitle: \""), "n_name", F.lit("!\""))).otherwise(""), F.lit("\naliases: [nation "), key.cast("string"), F.lit("]\nrelations: [nation "), (key + 1).cast("string"), F.lit("]\n---\n"))
    raw = n.select(F.concat_ws("/", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.lower("n_name")).alias("folder"), F.concat(meta, F.lit("see [["), "n_name", F.lit("|x]] and [[Lost "), F.col("n_regionkey").cast("string"), F.lit("]]")).alias("value"))
    path = scratch(spark, "notes")
    raw.select(F.replace(F.col("folder"), F.lit(" "), F.lit("_")).alias("folder"), "value").write.partitionBy("folder").option("lineSep", "\n").text(path)
    found = spark.read.text(path, wholetext=True).select(F.concat("folder", F.lit(".md")).alias("path"), F.col("value").alias("raw"))
    return found.select("path", S.front_matter(F.col("raw")).alias("meta"), F.regexp_replace("raw", r"(?s)^---\n.*?\n---\n", "").alias("body"))


_NOTES = """nt AS (SELECT 'r' || n_regionkey || '/' || replace(lower(n_name), ' ', '_') AS id, replace(lower(n_name), ' ', '_') AS stem, n_nationkey AS k, n_regionkey AS r, n_name FROM nation),
ed AS (SELECT a.id AS source, coalesce((SELECT min(id) FROM nt b WHERE b.stem = lower(a.n_name)), lower(a.n_name)) AS target, 'link' AS kind FROM nt a UNION SELECT id, 'lost ' || r, 'link' FROM nt UNION SELECT a.id, coalesce(b.id, 'nation ' || (a.k + 1)), 'related' FROM nt a LEFT JOIN nt b ON b.k = a.k + 1)"""


@query("src17_19_note_nodes", f"WITH {_NOTES} SELECT id, CASE WHEN k % 2 = 0 THEN n_name || '!' ELSE stem END AS title, r::INT AS level, false AS ghost FROM nt UNION ALL SELECT DISTINCT target, CASE WHEN starts_with(target, 'lost') THEN 'Lost ' || substr(target, 6) WHEN starts_with(target, 'nation') THEN target ELSE upper(target) END, NULL, true FROM ed WHERE target NOT IN (SELECT id FROM nt)")
def src17(spark: SparkSession, d: str) -> DataFrame:
    return G.note_graph(vault(spark, d), S.typed)[0].select("id", "title", "level", "ghost")


@query("udf02_resolved_edges", f"WITH {_NOTES} SELECT source, target, kind FROM ed")
def udf02(spark: SparkSession, d: str) -> DataFrame:
    return G.note_graph(vault(spark, d), S.typed, G.resolve)[1]


@query("src12_config_table", "SELECT * FROM (VALUES ('S0', 3, NULL), ('S1', NULL, 'g')) t(code, semester, grp)")
def src12(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "config")
    spark.createDataFrame([('{"subjects": [{"code": "S0", "semester": 3}, {"code": "S1", "grp": "g"}]}',)], "value string").coalesce(1).write.text(f"{path}/subjects.json")
    return index.config_table(spark, index.config(spark, path, "subjects"), "subjects", "code string, semester int, grp string")


@query("src20_history", "SELECT o_custkey::VARCHAR AS path, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last, count(*) AS commits FROM orders GROUP BY 1")
def src20(spark: SparkSession, d: str) -> DataFrame:
    return index.history(frame(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")))


@query("src21_index_tables", sql("decisions", "SELECT sha, action FROM decisions"))
def src21(spark: SparkSession, d: str) -> DataFrame:
    found = index.Index(spark, scratch(spark, "index"), 4)
    found.create("decisions", frame(spark, d, "decisions").select("sha", "action"))
    return found.table("decisions")


@query("stm08_stage_chain", "SELECT * FROM (VALUES ('scan', 0, 'done'), ('hash', 1, 'failed'), ('plan', 2, 'stopped')) t(stage, pos, state)")
def stm08(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "logs")
    for stage, lines in {"scan": ["reading", "exit 0"], "hash": ["bad", "exit 2"]}.items():
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/{stage}.log")
    rows = spark.read.text([f"{path}/{s}.log" for s in ("scan", "hash")]).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.log/", 1).alias("stage"), "value")
    order = spark.createDataFrame([("scan", 0), ("hash", 1), ("plan", 2)], "stage string, pos int")
    return logs.chain(order, logs.events(rows).where("event = 'exit'").select("stage", "code"))
