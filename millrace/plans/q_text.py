"""Queries over string, date, number and array functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import items as I
from millrace.plans.fixtures import frame, sql
from millrace.plans.registry import query

ACCENTS = "translate(translate(lower({0}), 'ąćęńóśźżáéíúàèìòùâêîôûäëïöüñçãõåæø', 'acenoszzaeiuaeiouaeiouaeiouncaoaao'), 'ł', 'l')"
FOLD = ACCENTS.format("text")


@query("str01_02_normalised_text", None)
def str01(spark: SparkSession, d: str) -> DataFrame:
    n = frame(spark, d, "documents").select("doc_id", T.normalised(F.col("text")).alias("normalised"))
    return n.withColumn("text_hash", F.when(F.col("normalised") != "", F.sha2("normalised", 256)))


@query("str03_shingles", "SELECT doc_id, CASE WHEN len(w) < 3 THEN len(w) ELSE len(w) - 2 END AS n, CASE WHEN len(w) < 3 THEN w[1] ELSE array_to_string(w[1:3], ' ') END AS first_one FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) x")
def str03(spark: SparkSession, d: str) -> DataFrame:
    s = frame(spark, d, "documents").select("doc_id", F.explode(F.array(F.struct(F.split("text", " ").alias("w")))).alias("x")).select("doc_id", T.shingles(F.col("x.w")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).alias("first_one"))


_DIGITS = ", ".join(f"(CASE WHEN sum(CASE WHEN (('0x' || substr(h, {1 + 8 * f}, 8))::BIGINT >> {31 - b}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN 1 ELSE 0 END)" for f in range(2) for b in range(32))


@query("str04_simhash_md5", f"WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), g AS (SELECT doc_id, md5(unnest(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS h FROM w), v AS (SELECT doc_id, [{_DIGITS}] AS b FROM g GROUP BY doc_id) SELECT doc_id, array_to_string(list_transform(range(0, 16), lambda k: lower(to_hex(8 * b[4 * k + 1] + 4 * b[4 * k + 2] + 2 * b[4 * k + 3] + b[4 * k + 4]))), '') AS simhash FROM v")
def str04(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "documents").select("doc_id", F.explode(F.array(F.struct(F.split("text", " ").alias("w")))).alias("x"))
    made = rows.select("doc_id", F.explode(F.array(F.struct(T.shingle_halves(F.col("x.w")).alias("h")))).alias("y"))
    return made.select("doc_id", T.simhash_of(F.col("y.h")).alias("simhash"))


@query("str05_hamming", "SELECT doc_id, bit_count(xor(('0x' || substr(md5(text), 1, 16))::UBIGINT, ('0x' || substr(md5(lang), 1, 16))::UBIGINT))::INT AS distance FROM documents")
def str05(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "documents").select("doc_id", T.hamming_hex(F.substring(F.md5("text"), 1, 16), F.substring(F.md5("lang"), 1, 16)).alias("distance"))


@query("str07_folded", f"SELECT doc_id, sha256({FOLD}) AS folded FROM documents")
def str07(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "documents").select("doc_id", F.sha2(T.folded(F.col("text")), 256).alias("folded"))


@query("str08_token_phrase", f"SELECT doc_id, contains(' ' || array_to_string(regexp_extract_all({FOLD}, '[a-z0-9]+'), ' ') || ' ', ' of the ') AS has_phrase FROM documents")
def str08(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "documents").select("doc_id", T.contains_tokens(F.col("text"), F.lit("Of the")).alias("has_phrase"))


@query("str09_keyword_prefix", f"SELECT doc_id, regexp_matches({FOLD}, '(^|[^a-z0-9])thes[a-z]*') AS hit FROM documents")
def str09(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "documents").select("doc_id", T.folded(F.col("text")).rlike("(?<![a-z0-9])thes[a-z]*").alias("hit"))


@query("str10_slot_number", sql("files", "SELECT file_id, CASE WHEN len(list_distinct(regexp_extract_all(relpath, '([0-9]+)/', 1))) = 1 THEN regexp_extract(relpath, '([0-9]+)/', 1) END AS slot FROM files"))
def str10(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "files").select("file_id", T.only_match(F.col("relpath"), "([0-9]+)/").alias("slot"))


_Y = "'a ' || (1985 + id % 45) || CASE WHEN id % 3 = 0 THEN '/' || (1986 + id % 45) WHEN id % 3 = 1 THEN ' x20231015' ELSE '' END"


@query("str11_year", sql("decisions", f"SELECT sha, CASE WHEN len(y) = 1 THEN y[1] WHEN len(y) = 2 AND y[2] = y[1] + 1 THEN y[1] END AS year FROM (SELECT sha, list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(s, '[0-9]+'), lambda t: length(t) = 4), lambda t: t::INT), lambda v: v >= 1990 AND v <= 2027))) AS y FROM (SELECT sha, {_Y} AS s FROM decisions) a) b"))
def str11(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    text = F.concat(F.lit("a "), (1985 + i % 45).cast("string"), F.when(i % 3 == 0, F.concat(F.lit("/"), (1986 + i % 45).cast("string"))).when(i % 3 == 1, F.lit(" x20231015")).otherwise(""))
    return frame(spark, d, "decisions").select("sha", T.year_of(text, 2026).alias("year"))


_NR = "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN cast(id % 120 AS string) ELSE '00' || cast(id % 12 AS string) END"


@query("str13_template", sql("decisions", f"""SELECT sha, CASE WHEN category IS NOT NULL AND nr IS NOT NULL THEN subject || '/' || category || '/lab_' || pad || '_v' || nr WHEN category IS NOT NULL THEN subject || '/' || category || '/all' ELSE subject || '/all' END AS target
FROM (SELECT *, CASE WHEN length(ltrim(nr, '0')) < 2 THEN lpad(ltrim(nr, '0'), 2, '0') ELSE ltrim(nr, '0') END AS pad FROM (SELECT *, {_NR.replace('string', 'varchar')} AS nr FROM decisions) x) y"""))
def str13(spark: SparkSession, d: str) -> DataFrame:
    values = {"subject": F.col("subject"), "category": F.col("category"), "nr": F.expr(_NR)}
    return frame(spark, d, "decisions").select("sha", T.render_best(["{subject}/{category}/lab_0{nr}_v{nr}", "{subject}/{category}/all"], values).alias("target"))

@query("str14_safe_name", r"SELECT page_id, CASE WHEN n = '' THEN 'bez_nazwy' ELSE n END AS name FROM (SELECT page_id, regexp_replace(rtrim(trim(regexp_replace(url, '[<>:\"/\\|?*\x00-\x1f]', '_', 'g'))), '[. ]+$', '') AS n FROM pages) x")
def str14(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("str15_16_slug", f"SELECT doc_id, trim(substr(trim(regexp_replace({FOLD}, '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), '-') || '-' || substr(sha256(text), 1, 8) AS slug FROM documents")
def str15(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "documents").select("doc_id", F.concat_ws("-", T.slug(F.col("text"), 40), F.substring(F.sha2("text", 256), 1, 8)).alias("slug"))


@query("str17_human_size", sql("files", "SELECT file_id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KiB', round(s / 1024, 1)) ELSE printf('%.1f MiB', round(s / 1048576, 1)) END AS human FROM (SELECT file_id, size * 37 AS s FROM files) x"))
def str17(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "files").select("file_id", T.human_size(F.col("size") * 37).alias("human"))


@query("str18_excerpt", r"SELECT page_id, substr(trim(regexp_replace(regexp_replace(html, '[#>*`\[\]]', '', 'g'), '\s+', ' ', 'g')), 1, 200) AS excerpt, len(list_filter(regexp_split_to_array(html, '\s+'), lambda w: w <> '')) AS words FROM pages")
def str18(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "pages").select("page_id", T.excerpt(F.col("html")).alias("excerpt"), T.words_in(F.col("html")).cast("long").alias("words"))


_MD = "'see [[' || source || '#Head|alias]] and [[' || lang || ']] ' || chr(96) || chr(96) || chr(96) || ' [[no]] ' || chr(96) || chr(96) || chr(96) || ' [[#only]]'"


@query("str19_wiki_links", f"SELECT doc_id, nullif(trim(regexp_extract(x, '^([^#|]*)', 1)), '') AS target, nullif(trim(regexp_extract(x, '#([^|]*)', 1)), '') AS heading, nullif(trim(regexp_extract(x, '[|](.*)$', 1)), '') AS alias FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace({_MD}, '```[^`]*```', '', 'g'), '\\[\\[([^\\[\\]]+)\\]\\]', 1)) AS x FROM documents) y")
def str19(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "documents").select("doc_id", F.explode(T.wiki_links(F.expr(_MD))).alias("l")).select("doc_id", "l.target", "l.heading", "l.alias")


@query("str20_collapsed", r"SELECT doc_id, sha256(lower(regexp_replace(trim(text), '\s+', ' ', 'g'))) AS h FROM documents")
def str20(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "documents").select("doc_id", F.sha2(F.lower(F.regexp_replace(F.trim("text"), r"\s+", " ")), 256).alias("h"))


@query("str21_typed_getters", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'note' || event_id ELSE 'T ' || event_id END AS title, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'Uncategorized' END AS category, CASE WHEN event_id % 5 <> 0 THEN (props->>'k')::INT END AS level,
  CASE event_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'in-progress' END AS status, CASE event_id % 3 WHEN 0 THEN 'a|' || user_id WHEN 1 THEN 'b c|' || event_type ELSE '' END AS tags,
  CASE event_id % 4 WHEN 0 THEN 'docker:related' WHEN 1 THEN 'x' || user_id || ':near_duplicate:0.5|y:related' WHEN 2 THEN 'p:related|q:related' ELSE '' END AS relations FROM events""")
def str21(spark: SparkSession, d: str) -> DataFrame:
    from millrace.sources.files import typed

    i, e = F.col("event_id"), frame(spark, d, "events")
    text = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    user = F.col("user_id").cast("string")
    fields = {
        "title": F.when(i % 4 != 0, text('T ', i.cast("string"))),
        "category": F.when(i % 3 == 0, F.col("event_type")),
        "level": F.when(i % 5 == 0, "high").otherwise(F.get_json_object("props", "$.k")),
        "status": F.when(i % 4 == 0, "Completed").when(i % 4 == 1, "in-progress").when(i % 4 == 2, "someday"),
        "tags": F.when(i % 3 == 0, text("[a, ", user, "]")).when(i % 3 == 1, text("'b c' ,, ", F.col("event_type"))),
        "relations": F.when(i % 4 == 0, "docker").when(i % 4 == 1, text('[{"target": "x', user, '", "kind": "near_duplicate", "confidence": 0.5}, {"kind": "lost"}, {"target": "y"}]')).when(i % 4 == 2, "[p, q]"),
    }
    meta = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in fields.items()]), lambda x: x["v"].isNotNull()))
    t = e.select("event_id", typed(meta, text("notes/note", i.cast("string"), ".md")).alias("t"))
    shown = F.transform("t.relations", lambda r: F.concat_ws(":", r["target"], r["kind"], r["confidence"].cast("string")))
    return t.select("event_id", "t.title", "t.category", "t.level", "t.status", F.array_join("t.tags", "|").alias("tags"), F.array_join(shown, "|").alias("relations"))

@query("str22_quoted", r"""SELECT doc_id, '"' || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '"' AS quoted FROM documents""")
def str22(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return frame(spark, d, "documents").select("doc_id", F.concat(F.lit('"'), t, F.lit('"')).alias("quoted"))


@query("str23_middle_ellipsis", "SELECT doc_id, CASE WHEN length(text) <= 30 THEN text ELSE substr(text, 1, 15) || '…' || right(text, 14) END AS short FROM documents")
def str23(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "documents").select("doc_id", T.middle_cut(F.col("text"), 30).alias("short"))


@query("str25_note_search", "SELECT doc_id FROM documents WHERE contains(lower(source), '1') OR contains(lower(lang), 'fr')")
def str25(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "documents").where(F.lower("source").contains("1") | F.lower("lang").contains("fr")).select("doc_id")


@query("str27_source_language", sql("files content", "SELECT file_id, CASE WHEN kind IN ('text', 'code', 'other') OR kind IS NULL THEN CASE lower(extension) WHEN '.py' THEN 'python' WHEN '.txt' THEN 'plaintext' END END AS language FROM files LEFT JOIN content USING (sha)"))
def str27(spark: SparkSession, d: str) -> DataFrame:
    made: dict = {}
    f = frame(spark, d, "files", made).join(frame(spark, d, "content", made).select("sha", "kind"), "sha", "left")
    return f.select("file_id", T.source_language(F.col("filename"), F.col("kind")).alias("language"))

@query("str28_transient_error", "SELECT event_id, regexp_matches(m, '(timeout|reset|temporar|HTTP (429|5[0-9][0-9]))') AS transient FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'HTTP 503' WHEN 1 THEN 'HTTP 404' WHEN 2 THEN 'read timeout' ELSE 'denied' END AS m FROM events) x")
def str28(spark: SparkSession, d: str) -> DataFrame:
    m = F.expr("CASE event_id % 4 WHEN 0 THEN 'HTTP 503' WHEN 1 THEN 'HTTP 404' WHEN 2 THEN 'read timeout' ELSE 'denied' END")
    return frame(spark, d, "events").select("event_id", T.passing_error(m).alias("transient"))


@query("str10_slot_numbers", sql("files", "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN (file_id % 20)::VARCHAR END AS lab, CASE WHEN file_id % 3 = 1 AND file_id % 20 = (file_id + 1) % 20 THEN '1' END AS kol FROM files"))
def str10b(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("file_id")
    s = F.when(i % 3 == 0, F.concat(F.lit("Lab "), (i % 20).cast("string"), F.lit(".pdf"))).when(i % 3 == 1, F.concat(F.lit("kol_"), (i % 20).cast("string"), F.lit(" kol_"), ((i + 1) % 20).cast("string"))).otherwise(F.col("filename"))
    m = T.slot_numbers(s)
    return frame(spark, d, "files").select("file_id", F.element_at(m, "nr_laby").alias("lab"), F.element_at(m, "nr_kolosa").alias("kol"))


@query("str12_lecturer", sql("files", "SELECT file_id, CASE WHEN file_id % 4 = 0 THEN 'anna ' || package END AS lecturer FROM files"))
def str12(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("/", "package", F.when(F.col("file_id") % 4 == 0, F.concat(F.lit("dr Anna "), "package")), "filename")
    return frame(spark, d, "files").select("file_id", T.lecturer(path).alias("lecturer"))


@query("dat01_02_days", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%d') AS day FROM events")
def dat01(spark: SparkSession, d: str) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return frame(spark, d, "events").select("event_id", iso.alias("iso"), F.substring(iso, 1, 10).alias("day"))


@query("dat03_duration", "SELECT event_id, CASE WHEN s < 3600 THEN printf('%02d:%02d', s // 60, s % 60) ELSE (s // 3600) || printf(':%02d:%02d', (s % 3600) // 60, s % 60) END AS took FROM (SELECT event_id, event_id % 20000 AS s FROM events) x")
def dat03(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "events").select("event_id", T.duration(F.col("event_id") % 20000).alias("took"))


@query("mat01_confidence", "SELECT event_id, round(1 - (event_id % 9) / 18.0, 4)::DOUBLE AS confidence FROM events")
def mat01(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.similarity import confidence

    return frame(spark, d, "events").select("event_id", confidence(F.col("event_id") % 9, 8).alias("confidence"))


@query("mat02_backoff", "SELECT event_id, least(0.5 * pow(2, event_id % 10), 60.0) AS wait FROM events")
def mat02(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "events").select("event_id", F.least(F.lit(0.5) * F.pow(F.lit(2.0), F.col("event_id") % 10), F.lit(60.0)).alias("wait"))


@query("mat03_edge_width", "SELECT event_id, round(2.0 * (0.6 + 0.8 * greatest(0, least(1, value / 100))), 6) AS width FROM events")
def mat03(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "events").select("event_id", F.round(2.0 * (0.6 + 0.8 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100))), 6).alias("width"))


@query("mat04_case_table", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 9 END AS rank FROM events")
def mat04(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "events").select("event_id", F.coalesce(F.element_at(F.create_map(F.lit("click"), F.lit(1), F.lit("view"), F.lit(2)), F.col("event_type")), F.lit(9)).alias("rank"))


@query("mat05_speed", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE round(event_id * 1000 / 1048576 / (event_id % 7), 6) END AS speed FROM events")
def mat05(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return frame(spark, d, "events").select("event_id", F.when(e % 7 == 0, 0.0).otherwise(F.round(e * 1000 / 1048576 / F.when(e % 7 > 0, e % 7), 6)).alias("speed"))


@query("arr01_set06_ratios", sql("files", "WITH s AS (SELECT folder, list_distinct(list(extension)) AS e FROM files GROUP BY folder) SELECT folder, list_contains(e, '.py') AS has_code, round(len(list_intersect(e, ['.py', '.txt', '.pdf'])) / 3, 6) AS share FROM s"))
def arr01(spark: SparkSession, d: str) -> DataFrame:
    s = frame(spark, d, "files").groupBy("folder").agg(F.collect_set("extension").alias("e"))
    return s.select("folder", F.array_contains("e", ".py").alias("has_code"), F.round(F.size(F.array_intersect("e", F.array(F.lit(".py"), F.lit(".txt"), F.lit(".pdf")))) / 3, 6).alias("share"))


@query("map01_rank_lookup", sql("decisions", "SELECT sha, CASE coalesce(method, 'llm') WHEN 'manual' THEN 0 WHEN 'deterministic' THEN 1 WHEN 'heuristic' THEN 2 WHEN 'llm' THEN 3 ELSE 99 END AS rank FROM decisions"))
def map01(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.planning import RANKS

    m = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    return frame(spark, d, "decisions").select("sha", F.coalesce(F.element_at(m, F.coalesce("method", F.lit("llm"))), F.lit(99)).alias("rank"))


@query("jsn01_json_arrays", "SELECT event_id, (props->>'k')::BIGINT AS k, json_array_length('[1,' || (props->>'k') || ']')::INT AS n FROM events")
def jsn01(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return frame(spark, d, "events").select("event_id", k.cast("long").alias("k"), F.size(F.from_json(F.concat(F.lit("[1,"), k, F.lit("]")), "array<long>")).alias("n"))


@query("stm03_sliding_minute", "SELECT e.event_id, (SELECT count(*) FROM events f WHERE f.user_id = e.user_id AND f.ts <= e.ts AND f.ts >= e.ts - INTERVAL 6 HOUR) AS n FROM events e")
def stm03(spark: SparkSession, d: str) -> DataFrame:
    from millrace.streaming.rates import sliding_counts

    return sliding_counts(frame(spark, d, "events"), "user_id", "ts", 6 * 3600).select("event_id", "n")
