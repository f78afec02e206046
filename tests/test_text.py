from pyspark.sql import functions as F

from millrace.functions import text as T


def one(spark, c, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or ["id"])
    return df.select(c.alias("x")).first().x


def test_normal_form():
    assert T.normal_form("Ｓtraße\u00ad--Ł  x") == "strasse ł x"
    assert T.normal_form(None) is None and T.normal_form("!!") == ""


def test_folding_and_slugs(spark):
    assert one(spark, T.folded(F.col("s")), s="Żółw ŁÓDŹ") == "zolw lodz"
    assert one(spark, T.slug(F.col("s"), 6), s="--Ala ma kota!") == "ala-ma"


def test_path_safety(spark):
    got = {p: one(spark, T.path_problem(F.col("p")), p=p) for p in ("a/b", "", "/a", "a\\b", "a//b", "../a", "C:/x")}
    assert got == {"a/b": None, "": "empty", "/a": "absolute", "a\\b": "backslash", "a//b": "segment", "../a": "segment", "C:/x": "absolute"}


def test_windows_names(spark):
    codes = lambda p: one(spark, T.windows_problems(F.col("p")), p=p)
    assert codes("a/b.txt") == [] and codes("a./b") == ["ends_in_dot_or_space"] and codes("a/NUL.txt") == ["reserved_name"]
    assert codes("x" * 241) == ["too_long"] and codes("a/b:c") == ["forbidden_character"]


def test_years(spark):
    year = lambda s: one(spark, T.year_of(F.col("s"), 2025), s=s)
    assert [year(s) for s in ("in 2021", "2020/2021", "2019 2021", "20231015", "1989", "2026", "2027", "2021 2021")] == [2021, 2020, None, None, None, 2026, None, 2021]


def test_hamming_and_simhash(spark):
    assert one(spark, T.hamming_hex(F.lit("ffffffffffffffff"), F.lit("0000000000000000"))) == 64
    assert one(spark, T.hamming_hex(F.lit("ff"), F.lit("0"))) is None
    df = spark.range(1).select(F.split(F.lit("a b c d e"), " ").alias("w"), F.array().cast("array<string>").alias("none"))
    r = df.select(T.simhash64(F.col("w")).alias("x"), T.simhash64(F.col("none")).alias("y")).first()
    assert len(r.x) == 16 and r.y is None


def test_ancestors(spark):
    assert one(spark, T.ancestors(F.col("p")), p="a/b/c") == ["a", "a/b", "a/b/c"]
    assert one(spark, T.ancestors(F.col("p"), inclusive=False), p="a") == []


def test_links(spark):
    got = one(spark, T.wiki_links(F.col("m")), m="x [[A#H|b]] ```\n[[no]]\n``` [[#only]] [[ C ]]")
    assert [(l.target, l.heading, l.alias) for l in got] == [("A", "H", "b"), (None, "only", None), ("C", None, None)]


def test_sizes_times_and_cuts(spark):
    assert one(spark, T.human_size(F.lit(1536))) == "1.5 KiB" and one(spark, T.human_size(F.lit(12))) == "12 B"
    assert one(spark, T.duration(F.lit(3725))) == "1:02:05" and one(spark, T.duration(F.lit(65))) == "01:05" and one(spark, T.duration(F.lit(None).cast("double"))) == "—"
    assert one(spark, T.middle_cut(F.col("s"), 5), s="abcdefgh") == "ab…gh"
    assert one(spark, T.safe_name(F.col("s")), s=" a:b?. ") == "a_b_" and one(spark, T.safe_name(F.col("s")), s="...") == "bez_nazwy"


def test_slots_lecturers_and_errors(spark):
    assert one(spark, T.slot_numbers(F.col("s")), s="Laboratorium 3 - kol_2 kol_4") == {"nr_laby": "3"}
    assert one(spark, T.lecturer(F.col("p")), p="x/Drzewa/dr inż. Kowalski/a.pdf") == "inz. kowalski"
    assert one(spark, T.lecturer(F.col("p")), p="x/drzewa") is None
    assert [one(spark, T.passing_error(F.col("m")), m=m) for m in ("HTTP 503", "429 Client Error", "http 404", "Read timed out")] == [True, True, False, True]


def test_kinds(spark):
    assert [one(spark, T.kind_of(F.col("e")), e=e) for e in (".PDF", "csv ", "", ".nope", "tgz")] == ["pdf", "xlsx", "other", "other", "archive"]


def test_templates(spark):
    from millrace.functions.text import render, render_best

    df = spark.createDataFrame([("S", "lab", "3"), ("S", "lab", "0012"), ("S", "lab", "00"), ("S", None, "3"), (None, "", None)], "s string, c string, n string")
    v = {"s": F.col("s"), "c": F.col("c"), "n": F.col("n")}
    got = [tuple(r) for r in df.select(render("{s}/{c}_0{n}/{n}x", v), render_best(["{s}/{c}/k_0{n}", "{s}/{c}"], v), render("{missing}", v)).collect()]
    assert got == [("S/lab_03/3x", "S/lab/k_03", None), ("S/lab_12/0012x", "S/lab/k_12", None), ("S/lab_00/00x", "S/lab/k_00", None), (None, "S", None), (None, "", None)]


def test_languages(spark):
    from millrace.functions.text import source_language

    df = spark.createDataFrame([("a.PY", "code"), ("a.py", "pdf"), ("x/.py", None), ("b.h", ""), ("c.unknown", "text"), ("d", None), ("e.tar.toml", None)], "f string, k string")
    assert [r[0] for r in df.select(source_language(F.col("f"), F.col("k"))).collect()] == ["python", None, None, "c", None, None, "ini"]


def test_prompts_and_addresses(spark):
    from millrace.functions.parse import prompt, resource

    df = spark.createDataFrame([("{{B}}", None)], "a string, b string")
    assert df.select(prompt("{{A}}-{{B}}-{{C}} {x}", {"A": F.col("a"), "B": F.col("b")})).first()[0] == "{{B}}-(none)-{{C}} {x}"
    i = "a" * 20
    rows = {f"https://d/document/d/{i}/e": ("doc", i), f"x/folders/{i}?a=1": ("folder", i), f"https://d/uc?export=1&id={i}": ("file", i), f"https://d/?id={i}": ("unknown", i), f" {i} ": ("unknown", i), "short": ("unknown", None), "": ("unknown", None)}
    got = spark.createDataFrame([(k,) for k in rows], "u string").select("u", resource(F.col("u")).alias("r")).collect()
    assert {r.u: (r.r.kind, r.r.id) for r in got} == rows

