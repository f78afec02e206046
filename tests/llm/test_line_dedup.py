import re

from millrace.llm.line_dedup import dedup_lines

LONG = "this line has more than twenty"


def brute(rows, least=20, docs=3):
    strip = re.compile("^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: strip.sub("", x).translate(low)
    where = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            where.setdefault(k, []).append(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(where[key(x)]) >= docs and i < max(where[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def check(rows, docs, **options):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in dedup_lines(docs(rows), **options).collect()}
    assert got == brute(rows)


def test_keeps_the_largest_id_and_strips_keys(docs):
    check([(1, LONG + "\nown"), (2, "  " + LONG.upper() + "\t"), (3, LONG), (4, "other " + LONG)], docs)


def test_batches_and_compaction_agree_with_brute_force(docs):
    rows = [(i, "\n".join(f"shared line number {(i * k) % 7:>12}" for k in range(6)) + f"\nonly in {i}") for i in range(60)]
    check(rows, docs, batches=7, fanout=2)


def test_nulls_empty_texts_and_repeats_in_one_document(docs):
    check([(1, None), (2, ""), (3, LONG + "\n" + LONG), (4, LONG), (5, "\n" + LONG), (6, "É" * 20), (7, "É" * 20), (8, "é" * 20)], docs)


def test_short_or_rare_lines_stay(docs):
    check([(1, "short"), (2, "short"), (3, "short"), (4, LONG), (5, LONG)], docs)


def test_null_id_is_below_all(docs):
    got = {r.doc_id: r.text for r in dedup_lines(docs([(None, LONG), (1, LONG), (2, LONG)])).collect()}
    assert got == {None: "", 1: "", 2: LONG}


def test_empty_table_and_clashing_columns(spark, empty):
    assert dedup_lines(empty).count() == 0
    df = spark.createDataFrame([(1, LONG, "a", 5), (2, LONG, "b", 6), (3, LONG, "c", 7)], "doc_id long, text string, h1 string, n_lines int")
    got = dedup_lines(df)
    assert sorted((r.doc_id, r.h1, r.n_lines, r.text) for r in got.collect()) == [(1, "a", 1, ""), (2, "b", 1, ""), (3, "c", 1, LONG)]


def test_no_column_name_is_reserved(spark):
    names = ["_id", "_t", "_drop", "_lines", "_keys", "_row", "id", "t", "lines", "drop", "keeper", "a.b", "N_Dropped"]
    df = spark.createDataFrame([(i, LONG, *[f"{n}{i}" for n in names]) for i in range(3)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = dedup_lines(df)
    assert got.columns == ["doc_id", "text", *names[:-1], "n_dropped", "n_lines"]
    assert {(r.doc_id, *[r[n] for n in names[:-1]]) for r in got.collect()} == {(i, *[f"{n}{i}" for n in names[:-1]]) for i in range(3)}


def test_very_long_text(docs):
    big = "\n".join(f"{LONG} {i % 5000}" for i in range(20_000))
    check([(1, big), (2, big), (3, big + "\nend")], docs)
