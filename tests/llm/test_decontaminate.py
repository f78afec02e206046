import re

from millrace.llm import decontaminate as D
from millrace.llm.decontaminate import UNITS

ITEMS = [
    (0, "The train from Warsaw covers 120 km in 2 hours while the slow bus needs 3 hours for it."),
    (1, "Short item."),
    (2, "seven plain words make one whole window"),
    (3, None),
    (4, "A farmer named John sold 15 kg of red apples and John kept 4 kg of green apples at home."),
]


def tokens(text):
    out, before = [], None
    for x in re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n]", text or ""):
        if x in ".!?\n":
            kind = ""
        elif x[0].isdigit():
            kind = "<num>"
        elif x.lower() in UNITS and before and before[0].isdigit():
            kind = "<unit>"
        elif re.match(r"[A-ZÀ-Þ][a-zà-ÿ]", x) and before is not None and before not in ".!?\n":
            kind = "<name>"
        else:
            kind = x.lower()
        before = x
        if kind:
            out.append((kind, x.lower()))
    return out


def windows(text, lengths):
    t = tokens(text)
    for n in lengths:
        for i in range(len(t) - n + 1):
            w = t[i : i + n]
            if sum(not c.startswith("<") for c, _ in w) >= -(-n // 2) + 1:
                yield i, tuple(c for c, _ in w), tuple(v for c, v in w if c.startswith("<"))


def brute(rows, items):
    own = [(k, tpl, slots) for k, t in items if len(tokens(t)) > 1 for _, tpl, slots in windows(t, [min(8, len(tokens(t)))])]
    lengths = {len(tpl) for _, tpl, _ in own}
    out = {}
    for i, t in rows:
        held = {}
        for at, x, s in windows(t, lengths):
            held.setdefault(x, []).append((at, s))
        for k, tpl, slots in own:
            for at, s in held.get(tpl, []):
                if len(set(zip(slots, s))) == len(set(slots)) == len(set(s)):
                    found = out.setdefault((i, k), (set(), set()))
                    found[0].add(at)
                    if s == slots:
                        found[1].add(at)
    return {key: (len(a), len(b)) for key, (a, b) in out.items()}


def got(spark, docs, rows, items=ITEMS):
    found = D.leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all((r.kind == "verbatim") == (r.n_exact > 0) for r in found)
    return {(r.doc_id, r.item_id): (r.n_windows, r.n_exact) for r in found}


ROWS = [
    (1, "Some words first. " + ITEMS[0][1] + " And more."),
    (2, "the train from Berlin covers 90 km in 5 hours while the slow bus needs 7 hours for it"),
    (3, "the train from Berlin covers 90 km in 90 hours while the slow bus needs 7 hours for it"),
    (4, "nothing to see here"),
    (5, "A farmer named Mary sold 15 kg of red apples and Peter kept 4 kg of green apples at home."),
    (6, "we say seven plain words make one whole window every day"),
    (7, "SEVEN PLAIN WORDS, MAKE: ONE (whole) WINDOW"),
    (8, None),
    (9, ""),
    (10, "seven plain words make one. Whole window"),
    (11, "x " * 50_000 + ITEMS[4][1] + " y" * 50_000),
]


def test_agrees_with_brute_force(spark, docs):
    assert got(spark, docs, ROWS) == brute(ROWS, ITEMS)


def test_slots_must_agree(spark, docs):
    found = got(spark, docs, ROWS)
    assert found[1, 0][1] > 0 and found[2, 0][1] == 0 and (6, 2) in found and (7, 2) in found
    assert {i for i, _ in found} == {1, 2, 3, 5, 6, 7, 11} | {i for i, _ in brute(ROWS, ITEMS)}


def test_pairs_that_are_not_broadcast(spark, docs, monkeypatch):
    with_pairs = got(spark, docs, ROWS)
    monkeypatch.setattr(D, "PAIRS", 0)
    assert got(spark, docs, ROWS) == with_pairs


def test_items_of_numbers_only_and_how_items_are_looked_for(spark, docs):
    items = [(0, "What is 12 + 7 ?"), (1, "Compute 3 x 4 x 5"), (2, "12 + 7 - 4"), (3, "word"), (4, ITEMS[0][1]), (5, None)]
    rows = [(i, f"so: {t} Yes.") for i, t in items] + [(7, "What is 12 + 8 ?"), (8, "4 - 7 + 12")]
    assert set(got(spark, docs, rows, items)) == {(0, 0), (1, 1), (2, 2), (4, 4)}
    told = {r.item_id: r.way for r in D.ways(spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert told == {0: "words", 1: "words", 2: "words", 3: "none", 4: "template", 5: "none"}


def test_many_documents_share_a_leak(spark, docs):
    rows = [(i, f"intro {i} " + ITEMS[4][1]) for i in range(300)]
    assert len(got(spark, docs, rows)) == 300


def test_empty_tables_and_clashing_columns(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.leaks(empty, items).count() == 0
    assert D.leaks(docs(ROWS), items.where("1 = 0")).count() == 0
    d = docs(ROWS)
    d = d.withColumns({"tpl": d.doc_id, "_k": d.doc_id, "item_id": d.doc_id})
    kept = D.decontaminate(d, items)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[0] for r in ROWS} - {i for i, _ in brute(ROWS, ITEMS)})
    assert set(kept.columns) == set(d.columns)


def test_null_ids_stay(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.decontaminate(docs([(None, ITEMS[0][1]), (1, ITEMS[0][1])]), items).count() == 1


def test_items_without_enough_literals_are_found_word_for_word(spark, docs):
    items = [(0, "Compute 12 + 30 - 4 and 7 + 9 - 2"), (1, "Die Summe der Zahlen 3 und 4 aus Berlin und Hamburg Nord"), (2, "Say: 5 of 6")]
    rows = [(i, f"he asks: {t}. More.") for i, t in items] + [(9, "Compute 12 + 31 - 4 and 7 + 9 - 2")]
    assert set(got(spark, docs, rows, items)) == {(0, 0), (1, 1), (2, 2)}


def test_first_word_of_a_short_item_in_mid_line(spark, docs):
    items = [(0, "Divide the sum of apples by 7"), (1, "Short item.")]
    rows = [(1, "we then Divide the sum of apples by 7"), (2, "so Divide the sum of apples by 9"), (3, "see Short item here"), (4, "Divide the sum of apples by 7")]
    found = got(spark, docs, rows, items)
    assert set(found) == {(1, 0), (2, 0), (3, 1), (4, 0)} and found[2, 0][1] == 0 < found[1, 0][1]


def test_the_sql_states_the_same_rows(spark, docs):
    """Items of numbers, one window, capitalised first words and shared templates, against the SQL of the query."""
    import duckdb
    import pandas as pd

    items = ITEMS + [(10, "What is 12 + 7 ?"), (11, "Compute 3 x 4 x 5"), (12, "12 + 7 - 4"), (13, "Divide the sum of apples by 7"), (14, "Short item."), (15, "Die Summe der Zahlen 3 und 4 aus Berlin und Hamburg Nord"), (16, "word")]
    rows = ROWS[:-1] + [(100 + i, f"he says: {t} and More, {t}") for i, t in items] + [(200, "we Divide the sum of apples by 9"), (201, "What is 12 + 8 ?"), (202, "see Short item here")]
    c = duckdb.connect()
    c.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = c.execute(D.SQL).df()
    found = D.leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string")).toPandas()
    as_set = lambda df: set(df[["doc_id", "item_id", "n_windows", "n_exact", "kind"]].itertuples(index=False, name=None))
    assert as_set(found) == as_set(want) and len(want) > 15

