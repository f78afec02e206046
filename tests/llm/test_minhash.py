import random
import re

from millrace.llm.components import components
from millrace.llm.minhash_dedup import dedup, near_duplicates

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids, top = sorted(sets), {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def check(rows, docs, k=4):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs(rows), k=k).collect()}
    assert got == brute(rows, k)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def test_groups_with_a_spread_of_similarities(docs):
    rng = random.Random(5)
    rows, i = [], 0
    for g in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        for n in [0, 0, 1, 2, 3, 4, 5, 6, 8, 12] * 4:
            rows.append((i, edited(rng, base, n)))
            i += 1
    rows += [(i + j, " ".join(f"x{rng.randrange(10**6)}" for _ in range(40))) for j in range(60)]
    check(rows, docs)


def test_large_nodes_branch(docs, monkeypatch):
    from millrace.llm import minhash_dedup

    monkeypatch.setattr(minhash_dedup, "SMALL", 6)
    rng = random.Random(9)
    passage = [f"p{j}" for j in range(60)]
    rows = [(i, " ".join(passage + [f"u{i}_{j}" for j in range(rng.randrange(4, 40))])) for i in range(120)]
    check(rows, docs)


def test_large_nodes_of_middling_similarity_and_blocks_at_the_last_level(docs, monkeypatch):
    from millrace.llm import minhash_dedup

    monkeypatch.setattr(minhash_dedup, "SMALL", 6)
    monkeypatch.setattr(minhash_dedup, "DEPTH", 1)
    rng = random.Random(4)
    base = [f"w{j}" for j in range(100)]
    rows = [(i, edited(rng, base, rng.choice((1, 3, 6, 9, 12)))) for i in range(90)]
    rows += [(200 + i, " ".join(base[:45] + [f"u{i % 9}_{j}" for j in range(55)] + [f"t{i}"])) for i in range(40)]
    check(rows, docs)


def test_blocks_of_a_large_group(docs, monkeypatch):
    from millrace.llm import minhash_dedup

    monkeypatch.setattr(minhash_dedup, "BLOCK_DOCS", 8)
    rng = random.Random(2)
    base = [f"w{j}" for j in range(90)]
    check([(i, edited(rng, base, i % 5)) for i in range(60)], docs)
    chain = [f"c{j}" for j in range(160)]
    check([(i, " ".join(chain[2 * i : 2 * i + 60])) for i in range(48)], docs)


def test_odd_texts(docs):
    check([(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "one  two"), (7, "É a b c d"), (8, "é a b c d"), (9, "one two three")], docs)


def test_empty_table_null_id_and_repeated_rows(docs, empty):
    assert near_duplicates(empty).count() == 0
    got = near_duplicates(docs([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 7, True), (7, 7, True), (7, 7, True), (8, 7, False)]


def test_rows_that_repeat_an_id_with_other_texts(docs):
    a, b, c = (" ".join(f"{x}{j}" for j in range(30)) for x in "abc")
    d = docs([(1, a), (1, b), (2, a + " end"), (3, b + " end"), (5, a + " more"), (5, c), (6, c + " end"), (None, a)])
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(d, k=4).collect())
    assert got == [(0, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 1, False), (5, 5, True), (6, 5, False)]
    assert sorted((r.doc_id or 0, r.text) for r in dedup(d, k=4).collect()) == [(0, a), (1, a), (1, b), (5, c)]


def test_dedup_keeps_all_columns_whatever_their_names(spark):
    names = ["_id", "t", "n", "f1", "gone", "_row", "a.b"]
    df = spark.createDataFrame([(i, "one text of some words", *names) for i in range(3)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    assert dedup(df).collect() == df.where("doc_id = 0").collect() and dedup(df).columns == df.columns


def test_very_long_text(docs):
    words = " ".join(f"w{j % 9973}-{j % 7}" for j in range(200_000))
    got = {r.doc_id: r.component_id for r in near_duplicates(docs([(1, words), (2, words + " end"), (3, "short text of a few words")])).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 130), 100)}


def test_few_links_take_one_task_and_no_rounds(spark, monkeypatch):
    from millrace.llm import components as C

    chain = list(range(1, 200))
    random.Random(3).shuffle(chain)
    links = [*zip(chain, chain[1:]), *((500, i) for i in range(501, 560)), (700, 700), (801, 800), (800, 801), (801, 800)]
    want = {**{i: 1 for i in chain}, **{i: 500 for i in range(500, 560)}, 800: 800, 801: 800}
    written, materialise = [], C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, label: written.append(label) or materialise(df, label))
    df = spark.createDataFrame(links, "a long, b long")
    rows = [tuple(r) for r in C.components(df).collect()]
    assert written == ["links"] and len(rows) == len(want) and dict(rows) == want
    assert C.components(df.where("a < 0")).collect() == []
    rows = [tuple(r) for r in C.components(df, in_one=0).collect()]  # the loop, for more links than a task takes
    assert len(written) > 5 and len(rows) == len(want) and dict(rows) == want
