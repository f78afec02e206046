import hashlib
import math

from millrace.llm.mixing import mix, schedule


def brute(rows, entropy=0.98, most=4.0):
    """rows (doc_id, n_tokens, source) -> copies"""
    total = {}
    for _, n, s in rows:
        total[s] = total.get(s, 0) + n
    logs = [math.log(t) for t in total.values() if t > 0]
    if not logs:
        return {i: 1 for i, _, _ in rows}
    top = max(logs)

    def h(m):
        a = m / 1e6
        z = sum(math.exp(a * (x - top)) for x in logs)
        return math.log(z) - sum(math.exp(a * (x - top)) * a * (x - top) for x in logs) / z

    lo, hi = 0, 1_000_000
    for _ in range(21):
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if h(mid) >= entropy * math.log(len(logs)) - 1e-12 else (lo, mid - 1)
    spread = top - min(logs)
    least = max(0, math.ceil((1 - math.log(most) / spread) * 1e6 - 1e-6)) if spread > 0 else 0
    alpha = max(lo, least) / 1e6
    big, out = max(total.values()), {}
    for s, t in total.items():
        own = sorted((r for r in rows if r[2] == s), key=lambda r: r[0])
        if not t:
            out.update({i: 1 for i, _, _ in own})
            continue
        budget = max(t, round(t * math.exp((1 - alpha) * math.log(big / t))))
        epochs, rest, used = budget // t, budget % t, 0
        for i, n, _ in sorted(own, key=lambda r: (hashlib.md5(f"{epochs}:{r[0]}".encode()).hexdigest(), str(r[0]))):
            used += n
            out[i] = epochs + (rest > 0 and used <= rest)
    return out


def rows_of(spec):
    out = []
    for s, n, size in spec:
        for k in range(n):
            out.append((len(out), size + k % 3, s))
    return out


def copies(docs, rows, **options):
    return {r.doc_id: r.copies for r in mix(docs([(i, "w " * n, "en", s) for i, n, s in rows]), **options).collect()}


def test_agrees_with_brute_force(docs):
    rows = rows_of([("a", 200, 30), ("b", 40, 20), ("c", 15, 10), ("d", 5, 4)])
    got = copies(docs, rows)
    assert got == brute(rows) and min(got.values()) >= 1


def test_cells_do_not_change_the_result(docs):
    rows = rows_of([("a", 300, 9), ("b", 90, 7), ("c", 30, 5)])
    assert copies(docs, rows, cells=2) == copies(docs, rows, cells=4096) == brute(rows)


def test_repetition_limit_and_budget(docs):
    rows = rows_of([("a", 400, 50), ("b", 20, 10)])
    got = copies(docs, rows, target_entropy=1.0, max_repetition=2.0)
    spent = sum(got[i] * n for i, n, s in rows if s == "b")
    total = sum(n for _, n, s in rows if s == "b")
    assert max(got.values()) <= 2 and 2 * total - 12 <= spent <= 2 * total


def test_odd_rows(docs, empty):
    got = {(r.doc_id, r.source): (r.n_tokens, r.copies) for r in mix(docs([(1, None, "en", "a"), (2, "", "en", None), (3, "one two", "en", None), (4, "x", "en", "b")])).collect()}
    assert got[1, "a"] == (0, 1) and got[2, None][0] == 0 and got[3, None][0] == 2
    assert mix(empty).count() == 0
    assert {r.copies for r in mix(docs([(1, None), (2, "")])).collect()} == {1}


def test_repeated_rows_and_clashing_columns(spark, docs):
    d = docs([(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, "d", "en", "t")]).withColumn("copies", docs([(1,)]).select("doc_id").first().doc_id * __import__("pyspark").sql.functions.lit(9))
    got = mix(d)
    assert got.count() == 3 and sorted(got.columns) == sorted([*docs([(1,)]).columns, "n_tokens", "weight_ppm", "copies", "blocks"])


def test_blocks_hold_the_weights_and_a_permutation_each(docs):
    rows = rows_of([("a", 900, 30), ("b", 300, 20), ("c", 120, 10)])
    mixed = mix(docs([(i, "w " * n, "en", s) for i, n, s in rows]), block_tokens=5000)
    got = schedule(mixed).collect()
    of, size = {i: s for i, _, s in rows}, {i: n for i, n, _ in rows}
    assert sorted((r.doc_id, r.epoch) for r in got) == sorted((r.doc_id, e) for r in mixed.collect() for e in range(r.copies))
    want = {r.source: r.weight_ppm / 1e6 for r in mixed.collect()}
    blocks = {}
    for r in got:
        blocks.setdefault(r.block, []).append(r)
    assert sorted(blocks) == list(range(len(blocks))) and len(blocks) > 5
    for b in blocks.values():
        assert sorted(r.place for r in b) == list(range(len(b)))
        total = sum(size[r.doc_id] for r in b)
        assert all(abs(sum(size[r.doc_id] for r in b if of[r.doc_id] == s) / total - w) < 0.12 for s, w in want.items())


def test_no_column_name_is_reserved(spark):
    names = ["_src", "_i", "_key", "_row", "id", "src", "n", "key", "cell", "s", "a.b", "Copies"]
    df = spark.createDataFrame([(i, "a b c", "x", *[f"{n}{i}" for n in names]) for i in range(3)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = mix(df)
    assert got.columns == ["doc_id", "text", "source", *names[:-1], "copies", "n_tokens", "weight_ppm", "blocks"]
    assert {(r.doc_id, *[r[n] for n in names[:-1]]) for r in got.collect()} == {(i, *[f"{n}{i}" for n in names[:-1]]) for i in range(3)}
