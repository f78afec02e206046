import hashlib

from pyspark.sql import functions as F

from millrace.operators import graph as G
from millrace.operators import planning as P
from millrace.operators import rules as R
from millrace.operators import similarity as S
from millrace.operators import tree
from millrace.operators.items import confidence_bucket, item_filter, under_any

FILES = "file_id long, package string, relpath string, folder string, size long, mtime string, sha string, status string"


def files(spark, *paths):
    rows = []
    for i, (path, sha) in enumerate(paths):
        package, rel = path.split("/", 1)
        rows.append((i, package, rel, path.rsplit("/", 1)[0], 10 + i, "2024-01-01T00:00:00Z", sha, "hashed"))
    return spark.createDataFrame(rows, FILES)


def folders(spark, f):
    from millrace.functions.text import ancestors

    return f.select(F.explode(ancestors(F.col("folder"))).alias("folder")).distinct()


def test_equal_trees_and_component_order(spark):
    f = files(spark, ("P/AKO2020/x", "1"), ("P/AKO2020/d/y", "2"), ("P/AKO2020 (1)/x", "1"), ("P/AKO2020 (1)/d/y", "2"), ("Q/z", None))
    h = tree.folder_hashes(f, folders(spark, f))
    state = {r.folder: r.state for r in h.collect()}
    assert state["Q"] == "incomplete" and state["P/AKO2020"] == "hashed"
    d = tree.duplicates(h)
    assert {(r.folder, r.duplicate_of) for r in d.collect()} == {("P/AKO2020 (1)", "P/AKO2020"), ("P/AKO2020 (1)/d", "P/AKO2020/d")}
    assert {r.folder for r in tree.topmost(d).collect()} == {"P/AKO2020 (1)"}
    assert tree.canonical_broken(d).count() == 0


def test_error_wins_over_incomplete(spark):
    f = files(spark, ("P/a/x", None), ("P/b/y", "1")).withColumn("status", F.when(F.col("relpath") == "a/x", "error").otherwise("hashed"))
    assert {r.folder: r.state for r in tree.folder_hashes(f, folders(spark, f)).collect()} == {"P": "error", "P/a": "error", "P/b": "hashed"}


def test_prefix_relations_ignore_wildcards(spark):
    df = spark.createDataFrame([("a_b",), ("a_b/c",), ("axb/c",), ("a_bc",)], "folder string")
    roots = spark.createDataFrame([("a_b",)], "r string")
    assert {r.folder for r in under_any(df, "folder", roots, "r", keep=True).collect()} == {"a_b", "a_b/c"}
    assert {r.folder for r in under_any(df, "folder", roots, "r", keep=False).collect()} == {"axb/c", "a_bc"}


def test_overlap_guards(spark):
    sets = spark.createDataFrame([(f"f{i}", "s") for i in range(5)] + [("f0", "t"), ("f1", "t")], "folder string, sha string")
    pairs, skipped = tree.common_counts(sets, max_folders=3)
    assert [tuple(r) for r in pairs.collect()] == [("f0", "f1", 1)] and skipped == 1
    assert tree.common_counts(sets, max_pairs=1) == (None, 0)


def test_overlap_counts_contents_of_many_folders(spark):
    wide = spark.createDataFrame([(f"f{i:03}", "s") for i in range(300)] + [("f000", "t"), ("f001", "t"), ("f299", "u")], "folder string, sha string")
    pairs, skipped = tree.common_counts(wide)
    got = {(r.a, r.b): r.common for r in pairs.collect()}
    assert len(got) == 300 * 299 // 2 and got["f000", "f001"] == 2 and got["f000", "f299"] == 1 and skipped == 0
    # over 5,000,000 pairs of occurrences
    sets = spark.range(260).select(F.col("id").cast("string").alias("sha")).crossJoin(spark.range(200).select(F.col("id").cast("string").alias("folder")))
    pairs, _ = tree.common_counts(sets)
    assert pairs.count() == 200 * 199 // 2 and [r.common for r in pairs.select("common").distinct().collect()] == [260]


def test_bands_cover_64_bits():
    for k in range(9):
        b = S.bands(k)
        assert len(b) == k + 1 and sum(w for _, w in b) == 64 and all(x + w == y for (x, w), (y, _) in zip(b, b[1:]))


def sigs(spark, rows):
    return spark.createDataFrame(rows, "sha string, text_hash string, simhash string, phash string, year string, folders array<string>, chars int")


def flip(n):
    return f"{(1 << 64) - 1 ^ ((1 << n) - 1):016x}"


def test_distances_and_bucket_guard(spark):
    rows = sigs(spark, [(f"s{n}", None, flip(n), None, None, [], 0) for n in (0, 3, 4, 8, 9)])
    near, skipped = S.distance_pairs(rows, "simhash", 3)
    assert {tuple(r) for r in near.collect()} == {("s0", "s3", 3), ("s3", "s4", 1), ("s8", "s9", 1)} and skipped.first().skipped == 0
    _, skipped = S.distance_pairs(rows, "simhash", 3, max_bucket=2)
    assert skipped.first().skipped > 0


def test_pairs_in_large_buckets_are_found(spark):
    import random

    r = random.Random(5)
    values = [r.getrandbits(64) & ~0xFF | i % 4 for i in range(6)]
    values += [v ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 9))) for v in values for _ in range(20)]
    rows = sigs(spark, [(f"s{i:03}", None, f"{v:016x}", None, None, [], 0) for i, v in enumerate(values)])
    for limit in (3, 8):
        want = {(f"s{i:03}", f"s{j:03}", d) for j, y in enumerate(values) for i, x in enumerate(values[:j]) if (d := (x ^ y).bit_count()) <= limit}
        near, skipped = S.distance_pairs(rows, "simhash", limit, max_bucket=2)
        assert [tuple(x) for x in near.orderBy("left", "right").collect()] == sorted(want) and skipped.first().skipped > 0


def test_relations_layers(spark):
    rows = sigs(spark, [
        ("a", "h", flip(0), None, "2020", ["f"], 100), ("b", "h", flip(0), None, "2021", ["g"], 100),
        ("c", "i", flip(8), None, None, ["f"], 100), ("d", "j", "00000000ffffffff", "ffff000000000000", None, ["x"], 10), ("e", "k", "0f0f0f0f0f0f0f0f", "ffff000000000001", None, ["y"], 10),
    ])
    got = {(r.src, r.tgt, r.type): (r.confidence, r.method) for r in S.relations(rows).collect()}
    assert got["a", "b", "older_version"] == (1.0, "near_dupe:text_hash")
    assert got["a", "c", "related"] == (round(round(1 - 8 / 18, 4) * 0.6 + 0.05, 4), "near_dupe:related")
    assert ("b", "c", "related") not in got and got["d", "e", "near_duplicate"][1] == "near_dupe:phash"


def test_clusters(spark):
    links = spark.createDataFrame([("b", "c"), ("c", "d"), ("a", "d"), ("x", "y")], "src string, tgt string")
    assert {r.node: r.cluster for r in S.clusters(links).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_upsert_tells_null_from_not_supplied(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    c = spark.createDataFrame([(1, None), (3, "new")], "k int, v string")
    assert {tuple(r) for r in P.upsert(t, c, ["k"], ["v"]).collect()} == {(1, None, "x"), (2, "b", "y"), (3, "new", None)}


def test_plan_hash_ignores_order(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(20)], "a int, b string")
    h = P.plan_hash(df, "a", "b").first()[0]
    assert h == P.plan_hash(df.orderBy(F.desc("a")), "b", "a").first()[0] != P.plan_hash(df.where("a > 0"), "a", "b").first()[0]


def test_disambiguation_falls_back_to_the_hash(spark):
    rows = spark.createDataFrame([("s1" * 8, "copy", "T/f.txt", "P/a/x/f.txt"), ("s2" * 8, "copy", "T/f.txt", "P/b/x/f.txt"), ("s3" * 8, "copy", "T/g.txt", "P/g.txt"), ("s4" * 8, "copy", "T/h", "P/q/h"), ("s5" * 8, "copy", "T/h", "P/q/h")], "sha string, action string, target string, source string")
    got = {r.sha[:2]: r.target for r in P.disambiguated(rows).collect()}
    assert got == {"s1": "T/a/x/f.txt", "s2": "T/b/x/f.txt", "s3": "T/g.txt", "s4": "T/s4s4s4s4_h", "s5": "T/s5s5s5s5_h"}


def test_transitions(spark):
    df = spark.createDataFrame([("hashed", "planned"), ("planned", "hashed"), ("planned", "planned"), ("error", "hashed"), ("error", "discovered"), ("verified", "error")], "a string, b string")
    assert [r[0] for r in df.select(P.transition(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, True, True]


def test_classification_cascade(spark):
    rules = spark.createDataFrame([("lab", "lab", [], 10), ("exam", "kolo", [], 20), ("proj", "proj", ["P"], 30)], "category string, keyword string, forms array<string>, priority int")
    rows = spark.createDataFrame([
        ("n", "P/x/Lab1.pdf", "", ["W"]), ("f", "P/kolokwia/lab/x.pdf", "", ["W"]), ("t", "P/x/y.pdf", "to jest kolokwium", ["W"]), ("p", "P/projekt.pdf", "", ["W"]), ("tie", "P/lab kolo.pdf", "", ["W"]), ("gt", "P/q", "", ["W"]), ("ig", "P/lab.o", "", ["W"]), ("q", "P/lab", "", ["W"]),
    ], "sha string, path string, text_head string, forms array<string>")
    found = R.signals(rows, rules)
    best = {(r.sha, r.category): r.weight for r in found.collect()}
    assert best["n", "lab"] == 0.95 and best["f", "lab"] == 0.9 and best["f", "exam"] == 0.78 and best["t", "exam"] == 0.74 and ("p", "proj") not in best
    flags = rows.select("sha", F.when(F.col("sha") == "gt", "truth").alias("ground_truth"), (F.col("sha") == "ig").alias("ignored"), (F.col("sha") != "q").alias("healthy"), F.lit(False).alias("media"))
    got = {r.sha: (r.action, r.category, r.confidence) for r in R.decide(flags, found).collect()}
    assert got == {"n": ("copy", "lab", 0.95), "f": ("copy", "lab", 0.9), "t": ("copy", "exam", 0.74), "p": ("quarantine", None, 0.0), "tie": ("copy", "lab", 0.83), "gt": ("copy", "truth", 1.0), "ig": ("skip", None, 0.99), "q": ("quarantine", None, 0.0)}


def test_subject_match(spark):
    schema = "semester int, code string, name string, aliases array<string>, `group` string, department string"
    subjects = spark.createDataFrame([(1, "AKO", "Architektura komputerow", ["arch"], None, None), (2, "AKO", "Inna architektura", None, None, None), (5, "SI", "Sieci", [], "ISI", "KASK"), (5, "SI2", "Sieci", [], "IS", None)], schema)
    want = {
        "SEM I/Architektura komputerów/x.txt": ({(1, "AKO", 3)}, []),
        "sem2/ako": ({(2, "AKO", 2)}, []),
        "ako notes": ({(1, "AKO", 2), (2, "AKO", 2)}, ["missing_semester", "ambiguous_subject"]),
        "akord": (set(), ["missing_semester"]),
        "sem1 sem2/arch": ({(1, "AKO", 1)}, ["conflicting_semesters"]),
        "sem5/kask/sieci": ({(5, "SI", 3)}, []),
        "sem5/sieci/kask": ({(5, "SI", 3), (5, "SI2", 3)}, ["ambiguous_subject"]),
        "sem5/isi/is/sieci": ({(5, "SI", 3), (5, "SI2", 3)}, ["conflicting_groups", "ambiguous_subject"]),
        "magisterskie/sem1/ako": (set(), None),
    }
    found, reasons = R.match_subjects(spark.createDataFrame([(p,) for p in want], "path string"), subjects)
    told = {r.path: list(r.reasons) for r in reasons.collect()}
    got = {p: (set(), told.get(p)) for p in want}
    for r in found.collect():
        got[r.path][0].add((r.semester, r.subject, r.score))
    assert got == want


def test_link_tiers_and_ghosts(spark):
    notes = spark.createDataFrame([("1", "a/Docker.md", "Docker", ["dk"]), ("2", "b/docker.md", "docker", []), ("3", "c.md", "c", ["Docker"])], "id string, path string, stem string, aliases array<string>")
    links = spark.createDataFrame([("s", "A/docker"), ("s", "DOCKER"), ("s", "DK"), ("s", "gone")], "source string, target_text string")
    assert {r.target_text: (r.id, r.tier, r.ambiguous) for r in G.resolve(links, notes).collect()} == {"A/docker": ("1", 0, False), "DOCKER": ("1", 1, True), "DK": ("1", 2, False), "gone": (None, None, False)}


def test_hierarchy_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b", "belongs_to"), ("b", "c", "belongs_to"), ("c", "a", "belongs_to"), ("x", "y", "belongs_to")], "source string, target string, kind string")
    assert {r.node: r.descendants for r in G.descendants(G.parents(e)).collect()} == {"a": 2, "b": 2, "c": 2, "y": 1}


def test_filters(spark):
    df = spark.createDataFrame([(1, 1, "copy", 0.5, None, None), (2, 1, "skip", None, 1, "ground_truth"), (3, None, None, None, None, None)], "i int, semester int, action string, confidence double, needs_review int, run_id string")
    ids = lambda **k: {r.i for r in item_filter(df, **k).collect()}
    assert ids() == {1, 2, 3} and ids(classified=False) == {3} and ids(ground_truth=False) == {1, 3} and ids(needs_review=False) == {1, 3} and ids(confidence=(0.5, 0.5)) == {1}
    got = spark.createDataFrame([(0.9,), (0.7,), (0.69,), (None,)], "c double").select(confidence_bucket(F.col("c"))).collect()
    assert [r[0] for r in got] == ["auto", "review", "unresolved", "brak"]


def test_best_name_prefers_telling_names(spark):
    rows = spark.createDataFrame([(1, "Kopia egzamin.pdf"), (1, "IMG_20190312_123456.jpg"), (1, "AiSD_2012_egzamin.jpg"), (1, "egzamin (1).pdf"), (2, "scan12.pdf"), (2, "b.pdf")], "k int, name string")
    assert {r.k: r.best for r in P.best_name(rows, "k", "name").collect()} == {1: "AiSD_2012_egzamin.jpg", 2: "b.pdf"}


def test_build_products_and_noise(spark):
    from millrace.operators.items import artifact, noise

    df = spark.createDataFrame([("a/Debug/x.c",), ("a/x.OBJ",), ("a/debug.c",), ("p/.git/x",), ("p/x.sln",)], "p string")
    assert [tuple(r) for r in df.select(artifact(F.col("p")), noise(F.col("p"))).collect()] == [(True, False), (True, False), (False, False), (True, True), (False, True)]


def test_ancestors_of_a_deep_chain(spark):
    p = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(100)], "child string, parent string")
    pairs = G.ancestor_pairs(p)
    assert pairs.count() == 101 * 100 // 2 and pairs.where("node = 'n0' AND above = 'n100'").first().steps == 100
    assert {r.node: r.found for r in G.nearest_of_type(p, spark.createDataFrame([("n40", "t"), ("n99", "t")], "id string, type string"), "t").where("node IN ('n0', 'n39', 'n40', 'n98')").collect()} == {"n0": "n40", "n39": "n40", "n40": "n99", "n98": "n99"}


def test_listed_children_that_close_a_cycle(spark):
    p = spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x"), ("z", "y"), ("x", "z")], "child string, parent string")
    seen = spark.createDataFrame([("c", "a"), ("c", "c"), ("c", "d"), ("a", "b"), ("b", "c"), ("z", "x"), ("z", "a")], "parent string, child string")
    got = {(r.parent, r.child): r.status for r in G.listed(seen, p).collect()}
    assert {k for k, v in got.items() if v == "cycle"} == {("c", "a"), ("c", "c"), ("z", "x")} and len(got) == 7


def test_anchors(spark):
    n = spark.createDataFrame([("a", None, 4), ("b", "a", 1), ("c", "gone", 9), ("d", "c", 0), ("e", "c", 400)], "id string, parent string, weight long")
    at = {r.id: (r.x, r.y) for r in G.anchors(n).collect()}
    away = lambda x, y: ((at[x][0] - at[y][0]) ** 2 + (at[x][1] - at[y][1]) ** 2) ** 0.5
    assert at["b"] == at["a"] and abs((at["a"][0] ** 2 + at["a"][1] ** 2) ** 0.5 - 120) < 1e-6
    assert abs(away("c", "d") - max(120, 22 * 21 / 3.141592653589793)) < 1e-6 and len(at) == 5


def test_siblings(spark):
    n = spark.createDataFrame([("1", "t", "łan"), ("2", "t", "lot"), ("3", "u", "a"), ("4", None, "a"), ("5", "t", "mama"), ("6", "t", "x")], "id string, type string, title string")
    p = spark.createDataFrame([(i, "6") for i in "12345"], "child string, parent string")
    assert {r.id: r.pos for r in G.siblings(n, p, ["u", "t"]).collect()} == {"3": 1, "2": 2, "1": 3, "5": 4, "4": 5, "6": 1}


def test_vault_groups_and_ghosts(spark):
    d = spark.createDataFrame([(s, 1, "S", "c") for s in "abcd"] + [("e", 1, "S", None), ("f", 1, "S", None)], "sha string, semester int, subject string, category string")
    f = spark.createDataFrame([(s, "p", f"{s if s == 'd' else 'dir'}/{s}") for s in "abcdef"] + [("a", "a", "top")], "sha string, package string, relpath string")
    r = spark.createDataFrame([("a", "b", "near", 0.9), ("x", "a", "near", 0.8), ("x", "y", "near", 0.7)], "src string, tgt string, type string, confidence double")
    nodes, edges = G.vault(d, f, r)
    assert {(n.id, n.kind, n.members) for n in nodes.collect() if n.kind not in ("file", "semester", "subject")} == {("SEM1/S/c", "category", 4), ("SEM1/S/inne", "category", 2), ("SEM1/S/c/dir", "group", 2), ("x", "ghost", 0)}
    got = {(e.source, e.target, e.kind) for e in edges.collect()}
    assert {("a", "SEM1/S/c", "belongs_to"), ("b", "SEM1/S/c/dir", "belongs_to"), ("e", "SEM1/S/inne", "belongs_to"), ("a", "b", "near"), ("a", "x", "near"), ("SEM1/S/c/dir", "SEM1/S/c", "belongs_to")} <= got and len(got) == 2 + 6 + 1 + 1 + 2


def test_equal_values_in_blocks(spark):
    rows = spark.createDataFrame([(f"s{i:02}", "v" if i < 30 else "w") for i in range(33)] + [("x", ""), ("y", None)], "sha string, text_hash string")
    got = {tuple(r) for r in S.equal_pairs(rows, "text_hash", block=4).collect()}
    assert got == {(f"s{i:02}", f"s{j:02}") for j in range(33) for i in range(j) if (i < 30) == (j < 30)}


def test_findings_of_rows_without_a_target(spark):
    p = spark.createDataFrame([("a", "copy", "T/x", 0.9, "T"), ("b", "copy", "t/X", 0.05, "T"), ("c", "skip", None, None, "T"), ("c", "skip", None, None, "T"), ("d", "skip", "T/x", 0.5, "T")], "sha string, action string, target string, confidence double, subject_dir string")
    truth = spark.createDataFrame([], "target string, sha string")
    got = sorted((r.sha, r.code) for r in P.findings(p, truth).collect())
    assert got == [("a", "collision"), ("b", "collision"), ("b", "low_confidence"), ("b", "outside_subject"), ("c", "duplicate_row"), ("c", "duplicate_row")]
    counts = P.blocking(P.findings(p, truth)).first()
    assert (counts.errors, counts.warnings, counts.blocking, counts.blocking_strict) == (5, 1, 5, 6)


def test_overview_tells_why_a_plan_cannot_be_applied(spark):
    p = spark.createDataFrame([("a", "copy", "T/x", 1), ("b", "media", "T/d/y", 0), ("c", "skip", None, 0)], "sha string, action string, target string, needs_review int")
    none = spark.createDataFrame([], "level string")
    states = spark.createDataFrame([("a", "new")], "sha string, state string")
    r = P.overview(p, none, states).first()
    assert (r.items, r.needs_review, r.files, r.folders, r.new, r.can_apply, r.reason) == (3, 1, 2, 2, 1, True, "")
    assert P.overview(p, none, states.replace("new", "outside")).first().reason == "operations"
    assert P.overview(p, spark.createDataFrame([("error",)], "level string"), states).first().reason == "findings"
    assert {(x.part, x.path) for x in P.tree_diff(p).collect()} == {("file", "T/x"), ("file", "T/d/y"), ("folder", "T"), ("folder", "T/d")}


def test_ground_truth_reuses_hashes_and_spares_manual_decisions(spark):
    seen = spark.createDataFrame([("SEM1/A/x", 1, "t", "h1"), ("SEM1/A-b/x", 2, "t", "h1"), ("SEM2/B/y", 3, "t", "h2"), ("SEM2/B/z", 4, "t", "h3")], "path string, size long, mtime string, now string")
    known = spark.createDataFrame([("SEM2/B/y", "old", "ground_truth:3:t"), ("SEM2/B/z", "older", "ground_truth:9:t"), ("gone", "g", "ground_truth:1:t")], "path string, sha string, stamp string")
    decided = spark.createDataFrame([("h3", "manual", None), ("old", "manual", "ground_truth")], "sha string, method string, run_id string")
    rows, made = P.ground_truth(seen, known, decided, F.col("now"))
    assert {r.path: (r.sha, r.reused) for r in rows.collect()} == {"SEM1/A/x": ("h1", False), "SEM1/A-b/x": ("h1", False), "SEM2/B/y": ("old", True), "SEM2/B/z": ("h3", False)}
    assert {r.sha: (r.path, r.semester, r.subject, r.rest) for r in made.collect()} == {"h1": ("SEM1/A/x", 1, "A", "x"), "old": ("SEM2/B/y", 2, "B", "y")}
    assert P.ground_truth(seen, known, decided, F.col("now"), partial=True)[0].where("path = 'gone'").count() == 1


def test_canonical_folder_under_a_duplicate_and_chains_are_reported(spark):
    d = spark.createDataFrame([("P/b", "Q/a/c"), ("Q/a", "R"), ("R", "S")], "folder string, duplicate_of string")
    assert {r.folder for r in tree.canonical_broken(d).collect()} == {"P/b", "Q/a"}
    assert [tuple(r) for r in tree.chains(d).collect()] == [("Q/a", "R")]



def test_equal_pairs_keep_dictionaries(spark, tmp_path):
    rows = [(hashlib.sha256(f"{v}-{i}".encode()).hexdigest(), f"h{v}") for v in range(12) for i in range(60)] + [("alone", "h99"), ("none", None), ("empty", "")]
    pairs = S.equal_pairs(spark.createDataFrame(rows, "sha string, text_hash string"), "text_hash", block=20)
    pairs.write.option("parquet.dictionary.page.size", 16384).option("compression", "uncompressed").parquet(str(tmp_path / "pairs"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "pairs")).collect()))
    assert got == sorted((a, b) for a, u in rows for b, w in rows if u and u == w and a < b) and len(got) == 12 * 60 * 59 // 2
    # two values of 64 characters a pair; a task's few blocks fit a dictionary
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 40 * len(got)
