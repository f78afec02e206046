import numpy as np

from millrace.llm import language_id, toxicity
from millrace.llm.common import held_out, table


def bags(texts):
    return [toxicity.bag(t) for t in texts]


def test_toxicity_learns_stems_and_unseen_endings():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("aeioulmnrst"), rng.integers(2, 8)))
    texts, labels = [], []
    for i in range(600):
        w = [word() for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                w[rng.integers(60)] = "vrakk" + word()
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    m = toxicity.train(bags(texts[:400]), np.array(labels[:400]))
    p = m.score(texts[400:]) >= 0.5
    y = np.array(labels[400:]) == 1
    assert (p == y).mean() > 0.97


def test_toxicity_scores_odd_texts_and_ignores_batching():
    m = toxicity.train(bags(["good day to you all"] * 5 + ["you vile crook"] * 5), np.array([0] * 5 + [1] * 5))
    texts = ["you vile crook", None, "", "123 !!", "x" * 3_000_000, "good day"]
    got = m.score(texts)
    assert got[1] == got[2] and ((got >= 0) & (got <= 1)).all()
    assert np.allclose([m.score([t])[0] for t in texts], got)


def test_toxicity_without_labels_or_with_one_class():
    assert toxicity.train(bags([]), np.array([])).score(["a"])[0] < 0.01
    assert toxicity.train(bags(["a", "b"]), np.array([1, 1])).score(["a"])[0] > 0.99


def test_toxicity_query_on_held_out_rows(spark):
    got = toxicity.op2(spark, "/root/testdata/sf0.1").toPandas()
    labels = table(spark, "/root/testdata/sf0.1", "labels").toPandas().merge(got, on="doc_id")
    h = labels[labels.held_out]
    order = h.score.rank()
    pos = h.toxic == 1
    auc = (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert len(got) == 10_000 and auc > 0.9
    assert ((got.score >= 0.5).astype(int) == got.predicted).all()


def test_labels_conflicts_nulls_and_repeats(spark, docs, empty):
    d = docs([(i, "bad vrakkolo text here" if i % 2 else "fine and good text here") for i in range(40)])
    rows = [(i, i % 2) for i in range(40)] + [(0, 0), (1, 0), (None, 1), (2, None), (3, 7)]
    m = toxicity.learn(d, spark.createDataFrame(rows, "doc_id long, toxic int"))
    assert m.score(["vrakkolo vrakkolo"])[0] > m.score(["fine good"])[0]
    none = toxicity.learn(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(empty, none).count() == 0
    clash = toxicity.score(d.withColumn("score", d.doc_id), none)
    assert clash.columns == [*d.columns, "score"] and clash.first().score < 0.01


def test_language_of_held_out_rows(spark):
    got = language_id.op1(spark, "/root/testdata/sf0.1").toPandas()
    truth = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "lang", held_out("doc_id").alias("h")).toPandas().merge(got, on="doc_id")
    assert (truth.h == truth.held_out).all()
    h = truth[truth.h]
    assert (h.lang == h.lang_pred).mean() > 0.99
    assert got.score.between(0, 1).all()


def test_language_odd_rows(docs, empty):
    d = docs([(i, "der die das und nicht " * 5, "de") for i in range(9)] + [(100 + i, "the of and with that " * 5, "en") for i in range(9)] + [(50, None, "en"), (51, "some text", None)])
    p = language_id.learn(d)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs([(1, "und das nicht"), (2, "with that of"), (3, None), (4, ""), (5, "12 + 3"), (6, "the of and " * 100_000)]), p).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["de", "en", "und", "und", "und", "en"]
    assert got[3][1] == 0 and got[1][1] > 0.5
    assert language_id.identify(empty, p).count() == 0
    none = language_id.learn(empty)
    assert language_id.identify(docs([(1, "text")]), none).first().lang_pred == "und"


def test_bundle_is_the_sum_of_bound_and_permuted_letters():
    (_, v), = language_id.bundles(["ab"])
    zero, a, b = language_id.letter(0), language_id.letter(ord("a")), language_id.letter(ord("b"))
    want = np.roll(zero, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * zero
    assert (v == want).all()


def test_pieces_of_long_texts_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdeé .,1"), n)) for n in (0, 1, 5, 11, 12, 13, 200, 3000)] + [None, "x" * 500]
    model = toxicity.Model(rng.normal(0, 1, 1 << toxicity.BITS).astype(np.float32), 0.1)
    whole, own, vectors = model.score(texts), bags(texts), list(language_id.bundles(texts))
    monkeypatch.setattr(toxicity, "BLOCK", 12)
    monkeypatch.setattr(language_id, "GROUP", 7)
    assert np.allclose(model.score(texts), whole)
    assert all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(bags(texts), own))
    for (i, a), (j, b) in zip(language_id.bundles(texts), vectors, strict=True):
        assert i == j and (a is b is None or (a == b).all())


def test_a_large_alphabet_needs_little_memory():
    import tracemalloc

    text = "".join(chr(c) for c in np.random.default_rng(0).integers(0x4E00, 0x9FFF, 1_000_000))
    list(language_id.bundles(["warm up"]))
    tracemalloc.start()
    (_, v), = language_id.bundles([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert v is not None and peak < 400e6


def test_long_labelled_texts_are_learned_from_and_cells_are_bounded(spark, docs):
    d = docs([(i, ("word%d " % i) * 60_000 + ("vrakkolo " if i % 2 else "fine ") * 30_000) for i in range(12)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    m = toxicity.learn(d, labels)
    assert m.score(["vrakkolo vrakkolo " * 9])[0] > m.score(["fine fine " * 9])[0]
    toxicity.learn(d, labels, max_train_cells=200)


def test_no_column_name_is_reserved(spark):
    names = ["_p", "_id", "_y", "_text", "_row", "told", "a.b"]
    df = spark.createDataFrame([(1, "some text", "en", *names)], "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    for got in (language_id.identify(df, language_id.learn(df)), toxicity.score(df, toxicity.learn(df, df.selectExpr("doc_id", "1 AS toxic", "`_id`", "`_y`")))):
        assert got.columns[:10] == df.columns and got.first()[:10] == df.first()


def test_language_query_against_brute_force(spark):
    """Every text of the table by single n-grams in a loop, with the profiles that the query learns."""
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    profiles = language_id.learn(docs, usable=~held_out("doc_id"))
    got = {r.doc_id: r for r in language_id.op1(spark, sf).collect()}
    assert len(got) == docs.count()
    grams = {}

    def gram(g):
        if g not in grams:
            v = np.ones(language_id.DIM, np.int64)
            for place, c in enumerate(g):
                v = v * np.roll(language_id.letter(ord(c) if c else 0), language_id.N - 1 - place)
            grams[g] = v
        return grams[g]

    low = lambda c: (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else ""
    for r in docs.select("doc_id", "text").collect():
        x = ["", *map(low, (r.text or "")[:]), ""]
        found = [tuple(x[i - 1 : i + 2]) for i in range(1, len(x) - 1) if x[i]]
        if not found:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        total = sum(gram(g) for g in found)
        e = profiles.sharpness * (profiles.vectors @ (total / np.linalg.norm(total)))
        best = int(np.argmax(e))
        assert got[r.doc_id].lang_pred == profiles.names[best] and abs(got[r.doc_id].score - 1 / np.exp(e - e[best]).sum()) < 1e-5


def test_toxicity_query_against_brute_force(spark):
    """Every text of the table by single character n-grams in a loop, with the model that the query learns."""
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = toxicity.learn(docs, table(spark, sf, "labels"), usable=~held_out("_id"))
    got = {r.doc_id: r for r in toxicity.op2(spark, sf).collect()}
    assert len(got) == docs.count()
    weights, m32 = {}, 0xFFFFFFFF

    def weight(g):
        if g not in weights:
            h = ord(g[0]) if g[0] else 0
            for c in g[1:]:
                h = (h * 0x01000193 + (ord(c) if c else 0)) & m32
            h = ((h ^ (h >> 15)) * 0x9E3779B1 + len(g)) & m32
            weights[g] = float(model.weight[h >> (32 - toxicity.BITS)])
        return weights[g]

    low = lambda c: (c.lower() if len(c.lower()) == 1 else c) if c.isalnum() else ""
    for r in docs.select("doc_id", "text").collect():
        x = ["", *map(low, r.text or ""), ""]
        total, n = 0.0, 0
        for size in toxicity.SIZES:
            for i in range(len(x) - size + 1):
                g = tuple(x[i : i + size])
                if all(g[1:-1]):
                    total, n = total + weight(g), n + 1
        p = 1 / (1 + np.exp(-(total / (n + model.pad) + model.bias)))
        assert abs(got[r.doc_id].score - p) < 1e-6 and got[r.doc_id].predicted == int(p >= 0.5)
