def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as P
    from test_decontaminate import brute as leak_brute
    from test_line_dedup import brute as line_brute
    from test_minhash import brute as near_brute
    from test_mixing import brute as mix_brute

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "mix"]
    rows = {r.doc_id: r for r in docs.collect()}
    a = P.materialise(P.drop_toxic(spark, docs, sf), "t")
    assert a.columns == columns and 0 < a.count() < len(rows)
    b = P.materialise(P.drop_lines(spark, a, sf), "t")
    kept = [(r.doc_id, r.text) for r in a.collect()]
    want = line_brute(kept)
    assert b.columns == columns and {r.doc_id: r.text for r in b.collect()} == {i: t for i, (_, _, t) in want.items()}
    assert all(r.n_chars == len(r.text) for r in b.collect())
    c = P.materialise(P.drop_near(spark, b, sf), "t")
    near = near_brute([(r.doc_id, r.text) for r in b.collect()], 5)
    assert c.columns == columns and {r.doc_id for r in c.collect()} == {i for i, (_, _, k) in near.items() if k}
    e = P.materialise(P.drop_leaks(spark, c, sf), "t")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, _ in leak_brute([(r.doc_id, r.text) for r in c.collect()], items)}
    assert e.columns == columns and {r.doc_id for r in e.collect()} == {r.doc_id for r in c.collect()} - bad
    f = P.mix(spark, e, sf)
    words = [(r.doc_id, len(__import__("re").findall("[^\x20\x09-\x0d]+", r.text)), r.source) for r in e.collect()]
    assert {r.doc_id: r.copies for r in f.collect()} == mix_brute(words)


def tables(spark, tmp_path, rows, extra=(), labels=(), items=()):
    names = "".join(f", `{n}` string" for n in extra)
    spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], "doc_id long, text string, lang string, source string, n_chars long" + names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_nulls_repeats_and_clashing_names(spark, tmp_path):
    import corpus_pipeline as P

    text = "a plain text of some twenty five words that is like no other one in this small table of rows and says " + "nothing at all of use here"
    line = "this line stands in four documents"
    item = "how many apples does the old farmer keep at home"
    rows = [(None, "no id " + text, "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, text + " first\n" + line, "en", "a"), (4, text + " first\nend\n" + line, "en", "b"), (5, line, "en", "b"), (6, line, "en", "b"), (7, "x " + item, "en", "b"), (8, "rude vrakkolo", "en", "b"), (8, "other words for eight", "en", "b"), (8, "other words for eight", "en", "b")]
    extra = ["_score", "_id", "_t", "_src", "_row", "score", "n_lines", "gone", "id", "a.b"]
    sf = tables(spark, tmp_path, rows, extra, [(1, 0, 0), (None, 1, 1), (2, None, None)], [(0, item), (None, "of some twenty five words that is like"), (1, None)])
    out = P.run(spark, sf)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra, "n_tokens", "weight_ppm", "copies", "blocks"]
    got = out.collect()
    assert sorted(((r.doc_id or 0), r.text) for r in got) == sorted([(0, "no id " + text), (1, ""), (2, ""), (3, text + " first"), (5, ""), (6, line), (8, "other words for eight"), (8, "other words for eight"), (8, "rude vrakkolo")])
    assert all(r.n_chars == len(r.text) and [r[n] for n in extra] == extra and len(r.blocks) == r.copies >= 1 for r in got)


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    assert P.run(spark, tables(spark, tmp_path, [])).count() == 0

