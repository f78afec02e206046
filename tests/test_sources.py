import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import files as S
from millrace.sources import sinks


def test_scan_keeps_underscores_and_marks_errors(spark, tmp_path):
    (tmp_path / "A/d").mkdir(parents=True)
    (tmp_path / "B").mkdir()
    for name, text in {"A/x.txt": "abc", "A/_y.txt": "de", "A/d/z": "f", "A/.hidden": "no", "A/Thumbs.db": "no", "B/q": "1"}.items():
        (tmp_path / name).write_text(text)
    os.symlink(tmp_path / "B/q", tmp_path / "A/link")
    files, folders = S.scan(spark, str(tmp_path))
    assert {(r.package, r.relpath, r.size) for r in files.collect()} == {("A", "x.txt", 3), ("A", "_y.txt", 2), ("A", "d/z", 1), ("B", "q", 1)}
    assert {r.folder: (r.files, r.size) for r in folders.collect()} == {"A": (3, 6), "A/d": (1, 1), "B": (1, 1)}
    (tmp_path / "B/e/f").mkdir(parents=True)
    (tmp_path / "B/e/f/deep.txt").write_text("1234")
    files, folders = S.scan(spark, f"file://{tmp_path}")
    assert {r.folder: (r.files, r.size) for r in folders.where("package = 'B'").collect()} == {"B": (2, 5), "B/e": (1, 4), "B/e/f": (1, 4)}
    found, skipped = S.packages(spark, str(tmp_path))
    assert [r.package for r in found.collect()] == ["A", "B"] and skipped == 0


def test_a_folder_that_cannot_be_read_marks_those_above(spark, tmp_path, monkeypatch):
    for name in ("A/b/c/x", "A/d/y", "B/z"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    os.symlink(tmp_path / "gone", tmp_path / "B/link")
    (tmp_path / "A/b/c/x").unlink()
    (tmp_path / "A/b/c").rmdir()
    whole = S.entries

    def entries(folder):
        if folder.endswith("/A/b"):
            raise PermissionError(folder)
        return whole(folder)

    monkeypatch.setattr(S, "entries", entries)
    from pyspark import cloudpickle as spark_pickle

    spark_pickle.register_pickle_by_value(S)
    try:
        files, folders = S.scan(spark, str(tmp_path))
        assert {r.folder: r.status for r in folders.collect()} == {"A": "error", "A/b": "error", "A/d": "discovered", "B": "discovered"}
        assert files.count() == 2
    finally:
        spark_pickle.unregister_pickle_by_value(S)


def test_texts_and_archives():
    assert S.plain("zażółć".encode()) == "zażółć" and S.plain("zażółć".encode("cp1250")) == "zażółć"
    assert S.sniffed(b"\xff\xfea\0b\0") == "ab" and S.sniffed(b"a\0b") is None and S.sniffed(b"\x01\x02ab") is None and S.sniffed(b"") == ""
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n in "cab":
            z.writestr(n, "x")
    assert S.archive_head(b.getvalue(), 2) == (["a", "b"], 3) and S.archive_head(b"junk", 2) == ([], 0)
    assert S.text_of(b"<html><script>no</script><p>a <b>b</b></p>", "text", 100) == ("a b", "html") and S.text_of(b"x", "image", 9) == (None, "none") and S.text_of(b"x", "docx", 9) == (None, "none")


def test_office_files():
    from millrace.plans.q_sources import packed_office
    from millrace.sources.rich import text_in

    assert text_in(packed_office([f"line {i}" for i in range(12)], "pptx"), "pptx", 1000)[0].split("\n")[10] == "line 10"
    assert text_in(packed_office(["abcdef", "gh"], "docx"), "docx", 4) == ("abcd", "docx")
    assert text_in(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1 old", "docx", 9)[0] is None and text_in(b"x", "image", 9, {"image": lambda b: "seen"}) == ("seen", "image")
    rows = "".join(f"<table:table-row><table:table-cell><text:p>r{i}</text:p></table:table-cell><table:table-cell/></table:table-row>" for i in range(300))
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("content.xml", f"<o:body xmlns:o='o' xmlns:table='t' xmlns:text='x'><o:spreadsheet><table:table table:name='S'>{rows}</table:table></o:spreadsheet></o:body>")
    text, method = text_in(b.getvalue(), "xlsx", 10_000)
    assert method == "odf" and text.split("\n")[:2] == ["S", "r0"] and len(text.split("\n")) == 201


def test_jsonl_round_trip_with_line_separators(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\u2028b"), (2, None)], "i int, s string")
    sinks.jsonl(df, str(tmp_path / "x"), ["i"])
    assert [tuple(r) for r in S.jsonl(spark, str(tmp_path / "x"), "i int, s string").orderBy("i").collect()] == [(1, "a\u2028b"), (2, None)]
    (tmp_path / "bad.json").write_text('{"i": 1}\nnot an object\n')
    with pytest.raises(Exception):
        S.jsonl(spark, str(tmp_path / "bad.json"), "i int, s string").collect()


def test_notes_and_front_matter(spark, tmp_path):
    (tmp_path / ".obsidian").mkdir()
    (tmp_path / "d").mkdir()
    (tmp_path / ".obsidian/x.md").write_text("no")
    (tmp_path / "d/a.md").write_text("---\ntitle: \"T\"\ntag: x\n---\nbody")
    (tmp_path / "b.md").write_text("plain")
    n = S.notes(spark, str(tmp_path))
    got = {r.path: r.m for r in n.select("path", S.front_matter(F.col("raw")).alias("m")).collect()}
    assert got == {"d/a.md": {"title": "T", "tag": "x"}, "b.md": {}}


def test_byte_head(spark):
    df = spark.createDataFrame([("ab",), ("ąęć",), ("😀😀",)], "s string")
    assert [r[0] for r in df.select(S.byte_head(F.col("s"), 5)).collect()] == ["ab", "ąę", "😀"]


def test_version_gate(spark):
    df = spark.createDataFrame([(4,), (3,)], "v int")
    assert S.versioned(df.where("v = 4"), "v", 4).count() == 1
    with pytest.raises(Exception):
        S.versioned(df, "v", 4).collect()


def test_demo_index_is_the_same_every_time(spark):
    assert S.demo_files(spark, 50).collect() == S.demo_files(spark, 50).repartition(3).orderBy("file_id").collect()


def test_reports_and_graph(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "i int, s string")
    assert "a\\|b" in sinks.report({"T": df}) and "… 1 more" in sinks.report({"T": df}, 1) and "<h2>T</h2>" in sinks.html_report({"T": df})
    n = spark.createDataFrame([("x", None)], "id string, title string")
    e = spark.createDataFrame([("x", "y")], "source string, target string")
    assert [json.loads(r.json) for r in sinks.graph_json(n, e).collect()] == [{"id": "x"}, {"source": "x", "target": "y"}]


def test_reports_count_what_they_leave_out(spark):
    df = spark.range(450).withColumnRenamed("id", "i")
    assert "… 250 more" in sinks.html_report({"T": df}) and sinks.html_report({"T": df}).count("<td>") == 200 and "… 250 more" in sinks.report({"T": df})


def test_typed_front_matter(spark):
    rows = [("d/My note.md", "---\ntitle: T\nlevel: 3\nstatus: Completed\ntags: [a, 'b c', ]\naliases: x, y\nrelations: [p, q]\n---\n"), ("b.md", "---\nlevel: high\nstatus: later\nrelations: one\n---\n"), ("c", "")]
    got = {r.path: r.f for r in spark.createDataFrame(rows, "path string, raw string").select("path", S.typed(S.front_matter(F.col("raw")), F.col("path")).alias("f")).collect()}
    t = got["d/My note.md"]
    assert (t.title, t.category, t.level, t.status, t.tags, t.aliases, [tuple(x) for x in t.relations]) == ("T", "Uncategorized", 3, "completed", ["a", "b c"], ["x", "y"], [("p", "related", None), ("q", "related", None)])
    assert (got["b.md"].title, got["b.md"].level, got["b.md"].status, got["b.md"].relations[0].target) == ("b", None, None, "one") and got["c"].relations == []


def test_config_and_index(spark, tmp_path):
    from millrace.sources import index

    (tmp_path / "x.json").write_text('{"rows": [{"a": 1}, {"b": "t"}]}')
    assert index.config(spark, str(tmp_path), "gone") == {}
    doc = index.config(spark, str(tmp_path), "x")
    assert [tuple(r) for r in index.config_table(spark, doc, "rows", "a int, b string").collect()] == [(1, None), (None, "t")]
    with pytest.raises(ValueError):
        index.config_table(spark, doc, "rows", "a int")
    (tmp_path / "y.json").write_text("[1]")
    with pytest.raises(ValueError):
        index.config(spark, str(tmp_path), "y")
    i = index.Index(spark, str(tmp_path), 2)
    i.create("t", spark.range(3))
    assert i.table("t").count() == 3 and i.table("t").columns == ["id"]
    i.views("t")
    assert spark.sql("SELECT max(id) FROM t").first()[0] == 2
    with pytest.raises(Exception):
        i.create("t", spark.range(3))
    with pytest.raises(Exception):
        index.Index(spark, str(tmp_path), 3).table("t").collect()


def png(pixels, colour, kind=0):
    """An image of rows of bytes, all with one row filter (0, 1 or 2)."""
    import struct
    import zlib

    step = {0: 1, 2: 3}[colour]
    raw, above = b"", bytes(len(pixels[0]))
    for row in pixels:
        back = bytes(step) + row[:-step] if kind == 1 else above if kind == 2 else bytes(len(row))
        raw += bytes([kind]) + bytes((a - b) & 255 for a, b in zip(row, back))
        above = row
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]) // step, len(pixels), 8, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_perceptual_hash(spark):
    import math

    from millrace.sources import images

    value = lambda x, y, w: int(128 + 60 * math.sin(7 * x / w) + 50 * math.cos(5 * y / w + 2 * x / w))
    grey = lambda w: [bytes(value(x, y, w) for x in range(w)) for y in range(w)]
    one = images.perceptual_hash(png(grey(64), 0))
    assert len(one) == 16 and one == images.perceptual_hash(png(grey(64), 0, 1)) == images.perceptual_hash(png(grey(64), 0, 2))
    assert one == images.perceptual_hash(png([bytes(b for b in row for _ in range(3)) for row in grey(64)], 2))
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert apart(one, images.perceptual_hash(png(grey(96), 0))) <= 6
    assert apart(one, images.perceptual_hash(png([row[::-1] for row in grey(64)], 0))) > 12
    df = spark.createDataFrame([(bytearray(png(grey(64), 0)),), (bytearray(b"no image"),), (None,), (bytearray(png(grey(64), 0)[:60]),)], "c binary")
    assert [r[0] for r in df.select(images.phash(F.col("c"))).collect()] == [one, None, None, None]


def test_stage_logs_and_documents_as_streams(spark, tmp_path):
    from millrace.streaming import logs, rates

    (tmp_path / "scan.log").write_text("a\nexit 0\n")
    (tmp_path / "hash.log").write_text("b\nexit -2\n")
    got = rates.drain(logs.stage_log(spark, str(tmp_path)), "stage_log_test", "append")
    assert sorted((r.stage, r.event, r.text, r.code) for r in got.collect()) == [("hash", "exit", None, -2), ("hash", "line", "b", None), ("scan", "exit", None, 0), ("scan", "line", "a", None)]
    order = spark.createDataFrame([("scan", 0), ("hash", 1), ("plan", 2)], "stage string, pos int")
    ended = got.where("event = 'exit'").select("stage", "code")
    assert {r.stage: r.state for r in logs.chain(order, ended).collect()} == {"scan": "done", "hash": "failed", "plan": "stopped"}
    assert {r.stage: r.state for r in logs.chain(order, ended.where("stage = 'scan'")).collect()} == {"scan": "done", "hash": "running", "plan": "waiting"}
    for name, text in (("a.json", "{}"), ("b.json", "{}"), ("c.json", '{"x": 1}')):
        (tmp_path / name).write_text(text)
    docs = rates.drain(logs.changed(spark, str(tmp_path)), "documents_test", "append")
    assert sorted(r.value for r in docs.collect()) == ['{"x": 1}', "{}"]


def test_shared_backoff(spark):
    from millrace.streaming.rates import shared_backoff

    at = lambda s: f"2024-01-01 {s // 3600:02}:{s % 3600 // 60:02}:{s % 60:02}"
    asks = spark.createDataFrame([(i, at(s)) for i, s in enumerate((0, 10, 20, 4000, 9000))], "i int, t string").select("i", F.to_timestamp("t").alias("ts"))
    fines = spark.createDataFrame([(at(10), 5, "x"), (at(12), 4000, "y"), (at(13), 1, "z")], "t string, delay long, reason string").select(F.to_timestamp("t").alias("ts"), "delay", "reason")
    assert {r.i: (r.wait, r.reason) for r in shared_backoff(asks, fines).collect()} == {0: (0.0, None), 1: (5.0, "x"), 2: (3992.0, "y"), 3: (12.0, "y"), 4: (0.0, None)}

