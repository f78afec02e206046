"""Reading trees, texts, archives, notes, tables of lines and configuration."""

from __future__ import annotations

import io
import os
import re
import stat
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import reduce

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions import text as T
from millrace.session import ship, written
from millrace.sources.rich import Reader, text_in


def entries(folder: str) -> Iterator[tuple[str, str, int, int]]:
    """(name, kind, bytes, seconds) of a folder's entries, sorted by name; kind is folder, file, link or, for a name that isn't UTF-8, unreadable. A folder is an address that pyarrow.fs knows, or a path."""
    fs, base = pafs.FileSystem.from_uri(folder)
    if not isinstance(fs, pafs.LocalFileSystem):
        for i in sorted(fs.get_file_info(pafs.FileSelector(base)), key=lambda i: i.base_name):
            is_dir = i.type == pafs.FileType.Directory
            yield i.base_name, "folder" if is_dir else "file", 0 if is_dir else i.size, (i.mtime_ns or 0) // 10**9
        return
    for e in sorted(os.scandir(base), key=lambda e: e.name):
        if any(0xD800 <= ord(c) < 0xE000 for c in e.name):
            yield "", "unreadable", 0, 0
        elif e.is_symlink():
            yield e.name, "link", 0, 0
        else:
            info = e.stat()
            yield e.name, "folder" if stat.S_ISDIR(info.st_mode) else "file", info.st_size, info.st_mtime_ns // 10**9


def packages(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """The direct sub-folders of a root, sorted, and how many entries were skipped: links and names that aren't UTF-8. Dot names are skipped silently. One folder is listed, on the driver."""
    seen = [(name, kind) for name, kind, _, _ in entries(root) if not name.startswith(".")]
    return spark.createDataFrame(sorted((n,) for n, k in seen if k == "folder"), "package string"), sum(k in ("link", "unreadable") for _, k in seen)


LISTED = "kind string, package string, relpath string, size long, mtime string"


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, folders) below a root, level by level: the folders of a level are dealt over all tasks, so a large package is listed by many. Totals of folders are sums over their files. The binary reader hides names that begin with _; this lister keeps them.
    A folder that can't be read is an error, and so are the folders above it."""
    found, _ = packages(spark, root)
    ship(spark)
    top = root.rstrip("/")

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for package, rel in zip(pdf["package"], pdf["relpath"]):
                own = []
                try:
                    for name, kind, size, at in entries("/".join(x for x in (top, package, rel) if x)):
                        if kind in ("file", "folder") and not name.startswith((".", "~$")) and name.lower() not in ("thumbs.db", "desktop.ini"):
                            when = datetime.fromtimestamp(at, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
                            own.append((kind, package, f"{rel}/{name}" if rel else name, size if kind == "file" else 0, when))
                except OSError:
                    own = [("error", package, rel, 0, "")]
                rows += own
            yield pd.DataFrame(rows, columns=["kind", "package", "relpath", "size", "mtime"])

    level = found.select(F.lit("folder").alias("kind"), "package", F.lit("").alias("relpath"), F.lit(0).cast("long").alias("size"), F.lit("").alias("mtime"))
    every = [level]
    while not level.isEmpty():
        below = level.where("kind = 'folder'").select("package", "relpath").repartition(4 * spark.sparkContext.defaultParallelism, "package", "relpath")
        level = written(below.mapInPandas(listing, LISTED), "listing")
        every.append(level)
    rows = reduce(DataFrame.unionAll, every)
    files = rows.where("kind = 'file'").select("package", "relpath", "size", "mtime", F.lit("discovered").alias("status"))
    parts = F.split("relpath", "/")
    above = lambda n: F.transform(F.sequence(F.lit(0), n), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    sums = files.select("package", F.explode(above(F.size(parts) - 1)).alias("relpath"), "size", "mtime").groupBy("package", "relpath").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"), F.max("mtime").alias("mtime"))
    # a folder's own path is among those above an entry in it: for one that can't be read that is the folder itself
    bad = rows.where("kind = 'error'").select("package", F.explode(above(F.when(F.col("relpath") == "", 0).otherwise(F.size(parts)))).alias("relpath")).distinct().withColumn("bad", F.lit(True))
    folders = rows.where("kind = 'folder'").select("package", "relpath").join(sums, ["package", "relpath"], "left").join(bad, ["package", "relpath"], "left")
    status = F.when(F.col("bad"), "error").otherwise("discovered")
    folders = folders.select("package", "relpath", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("mtime", F.lit("")).alias("mtime"), status.alias("status"))
    return files, folders.withColumn("folder", F.when(F.col("relpath") == "", F.col("package")).otherwise(F.concat_ws("/", "package", "relpath")))


def hashed(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha) of the files below a root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(F.col("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha"))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, else as Windows-1250 with replacements."""
    ship()

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([plain(b) for b in s], dtype=object)

    return run(content)


def plain(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    try:
        return bytes(raw).decode()
    except UnicodeDecodeError:
        return bytes(raw).decode("cp1250", "replace")


def sniffed(raw: bytes) -> str | None:
    """The text of bytes that look like text: by byte order mark, else without NUL and with at most 2 % control characters; else None."""
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    if b"\0" in raw:
        return None
    out = plain(raw)
    control = sum(ord(c) < 32 and c not in "\t\n\r\f" for c in out)
    return None if out and control > 0.02 * len(out) else out


def archive_head(raw: bytes, limit: int) -> tuple[list[str], int]:
    """The first sorted names in a ZIP file and their true number; nothing for what can't be read."""
    try:
        names = sorted(n.filename for n in zipfile.ZipFile(io.BytesIO(raw)).infolist() if not n.is_dir())
    except (zipfile.BadZipFile, NotImplementedError, OSError, ValueError):
        return [], 0
    return names[:limit], len(names)


def archives(df: DataFrame, content: str, limit: int = 20) -> DataFrame:
    """`df` with names and n_names of its ZIP files."""
    ship(df.sparkSession)

    @F.pandas_udf("names array<string>, n long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            got = [archive_head(bytes(b), limit) if b is not None else ([], 0) for b in s]
            yield pd.DataFrame({"names": [g[0] for g in got], "n": [g[1] for g in got]})

    return df.withColumn("_a", run(F.col(content))).withColumns({"names": F.col("_a.names"), "n_names": F.col("_a.n")}).drop("_a")


def extracted(df: DataFrame, content: str, kind: str, max_chars: int = 20_000, readers: dict[str, Reader] | None = None) -> DataFrame:
    """`df` with text and method: plain text and code are decoded, HTML loses its tags, text inside office files is read from their XML. Kinds that need a reader of their own (images, old formats, PDF) have text where one is given or found.
    One file that can't be read is a row without text, never a failure."""
    ship(df.sparkSession)

    @F.pandas_udf("text string, method string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for raws, kinds in batches:
            got = [text_of(bytes(b), k, max_chars, readers) if b is not None else (None, "none") for b, k in zip(raws, kinds)]
            yield pd.DataFrame({"text": pd.Series([g[0] for g in got], dtype=object), "method": [g[1] for g in got]})

    return df.withColumn("_x", run(F.col(content), F.col(kind))).withColumns({"text": F.col("_x.text"), "method": F.col("_x.method")}).drop("_x")


def text_of(raw: bytes, kind: str, max_chars: int, readers: dict[str, Reader] | None = None) -> tuple[str | None, str]:
    if kind not in ("text", "code") or (readers and kind in readers):
        return text_in(raw, kind, max_chars, readers)
    found = sniffed(raw[: 4 * max_chars])
    if found is not None and re.match(r"\s*<(!doctype|html)", found, re.I):
        return re.sub(r"\s+", " ", re.sub(r"(?s)<(script|style).*?</\1>|<[^>]*>", " ", found)).strip()[:max_chars], "html"
    return (found[:max_chars], "plain") if found is not None else (None, "none")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects, one a line; lines end at \\n only, and what isn't an object fails the read."""
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST").json(path)


def notes(spark: SparkSession, root: str) -> DataFrame:
    """(path, raw) of the Markdown files below a root, none under a folder or file whose name begins with a dot."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    where = raw.select(F.col("_metadata.file_path").alias("full"), F.col("value").alias("raw"))
    base = root.rstrip("/").removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("full", "^file:/*", "/"), "^" + base.replace("\\", "\\\\") + "/", "")
    return where.select(rel.alias("path"), "raw").where(~F.exists(F.split("path", "/"), lambda s: s.startswith(".")))


def front_matter(raw: Column) -> Column:
    """The `key: value` lines between leading --- lines as a map; empty where there are none."""
    block = F.regexp_extract(raw, r"(?s)^---\n(.*?)\n---", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1).alias("k"), F.btrim(F.btrim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), F.lit("\"'")).alias("v")))
    return F.map_from_entries(F.array_distinct(entries))


#: The statuses of a note, and the kind of a relation that names none.
STATUSES, RELATED = ["not-started", "in-progress", "completed"], "related"


def listed(text: Column) -> Column:
    """A list written as [a, b] or as a, b; blanks and quotes around the items go, and so do empty items."""
    items = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*\[|\]\s*$", ""), ","), lambda x: F.btrim(F.btrim(x), F.lit("\"'")))
    return F.filter(items, lambda x: x != "")


def typed(meta: Column, path: Column) -> Column:
    """The fields of a note's front matter with their types: title (else the file's stem), category, level, status (null if unknown), tags, aliases, modified, type, and relations, given as names, a list of names, or JSON objects with a target."""
    get = lambda k: F.nullif(F.btrim(F.get(F.transform(F.filter(F.map_entries(meta), lambda e: e["key"] == k), lambda e: e["value"]), F.lit(0))), F.lit(""))
    relation = "array<struct<target:string,kind:string,confidence:double>>"
    given = get("relations")
    objects = F.filter(F.from_json(given, relation), lambda r: F.coalesce(r["target"], F.lit("")) != "")
    names = F.transform(listed(given), lambda t: F.struct(t.alias("target"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("confidence")))
    relations = F.transform(F.when(given.rlike(r"^\[\s*\{"), objects).otherwise(names), lambda r: F.struct(r["target"].alias("target"), F.coalesce(r["kind"], F.lit(RELATED)).alias("kind"), r["confidence"].alias("confidence")))
    status = F.lower(get("status"))
    return F.struct(
        F.coalesce(get("title"), F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)).alias("title"),
        F.coalesce(get("category"), F.lit("Uncategorized")).alias("category"),
        get("level").try_cast("int").alias("level"),
        F.when(status.isin(STATUSES), status).alias("status"),
        listed(get("tags")).alias("tags"),
        listed(get("aliases")).alias("aliases"),
        get("modified").alias("modified"),
        get("type").alias("type"),
        F.coalesce(relations, F.array().cast(relation)).alias("relations"),
    )


def catalogue(groups: DataFrame) -> DataFrame:
    """(semester, code, name, group), the first of each, of rows (semester, group, ord, subjects array<struct<code, name>>)."""
    flat = groups.select("semester", "group", "ord", F.posexplode("subjects").alias("i", "s")).select("semester", "group", "s.code", "s.name", "ord", "i")
    return flat.groupBy("semester", "code", "name").agg(F.min_by("group", F.struct("ord", "i")).alias("group"))


def find(cat: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (semester, key) with its code: by code whatever the case, else by alias; null if none or several fit."""
    by_code = cat.groupBy("semester", F.lower("code").alias("_k")).agg(F.min("code").alias("c1"), F.count_distinct("group").alias("n1"))
    by_alias = cat.where("alias IS NOT NULL").groupBy("semester", F.lower("alias").alias("_k")).agg(F.min("code").alias("c2"), F.count_distinct("code").alias("n2"))
    w = wanted.withColumn("_k", F.lower("key"))
    j = w.join(F.broadcast(by_code), ["semester", "_k"], "left").join(F.broadcast(by_alias), ["semester", "_k"], "left")
    return j.withColumn("code", F.when(F.col("n1") == 1, F.col("c1")).when(F.col("n1").isNull() & (F.col("n2") == 1), F.col("c2"))).drop("_k", "c1", "c2", "n1", "n2")


def curriculum(lines: DataFrame) -> DataFrame:
    """(line, semester, profile, acronym, forms) of the subject rows of `lines` (doc, line, value): header lines give the context of the rows below them, within a document."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    cells = F.split("value", ";")
    head = F.when(F.col("value").rlike(r"^Semestr \d+"), F.regexp_extract("value", r"^Semestr (\d+)", 1).cast("int"))
    prof = F.when(F.col("value").rlike("^Profil "), F.regexp_extract("value", "^Profil (.*)$", 1))
    rows = lines.withColumns({"semester": F.last(head, ignorenulls=True).over(w), "profile": F.last(prof, ignorenulls=True).over(w), "_c": cells})
    initials = F.upper(F.array_join(F.transform(F.filter(F.split(F.get("_c", F.lit(0)), " "), lambda x: F.length(x) > 2), lambda x: F.substring(x, 1, 1)), ""))
    hours = F.array_join(F.filter(F.array(*[F.when(F.try_to_number(F.get("_c", F.lit(i + 1)), F.lit("999")) > 0, F.lit(f)) for i, f in enumerate("WCLP")]), lambda x: x.isNotNull()), "")
    return rows.where((F.size("_c") > 1) & F.col("semester").isNotNull()).select("doc", "line", "semester", "profile", initials.alias("acronym"), hours.alias("forms"))


def byte_head(text: Column, limit: int = 2048) -> Column:
    """The longest prefix of at most `limit` UTF-8 bytes, no character cut."""
    b = F.encode(text, "UTF-8")
    cut = F.when(F.length(b) <= limit, b).otherwise(F.substring(b, 1, limit))
    # a cut character leaves one to three bytes that are not valid at the end
    tries = [F.when(F.is_valid_utf8(F.substring(cut, F.lit(1), F.greatest(F.length(cut) - k, F.lit(0)))), F.substring(cut, F.lit(1), F.greatest(F.length(cut) - k, F.lit(0)))) for k in range(4)]
    return F.trim(F.decode(F.coalesce(*tries), "UTF-8"))


def preview(kind: Column, head: Column, names: Column) -> Column:
    """What to show of an item: an image, its text, its list of files, or none."""
    return F.when(kind.isin("image", "pdf"), "image").when(F.coalesce(F.length(head), F.lit(0)) > 0, "text").when(F.coalesce(F.size(names), F.lit(0)) > 0, "archive").otherwise("none")


def versioned(df: DataFrame, column: str, version: int) -> DataFrame:
    """`df`, failing on the first row of another schema version."""
    return df.where(F.coalesce(F.assert_true(F.col(column) == version, F.concat(F.lit("schema version "), F.col(column).cast("string"))).isNull(), F.lit(True)))


def demo_files(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """A seeded index of n made-up files; the same rows whatever the number of partitions."""
    h = lambda k, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(m))
    exts = F.array(*map(F.lit, [".pdf", ".docx", ".txt", ".png", ".py", ".zip", ".mp4"]))
    return spark.range(n).select(F.col("id").alias("file_id"), F.concat(F.lit("Pack"), h(1, 3).cast("string")).alias("package"), F.concat(F.lit("file_"), h(2, 1000).cast("string"), F.get(exts, h(3, 7).cast("int"))).alias("filename"), h(4, 1_000_000).alias("size"))
