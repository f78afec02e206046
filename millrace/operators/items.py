"""Items of a file index: filters, canonical rows, listings and selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

GROUND_TRUTH = "ground_truth"
#: Suffixes and folders of build products, and patterns of paths that are noise among clusters.
BUILD_SUFFIXES = ["obj", "o", "ilk", "pdb", "tlog", "lastbuildstate", "idb", "exp", "res", "ncb", "suo", "sdf", "opendb", "aps", "user", "lib", "dll", "exe", "class", "pyc", "log", "tmp", "bak"]
BUILD_FOLDERS = ["Debug", "Release", "x64", "ipch", "bin", "obj", ".vs", ".git", "__pycache__", "node_modules", ".idea"]
NOISE = ["*.vcxproj*", "*.sln", "*.suo", "*/__pycache__/*", "*/node_modules/*", "*/.git/*"]
STAGES = ["discovered", "hashed", "extracted", "classified", "planned", "applied", "verified"]


def first_file(files: DataFrame) -> DataFrame:
    """(sha, first, copies): the file with the smallest id and the number of files of each content."""
    cols = [c for c in files.columns if c not in ("sha", "text")]
    return files.where("sha IS NOT NULL").groupBy("sha").agg(F.min_by(F.struct(*cols), "file_id").alias("first"), F.count(F.lit(1)).alias("copies"))


def items(content: DataFrame, decisions: DataFrame, files: DataFrame) -> DataFrame:
    """Content with its decision and its first file; contents without either stay."""
    one = first_file(files).select("sha", F.col("first.file_id").alias("file_id"), F.col("first.filename").alias("filename"), F.col("first.relpath").alias("relpath"), F.col("first.folder").alias("folder"), F.col("first.status").alias("status"), F.col("first.size").alias("size"), "copies")
    return content.select("sha", "kind").join(decisions.drop("id"), "sha", "left").join(one, "sha", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))


def not_ground_truth(keep_null: bool = True) -> Column:
    """Three readings of a null run_id exist: lists keep it, subject pages and statistics drop it, the status report counts it as planned."""
    c = F.col("run_id") != GROUND_TRUTH
    return F.coalesce(c, F.lit(keep_null))


def item_filter(df: DataFrame, *, semester: int | None = None, subject: str | None = None, category: str | None = None, action: str | None = None, status: str | None = None, kind: str | None = None, needs_review: bool | None = None, classified: bool | None = None, confidence: tuple[float | None, float | None] = (None, None), ground_truth: bool = True) -> DataFrame:
    """The AND of what is given; an omitted condition passes everything."""
    preds: list[Column] = [F.col(n) == v for n, v in (("semester", semester), ("subject", subject), ("category", category), ("action", action), ("status", status), ("kind", kind)) if v is not None]
    if needs_review is not None:
        preds.append(F.coalesce("needs_review", F.lit(0)) == int(needs_review))
    if classified is not None:
        preds.append(F.col("semester").isNotNull() == F.lit(classified))
    low, high = confidence
    if low is not None:
        preds.append(F.col("confidence") >= low)
    if high is not None:
        preds.append(F.col("confidence") <= high)
    if not ground_truth:
        preds.append(not_ground_truth())
    return reduce(lambda d, p: d.where(p), preds, df)


def confidence_bucket(c: Column, auto: float = 0.90, review: float = 0.70) -> Column:
    return F.when(c.isNull(), "brak").when(c >= auto, "auto").when(c >= review, "review").otherwise("unresolved")


def search(df: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Items whose name, path, category or hash contains the text; % and _ in it stay wildcards."""
    like = f"%{text}%"
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(like), F.lit(False)) for c in ("filename", "relpath", "category", "sha")])
    return df.where(hit).orderBy("sha").limit(limit)


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """The review order: what needs review first, then rising confidence with none first, then hash."""
    return df.orderBy(F.coalesce("needs_review", F.lit(0)).desc(), F.col("confidence").asc_nulls_first(), "sha").offset(offset).limit(limit)


def by_folder(files: DataFrame, folder: str, partners: DataFrame | None = None) -> DataFrame:
    """Contents in a folder or below it, and in the folders linked with it; of each the first by folder and path."""
    below = (F.col("folder") == folder) | F.col("relpath").startswith(folder + "/")
    rows = files.where(below)
    if partners is not None:
        rows = rows.unionByName(files.join(partners.select("folder").distinct(), "folder", "left_semi")).dropDuplicates(["file_id"])
    w = Window.partitionBy("sha").orderBy("folder", "relpath", "file_id")
    return rows.where("sha IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def under_any(df: DataFrame, path: str, roots: DataFrame, root: str, *, keep: bool) -> DataFrame:
    """Rows whose path is, or lies under, one of the roots (keep) or none of them: an equi-join on the paths above, not a prefix join."""
    top = roots.select(F.col(root).alias("_root")).distinct()
    keyed = df.select(path).distinct().withColumn("_root", F.explode(T.ancestors(F.col(path))))
    hit = keyed.join(top, "_root", "left_semi").select(path).distinct()
    return df.join(hit, path, "left_semi" if keep else "left_anti")


def pending(files: DataFrame, stage: str, duplicates: DataFrame) -> DataFrame:
    """Files ready for a stage: in the status before it and, but for hashing, not under a duplicate folder."""
    before = STAGES[STAGES.index(stage) - 1]
    rows = files.where(F.col("status") == before)
    return rows if stage == "hashed" else under_any(rows, "folder", duplicates, "folder", keep=False)


def artifact(path: Column, suffixes: list[str] = BUILD_SUFFIXES, folders: list[str] = BUILD_FOLDERS) -> Column:  # noqa: B006
    """Build products: by suffix, or under a folder of that name, whatever the case."""
    segs = F.transform(F.split(path, "/"), T.folded)
    suffix = F.regexp_extract(F.element_at(segs, -1), r"\.([^.]*)$", 1)
    return suffix.isin([x.lower().lstrip(".") for x in suffixes]) | F.arrays_overlap(F.slice(segs, F.lit(1), F.greatest(F.size(segs) - 1, F.lit(0))), F.lit([x.lower() for x in folders]))


def glob(pattern: str) -> str:
    """A file name pattern as a regular expression."""
    import fnmatch

    return fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")


def noise(path: Column, patterns: list[str] = NOISE) -> Column:  # noqa: B006
    """Whether a path matches one of the patterns."""
    return reduce(lambda a, b: a | b, [path.rlike(glob(p)) for p in patterns], F.lit(False))


def skip_reason(name: Column, is_link: Column) -> Column:
    """Why a directory entry isn't read: hidden, ignored, symlink; null if it is."""
    return F.when(name.startswith("."), "hidden").when(F.lower(name).isin("thumbs.db", "desktop.ini") | name.startswith("~$"), "ignored").when(is_link, "symlink")


def target_skip_reason(name: Column, is_dir: Column) -> Column:
    """In the curated tree only dot folders and two marker files are hidden."""
    return F.when(is_dir & name.startswith("."), "hidden").when(~is_dir & name.isin(".gitkeep", ".DS_Store"), "hidden")


def manifest(files: DataFrame, duplicates: DataFrame, matched: Column) -> DataFrame:
    """A row for each content: all paths, those matched, and a representative that doesn't lie under a duplicate folder, matched ones first, then by path."""
    bad = under_any(files.select("folder").distinct(), "folder", duplicates, "folder", keep=True).withColumn("_bad", F.lit(True))
    path = F.concat_ws("/", "package", "relpath")
    rows = files.where("sha IS NOT NULL").join(bad, "folder", "left").select("sha", path.alias("path"), matched.alias("matched"), F.col("_bad").isNull().alias("healthy"), "size")
    order = F.struct((~F.col("matched")).alias("m"), F.split("path", "/").alias("p"))
    return rows.groupBy("sha").agg(
        F.array_sort(F.collect_set("path")).alias("paths"),
        F.array_sort(F.collect_set(F.when(F.col("matched"), F.col("path")))).alias("matched_paths"),
        F.min_by(F.when(F.col("healthy"), F.col("path")), F.when(F.col("healthy"), order)).alias("source_path"),
        F.min("size").alias("size"),
    )


def review_rows(manifest_rows: DataFrame, resolved: DataFrame, only_review: bool = True) -> DataFrame:
    """The first row of each content that isn't resolved yet, in manifest order (`ord`)."""
    rows = manifest_rows.where("needs_review") if only_review else manifest_rows
    w = Window.partitionBy("sha").orderBy("ord")
    return rows.join(resolved.select("sha").distinct(), "sha", "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
