"""Plans: decisions, collisions, conflicts, checks, states and table changes. Changes return the new table; nothing is updated in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.tree import multiset_hash

RANKS = {"manual": 0, "deterministic": 1, "heuristic": 2, "llm": 3, "unknown": 99}


def best_decision(rows: DataFrame, order: str) -> DataFrame:
    """One row for each content by the rank of its method; a missing method counts as llm, and among equals the earliest stays. `dropped` is how many lost."""
    pairs = [F.lit(x) for kv in RANKS.items() for x in kv]
    rank = F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce("method", F.lit("llm"))), F.lit(99))
    w = Window.partitionBy("sha")
    return rows.withColumns({"_n": F.row_number().over(w.orderBy(rank, order)), "dropped": F.count(F.lit(1)).over(w) - 1}).where("_n = 1").drop("_n")


def disambiguated(rows: DataFrame) -> DataFrame:
    """Rows (sha, action, target, source) that share a target although their contents differ get 1 to 3 of their nearest source folders in front of the name: the fewest at which the whole group differs, else eight digits of the hash."""
    counted = rows.where(F.col("action").isin("copy", "media")).groupBy("target").agg(F.count_distinct("sha").alias("_c"))
    j = rows.join(counted, "target", "left")
    clash = F.col("action").isin("copy", "media") & (F.coalesce("_c", F.lit(0)) > 1)
    folders = F.split(T.parent(F.col("source")), "/")
    head, name = T.parent(F.col("target")), F.element_at(F.split("target", "/"), -1)

    def level(k: int) -> Column:
        near = F.array_join(F.slice(folders, F.greatest(F.size(folders) - k + 1, F.lit(1)), F.lit(k)), "/")
        return F.concat_ws("/", head, near, name)

    j = j.withColumns({f"_p{k}": F.when(clash, level(k)) for k in (1, 2, 3)})
    w = j.where(clash).groupBy("target").agg(F.count(F.lit(1)).alias("_rows"), *[F.count_distinct(f"_p{k}").alias(f"_u{k}") for k in (1, 2, 3)])
    j = j.join(w, "target", "left")
    stem = F.concat_ws("/", head, F.concat(F.substring("sha", 1, 8), F.lit("_"), name))
    new = reduce(lambda c, k: c.when(F.col(f"_u{k}") == F.col("_rows"), F.col(f"_p{k}")), (2, 3), F.when(F.col("_u1") == F.col("_rows"), F.col("_p1"))).otherwise(stem)
    return j.select("sha", "action", "source", F.when(clash, new).otherwise(F.col("target")).alias("target"), clash.alias("disambiguated"))


def conflicts(plan: DataFrame, applied: DataFrame) -> DataFrame:
    """(key, kind, contents): targets, whatever their case, that several contents want, or that another content already has; the latter wins as kind."""
    p = plan.groupBy(F.lower("target").alias("key")).agg(F.collect_set("sha").alias("want"))
    a = applied.groupBy(F.lower("target").alias("key")).agg(F.collect_set("sha").alias("has"))
    j = p.join(a, "key", "left")
    taken = F.col("has").isNotNull() & (F.size(F.array_except("want", "has")) > 0)
    kind = F.when(taken, "applied").when(F.size("want") > 1, "plan")
    return j.select("key", kind.alias("kind"), F.size("want").cast("long").alias("contents")).where("kind IS NOT NULL")


def findings(plan: DataFrame, ground_truth: DataFrame, padding: int = 2) -> DataFrame:
    """(level, code, sha, target): what is wrong with plan rows (sha, action, target, confidence, subject_dir)."""
    moved = F.col("action").isin("copy", "media")
    # sums by key instead of windows: rows without a target have no key to meet under
    same = plan.groupBy("sha").agg(F.count(F.lit(1)).alias("_same")).where("_same > 1")
    ends = plan.where(moved & F.col("target").isNotNull()).groupBy(F.lower("target").alias("_key")).agg(F.min("sha").alias("_min"), F.max("sha").alias("_max"))
    rows = plan.join(same, "sha", "left").join(ends, F.lower("target") == F.col("_key"), "left")
    rows = rows.join(ground_truth.select(F.lower("target").alias("_gt"), F.col("sha").alias("_gs")).groupBy("_gt").agg(F.min("_gs").alias("_gs")), F.lower("target") == F.col("_gt"), "left")
    tests = [
        ("error", "duplicate_row", F.col("_same") > 1),
        ("error", "unsafe_path", moved & T.path_problem(F.col("target")).isNotNull()),
        ("error", "windows_name", moved & (F.size(T.windows_problems(F.col("target"))) > 0)),
        ("error", "collision", moved & (F.col("_min") != F.col("_max"))),
        ("error", "overwrites_ground_truth", moved & F.col("_gs").isNotNull() & (F.col("_gs") != F.col("sha"))),
        ("error", "outside_subject", moved & ~F.col("target").startswith(F.concat("subject_dir", F.lit("/")))),
        ("error", "confidence", F.col("confidence").isNotNull() & ~F.col("confidence").between(0, 1)),
        ("warning", "low_confidence", F.col("confidence") < 0.1),
    ]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(lv).alias("level"), F.lit(code).alias("code"))) for lv, code, c in tests]), lambda x: x.isNotNull())
    return rows.select("sha", "target", F.explode(found).alias("f")).select("f.level", "f.code", "sha", "target")


LEVELS = ["error", "warning", "info"]


def blocking(found: DataFrame) -> DataFrame:
    """One row: errors, warnings, and how many findings stop a plan, also if warnings count too."""
    count = lambda level: F.count(F.when(F.col("level") == level, 1))
    return found.agg(count("error").alias("errors"), count("warning").alias("warnings")).withColumns({"blocking": F.col("errors"), "blocking_strict": F.col("errors") + F.col("warnings")})


def worst(found: DataFrame, *by: str) -> DataFrame:
    """(*by, level): the gravest level among the findings of each group; groups without findings have no row."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    return found.where(rank > 0).groupBy(*by).agg(F.min_by("level", rank).alias("level"))


def tree_diff(plan: DataFrame) -> DataFrame:
    """(part, path): the files that a plan adds and the distinct folders that hold them."""
    files = plan.where(F.col("action").isin("copy", "media") & (F.coalesce("target", F.lit("")) != "")).select(F.lit("file").alias("part"), F.col("target").alias("path"))
    head = T.parent(F.col("path"))
    return files.union(files.select(F.lit("folder"), F.when(head == "", ".").otherwise(head)).distinct())


def build_meta(decided: DataFrame, conflicts: Column, attached: DataFrame, distinct: DataFrame) -> DataFrame:
    """One row about a plan as built: items and actions of `decided` (sha, action, target, needs_review), contents for which `conflicts` holds, rows with a relation, names made distinct, and the plan's hash."""
    actions = {f"n_{a}": F.count(F.when(F.col("action") == a, 1)) for a in ("copy", "media", "quarantine", "skip")}
    rows = decided.agg(F.count(F.lit(1)).alias("items"), *[c.alias(n) for n, c in actions.items()], F.count(F.when(F.col("needs_review") == 1, 1)).alias("needs_review"), F.count(F.when(conflicts, 1)).alias("conflicts"))
    related = attached.agg(F.count("related_to").alias("with_relation"))
    made = distinct.agg(F.count(F.when(F.col("disambiguated"), 1)).alias("disambiguated"))
    return rows.join(related, F.lit(True)).join(made, F.lit(True)).join(plan_hash(decided, "sha", "action", "target"), F.lit(True))


BLOCKERS = ["conflict", "missing_source", "outside"]


def overview(plan: DataFrame, found: DataFrame, states: DataFrame) -> DataFrame:
    """One row: what is known before a plan is applied. `found` are its findings, `states` its operations. It can be applied if no finding stops it and no operation is in a state that can't be carried out; `reason` tells which."""
    one = lambda name: F.count(F.when(F.col("state") == name, 1)).alias(name)
    rows = plan.agg(F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("needs_review") == 1, 1)).alias("needs_review"))
    parts = tree_diff(plan).agg(F.count(F.when(F.col("part") == "file", 1)).alias("files"), F.count(F.when(F.col("part") == "folder", 1)).alias("folders"))
    ops = states.agg(*[one(n) for n in ("new", "present", *BLOCKERS)])
    out = rows.join(blocking(found).drop("blocking_strict"), F.lit(True)).join(parts, F.lit(True)).join(ops, F.lit(True))
    stuck = sum((F.col(n) for n in BLOCKERS), F.lit(0)) > 0
    reason = F.when(F.col("blocking") > 0, "findings").when(stuck, "operations").otherwise("")
    return out.withColumns({"can_apply": (F.col("blocking") == 0) & ~stuck, "reason": reason})


TRUTH = "ground_truth"


def ground_truth(seen: DataFrame, known: DataFrame, decided: DataFrame, hash_of: Column, partial: bool = False) -> tuple[DataFrame, DataFrame]:
    """((path, sha, stamp, reused), (sha, path, semester, subject, rest)) of the files `seen` (path, size, mtime, and what `hash_of` reads). A file whose stamp, made of size and time, is the one in `known` (path, sha, stamp) keeps its hash, so that only
    others are read; known paths that aren't seen any more go, unless the scan is partial. Each content is classified by the smallest of its paths, compared by components; contents with a manual decision in `decided` (sha, method, run_id) other than ground truth are left alone."""
    old = known.select("path", F.col("sha").alias("_sha"), F.col("stamp").alias("_stamp"))
    now = seen.withColumn("stamp", F.concat_ws(":", F.lit(TRUTH), F.col("size").cast("string"), F.col("mtime").cast("string"))).join(old, "path", "left")
    same = F.coalesce(F.col("_stamp") == F.col("stamp"), F.lit(False))
    rows = now.select("path", F.when(same, F.col("_sha")).otherwise(hash_of).alias("sha"), "stamp", same.alias("reused"))
    if partial:
        rows = rows.unionByName(known.join(seen.select("path"), "path", "left_anti").select("path", "sha", "stamp", F.lit(True).alias("reused")))
    first = rows.where("sha IS NOT NULL").groupBy("sha").agg(F.min(F.split("path", "/")).alias("p"))
    manual = decided.where((F.col("method") == "manual") & (F.coalesce("run_id", F.lit("")) != TRUTH)).select("sha")
    semester = F.regexp_extract(F.get("p", F.lit(0)), r"^SEM(\d+)$", 1).try_cast("int")
    made = first.join(manual, "sha", "left_anti").select("sha", F.array_join("p", "/").alias("path"), semester.alias("semester"), F.when(F.size("p") > 2, F.get("p", F.lit(1))).alias("subject"), F.array_join(F.slice("p", 3, F.size("p")), "/").alias("rest"))
    return rows, made


def taken(wanted: DataFrame, *held: DataFrame) -> DataFrame:
    """(target, taken) of `wanted` (target): whether another path that is the same but for case stands in one of the tables `held` (target)."""
    every = reduce(DataFrame.unionAll, [h.select("target") for h in held]).where("target IS NOT NULL")
    ends = every.groupBy(F.lower("target").alias("_k")).agg(F.min("target").alias("_lo"), F.max("target").alias("_hi"))
    j = wanted.select("target").distinct().join(ends, F.lower("target") == F.col("_k"), "left")
    return j.select("target", F.coalesce((F.col("_lo") != F.col("target")) | (F.col("_hi") != F.col("target")), F.lit(False)).alias("taken"))


def plan_hash(plan: DataFrame, *cols: str) -> DataFrame:
    """One row: a hash that is equal for equal rows, whatever their order. Rows are hashed as JSON with sorted keys where they are, and sums of the hashes' digits are hashed in turn, so only numbers meet."""
    lines = plan.select(F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256).alias("h"))
    return lines.agg(multiset_hash("h").alias("plan_hash"))


def operations(plan: DataFrame, copies: DataFrame, listing: DataFrame) -> DataFrame:
    """(sha, target, state) of copy rows, first match of outside, missing_source, present, conflict, new. copies: (sha); listing: (target, sha) of what is on disk."""
    rows = plan.where("action = 'copy'").join(copies.select("sha").distinct().withColumn("_src", F.lit(True)), "sha", "left")
    rows = rows.join(listing.groupBy("target").agg(F.min("sha").alias("_has")), "target", "left")
    state = (
        F.when(T.path_problem(F.col("target")).isNotNull(), "outside")
        .when(F.col("_src").isNull(), "missing_source")
        .when(F.col("_has") == F.col("sha"), "present")
        .when(F.col("_has").isNotNull(), "conflict")
        .otherwise("new")
    )
    return rows.select("sha", "target", state.alias("state"))


def upsert(table: DataFrame, changes: DataFrame, key: list[str], supplied: list[str]) -> DataFrame:
    """Rows inserted, or updated in the supplied columns only: a null that was supplied overwrites, a column that wasn't doesn't."""
    c = changes.select(*[F.col(k).alias(f"_k_{k}") for k in key], *[F.col(s).alias(f"_s_{s}") for s in supplied], F.lit(True).alias("_hit"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key])
    j = table.withColumn("_old", F.lit(True)).join(c, on, "full_outer")
    out = []
    for name in table.columns:
        if name in key:
            out.append(F.when(F.col("_old"), F.col(name)).otherwise(F.col(f"_k_{name}")).alias(name))
        elif name in supplied:
            out.append(F.when(F.col("_hit"), F.col(f"_s_{name}")).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return j.select(*out)


def replace_slice(table: DataFrame, slice_: Column, new: DataFrame, protected: DataFrame, key: str = "sha") -> DataFrame:
    """The table without the slice, and the new rows whose key isn't protected; protected rows of the slice stay."""
    mine = F.coalesce(slice_, F.lit(False))
    gone = table.where(mine).select(key).distinct().join(protected.select(key), key, "left_anti")
    kept = table.where(~mine).unionByName(table.where(mine).join(gone, key, "left_anti"))
    return kept.unionByName(new.join(protected.select(key), key, "left_anti"))


def scan_changes(known: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, change) by size and time: new, changed, unchanged, missing."""
    a, b = known.select("path", F.col("size").alias("s0"), F.col("mtime").alias("m0")), seen.select("path", F.col("size").alias("s1"), F.col("mtime").alias("m1"))
    j = a.join(b, "path", "full_outer")
    change = F.when(F.col("m0").isNull(), "new").when(F.col("m1").isNull(), "missing").when((F.col("s0") == F.col("s1")) & (F.col("m0") == F.col("m1")), "unchanged").otherwise("changed")
    return j.select("path", change.alias("change"))


STATES = ["discovered", "hashed", "extracted", "classified", "planned", "applied", "verified"]


def transition(old: Column, new: Column) -> Column:
    """Whether a status may follow another: only forward; error from anywhere, and nothing out of it but discovered (a rescan)."""
    at = lambda c: F.array_position(F.array(*map(F.lit, STATES)), c)
    return F.when(new == "error", True).when(new == "discovered", True).when(old == "error", False).otherwise((at(old) > 0) & (at(new) > at(old)))


def numbered_names(rows: DataFrame, key: list[str], name: str, order: str) -> DataFrame:
    """The nth equal name gets __dupN in front of its suffix."""
    w = Window.partitionBy(*key, name).orderBy(order)
    n = F.row_number().over(w)
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return rows.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit("__dup"), (n - 1).cast("string"), suffix)))


#: Marks of copies, and names given by devices.
COPY_NAME = r"(?i)^(?:Kop(?:i)?a |Copy of )|\([1-9][0-9]*\)$| - (?:kopia|Copy)$"
DEVICE_NAME = r"(?i)^(?:IMG[-_ ]?[0-9]+|DSC[-_ ]?[0-9]+|scan[-_ ]?[0-9]*$|obraz(?: \([0-9]+\))?$|zrzut ekranu.*$|bez tytułu$|[0-9]{8}[-_ ][0-9]{6}$)"


def best_name(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The most telling file name: no copy mark, not given by a device, more parts, longer, then by name."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    parts = F.size(F.filter(F.split(stem, r"[_\s.-]+"), lambda p: p != ""))
    order = F.struct(stem.rlike(COPY_NAME).alias("a"), stem.rlike(DEVICE_NAME).alias("b"), (-parts).alias("c"), (-F.length(stem)).alias("d"), F.col(name).alias("e"))
    return rows.where(F.trim(name) != "").groupBy(key).agg(F.min_by(name, order).alias("best"))


def undo_last(log: DataFrame, user: str) -> DataFrame:
    """The log without the user's newest decision; of equal times the one with the largest hash."""
    last = log.where(F.col("decided_by") == user).agg(F.max(F.struct("decided_at", "sha")).alias("m"))
    return log.join(F.broadcast(last), (F.col("decided_by") == user) & (F.struct("decided_at", "sha") == F.col("m")), "left_anti")


def integrity(files: DataFrame, content: DataFrame, folders: DataFrame, dups: DataFrame, applied: DataFrame) -> DataFrame:
    """(check, n) of violations."""
    known = content.select("sha").distinct()
    tests = {
        "file_without_content": files.where("sha IS NOT NULL").join(known, "sha", "left_anti"),
        "content_without_file": known.join(files.select("sha"), "sha", "left_anti").join(applied.select("sha"), "sha", "left_anti"),
        "file_without_folder": files.join(folders.select("folder"), "folder", "left_anti"),
        "duplicate_of_duplicate": dups.alias("d").join(dups.select(F.col("folder").alias("t")), F.col("duplicate_of") == F.col("t"), "left_semi"),
        "negative_size": files.where("size < 0"),
        "unknown_status": files.where(~F.col("status").isin(*STATES, "error")),
        "hashed_without_hash": files.where("status = 'hashed' AND sha IS NULL"),
    }
    rows = [f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n") for name, f in tests.items()]
    return reduce(DataFrame.unionAll, rows)


def key_violations(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(table, n): how many natural keys occur more than once."""
    rows = [df.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, (df, key) in tables.items()]
    return reduce(DataFrame.unionAll, rows)


def renamed(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Paths equal to `old` or below it, moved to `new`."""
    c = F.col(column)
    return df.withColumn(column, F.when((c == old) | c.startswith(old + "/"), F.concat(F.lit(new), F.substring(c, F.lit(len(old) + 1), F.length(c)))).otherwise(c))


def applied_rows(states: DataFrame, blocking: int, at: str, plan_hash: str, dry_run: bool = True) -> DataFrame:
    """Audit rows for operations that would copy, or none where something blocks; the copying itself is the caller's."""
    rows = states.where(F.lit(blocking == 0) & (F.col("state") == "new"))
    return rows.select("sha", "target", F.lit("would copy" if dry_run else "copied").alias("action"), F.lit(plan_hash).alias("plan_hash"), F.lit(at).alias("applied_at"))


def migrated(df: DataFrame, version: int, steps: dict[int, object], current: int) -> DataFrame:
    """A table of an older version brought to `current`, step by step; a newer one is refused."""
    if version > current:
        raise ValueError(f"the table has version {version}; this engine knows {current}")
    for v in range(version, current):
        df = steps[v](df)
    return df
