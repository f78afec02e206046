"""Declarative classification: signals from names, folders and text, and the cascade that decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T


@dataclass(frozen=True)
class Weights:
    filename: float = 0.95
    folder: float = 0.90
    far: float = 0.12
    text: float = 0.74
    tie: float = 0.12
    cap: float = 0.89
    review: float = 0.70


def signals(rows: DataFrame, rules: DataFrame, w: Weights = Weights()) -> DataFrame:
    """(sha, category, weight) of `rows` (sha, path, text_head, forms) for `rules` (category, keyword, forms, priority): the best signal of each category. A file name weighs most; the deepest folder that matches has the full folder weight and those above less; text weighs least. A rule whose forms have nothing in common with the row's doesn't apply."""
    segs = F.split("path", "/")
    parts = rows.select("sha", "forms", F.posexplode(F.concat(F.transform(segs, T.folded), F.array(T.folded(F.coalesce("text_head", F.lit("")))))).alias("i", "s"), F.size(segs).alias("n"))
    hit = parts.join(F.broadcast(rules), (F.size(rules["forms"]) == 0) | F.arrays_overlap(parts["forms"], rules["forms"]))
    hit = hit.where(F.rlike(F.col("s"), F.concat(F.lit("(?<![a-z0-9])"), "keyword", F.lit("[a-z]*")))).select("sha", "category", "priority", "i", "n")
    place = F.when(F.col("i") == F.col("n"), "text").when(F.col("i") == F.col("n") - 1, "name").otherwise("folder")
    hit = hit.withColumn("place", place)
    deepest = hit.where("place = 'folder'").groupBy("sha").agg(F.max("i").alias("deep"))
    hit = hit.join(deepest, "sha", "left")
    weight = F.when(F.col("place") == "name", w.filename).when(F.col("place") == "text", w.text).when(F.col("i") == F.col("deep"), w.folder).otherwise(w.folder - w.far)
    return hit.withColumn("weight", F.round(weight, 4)).groupBy("sha", "category").agg(F.max("weight").alias("weight"), F.min("priority").alias("priority"))


def decide(rows: DataFrame, found: DataFrame, w: Weights = Weights()) -> DataFrame:
    """(sha, action, category, confidence, method) by the cascade: ground truth, build products only, no healthy source, media, the best signal (less for ties, decided by priority), unresolved. rows: (sha, ground_truth, ignored, healthy, media)."""
    win = Window.partitionBy("sha").orderBy(F.desc("weight"), "priority", "category")
    best = found.withColumns({"_n": F.row_number().over(win), "_same": F.count(F.lit(1)).over(Window.partitionBy("sha", "weight"))}).where("_n = 1")
    sure = F.round(F.col("weight") - F.when(F.col("_same") > 1, w.tie).otherwise(0.0), 4)
    best = best.select("sha", F.col("category").alias("_cat"), F.when(F.col("_same") > 1, F.least(sure, F.lit(w.cap))).otherwise(sure).alias("_conf"))
    j = rows.join(best, "sha", "left")
    truth = F.col("ground_truth").isNotNull()
    low = F.coalesce(F.col("_conf"), F.lit(0.0)) < w.review
    action = F.when(truth, "copy").when(F.col("ignored"), "skip").when(~F.col("healthy"), "quarantine").when(F.col("media"), "media").when(low, "quarantine").otherwise("copy")
    conf = F.when(truth, 1.0).when(F.col("ignored") | F.col("media"), 0.99).when(~F.col("healthy"), 0.0).otherwise(F.coalesce("_conf", F.lit(0.0)))
    return j.select("sha", action.alias("action"), F.when(truth, F.col("ground_truth")).when(~F.col("ignored") & F.col("healthy") & ~F.col("media") & ~low, F.col("_cat")).alias("category"), conf.alias("confidence"), F.when(truth, "manual").when(F.col("_conf").isNotNull(), "heuristic").otherwise("unknown").alias("method"))


def normalised_model_output(rows: DataFrame, known: list[str], review: float = 0.70, auto: float = 0.90) -> DataFrame:
    """Model answers with confidence clamped to 0..1: unknown categories and low confidence are quarantined, less than sure ones reviewed."""
    c = F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    bad = ~F.coalesce(F.col("category").isin(known), F.lit(False)) | (c < review)
    return rows.withColumns({"confidence": c, "action": F.when(bad, "quarantine").otherwise(F.col("action")), "needs_review": bad | (c < auto)})


#: Words of a path that leave it out, and semesters in Roman digits.
LEFT_OUT, ROMAN = ["magisterskie"], ["i", "ii", "iii", "iv", "v", "vi", "vii"]


def match_subjects(paths: DataFrame, subjects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, semester, subject, group, score), (path, reasons)) of `paths` (path) for `subjects` (semester, code, name, aliases, group, department): subjects whose name (3), code (2) or alias (1) stands as whole words in a component of the path; of each
    component and semester the best score. Semesters that the path names (sem3, SEM III) restrict all hits; a component that is the name of a group or department (from the fifth semester on) restricts the hits of its semester in the components after it.
    Reasons: missing_semester, conflicting_semesters, conflicting_groups (a hit after components of several groups), ambiguous_subject. Paths with a word that leaves them out have no hit and no reason."""
    words = lambda c: F.regexp_extract_all(T.folded(c), F.lit("[a-z0-9]+"), F.lit(0))
    parts = F.split("path", "/")
    last = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    rows = paths.select("path", F.transform(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(last)), words).alias("w"))
    rows = rows.where(~F.exists("w", lambda x: F.arrays_overlap(x, F.array(*map(F.lit, LEFT_OUT)))))
    numbers = F.flatten(F.transform("w", lambda x: F.regexp_extract_all(F.array_join(x, " "), F.lit(r"(?<![a-z0-9])sem(?:estr)?[ ]?([1-7]|vii|vi|iv|v|iii|ii|i)(?![a-z0-9])"), F.lit(1))))
    number = lambda x: F.when(x.rlike("^[1-7]$"), x).otherwise(F.array_position(F.array(*map(F.lit, ROMAN)), x).cast("string")).cast("int")
    rows = rows.withColumn("semesters", F.array_distinct(F.transform(numbers, number)))
    parts_ = rows.select("path", "semesters", F.posexplode("w").alias("i", "x"))
    labels = F.concat(F.array(F.struct(words(F.col("name")).alias("k"), F.lit(3).alias("score")), F.struct(words(F.col("code")).alias("k"), F.lit(2).alias("score"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(words(a).alias("k"), F.lit(1).alias("score"))))
    known = subjects.select("semester", F.col("code").alias("subject"), "group", F.explode(labels).alias("l")).where(F.size("l.k") > 0).select("semester", "subject", "group", F.array_join("l.k", " ").alias("k"), "l.score")
    longest = known.agg(F.max(F.size(F.split("k", " "))).alias("n")).first()["n"] or 1
    grams = parts_.select("path", "semesters", "i", F.explode(F.array_distinct(_grams(F.col("x"), longest))).alias("k"))
    hits = grams.join(known, "k").where((F.size("semesters") == 0) | F.array_contains("semesters", F.col("semester")))
    named = subjects.where("semester >= 5").select("semester", "group", F.explode(F.array("group", "department")).alias("g")).select("semester", "group", F.array_join(words(F.col("g")), " ").alias("k")).where("k <> ''").distinct()
    seen = parts_.select("path", "i", F.array_join("x", " ").alias("k")).join(named, "k").select("path", "semester", F.col("i").alias("j"), F.col("group").alias("g")).distinct()
    before = hits.select("path", "i", "semester").distinct().join(seen, ["path", "semester"]).where("j < i").groupBy("path", "i", "semester").agg(F.collect_set("g").alias("groups"))
    hits = hits.join(before, ["path", "i", "semester"], "left").where(F.col("groups").isNull() | F.array_contains("groups", F.col("group")))
    top = hits.groupBy("path", "i", "semester").agg(F.max("score").alias("best"))
    found = hits.join(top, ["path", "i", "semester"]).where("score = best").groupBy("path", "semester", "subject", "group").agg(F.max("score").alias("score"))
    told = hits.groupBy("path").agg(F.bool_or(F.size("groups") > 1).alias("mixed")).join(found.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "path", "left")
    flags = rows.select("path", F.size("semesters").alias("s")).join(told, "path", "left")
    reasons = F.array(F.when(F.col("s") == 0, "missing_semester"), F.when(F.col("s") > 1, "conflicting_semesters"), F.when(F.coalesce("mixed", F.lit(False)), "conflicting_groups"), F.when(F.col("n") > 1, "ambiguous_subject"))
    return found, flags.select("path", F.filter(reasons, lambda r: r.isNotNull()).alias("reasons"))


def _grams(words: Column, longest: int) -> Column:
    n = F.size(words)
    out = [F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>")) for k in range(1, longest + 1)]  # noqa: B023
    return F.concat(*out)


def target_of(paths: DataFrame, subjects: DataFrame) -> DataFrame:
    """(path, semester, subject, category, outdated) of curated paths SEMn/[group/](CODE)_Name/category/...; subject is null where no known code stands in the first three parts."""
    p = F.split("path", "/")
    rows = paths.select("path", F.regexp_extract(F.get(p, F.lit(0)), r"^SEM(\d+)$", 1).alias("_s"), p.alias("_p"))
    codes = F.transform(F.slice("_p", 2, 3), lambda s: F.regexp_extract(s, r"^\(?([A-Z0-9]+)\)?_", 1))
    at = F.array_position(F.transform(codes, lambda c: c != ""), True)
    rows = rows.withColumns({"semester": F.expr("try_cast(_s AS int)"), "_at": at.cast("int"), "_code": F.get(codes, (at - 1).cast("int"))})
    after = F.get(F.col("_p"), F.col("_at") + 1)
    old = F.lower(after) == "outdated"
    known = subjects.select("semester", F.col("code").alias("_code")).distinct().withColumn("_known", F.lit(True))
    j = rows.join(F.broadcast(known), ["semester", "_code"], "left")
    return j.select("path", "semester", F.when(F.col("_known"), F.col("_code")).alias("subject"), F.when(F.col("_known"), F.when(old, F.get(F.col("_p"), F.col("_at") + 2)).otherwise(after)).alias("category"), F.coalesce(old, F.lit(False)).alias("outdated"))
