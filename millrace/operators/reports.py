"""Aggregations: duplicate reports, status and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.items import GROUND_TRUTH, not_ground_truth


def per_content(files: DataFrame) -> DataFrame:
    """Size, copies and first path of each content, and whether its copies differ in size."""
    g = files.where("sha IS NOT NULL").groupBy("sha").agg(F.min("size").alias("size"), F.max("size").alias("_m"), F.count(F.lit(1)).alias("copies"), F.min(F.concat_ws("/", "package", "relpath")).alias("first_path"))
    return g.withColumn("mixed", F.col("size") != F.col("_m")).drop("_m")


def dedup_summary(files: DataFrame) -> DataFrame:
    """One row: files by state, unique contents and bytes, duplicate copies, bytes and their share."""
    state = F.when(F.col("status") == "error", "error").when(F.col("sha").isNotNull(), "hashed").otherwise("pending")
    count = lambda s: F.count(F.when(state == s, 1)).alias(s)
    total = files.agg(count("error"), count("hashed"), count("pending"))
    good = per_content(files.where("status <> 'error'")).agg(F.count(F.lit(1)).alias("unique"), F.coalesce(F.sum("size"), F.lit(0)).alias("unique_bytes"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("dup_copies"), F.coalesce(F.sum((F.col("copies") - 1) * F.col("size")), F.lit(0)).alias("dup_bytes"))
    whole = F.col("unique_bytes") + F.col("dup_bytes")
    return total.join(good, F.lit(True)).withColumn("dup_percent", F.when(whole > 0, F.round(100 * F.col("dup_bytes") / whole, 4)).otherwise(0.0))


def exclusivity(files: DataFrame) -> DataFrame:
    """Per package: contents only it has, contents it shares, copies within it; packages without hashed files stay."""
    pairs = files.where("sha IS NOT NULL").groupBy("sha", "package").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"))
    spread = pairs.groupBy("sha").agg(F.count(F.lit(1)).alias("packages"))
    j = pairs.join(spread, "sha")
    one = j.groupBy("package").agg(F.count(F.when(F.col("packages") == 1, 1)).alias("exclusive"), F.count(F.when(F.col("packages") > 1, 1)).alias("shared"), F.sum(F.col("n") - 1).alias("copies"), F.sum("size").alias("bytes"))
    return files.select("package").distinct().join(one, "package", "left").na.fill(0)


def kind_totals(files: DataFrame, content: DataFrame) -> DataFrame:
    j = per_content(files).join(content.select("sha", "kind"), "sha", "left")
    return j.groupBy(F.coalesce("kind", F.lit("other")).alias("kind")).agg(F.count(F.lit(1)).alias("unique"), F.sum("size").alias("bytes"), F.sum("copies").alias("copies"))


def top_waste(files: DataFrame, n: int = 20) -> DataFrame:
    return per_content(files).where("copies > 1").withColumn("wasted", F.col("size") * (F.col("copies") - 1)).orderBy(F.desc("wasted"), "sha").limit(n).select("sha", "copies", "wasted")


def domain_counts(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows for each value of a domain, zeros included."""
    names = df.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    return names.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").na.fill(0, ["n"])


def histogram(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(dimension, value, n) for several columns in one pass over grouping sets; null as a dash."""
    cells = F.array(*[F.struct(F.lit(k).alias("dimension"), F.coalesce(c.cast("string"), F.lit("—")).alias("value")) for k, c in columns.items()])
    return df.select(F.explode(cells).alias("c")).groupBy("c.dimension", "c.value").agg(F.count(F.lit(1)).alias("n"))


def subject_status(decisions: DataFrame) -> DataFrame:
    """Per subject: ground truth, planned (a null run counts as planned), to review, actions, latest decision and its run."""
    truth = F.coalesce(F.col("run_id") == GROUND_TRUTH, F.lit(False))
    return decisions.groupBy("semester", "subject").agg(
        F.count(F.when(truth, 1)).alias("ground_truth"),
        F.count(F.when(~truth, 1)).alias("planned"),
        F.count(F.when(~truth & (F.col("needs_review") == 1), 1)).alias("needs_review"),
        *[F.count(F.when(~truth & (F.col("action") == a), 1)).alias(a) for a in ("copy", "media", "quarantine", "skip")],
        F.max("decided_at").alias("latest"),
        F.max_by("run_id", F.struct("decided_at", "sha")).alias("latest_run"),
    )


def stage_label(planned: Column, review: Column, truth: Column) -> Column:
    return F.when((planned > 0) & (review == 0), "plan gotowy").when(planned > 0, "plan do przeglądu").when(truth > 0, "tylko ground truth").otherwise("nietknięty")


def dashboard(catalogue: DataFrame, decisions: DataFrame) -> DataFrame:
    s = catalogue.join(subject_status(decisions), ["semester", "subject"], "left").na.fill(0, ["ground_truth", "planned", "needs_review"])
    return s.withColumn("stage", stage_label(F.col("planned"), F.col("needs_review"), F.col("ground_truth")))


def subject_detail(decisions: DataFrame) -> DataFrame:
    """Per subject and category, without ground truth and without null runs: count, to review, lowest confidence, outdated."""
    rows = decisions.where(not_ground_truth(keep_null=False))
    return rows.groupBy("semester", "subject", F.coalesce("category", F.lit("—")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("needs_review") == 1, 1)).alias("needs_review"), F.min("confidence").alias("lowest"), F.count(F.when(F.col("outdated"), 1)).alias("outdated"))


def coverage(nodes: DataFrame) -> DataFrame:
    """(subject, category, count, planned, needs_human) of rows with those flags: the matrix in long form, empty rows kept by the caller's left join."""
    return nodes.groupBy("subject", "category").agg(F.count(F.lit(1)).alias("count"), F.count(F.when(F.col("planned"), 1)).alias("planned"), F.count(F.when(F.col("needs_human"), 1)).alias("needs_human"))


def heat_map(days: DataFrame, today: str, weeks: int = 26) -> DataFrame:
    """(day, week, weekday, n, level) from the Sunday on or before today - (7 * weeks - 1) days; days after today are left out; level is the share of the busiest day."""
    spark = days.sparkSession
    start = F.date_sub(F.date_sub(F.lit(today).cast("date"), 7 * weeks - 1), F.dayofweek(F.date_sub(F.lit(today).cast("date"), 7 * weeks - 1)) - 1)
    calendar = spark.range(1).select(F.explode(F.sequence(start, F.lit(today).cast("date"))).alias("day"), start.alias("_s"))
    counts = days.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    j = calendar.join(F.broadcast(counts.join(calendar.select("day"), "day", "left_semi")), "day", "left").na.fill(0, ["n"]).join(F.broadcast(top), F.lit(True))
    return j.select("day", F.floor(F.datediff("day", "_s") / 7).cast("int").alias("week"), (F.dayofweek("day") - 1).alias("weekday"), "n", F.round(F.when(F.col("top") > 0, F.col("n") / F.col("top")).otherwise(0.0), 4).alias("level"))


def longest_streak(days: DataFrame) -> DataFrame:
    """One row: the largest number of days in a row that occur."""
    d = days.select("day").distinct()
    runs = d.withColumn("_g", F.date_sub("day", F.row_number().over(Window.orderBy("day"))))  # days of a calendar: a few thousand rows at most
    return runs.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("streak"))


def download_tree(files: DataFrame) -> DataFrame:
    """Per folder: files in all, done, failed, pending, running."""
    is_ = lambda *s: F.sum(F.when(F.col("status").isin(*s), 1).otherwise(0))
    return files.groupBy("folder").agg(F.count(F.lit(1)).alias("total"), is_("verified", "applied").alias("ok"), is_("error").alias("failed"), is_("discovered").alias("pending"), is_("extracted", "classified").alias("running"))


def kind_drift(files: DataFrame, content: DataFrame, expected: Column) -> DataFrame:
    """(was, becomes, n): contents whose stored kind isn't the one of their first file."""
    one = files.where("sha IS NOT NULL").groupBy("sha").agg(F.min_by(expected, "file_id").alias("becomes"))
    return content.select("sha", F.col("kind").alias("was")).join(one, "sha").where("was <> becomes").groupBy("was", "becomes").agg(F.count(F.lit(1)).alias("n"))
