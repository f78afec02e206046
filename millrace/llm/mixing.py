"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power alpha, normalised. Alpha (in millionths) is bisected to the largest value at which the weights' entropy still
reaches target_entropy (a share of the logarithm of the number of sources), and raised as far as needed for no source to be repeated more than
max_repetition times. The budget is the smallest at which no source loses documents: the largest source is read once and every other one tokens_max / tokens, to the power 1 - alpha, times.

A source's budget is realised as whole epochs and a part of one more. The documents of an epoch are in a pseudo-random order (md5 of epoch and doc_id) that is cut in `cells`
by the leading bits. Token sums by source and cell, added up before the shuffle, tell in which cell the budget ends; only inside that cell are documents ordered, so no task
sees more than a cell, whatever share of the rows a source holds.

The mix is a sequence of blocks of about block_tokens tokens, each with the target weights: reading number e of a document goes to the place (e + u) / (epochs of its source) of the whole,
u being the order within its epoch, as a number from 0 to 1. So each source runs through its epochs evenly over all blocks, and `blocks` has the block of every reading. `schedule` gives a row for each reading, with its place in the block's permutation.

DataFrame functions only. Sources, unlike documents, are few: their token sums (8 bytes each) are folded in one row. Defined cases: a token is a run of anything but ASCII whitespace; null texts have none; a null source is a source of its own; a source without a token is read once; rows
that repeat a doc_id are ordered by their number of tokens and get copies each; input columns named like the outputs are replaced, and all others stay, whatever their names.
Texts are tokenised twice, once for the sums and once for the rows given back: a join that carried the counts over would shuffle every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, named, packed, small_side, table, unpacked

WORD = r"[^\x20\x09-\x0D]+"
STEPS = 1_000_000


def exponent(stats: DataFrame, target_entropy: float, max_repetition: float) -> int:
    """Alpha in millionths, from (tokens) by source. One row of one number for each source is folded; sources, unlike documents, are few."""
    logs = stats.where("tokens > 0").agg(F.collect_list(F.ln("tokens")).alias("t"))
    top = F.array_max("t")

    def total(f) -> Column:  # noqa: ANN001
        return F.aggregate("t", F.lit(0.0), lambda a, x: a + f(x))

    def entropy(alpha: Column) -> Column:
        z = total(lambda x: F.exp(alpha * (x - top)))
        return F.ln(z) - total(lambda x: F.exp(alpha * (x - top)) * alpha * (x - top)) / z

    def flat_enough(m: Column) -> Column:
        return entropy(m / F.lit(float(STEPS))) >= F.lit(target_entropy) * F.ln(F.size("t")) - 1e-12

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("long")
        return F.when(flat_enough(mid), F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (mid - 1).alias("hi")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(21)), F.struct(F.lit(0).cast("long").alias("lo"), F.lit(STEPS).cast("long").alias("hi")), halve)["lo"]
    spread = top - F.array_min("t")
    least = F.when(spread > 0, F.greatest(F.lit(0), F.ceil((1 - F.ln(F.lit(float(max_repetition))) / spread) * STEPS - 1e-6))).otherwise(F.lit(0)).cast("long")
    row = logs.select(F.when(F.size("t") > 0, F.greatest(found, least)).alias("m")).first()
    return STEPS if row is None or row["m"] is None else int(row["m"])


def _order(epoch: Column, doc: Column) -> Column:
    """A document's place in the order of an epoch, 0 to 2^32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", epoch.cast("string"), doc)), 1, 8), 16, 10).cast("long")


def _counted(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    tokens = F.coalesce(F.regexp_count(named(text), F.lit(WORD)), F.lit(0)).cast("long")
    return packed(docs, id=F.coalesce(named(doc_id).cast("string"), F.lit("")), src=named(source).cast("string"), n=tokens)


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", target_entropy: float = 0.98, max_repetition: float = 4.0, cells: int = 4096, block_tokens: int = 1 << 20) -> DataFrame:
    """`docs` with n_tokens, weight_ppm (the source's weight in millionths), copies (how often the document is read) and blocks (the block of each reading)."""
    counted = _counted(docs, doc_id, text, source)
    light = materialise(counted.select("id", "src", "n"), "tokens")
    stats = materialise(light.groupBy("src").agg(F.sum("n").alias("tokens")), "sources")
    alpha = exponent(stats, target_entropy, max_repetition) / STEPS
    top = stats.agg(F.max("tokens").alias("m")).first()["m"] or 0
    some = F.col("tokens") > 0
    power = F.when(some, F.exp(F.lit(alpha) * F.ln(F.col("tokens") / F.lit(float(max(top, 1)))))).otherwise(F.lit(0.0))
    whole = stats.select(power.alias("p")).agg(F.sum("p")).first()[0] or 1.0
    budget = F.when(some, F.greatest(F.col("tokens"), F.round(F.col("tokens") * F.exp(F.lit(1 - alpha) * F.ln(F.lit(float(max(top, 1))) / F.col("tokens")))).cast("long"))).otherwise(F.lit(0))
    plan = stats.select("src", "tokens", power.alias("power"), budget.alias("budget"))
    rest = F.when(some, F.col("budget") % F.col("tokens")).otherwise(F.lit(0)).cast("long")
    epochs = F.when(some, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)).cast("long")
    span = F.when(some, F.col("budget") / F.col("tokens")).otherwise(F.lit(1.0))
    plan = materialise(plan.select("src", F.round(F.col("power") / F.lit(whole) * 1e6).cast("long").alias("weight_ppm"), epochs.alias("epochs"), rest.alias("rest"), span.alias("span"), "budget"), "plan")
    told = plan.agg(F.count(F.lit(1)).alias("n"), F.sum("budget").alias("t")).first()
    n_blocks = max(1, -(-(told["t"] or 0) // block_tokens))
    sources = small_side(plan.drop("budget").withColumnRenamed("src", "s"), told["n"])
    cell = (F.col("key") * F.lit(cells) / F.lit(1 << 32)).cast("int")
    keyed = light.join(sources, F.col("src").eqNullSafe(F.col("s"))).drop("s").withColumn("key", _order(F.col("epochs"), F.col("id"))).withColumn("cell", cell)
    sums = keyed.groupBy("src", "cell", "rest").agg(F.sum("n").alias("t"))
    before = F.sum("t").over(Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("t")
    ends = sums.withColumn("before", before).where((F.col("rest") > 0) & (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest"))).select(F.col("src").alias("s"), F.col("cell").alias("last"), "before")
    ends = small_side(materialise(ends, "ends"), told["n"])
    at = keyed.join(ends, F.col("src").eqNullSafe(F.col("s"))).drop("s").where(F.col("cell") == F.col("last"))
    inside = Window.partitionBy("src", "cell").orderBy(F.md5(F.concat_ws(":", F.col("epochs").cast("string"), "id")), "id", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = at.withColumn("upto", F.sum("n").over(inside)).select("id", "src", "n", (F.col("before") + F.col("upto") <= F.col("rest")).cast("long").alias("more"))
    edge = materialise(edge.groupBy("id", "src", "n").agg(F.max("more").alias("more")), "edge")
    # the decisions, joined to the documents: those of whole cells follow from the source's row alone
    e = small_side(edge.select(F.col("id").alias("edge_id"), F.col("src").alias("edge_src"), F.col("n").alias("edge_n"), "more"), edge.count())
    d = counted.join(sources, F.col("src").eqNullSafe(F.col("s"))).drop("s").withColumn("key", _order(F.col("epochs"), F.col("id"))).withColumn("cell", cell)
    d = d.join(ends, F.col("src").eqNullSafe(F.col("s")), "left").drop("s")
    d = d.join(e, (F.col("id") == F.col("edge_id")) & F.col("src").eqNullSafe(F.col("edge_src")) & (F.col("n") == F.col("edge_n")), "left")
    extra = F.when(F.col("last").isNull(), F.lit(0)).when(F.col("cell") < F.col("last"), F.lit(1)).when(F.col("cell") > F.col("last"), F.lit(0)).otherwise(F.coalesce("more", F.lit(0)))
    d = d.withColumn("copies", (F.col("epochs") + extra).cast("long"))
    placed = F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda r: F.least(F.lit(n_blocks - 1), F.floor((r + _order(r, F.col("id")) / F.lit(float(1 << 32))) / F.col("span") * F.lit(n_blocks))).cast("long"))
    return unpacked(d, docs.columns, n_tokens=F.col("n"), weight_ppm=F.col("weight_ppm"), copies=F.col("copies"), blocks=placed)


def schedule(mixed: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, epoch, block, place) for each reading of the documents that `mix` returned: the readings of a block are permuted by a hash, and a task orders one block at a time."""
    each = mixed.select(named(doc_id).alias("doc_id"), F.posexplode("blocks").alias("epoch", "block"))
    inside = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(23), "epoch", "doc_id"), "epoch", "doc_id")
    return each.select("doc_id", "epoch", "block", (F.row_number().over(inside) - 1).alias("place"))


SQL = r"""
WITH RECURSIVE tok AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
st AS (SELECT source, sum(n)::BIGINT AS t FROM tok GROUP BY source),
logs AS (SELECT list(ln(t)) AS a, max(ln(t)) AS top, min(ln(t)) AS low FROM st WHERE t > 0),
bis AS (
  SELECT 0 AS i, 0::BIGINT AS lo, 1000000::BIGINT AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid - 1 END FROM (
    SELECT i, lo, hi, mid, ln(z) - list_sum(list_transform(a, lambda x: exp(al * (x - top)) * al * (x - top))) / z >= 0.98 * ln(len(a)) - 1e-12 AS ok FROM (
      SELECT *, list_sum(list_transform(a, lambda x: exp(al * (x - top)))) AS z FROM (
        SELECT i, lo, hi, (lo + hi + 1) // 2 AS mid, ((lo + hi + 1) // 2) / 1e6 AS al, a, top FROM bis, logs WHERE i < 21)))),
alpha AS (
  SELECT greatest((SELECT lo FROM bis WHERE i = 21), CASE WHEN top > low THEN greatest(0, ceil((1 - ln(4.0) / (top - low)) * 1000000 - 1e-6)) ELSE 0 END) / 1e6 AS al, exp(top) AS tmax FROM logs),
pw AS (SELECT source, t, CASE WHEN t > 0 THEN exp(al * ln(t / mt)) ELSE 0.0 END AS p, CASE WHEN t > 0 THEN greatest(t, round(t * exp((1 - al) * ln(mt / t)))::BIGINT) ELSE 0 END AS budget
  FROM st, alpha, (SELECT max(t)::DOUBLE AS mt FROM st)),
plan AS (SELECT source, round(p / sum(p) OVER () * 1e6)::BIGINT AS weight_ppm, CASE WHEN t > 0 THEN budget // t ELSE 1 END AS e, CASE WHEN t > 0 THEN budget % t ELSE 0 END AS rest, CASE WHEN t > 0 THEN budget::DOUBLE / t ELSE 1.0 END AS span FROM pw),
nb AS (SELECT greatest(1, ceil(sum(budget) / 1048576.0))::BIGINT AS nb FROM pw),
ordered AS (
  SELECT doc_id, tok.source, n, weight_ppm, e, rest, span, sum(n) OVER (PARTITION BY tok.source ORDER BY md5(e || ':' || doc_id), doc_id, n ROWS UNBOUNDED PRECEDING) AS upto
  FROM tok JOIN plan ON tok.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, source, n AS n_tokens, weight_ppm, copies,
  array_to_string(list_transform(range(copies), lambda r: least(nb - 1, floor((r + ('0x' || substr(md5(r || ':' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE) / span * nb)::BIGINT)), ',') AS blocks
FROM (SELECT *, e + CASE WHEN upto <= rest AND rest > 0 THEN 1 ELSE 0 END AS copies FROM ordered), nb
"""


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "n_tokens", "weight_ppm", "copies", F.array_join(F.col("blocks").cast("array<string>"), ",").alias("blocks"))
