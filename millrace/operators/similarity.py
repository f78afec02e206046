"""Signature joins and clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.session import written


def confidence(distance: Column, limit: int) -> Column:
    """1 at distance 0, falling to a half beyond the limit."""
    return F.round(1 - distance / (2.0 * (limit + 1)), 4) if limit > 0 else F.lit(1.0)


def equal_pairs(signatures: DataFrame, attribute: str, block: int = 1000) -> DataFrame:
    """(left, right) for contents with the same non-empty value: all pairs, as the rows ask for them. A group of more than `block` is dealt over blocks, and each block's contents meet as left ones every block's as right ones under a key of their own.
    The pairs come out as runs of one left beside a sorted stretch of right ones, and a task has about four blocks a side, so a columnar writer keeps its dictionaries and a pair takes it a fraction of a byte instead of two values."""
    rows = signatures.where(F.coalesce(F.col(attribute), F.lit("")) != "").select("sha", F.col(attribute).alias("_v"))
    sizes = rows.groupBy("_v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = written(rows.join(sizes, "_v").select("_v", F.col("sha").alias("_i"), F.ceil(F.col("n") / block).alias("_n")), "equal")
    tasks = -(-(dealt.agg(F.sum("_n")).first()[0] or 1) // (4 * block))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    each = dealt.select("_v", "_i", F.pmod(F.xxhash64("_i"), F.col("_n")).alias("_m"), others.alias("_o"))
    key = ["_v", "_p", "_q"]
    a = each.select("_v", F.col("_m").alias("_p"), F.col("_o").alias("_q"), F.col("_i").alias("left"))
    b = each.select("_v", F.col("_o").alias("_p"), F.col("_m").alias("_q"), F.col("_i").alias("right"))
    a, b = a.repartition(tasks, *key), b.repartition(tasks, *key)
    # a sort in front of a join is dropped by the optimiser, that of a window whose number is read is not
    b = b.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("right")))
    return a.join(b.hint("merge"), key).where("left < right AND _k > 0").select("left", "right")


def bands(limit: int) -> list[tuple[int, int]]:
    """(offset, width) of limit + 1 disjoint bands of 64 bits, from the low end, the first ones a bit wider."""
    count, at, out = limit + 1, 0, []
    for i in range(count):
        width = 64 // count + (i < 64 % count)
        out.append((at, width))
        at += width
    return out


def meet(rows: DataFrame, by: list[str], item: str, n: Column, block: int) -> DataFrame:
    """(*by, x, y), x < y: all pairs of items of `rows` with the same `by`, of which there are n. A group of more than `block` is dealt over blocks, and each two blocks meet under a key of their own."""
    parts = F.greatest(F.ceil(n / block), F.lit(1))
    dealt = rows.select(*by, F.col(item).alias("_i"), parts.alias("_n")).withColumn("_m", F.pmod(F.xxhash64("_i"), F.col("_n")))
    each = dealt.select(*by, "_i", "_m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_o")).withColumns({"_lo": F.least("_m", "_o"), "_hi": F.greatest("_m", "_o")})
    key = [*by, "_lo", "_hi"]
    a, b = each.where("_m = _lo").select(*key, F.col("_i").alias("_a")), each.where("_m = _hi").select(*key, F.col("_i").alias("_b"))
    return a.join(b, key).where("_lo < _hi OR _a < _b").select(*by, F.least("_a", "_b").alias("x"), F.greatest("_a", "_b").alias("y"))


def finer(tables: dict[int, tuple[int, list[int]]], limit: int) -> list[tuple[int, int, list[int]]]:
    """(table, mask, free bits) for each table (its mask and free bits) and each of limit + 1 bands of its free bits added to its mask."""
    out = []
    for t, (mask, free) in tables.items():
        at = 0
        for i in range(limit + 1):
            width = len(free) // (limit + 1) + (i < len(free) % (limit + 1))
            band = free[at : at + width]
            at += width
            out.append((t, mask | sum(1 << b for b in band), [b for b in free if b not in band]))
    return out


def distance_pairs(signatures: DataFrame, attribute: str, limit: int, max_bucket: int = 1000, max_tables: int = 1000) -> tuple[DataFrame, DataFrame]:
    """((left, right, distance), (skipped)) for signatures within `limit` bits; every pair is found. Distinct values meet in a band. Those in a bucket of more than max_bucket values meet in the bands of
    the bits that are left, which again hold one on which a near pair agrees, and so on while there are at most max_tables tables; what is still larger is compared block by block.
    `skipped` counts the buckets of the first bands that were split so."""
    rows = signatures.where(F.coalesce(F.col(attribute), F.lit("")) != "").select("sha", F.conv(F.col(attribute), 16, -10).cast("long").alias("v"))
    spark = signatures.sparkSession
    todo = rows.select("v").distinct().withColumn("t", F.lit(0))
    tables: dict[int, tuple[int, list[int]]] = {0: (0, list(range(64)))}
    found, skipped = [], None
    while True:
        cut = finer(tables, limit)
        signed = [(t, i, m - (1 << 64) if m >> 63 else m) for i, (t, m, _) in enumerate(cut)]
        masks = F.broadcast(spark.createDataFrame(signed, "t int, u int, mask long"))
        keyed = todo.join(masks, "t").select("v", F.col("u").alias("t"), F.col("v").bitwiseAND(F.col("mask")).alias("key"))
        sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        many = sizes.where(F.col("n") > max_bucket)
        skipped = many.agg(F.count(F.lit(1)).alias("skipped")) if skipped is None else skipped
        tables = {i: (m, free) for i, (_, m, free) in enumerate(cut)}
        more = many.limit(1).count() > 0
        last = not more or len(tables) * (limit + 1) > max_tables or min(len(free) for _, free in tables.values()) <= limit
        close = keyed.join(sizes if last else sizes.where(F.col("n") <= max_bucket), ["t", "key"])
        found.append(meet(close, ["t", "key"], "v", F.col("n"), max_bucket))
        if last:
            break
        todo = keyed.join(many, ["t", "key"], "left_semi").select("v", "t")
    near = reduce(DataFrame.unionAll, [f.select("x", "y") for f in found]).withColumn("distance", F.bit_count(F.col("x").bitwiseXOR(F.col("y")))).where(F.col("distance") <= limit).distinct()
    one, two = rows.select(F.col("sha").alias("s"), F.col("v").alias("x")), rows.select(F.col("sha").alias("o"), F.col("v").alias("y"))
    apart = near.join(one, "x").join(two, "y").where("s <> o").select(F.least("s", "o").alias("left"), F.greatest("s", "o").alias("right"), "distance")
    same = equal_pairs(signatures, attribute, max_bucket).withColumn("distance", F.lit(0))
    return same.union(apart).dropDuplicates(["left", "right"]), skipped


def relations(signatures: DataFrame, *, near: int = 3, related: int = 8, phash: int = 8, veto: int = 12, min_chars: int = 40, bonus: float = 0.05, scale: float = 0.6, max_bucket: int = 1000) -> DataFrame:
    """(src, tgt, type, confidence, method) of `signatures` (sha, text_hash, simhash, phash, year, folders, chars): equal texts, near signatures, related ones in a shared folder and near images that their texts don't contradict.
    A later year makes the earlier one an older version. Of several relations with the same key the surest stays, the earlier layer on ties."""
    side = lambda p: signatures.select(*[F.col(c).alias(p + c) for c in ("sha", "simhash", "year", "folders", "chars")])
    text = equal_pairs(signatures, "text_hash").withColumns({"layer": F.lit(0), "conf": F.lit(1.0), "method": F.lit("near_dupe:text_hash")})
    wide, _ = distance_pairs(signatures, "simhash", related, max_bucket)
    close, _ = distance_pairs(signatures, "simhash", near, max_bucket)
    sim = close.select("left", "right", F.lit(1).alias("layer"), confidence(F.col("distance"), near).alias("conf"), F.lit("near_dupe:simhash").alias("method"))
    far = wide.where(F.col("distance") > near).select("left", "right", F.lit(2).alias("layer"), F.round(confidence(F.col("distance"), related) * scale, 4).alias("conf"), F.lit("near_dupe:related").alias("method"))
    image, _ = distance_pairs(signatures, "phash", phash, max_bucket)
    pic = image.select("left", "right", F.lit(3).alias("layer"), confidence(F.col("distance"), phash).alias("conf"), F.lit("near_dupe:phash").alias("method"))
    cols = ["left", "right", "layer", "conf", "method"]
    all_ = text.select(cols).unionByName(sim).unionByName(far).unionByName(pic)
    j = all_.join(side("l_"), F.col("left") == F.col("l_sha")).join(side("r_"), F.col("right") == F.col("r_sha"))
    shared = F.array_min(F.array_intersect("l_folders", "r_folders")).isNotNull()
    apart = T.hamming_hex(F.col("l_simhash"), F.col("r_simhash"))
    usable = (F.col("l_chars") >= min_chars) & (F.col("r_chars") >= min_chars)
    j = j.where(((F.col("layer") != 2) | shared) & ((F.col("layer") != 3) | ~F.coalesce(usable & (apart > veto), F.lit(False))))
    conf = F.round(F.least(F.col("conf") + F.when(shared, bonus).otherwise(0.0), F.lit(1.0)), 4)
    dated = (F.col("layer") != 2) & F.col("l_year").isNotNull() & F.col("r_year").isNotNull() & (F.col("l_year") != F.col("r_year"))
    older = F.col("l_year") < F.col("r_year")
    out = j.select(
        F.when(dated & ~older, F.col("right")).otherwise(F.col("left")).alias("src"),
        F.when(dated & ~older, F.col("left")).otherwise(F.col("right")).alias("tgt"),
        F.when(F.col("layer") == 2, "related").when(dated, "older_version").otherwise("near_duplicate").alias("type"),
        conf.alias("confidence"), "method", "layer",
    )
    w = Window.partitionBy("src", "tgt", "type").orderBy(F.desc("confidence"), "layer")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "layer")


def clusters(links: DataFrame) -> DataFrame:
    """(node, cluster) of `links` (src, tgt): the smallest node reachable, by spreading minima until nothing changes. Each round is written to the shared folder, so lost executors cost one round."""
    edges = written(links.select("src", "tgt").union(links.select("tgt", "src")).distinct(), "edges")
    state = written(edges.groupBy("src").agg(F.least(F.min("tgt"), F.col("src")).alias("cluster")).withColumnRenamed("src", "node"), "clusters")
    while True:
        best = edges.join(state, F.col("tgt") == F.col("node")).groupBy("src").agg(F.min("cluster").alias("c"))
        step = state.join(best, F.col("node") == F.col("src")).select("node", F.least("cluster", "c").alias("cluster"), "cluster")
        step = step.toDF("node", "cluster", "old")
        jump = step.select(F.col("node").alias("_x"), F.col("cluster").alias("_y"))
        step = written(step.join(jump, F.col("cluster") == F.col("_x"), "left").select("node", F.least("cluster", F.coalesce("_y", "cluster")).alias("cluster"), "old"), "clusters")
        state = step.drop("old")
        if step.where("cluster <> old").isEmpty():
            return state


def symmetric(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of unordered pairs."""
    return pairs.select(F.col(a).alias("node"), F.col(b).alias("partner")).union(pairs.select(F.col(b).alias("node"), F.col(a).alias("partner"))).distinct()


def attach(rows: DataFrame, rels: DataFrame) -> DataFrame:
    """Each row's one relation: its own older version first, else the surest symmetric one in either direction; rows that have one keep it."""
    own = rels.where("type = 'older_version'").select(F.col("src").alias("sha"), F.col("tgt").alias("other"), "type", "confidence", F.lit(0).alias("rank"))
    sym = rels.where("type <> 'older_version'")
    both = sym.select(F.col("src").alias("sha"), F.col("tgt").alias("other"), "type", "confidence").union(sym.select(F.col("tgt"), F.col("src"), "type", "confidence")).withColumn("rank", F.lit(1))
    w = Window.partitionBy("sha").orderBy("rank", F.desc("confidence"), "other", "type")
    best = own.unionByName(both).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("sha", F.col("other").alias("_o"), F.col("type").alias("_t"))
    j = rows.join(best, "sha", "left")
    return j.withColumns({"relation": F.when(F.col("related_to").isNull(), F.col("_t")).otherwise(F.col("relation")), "related_to": F.coalesce("related_to", "_o")}).drop("_o", "_t")
