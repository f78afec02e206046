"""Benchmark decontamination by template canonicalisation.

A text's tokens are its letter runs and numbers. Numbers become <num>, a unit right after a number becomes <unit>, and a capitalised word inside a
sentence becomes <name>; all other tokens are literals, lower-cased. A window is `width` consecutive template tokens (an item of fewer tokens is one window), most of them literals, so
that two literals stand side by side. A document's windows are hash-joined with the items' windows on the template; the values in the slots must agree
one to one (equal values in the item are equal in the document and different ones differ), which catches questions whose numbers, names or units were changed: that is so if the places of first occurrence of the values are the same,
so template and places together are the key of the join.
A window takes part if it has ceil(size / 2) + 1 literals at least. An item without such a window is found by its windows' lower-cased tokens, word for word. An item of one window is also met with its capitalised first word as a <name>, as in mid-line, and word for word.
An item of one token, or of none, can't be found; `ways` tells for each item how it is looked for.

Before that, one pass over all whole texts notes which of the items' pairs of neighbouring words each document holds, by a hash join of the text's pairs. A document with a window holds all the window's pairs of neighbouring literals, and one with an item's tokens
all of its pairs of neighbouring words, so only documents with all pairs of some window go on, and nothing is lost. Each window is looked up by the one of its pairs that the fewest documents hold, as counted over all of them. If an item
without a window has no two words, all documents are searched for it.

DataFrame functions only. Defined cases: null and empty texts and items have no window; items without an item_id are left out; repeated items count for each item_id; a document is listed once for each item that it leaks; rows that repeat a doc_id are one document; columns other than those named are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bounded, materialise, named, packed, small_side, table, unpacked

#: Units that may follow a number.
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "min", "h", "hz", "khz", "mhz", "ghz", "v", "w", "kw", "j", "kj", "n", "pa", "k", "c", "f", "inch", "inches", "ft", "feet", "foot", "yard", "yards", "mile", "miles", "oz", "lb", "lbs", "gallon", "gallons", "liter", "liters", "litre", "litres", "meter", "meters", "metre", "metres", "gram", "grams", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents"]
TOKEN = r"[\p{L}\p{M}]+|\p{N}+(?:[.,]\p{N}+)*|[.!?\n]"
#: Largest number of pairs, one long each, that may be broadcast, once they have been counted.
PAIRS = 2_000_000


def needed(size: Column) -> Column:
    """So many literals among `size` tokens that two of them must be neighbours."""
    return F.ceil(size / 2) + 1


def template(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(_k, _c, _v): for each row the template tokens and the tokens as they stand, lower-cased."""
    marked = texts.select(F.col(key).alias("_k"), F.explode(F.array(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)))).alias("_t"))

    def typed(x: Column, i: Column) -> Column:
        before = F.get(F.col("_t"), i - 1)
        kind = (
            F.when(x.rlike(r"^[.!?\n]"), F.lit(""))
            .when(x.rlike(r"^\p{N}"), F.lit("<num>"))
            .when((i > 0) & F.lower(x).isin(UNITS) & before.rlike(r"^\p{N}"), F.lit("<unit>"))
            .when((i > 0) & x.rlike(r"^\p{Lu}\p{Ll}") & ~before.rlike(r"^[.!?\n]"), F.lit("<name>"))
            .otherwise(F.lower(x))
        )
        return F.struct(kind.alias("c"), F.lower(x).alias("v"))

    tokens = marked.select("_k", F.explode(F.array(F.filter(F.transform("_t", typed), lambda s: s["c"] != ""))).alias("_s"))
    return tokens.select("_k", F.col("_s.c").alias("_c"), F.col("_s.v").alias("_v"))


def cells(tokens: DataFrame, widths: list[int]) -> DataFrame:
    """(_k, at, _w, _x): template tokens and tokens of each window of a width. Windows are cut by place, so a text costs its length times the width."""

    def cut(width: int) -> Column:
        take = lambda c, i: F.array(*[F.get(F.col(c), i + j) for j in range(width)])
        starts = F.when(F.size("_c") >= width, F.sequence(F.lit(0), F.size("_c") - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), take("_c", i).alias("c"), take("_v", i).alias("v")))

    parts = tokens.select("_k", F.explode(F.concat(*[cut(w) for w in widths])).alias("_p"))
    return parts.select("_k", F.col("_p.at").alias("at"), F.col("_p.c").alias("_w"), F.col("_p.v").alias("_x"))


def templates(apart: DataFrame) -> DataFrame:
    """(_k, at, _w, key, slots) for each of the windows with enough literals; the key is the template and, for each slot, the place of the first one with its value."""
    literals = F.size(F.filter("_w", lambda c: ~c.startswith("<")))
    held = apart.where(literals >= needed(F.size("_w")))
    held = held.select("_k", "at", "_w", F.transform(F.filter(F.arrays_zip("_w", "_x"), lambda z: z["_w"].startswith("<")), lambda z: z["_x"]).alias("slots"))
    places = F.transform("slots", lambda v: F.array_position(F.col("slots"), v).cast("string"))
    return held.select("_k", "at", "_w", F.concat_ws("|", F.array_join("_w", " "), F.array_join(places, " ")).alias("key"), "slots")


def windows(tokens: DataFrame, widths: list[int]) -> DataFrame:
    """(_k, at, _w, key, slots) for each window of a width with enough literals."""
    return templates(cells(tokens, widths))


def wanted(items: DataFrame, item_id: str, text: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Windows (item_id, _w, key, item_slots) of the items, and (item_id, words, _x) of what is looked up word for word; both written."""
    items = items.select(named(item_id).alias("_k"), named(text).alias("_x")).where("_k IS NOT NULL")
    bench = template(items, "_k", "_x")
    apart = cells(bench.where(F.size("_c") >= width), [width]).withColumn("one", F.lit(False))
    first = capitalised(items, "_k", "_x")
    for short in range(2, width + 1):
        whole = cells(bench.where(F.size("_c") == short), [short])
        # the first word of a text is a literal, but in mid-line a capitalised one is a name
        inside = whole.join(first, "_k", "left_semi").select("_k", "at", F.concat(F.array(F.lit("<name>")), F.slice("_w", 2, short)).alias("_w"), "_x")
        apart = apart.union(inside.withColumn("one", F.lit(True)))
        if short < width:
            apart = apart.union(whole.withColumn("one", F.lit(False)))
    apart = materialise(apart, "item-cells")
    rows = materialise(templates(apart).select(F.col("_k").alias("item_id"), "_w", "key", F.col("slots").alias("item_slots")), "item-windows")
    # items without a window, and those whose first word is a name in mid-line, are looked up word for word
    bare = apart.join(rows.select(F.col("item_id").alias("_k")).distinct(), "_k", "left_anti").union(apart.where("one"))
    return rows, materialise(bare.select(F.col("_k").alias("item_id"), F.array_join("_x", " ").alias("words"), "_x").distinct(), "item-words")


def ways(items: DataFrame, *, item_id: str = "item_id", text: str = "text", width: int = 8) -> DataFrame:
    """(item_id, way): `template` if an item has a window with enough literals, else `words`, or `none` if it has fewer than two tokens."""
    rows, bare = wanted(items, item_id, text, width)
    each = rows.select("item_id", F.lit("template").alias("way")).union(bare.select("item_id", F.lit("words"))).groupBy("item_id").agg(F.min("way").alias("way"))
    return items.select(named(item_id).alias("item_id")).where("item_id IS NOT NULL").distinct().join(each, "item_id", "left").select("item_id", F.coalesce("way", F.lit("none")).alias("way"))


def _hits(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, width: int, whole: bool) -> list[DataFrame]:
    """Tables (doc_id, item_id, doc_at, exact) of the windows met; without `whole` just (doc_id), and no row is multiplied by items of the same template."""
    rows, bare = wanted(items, item_id, text, width)
    sizes = lambda df, c: df.agg(F.array_sort(F.collect_set(F.size(c))).alias("s")).first()["s"]
    every = docs.select(named(doc_id).alias("_k"), named(text).alias("_x")).where("_k IS NOT NULL")
    words = bare.withColumn("_p", F.array_distinct(F.filter(neighbours(F.filter("_x", lambda v: ~v.rlike(r"^\p{N}"))), lambda h: h.isNotNull())))
    pairs = materialise(rows.select(literal_pairs(F.col("_w")).alias("_p"), F.lit(0).alias("part")).union(words.select("_p", F.lit(1))).where(F.size("_p") > 0).distinct(), "item-pairs")
    if pairs.isEmpty() and bare.isEmpty():
        return []
    held = held_pairs(every, pairs)
    hits = []

    def search(side: DataFrame, parts: DataFrame, found: DataFrame) -> None:
        theirs = found.join(parts, "_k", "left_semi") if parts is not None else found
        if side is rows:
            theirs = windows(template(theirs, "_k", "_x"), sizes(rows, "_w")).select(F.col("_k").alias("doc_id"), F.col("at").alias("doc_at"), "key", F.col("slots").alias("doc_slots"))
            own, key, exact = rows.drop("_w"), "key", F.col("item_slots") == F.col("doc_slots")
        else:
            theirs = cells(template(theirs, "_k", "_x"), sizes(side, "_x")).select(F.col("_k").alias("doc_id"), F.col("at").alias("doc_at"), F.array_join("_x", " ").alias("words"))
            own, key, exact = side.select("item_id", "words"), "words", F.lit(True)
        if whole:
            hits.append(theirs.join(bounded(own), key).select("doc_id", "item_id", "doc_at", exact.alias("exact")))
        else:
            hits.append(theirs.join(bounded(materialise(own.select(key).distinct(), "item-keys")), key, "left_semi").select("doc_id"))

    if not rows.isEmpty():
        search(rows, holding(held, pairs.where("part = 0")), every)
    some = materialise(words.where(F.size("_p") > 0).select("item_id", "words", "_x"), "item-words")
    if not some.isEmpty():
        search(some, holding(held, pairs.where("part = 1")), every)
    rest = materialise(words.where(F.size("_p") == 0).select("item_id", "words", "_x"), "item-words")
    if not rest.isEmpty():
        search(rest, None, every)
    return hits


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", width: int = 8) -> DataFrame:
    """(doc_id, item_id, n_windows, n_exact, kind) for each document that holds windows of an item; kind is `verbatim` if a window has the item's own slot values, else `reparameterised`."""
    hits = _hits(docs, items, doc_id, item_id, text, width, True)
    if not hits:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows long, n_exact long, kind string")
    met = reduce(DataFrame.unionAll, hits)
    out = met.groupBy("doc_id", "item_id").agg(F.count_distinct("doc_at").alias("n_windows"), F.count_distinct(F.when(F.col("exact"), F.col("doc_at"))).alias("n_exact"))
    return out.withColumn("kind", F.when(F.col("n_exact") > 0, "verbatim").otherwise("reparameterised"))


def capitalised(items: DataFrame, key: str, text: str) -> DataFrame:
    """(_k) of the items whose first word is capitalised."""
    return items.where(F.get(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)), F.lit(0)).rlike(r"^\p{Lu}\p{Ll}")).select(F.col(key).alias("_k")).distinct()


def neighbours(words: Column) -> Column:
    """A hash of each two neighbouring words, and a null for the last."""
    return F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))


def literal_pairs(window: Column) -> Column:
    """The hashes of a window's neighbouring literals."""
    after = F.slice(window, F.lit(2), F.size(window))
    return F.array_distinct(F.filter(F.zip_with(window, after, lambda a, b: F.when(~a.startswith("<") & ~b.startswith("<"), F.xxhash64(a, b))), lambda h: h.isNotNull()))


def held_pairs(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(_k, _h): those of the pairs (_p) that each text (_k, _x) holds; written."""
    all_ = materialise(pairs.select(F.explode("_p").alias("h")).distinct(), "pairs")
    # the word array stands behind a Generate, so that it is made once
    words = texts.select("_k", F.explode(F.array(F.struct(F.split(F.lower("_x"), r"[^\p{L}\p{M}]+", -1).alias("w")))).alias("s"))
    own = words.select("_k", F.explode(neighbours(F.col("s.w"))).alias("h"))
    own = own.join(F.broadcast(all_) if all_.count() <= PAIRS else all_, "h", "left_semi")
    return materialise(own.groupBy("_k").agg(F.collect_set("h").alias("_h")), "held-pairs")


def holding(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """(_k) of the texts, by the pairs they hold, that hold all the pairs of one of the windows `pairs` (_p); written."""
    shares = held.select(F.explode("_h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    window = pairs.select("_p", F.xxhash64("_p").alias("_w"))
    rarest = window.select("_w", F.explode("_p").alias("h")).join(shares, "h", "left").groupBy("_w").agg(F.min_by("h", F.struct(F.coalesce("n", F.lit(0)), "h")).alias("h"))
    keyed = materialise(window.join(rarest, "_w").select("h", "_p").distinct(), "rarest-pairs")
    met = held.select("_k", "_h", F.explode("_h").alias("h")).join(small_side(keyed, 8 * keyed.count()), "h")
    out = materialise(met.where(F.size(F.array_except("_p", "_h")) == 0).select("_k").distinct(), "holders")
    return small_side(out, out.count())


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", width: int = 8) -> DataFrame:
    """The documents that leak no item. Rows with a null doc_id stay."""
    hits = _hits(docs, items, doc_id, item_id, text, width, False)
    if not hits:
        return docs
    bad = materialise(reduce(DataFrame.unionAll, hits).distinct(), "leaking")
    bad = small_side(bad.withColumnRenamed("doc_id", "gone"), bad.count())
    return unpacked(packed(docs, id=named(doc_id)).join(bad, F.col("id") == F.col("gone"), "left_anti"), docs.columns)


_UNITS_SQL = ", ".join(f"'{u}'" for u in UNITS)


def _sql_tokens(name: str, source: str, key: str) -> str:
    return rf"""
{name}_raw AS (SELECT {key} AS k, unnest(range(len(a))) AS i, unnest(a) AS x FROM (SELECT {key}, regexp_extract_all(text, '[\p{{L}}\p{{M}}]+|\p{{N}}+(?:[.,]\p{{N}}+)*|[.!?\n]') AS a FROM {source})),
{name}_typed AS (
  SELECT k, i, lower(x) AS v, CASE
    WHEN regexp_matches(x, '^[.!?\n]') THEN ''
    WHEN regexp_matches(x, '^\p{{N}}') THEN '<num>'
    WHEN lower(x) IN ({_UNITS_SQL}) AND regexp_matches(lag(x) OVER w, '^\p{{N}}') THEN '<unit>'
    WHEN regexp_matches(x, '^\p{{Lu}}\p{{Ll}}') AND NOT regexp_matches(lag(x) OVER w, '^[.!?\n]') THEN '<name>'
    ELSE lower(x) END AS c
  FROM {name}_raw WINDOW w AS (PARTITION BY k ORDER BY i)),
{name}_arr AS (SELECT k, list(c ORDER BY i) AS c, list(v ORDER BY i) AS v, count(*) AS n FROM {name}_typed WHERE c <> '' GROUP BY k)"""


def _sql_slots(name: str, source: str) -> str:
    return f"""
{name} AS (
  SELECT k, pos, array_to_string(c, ' ') AS tpl, list_filter(list_transform(range(1, len(c) + 1), lambda j: CASE WHEN starts_with(c[j], '<') THEN v[j] END), lambda x: x IS NOT NULL) AS slots
  FROM {source} WHERE len(list_filter(c, lambda x: NOT starts_with(x, '<'))) >= ceil(len(c) / 2.0) + 1)"""


SQL = f"""
WITH {_sql_tokens("b", "benchmark", "item_id")},
b_win AS (SELECT k, s AS pos, c[s + 1 : s + w] AS c, v[s + 1 : s + w] AS v, false AS one FROM (SELECT k, c, v, least(n, 8) AS w, unnest(range(n - least(n, 8) + 1)) AS s FROM b_arr WHERE n > 1)
  UNION ALL SELECT k, 0, list_concat(['<name>'], c[2:]), v, true FROM b_arr WHERE n BETWEEN 2 AND 8 AND k IN (SELECT k FROM b_raw WHERE i = 0 AND regexp_matches(x, '^\\p{{Lu}}\\p{{Ll}}'))),{_sql_slots("b_ok", "b_win")},
bare AS (SELECT DISTINCT k, array_to_string(v, ' ') AS words, len(v) AS w FROM b_win WHERE one OR k NOT IN (SELECT k FROM b_ok)),
{_sql_tokens("d", "documents", "doc_id")},
d_win AS (SELECT k, s AS pos, c[s + 1 : s + w] AS c, v[s + 1 : s + w] AS v FROM (SELECT k, c, v, w, unnest(range(n - w + 1)) AS s FROM d_arr, (SELECT DISTINCT len(string_split(tpl, ' ')) AS w FROM b_ok UNION SELECT w FROM bare) WHERE n >= w)),{_sql_slots("d_ok", "d_win")},
met AS (
  SELECT d.k AS doc_id, b.k AS item_id, d.pos, b.slots = d.slots AS exact,
    list_distinct(list_transform(range(1, len(b.slots) + 1), lambda j: b.slots[j] || chr(0) || d.slots[j])) AS p, list_distinct(b.slots) AS pb, list_distinct(d.slots) AS pd
  FROM d_ok d JOIN b_ok b ON d.tpl = b.tpl
  UNION ALL SELECT d.k, bare.k, d.pos, true, [], [], [] FROM d_win d JOIN bare ON array_to_string(d.v, ' ') = words AND len(d.v) = w)
SELECT doc_id, item_id, count(DISTINCT pos) AS n_windows, count(DISTINCT CASE WHEN exact THEN pos END) AS n_exact,
  CASE WHEN bool_or(exact) THEN 'verbatim' ELSE 'reparameterised' END AS kind
FROM met WHERE len(p) = len(pb) AND len(p) = len(pd) GROUP BY doc_id, item_id
"""


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
