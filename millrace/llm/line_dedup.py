"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without ASCII whitespace at its ends, A-Z lower-cased. Keys are two 64-bit hashes (128 bits together:
at 1e12 lines a chance collision has a probability of about 1e-15). Documents arrive in batches of falling doc_id; each batch
aggregates its own keys, merge-anti-joins the keys that the runs have settled already (seen in enough documents: their keeper
can't change, as later batches have smaller ids), and adds what is left as a sorted run of level 0. When a level holds
`fanout` runs they are merged into one run of the next level, so a key is rewritten a logarithmic number of times.
Runs are plain Parquet in the shared folder: their order within files serves the column encoding and the row-group statistics. An order across files that Spark would use for a join without a shuffle
needs bucketed catalogue tables, which a job on a foreign cluster can't rely on; so a batch's anti-join shuffles its own new keys and the settled ones, both as two longs, never texts.

Defined cases: null or empty text is one empty line; every row counts as a document, so rows that repeat a doc_id count
each, and all rows with the largest doc_id keep the line; a null doc_id is below every other; input columns named like the outputs are replaced, and all others stay, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ASCII_SPACE, ascii_lower, materialise, named, packed, remove, shared_path, small_side, table, unpacked


@dataclass
class LineRuns:
    """Runs of (h1, h2, n, keeper), sorted by key, by level. `add` takes a batch of (h1, h2, owner) with one row per key and document; batches must come in falling order of owner."""

    spark: SparkSession
    min_docs: int = 3
    fanout: int = 3
    levels: list[list[str]] = field(default_factory=list)

    def read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n long, keeper long").parquet(*paths)

    def paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        path = shared_path(self.spark, f"line-run-{level}")
        rows.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    @staticmethod
    def merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        own = batch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("owner").alias("keeper"))
        if self.paths():
            settled = self.read(self.paths()).where(F.col("n") >= self.min_docs).select("h1", "h2")
            own = own.join(settled, ["h1", "h2"], "left_anti")
        self._write(own, 0)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                self._write(self.merged(self.read(old)), level + 1)
                for path in old:
                    remove(self.spark, path)
            level += 1

    def frequent(self) -> DataFrame:
        """(h1, h2, keeper) of the keys found in at least min_docs documents."""
        return self.merged(self.read(self.paths())).where(F.col("n") >= self.min_docs).select("h1", "h2", "keeper")


def line_table(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """A row for each line whose key is long enough: _id, _t (hash of the text, which tells rows of one id apart), pos, h1, h2, first (the key's first line in its document)."""
    body = F.coalesce(named(text), F.lit(""))
    lines = F.split(body, "\n", -1)
    keys = docs.select(
        named(doc_id).cast("long").alias("_id"),
        F.xxhash64(body).alias("_t"),
        F.transform(lines, lambda x: ascii_lower(F.btrim(x, F.lit(ASCII_SPACE)))).alias("_keys"),
    )
    hashed = keys.select(
        "_id",
        "_t",
        F.sort_array(
            F.filter(
                F.transform("_keys", lambda k, i: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), i.alias("pos"), F.char_length(k).alias("n"))),
                lambda s: s["n"] >= min_chars,
            )
        ).alias("_s"),
    )
    # the sorted array stands behind a Generate, so that it is made once and looked up by place
    held = hashed.select("_id", "_t", F.explode(F.array(F.struct("_s"))).alias("_b")).select("_id", "_t", F.col("_b._s").alias("_s"))

    def marked(x: Column, i: Column) -> Column:
        before = F.get(F.col("_s"), i - 1)
        return F.struct(x["pos"].alias("pos"), x["h1"].alias("h1"), x["h2"].alias("h2"), ((i == 0) | (before["h1"] != x["h1"]) | (before["h2"] != x["h2"])).alias("first"))

    return held.select("_id", "_t", F.inline(F.transform("_s", marked)))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """The documents with `text` less the lines that repeat, and n_lines (before) and n_dropped.

    A key of at least min_chars code points in at least min_docs documents keeps its lines in the largest doc_id that holds it and loses all others.
    """
    spark = docs.sparkSession
    cuts = docs.select(F.percentile_approx(named(doc_id).cast("long"), [i / batches for i in range(1, batches)], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    batch = sum(((F.col("_id") > c).cast("int") for c in cuts), F.lit(0)) if cuts else F.lit(0)
    lines = materialise(line_table(docs, doc_id, text, min_chars).withColumn("batch", F.coalesce(batch, F.lit(0))), "lines", partition_by="batch")
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(len(cuts), -1, -1):
        runs.add(lines.where((F.col("batch") == b) & F.col("first")).select("h1", "h2", F.col("_id").alias("owner")))
    frequent = materialise(runs.frequent(), "line-frequent")
    for path in runs.paths():
        remove(spark, path)
    kept = F.col("keeper").isNull() | (F.col("_id") >= F.col("keeper"))
    hits = (
        lines.join(small_side(frequent, frequent.count()), ["h1", "h2"])
        .where(~F.coalesce(kept, F.lit(False)))
        .groupBy("_id", "_t")
        .agg(F.collect_set("pos").alias("_drop"))
    )
    at = packed(docs, id=named(doc_id).cast("long"), t=F.xxhash64(F.coalesce(named(text), F.lit(""))))
    hits = hits.select(F.col("_id").alias("hit"), F.col("_t").alias("hit_t"), F.col("_drop").alias("drop"))
    body = F.coalesce(F.col("_row")[text], F.lit(""))
    joined = at.join(hits, F.col("id").eqNullSafe(F.col("hit")) & (F.col("t") == F.col("hit_t")), "left").withColumn("lines", F.split(body, "\n", -1))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop")), lambda i: F.get(F.col("lines"), i))
    kept = F.when(F.col("drop").isNotNull(), F.array_join(left, "\n")).otherwise(body)
    return unpacked(joined, docs.columns, **{text: kept, "n_lines": F.size("lines").cast("long"), "n_dropped": F.coalesce(F.size("drop"), F.lit(0)).cast("long")})


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, pos, line, f.k IS NOT NULL AND doc_id < keeper AS gone FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
