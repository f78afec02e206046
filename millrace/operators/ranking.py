"""Full-text ranking over notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T


def search(notes: DataFrame, query: str, limit: int = 6, *, title_weight: float = 3.0, fuzzy: float = 0.15, k1: float = 1.2, b: float = 0.7) -> DataFrame:
    """(id, score): notes (id, title, body) that hold a word of the query, begin with it, or, for words of over three letters, differ in a few; titles weigh more. Document frequencies are counted over all notes."""
    words = [w for w in dict.fromkeys(query.lower().split()) if w]
    fields = notes.select("id", F.explode(F.array(F.struct(F.lit(title_weight).alias("w"), T.tokens(F.col("title")).alias("t")), F.struct(F.lit(1.0).alias("w"), T.tokens(F.col("body")).alias("t")))).alias("f")).select("id", "f.w", "f.t")
    size = notes.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    mean = fields.where("w = 1.0").agg(F.avg(F.size("t")).alias("m")).first()["m"] or 1.0
    terms = fields.select("id", "w", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("id", "w", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    near = []
    for w in words:
        far = round(fuzzy * len(w)) if len(w) > 3 else 0
        match = F.when(F.col("term") == w, 1.0).when(F.col("term").startswith(w), 0.6)
        near.append((match.when(F.levenshtein("term", F.lit(w)) <= far, 0.4) if far else match).otherwise(0.0))
    hit = terms.withColumn("m", F.greatest(*near) if len(near) > 1 else near[0]).where("m > 0")
    df = hit.groupBy("term").agg(F.count_distinct("id").alias("df"))
    idf = F.ln(1 + (size - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("w") * F.col("m") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
    return hit.join(df, "term").groupBy("id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
