"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter's vector, permuted (rolled) by its place, is bound (multiplied) with those of its
neighbours into the vector of an n-gram; the n-grams of a text are bundled (added up) into the vector of the text, and those of a
language's texts into its prototype. A text has the language whose prototype is nearest by cosine.

The letters that the vectors are drawn for are all code points: a letter's vector comes from a generator seeded with the code point, so
nothing about the alphabet has to be learned or sent. Prototypes come from a bounded sample of the labelled rows (max_train_rows for each language, chosen by a hash),
added up where the rows are; only one vector for each language and partition moves. Prediction reads whole texts.

The score is the nearest prototype's share of a softmax over the cosines (times `sharpness`). Ties go to the smaller language name. A text
without a letter, or null, is `und` with score 0; so is everything when no labelled row has a letter. Input columns named like the outputs are replaced, and all others stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import held_out, named, packed, python_ready, table, unpacked
from millrace.llm.text_arrays import code_points, pieces

DIM, N, GROUP = 1024, 3, 1 << 17


@lru_cache(maxsize=20_000)
def letter(code: int) -> np.ndarray:
    return np.random.default_rng(0x5EED + code).integers(0, 2, DIM, np.int8) * 2 - 1


def ngram_vectors(codes: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each n-gram; `codes` holds N code points (21 bits each) in an int64."""
    out = np.ones((len(codes), DIM), np.int8)
    for place in range(N):
        points, at = np.unique((codes >> (21 * (N - 1 - place))) & 0x1FFFFF, return_inverse=True)
        out *= np.stack([np.roll(letter(int(p)), N - 1 - place) for p in points])[at]
    return out


def bundles(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray | None]]:
    """Each text's place and vector (None without a letter). Single letters count with the boundaries around them. Texts go in pieces of GROUP characters, so the n-grams held at once are few whatever the alphabet and the length."""
    total = np.zeros(DIM)
    some = False
    for parts, skip, size, strings in pieces(texts, GROUP, 1, 1):
        x, bounds = code_points(strings, "alpha")
        x = x.astype(np.int64)
        first = bounds[:-1] + 1 + skip  # of each piece, the first character that counts
        counts = x != 0
        inside = np.zeros(len(x) + 1, np.int64)
        np.add.at(inside, first, 1)
        np.add.at(inside, first + size, -1)
        ok = np.flatnonzero(counts & (np.cumsum(inside[:-1]) > 0))
        found, at = np.unique((x[ok - 1] << 42) | (x[ok] << 21) | x[ok + 1], return_inverse=True)
        row = np.searchsorted(ok, np.append(first, len(x)))
        vectors = np.empty((len(found), DIM), np.int8)
        for k in range(0, len(found), 4096):
            vectors[k : k + 4096] = ngram_vectors(found[k : k + 4096])
        for r, (place, last) in enumerate(parts):
            own = at[row[r] : row[r + 1]]
            if len(own):
                some = True
                kinds, n = np.unique(own, return_counts=True)
                for m in range(0, len(kinds), 4096):
                    total += n[m : m + 4096].astype(np.float32) @ vectors[kinds[m : m + 4096]].astype(np.float32)
            if last:
                yield place, total if some else None
                total, some = np.zeros(DIM), False


@dataclass
class Profiles:
    names: list[str]
    vectors: np.ndarray
    sharpness: float = 20.0

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if self.names:
            for k, v in bundles(texts):
                if v is not None and (size := float(np.linalg.norm(v))) > 0:
                    e = self.sharpness * (self.vectors @ (v / size))
                    best = int(np.argmax(e))
                    langs[k], scores[k] = self.names[best], float(1 / np.exp(e - e[best]).sum())
        return langs, scores


def learn(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", usable: Column | None = None, max_train_rows: int = 4000) -> Profiles:
    """Prototypes of the languages among the rows for which `usable` holds, from about max_train_rows rows of each at most."""
    python_ready(docs.sparkSession)
    rows = docs.where(named(lang).isNotNull() & named(text).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.select(named(doc_id).alias("id"), named(text).alias("text"), named(lang).alias("lang"))
    counts = {r["k"]: r["n"] for r in rows.groupBy(F.col("lang").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Profiles([], np.zeros((0, DIM)))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, max_train_rows / n))]), F.col("lang"))
    rows = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < share * 1e6)

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            names = pdf["lang"].tolist()
            for k, v in bundles(pdf["text"].tolist()):
                if v is not None and (size := float(np.linalg.norm(v))) > 0:
                    sums[names[k]] = sums.get(names[k], 0) + v / size
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})

    parts = rows.select("lang", "text").mapInPandas(added, "lang string, v array<double>")
    total = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = sorted((r["lang"], np.array([e["x"] for e in r["v"]])) for r in total.collect())
    return Profiles([k for k, _ in found], np.array([v / max(float(np.linalg.norm(v)), 1e-9) for _, v in found]).reshape(len(found), DIM))


def identify(docs: DataFrame, profiles: Profiles, *, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score."""
    python_ready(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            langs, scores = profiles.predict(s.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    out = packed(docs, told=predicted(named(text)))
    return unpacked(out, docs.columns, lang_pred=F.col("told.lang_pred"), score=F.col("told.score"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs, usable=~held_out("doc_id"))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
