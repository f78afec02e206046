"""Recall of the near-duplicate join, outside the test run.

    python tests/llm/recall_minhash.py /root/testdata/sf0.1    all links of a folder's documents, by an exact prefix join, against the components found
    python tests/llm/recall_minhash.py copies 100000           near copies of one text: seconds and components
    python tests/llm/recall_minhash.py family 20000            texts that share half of their shingles with each other and are linked in pairs only
"""

from __future__ import annotations

import math
import random
import re
import sys
import time
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from millrace.llm.minhash_dedup import near_duplicates  # noqa: E402
from millrace.session import local_session  # noqa: E402


def shingles(text: str | None, k: int) -> frozenset[int]:
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(hash(tuple(words[i : i + k])) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def exact_links(sets: dict[int, frozenset[int]], percent: int) -> list[tuple[int, int]]:
    """All pairs at the threshold among different sets: two such sets share one of their rarest elements, of which as many count as they may differ in."""
    often = Counter(e for s in sets.values() for e in s)
    held, out = defaultdict(list), []
    for i, s in sorted(sets.items(), key=lambda x: (len(x[1]), x[0])):
        rare = sorted(s, key=lambda e: (often[e], e))[: len(s) - math.ceil(percent * len(s) / 100) + 1]
        for j in {j for e in rare for j in held[e]}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                out.append((j, i))
        for e in rare:
            held[e].append(i)
    return out


def compare(folder: str, k: int = 4, percent: int = 80) -> None:
    spark = local_session(8)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    began = time.time()
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, k=k, percent=percent).collect()}
    took = time.time() - began
    classes: dict[frozenset[int], int] = {}
    for r in docs.orderBy("doc_id").collect():
        if s := shingles(r.text, k):
            first = classes.setdefault(s, r.doc_id)
            assert got[r.doc_id] == got[first], f"{r.doc_id} and {first} have equal sets"
    links = exact_links({i: s for s, i in classes.items()}, percent)
    missed = [x for x in links if got[x[0]] != got[x[1]]]
    top = {i: i for i in classes.values()}

    def find(x: int) -> int:
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    wrong = sum(got[i] != find(i) for i in top)
    print(f"{folder}: {len(classes)} different sets, {len(links)} links, {len(missed)} missed, recall {1 - len(missed) / max(1, len(links)):.6f}, {wrong} other components, {took:.0f} s")


def copies(n: int, edits: int = 3, words: int = 200) -> None:
    spark = local_session(8)
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(32)
    began = time.time()
    got = near_duplicates(docs, k=4).select("component_id").distinct().count()
    print(f"{n} near copies: {got} components, {time.time() - began:.0f} s")


def family(n: int, words: int = 120) -> None:
    """Each text has the first part in common with all others, so that they are about half alike; each two neighbours differ in one word."""
    spark = local_session(8)
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    rows = []
    for i in range(0, n, 2):
        own = base[: 2 * words // 3] + [f"u{i}_{j}" for j in range(words // 3)]
        rows += [(i, " ".join(own)), (i + 1, " ".join([*own[:-1], "end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(32)
    began = time.time()
    got = near_duplicates(docs, k=4).where("component_id <> doc_id").count()
    print(f"family of {n}: {got} of {n // 2} pairs found, {time.time() - began:.0f} s")


if __name__ == "__main__":
    {"copies": lambda: copies(int(sys.argv[2])), "family": lambda: family(int(sys.argv[2]))}.get(sys.argv[1], lambda: compare(sys.argv[1]))()
