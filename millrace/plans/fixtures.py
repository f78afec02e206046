"""The file-index tables that the queries run on, derived from the driver's tables.

Each is one SELECT in a dialect that both Spark and DuckDB read; {sha} is the only function that differs. `frames` gives Spark DataFrames, `sql` a statement with the same tables as CTEs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_EXT = "CASE doc_id % 8 WHEN 0 THEN '.txt' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' WHEN 3 THEN '.PNG' WHEN 4 THEN '.py' WHEN 5 THEN '.zip' WHEN 6 THEN '.mp4' ELSE '.xyz' END"
_BUCKET = "cast(cast(floor(n_chars / 1000) AS bigint) AS string)"
_PICK = "'doc_' || cast(doc_id % 300 AS string) || " + _EXT
_DAY = "lpad(cast(1 + {0} % 12 AS string), 2, '0') || '-' || lpad(cast(1 + {0} % 28 AS string), 2, '0') || 'T' || lpad(cast({0} % 24 AS string), 2, '0') || ':00:00Z'"

#: name -> (tables it reads, SELECT)
TABLES: dict[str, tuple[list[str], str]] = {
    "base": (
        ["documents"],
        f"""SELECT doc_id, source, lang, n_chars, text, {{sha}} AS sha, {_EXT} AS ext, {_PICK} AS name, lang || '/' || {_BUCKET} AS dir FROM {{documents}}""",
    ),
    "files": (
        ["base"],
        f"""SELECT file_id, package, dir || '/' || name AS relpath, package || '/' || dir AS folder, name AS filename, ext AS extension, n_chars AS size, mtime, sha, status, text FROM (
  SELECT doc_id AS file_id, source AS package, dir, name, ext, n_chars, '2024-' || {_DAY.format("doc_id")} AS mtime, CASE WHEN doc_id % 41 = 0 THEN NULL ELSE sha END AS sha,
    CASE doc_id % 8 WHEN 0 THEN 'discovered' WHEN 1 THEN 'hashed' WHEN 2 THEN 'extracted' WHEN 3 THEN 'classified' WHEN 4 THEN 'planned' WHEN 5 THEN 'applied' WHEN 6 THEN 'verified' ELSE 'error' END AS status, text FROM {{base}}
  UNION ALL
  SELECT doc_id + 1000000 AS file_id, 'src1_copy' AS package, dir, name, ext, n_chars, '2025-' || {_DAY.format("doc_id")} AS mtime, CASE WHEN doc_id % 41 = 0 THEN NULL ELSE sha END AS sha, 'hashed' AS status, text FROM {{base}} WHERE source = 'src1') x""",
    ),
    "folders": (
        ["files"],
        """SELECT folder, min(package) AS package, count(*) AS own_files FROM (
  SELECT folder, package FROM {files} UNION ALL SELECT package AS folder, package FROM {files} WHERE 1 = 0 UNION ALL SELECT DISTINCT package AS folder, package FROM {files}
  UNION ALL SELECT DISTINCT package || '/' || split_part(relpath, '/', 1) AS folder, package FROM {files}) x GROUP BY folder""",
    ),
    "content": (
        ["files"],
        """SELECT sha, min(file_id) AS id, CASE min(file_id) % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' WHEN 3 THEN 'code' ELSE 'other' END AS kind FROM {files} WHERE sha IS NOT NULL GROUP BY sha""",
    ),
    "decisions": (
        ["content"],
        f"""SELECT sha, id, 1 + id % 7 AS semester, 'S' || cast(id % 5 AS string) AS subject, CASE id % 4 WHEN 0 THEN 'wyklady' WHEN 1 THEN 'kolokwia' WHEN 2 THEN NULL ELSE 'laby' END AS category,
  CASE id % 6 WHEN 0 THEN 'skip' WHEN 1 THEN 'quarantine' WHEN 2 THEN 'media' ELSE 'copy' END AS action, CASE WHEN id % 13 = 0 THEN NULL ELSE cast(id % 100 AS double) / 100 END AS confidence,
  CASE WHEN id % 9 = 0 THEN 1 WHEN id % 17 = 0 THEN NULL ELSE 0 END AS needs_review, CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ground_truth' ELSE 'run' || cast(id % 3 AS string) END AS run_id,
  CASE id % 5 WHEN 0 THEN 'manual' WHEN 1 THEN 'deterministic' WHEN 2 THEN 'heuristic' WHEN 3 THEN 'llm' ELSE NULL END AS method, '2025-' || {_DAY.format("id")} AS decided_at,
  'SEM' || cast(1 + id % 7 AS string) || '/S' || cast(id % 5 AS string) || '/file_' || cast(id % 60 AS string) || '.txt' AS target, id % 11 = 0 AS outdated FROM {{content}} WHERE id % 10 <> 3""",
    ),
    "relations": (
        ["content"],
        """SELECT a.sha AS src, b.sha AS tgt, CASE a.id % 3 WHEN 0 THEN 'near_duplicate' WHEN 1 THEN 'older_version' ELSE 'related' END AS type, cast(50 + a.id % 50 AS double) / 100 AS confidence,
  CASE WHEN a.id % 4 = 0 THEN 'manual' ELSE 'near_dupe:simhash' END AS method FROM {content} a JOIN {content} b ON b.id = a.id + 1 WHERE a.id % 4 < 3""",
    ),
    "applied": (["decisions"], "SELECT 'SEM' || cast(semester AS string) || '/S' || cast(id % 5 AS string) || '/FILE_' || cast(id % 60 AS string) || '.TXT' AS target, sha FROM {decisions} WHERE id % 10 = 0"),
    "manual": (["content"], f"SELECT sha, CASE id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'skip' ELSE 'move' END AS kind, 'u' || cast(id % 4 AS string) AS decided_by, '2025-' || {_DAY.format('id')} AS decided_at, id FROM {{content}} WHERE id % 7 = 0"),
    "links": (["folders"], "SELECT least(a.folder, b.folder) AS folder_a, greatest(a.folder, b.folder) AS folder_b FROM {folders} a JOIN {folders} b ON a.package = 'src1' AND b.package = 'src1_copy' AND substring(a.folder, 5) = substring(b.folder, 10)"),
    "nodes": (
        ["region", "nation", "customer"],
        """SELECT 'r' || cast(r_regionkey AS string) AS id, 'region' AS type, r_name AS title, cast(NULL AS string) AS status, 0 AS level FROM {region}
  UNION ALL SELECT 'n' || cast(n_nationkey AS string), 'nation', n_name, 'in-progress', 1 FROM {nation}
  UNION ALL SELECT 'c' || cast(c_custkey AS string), 'customer', c_name, CASE c_custkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'in-progress' WHEN 2 THEN 'not-started' ELSE NULL END, cast(2 + c_custkey % 3 AS int) FROM {customer}""",
    ),
    "edges": (
        ["nation", "customer"],
        """SELECT 'n' || cast(n_nationkey AS string) AS source, 'r' || cast(n_regionkey AS string) AS target, 'belongs_to' AS kind FROM {nation}
  UNION ALL SELECT 'c' || cast(c_custkey AS string), 'n' || cast(c_nationkey AS string), 'belongs_to' FROM {customer} WHERE c_custkey % 10 <> 0
  UNION ALL SELECT 'c' || cast(c_custkey AS string), 'x' || cast(c_custkey % 50 AS string), NULL FROM {customer} WHERE c_custkey % 20 = 1""",
    ),
}
RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]


def frame(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """The table `name`; those it is made of come from `made` where they are there."""
    made = {} if made is None else made
    if name not in made:
        if name in RAW:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            needs, text = TABLES[name]
            made[name] = spark.sql(text.replace("{sha}", "sha2(text, 256)"), **{n: frame(spark, sf_dir, n, made) for n in needs})
    return made[name]


def sql(names: str, body: str) -> str:
    """`body` with the tables in `names` (and what they need) in front as CTEs."""

    def order(done: list[str], name: str) -> list[str]:
        if name in done or name in RAW:
            return done
        return reduce(order, TABLES[name][0], done) + [name]

    found = reduce(order, names.split(), [])
    ctes = [f"{n} AS MATERIALIZED ({TABLES[n][1].replace('{sha}', 'sha256(text)').format(**{k: k for k in TABLES[n][0]})})" for n in dict.fromkeys(found)]
    head = "WITH " + ",\n".join(ctes)
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + head[5:] + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return head + ",\n" + body[5:]
    return head + "\n" + body
