"""Writers. Spark's commit protocol replaces temporary files and renames; a single file is written only where one is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_json(df: DataFrame) -> Column:
    """A row as JSON with its columns sorted by name and nulls kept."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    rows = df.select(sorted_json(df).alias("value"), *[F.col(c).alias(f"_{c}") for c in order or []])
    if order:
        rows = rows.orderBy(*[f"_{c}" for c in order])
    rows.select("value").write.mode("overwrite").text(path)


def csv(df: DataFrame, path: str, ratios: list[str]) -> None:
    """Columns in their order, ratios with four decimals."""
    df.withColumns({c: F.format_string("%.4f", c) for c in ratios}).write.mode("overwrite").option("header", "true").csv(path)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, ord, json): a line a node by id and a line an edge by (source, target); absent values are left out."""
    n = nodes.select(F.lit("node").alias("part"), F.col("id").alias("ord"), F.to_json(F.struct(*sorted(nodes.columns))).alias("json"))
    e = edges.select(F.lit("edge").alias("part"), F.concat_ws("\0", "source", "target").alias("ord"), F.to_json(F.struct(*sorted(edges.columns))).alias("json"))
    return n.union(e)


def search_index(notes: DataFrame) -> DataFrame:
    return notes.select("id", F.to_json(F.struct("id", "title", "body")).alias("json"))


def _first(df: DataFrame, limit: int) -> tuple[list, int]:
    """The first rows and the number of all others, which are counted only if there are any."""
    rows = df.limit(limit + 1).collect()
    return rows[:limit], df.count() - limit if len(rows) > limit else 0


def report(sections: dict[str, DataFrame], limit: int = 200) -> str:
    """Markdown tables of small results; more than `limit` rows of a section are counted, not listed."""
    out = []
    for title, df in sections.items():
        rows, more = _first(df, limit)
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("—" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows]
        out += [f"… {more} more"] if more else []
        out.append("")
    return "\n".join(out)


def html_report(sections: dict[str, DataFrame], limit: int = 200) -> str:
    """The same as an HTML page."""
    from html import escape

    out = ["<!doctype html><meta charset='utf-8'>"]
    for title, df in sections.items():
        rows, more = _first(df, limit)
        out.append(f"<h2>{escape(title)}</h2><table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in df.columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{escape('—' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows]
        out.append("</table>" + (f"<p>… {more} more</p>" if more else ""))
    return "\n".join(out)


def vault(notes: DataFrame, path: str) -> None:
    """Notes (folder, title, meta map, body) as text with front matter, a folder each; what was there is replaced."""
    head = F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    notes.select("folder", F.concat(F.lit("---\n"), head, F.lit("\n---\n# "), "title", F.lit("\n\n"), "body").alias("value")).write.mode("overwrite").partitionBy("folder").text(path)


def snapshot(df: DataFrame, path: str, plan_hash: str) -> None:
    """States of operations before anything is changed, with the plan's hash."""
    df.select(F.to_json(F.struct(F.lit(plan_hash).alias("plan_hash"), *df.columns)).alias("value")).write.mode("errorifexists").text(path)
