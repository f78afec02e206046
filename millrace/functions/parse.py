"""Python functions for what SQL has no words for: JSON inside prose and text differences."""

from __future__ import annotations

import re

import difflib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.session import ship


def first_json(text: str | None) -> str | None:
    """The first object or array in a text, whatever stands around it, as compact JSON."""
    decoder = json.JSONDecoder()
    for i, c in enumerate(text or ""):
        if c in "{[":
            try:
                value, _ = decoder.raw_decode(text, i)
            except ValueError:
                continue
            return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    return None


def json_inside(c: Column) -> Column:
    ship()

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([first_json(t) for t in s], dtype=object)

    return run(c)


def differences(a: Column, b: Column, context: int = 2) -> Column:
    """A unified difference of two texts by lines."""
    ship()

    @F.pandas_udf(StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series(["\n".join(difflib.unified_diff((p or "").split("\n"), (q or "").split("\n"), "a", "b", n=context, lineterm="")) for p, q in zip(x, y)], dtype=object)

    return run(a, b)


def prompt(template: str, values: dict[str, Column], absent: str = "(none)") -> Column:
    """A text with each {{NAME}} of `values` put in once, empty and null ones as `absent`; what a value holds is never read as a placeholder again, and names without a value stay."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{([A-Z0-9_]+)\}\}", template):
        if m[1] in values:
            parts += [F.lit(template[at : m.start()]), F.coalesce(F.nullif(values[m[1]].cast("string"), F.lit("")), F.lit(absent))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


#: Kinds of shared documents by the part of their address, and what an identifier is made of.
DOCUMENTS, IDENTIFIER = {"document": "doc", "spreadsheets": "sheet", "presentation": "slide"}, r"([-\w]{20,})"


def resource(target: Column) -> Column:
    """(kind, id) of the address of a shared resource: doc, sheet, slide, folder or file; `unknown` with an identifier where only that is given, as a parameter or by itself, and without one where there is none."""
    t = F.trim(target)
    found = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    parameter = found(r"[?&]id=" + IDENTIFIER)
    shapes = [(kind, found(rf"/{part}/d/{IDENTIFIER}")) for part, kind in DOCUMENTS.items()]
    shapes += [("folder", F.when(t.contains("embeddedfolderview"), parameter)), ("folder", found("/folders/" + IDENTIFIER)), ("file", found("/file/d/" + IDENTIFIER)), ("file", F.when(t.rlike(r"uc\?(id|export)="), parameter)), ("unknown", parameter), ("unknown", found(f"^{IDENTIFIER}$"))]
    cells = F.array(*[F.struct(F.lit(kind).alias("kind"), i.alias("id")) for kind, i in shapes])
    known = F.filter(cells, lambda x: x["id"].isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.struct(F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("id")))
