"""Tool-call linking for chat data.

Calls (call_id, conv_id, turn, tool, arguments, needs) and results (call_id, conv_id, turn, content) are hash-joined by conversation and identifier. Within a
conversation a call comes after the calls that it needs: its level is the length of the longest chain below it, found by peeling (a call is released when all
it needs are), one join a level and as many levels as there are; a call that is never released is in a cycle or needs one, and has level null. Arguments are validated
against the tool's schema, and every message is serialised as canonical JSON: sorted keys, no blanks, non-ASCII characters as they are, one form for each number (whole numbers as digits, others as the shortest decimal that reads back the same).
(level, turn, call_id) orders the messages of a conversation; each message is a row, so a conversation of any length stays distributed.

There is one row for each call and each result that no call takes. `status` is linked, unanswered (no result), orphan (no call); where an identifier repeats within a conversation, the call is the row of the smallest turn
(then tool, arguments and needs), its result is the one of the smallest turn after it (then content), and all other rows, equal ones too, are `repeated`. `valid` tells whether the tool is known, the arguments are a JSON object with all required
fields, no unknown ones and the right types; null for results without a call.

Defined cases: a null call_id links with nothing; null arguments are invalid, and so are texts that are no JSON, that hold NaN, infinities, numbers beyond a double or of over 4,300 digits, lone surrogates, repeated keys, or nesting deeper than the parser goes:
they are serialised as the text that they are. A needed identifier that doesn't exist in the conversation is ignored; a type that the schema names but this module doesn't know fits nothing. Columns beside those named are not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from millrace.llm.common import forget, materialise, python_ready, shared_path, table

#: type name of a schema -> Python types that the parser gives
TYPES = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "object": (dict,), "array": (list,), "null": (type(None),)}


def _number(text: str) -> int | float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError(f"beyond a double: {text}")
    return int(x) if x.is_integer() and abs(x) < 1 << 53 else x


def _refused(text: str) -> None:
    raise ValueError(f"not JSON: {text}")


def _once(pairs: list[tuple[str, object]]) -> dict:
    if len(found := dict(pairs)) < len(pairs):
        raise ValueError("a key repeats")
    return found


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value: object, kind: str) -> bool:
    return isinstance(value, TYPES.get(kind, ())) and (kind == "boolean" or not isinstance(value, bool))


def check(arguments: str | None, schema: dict | None) -> tuple[bool, object]:
    """Whether the arguments fit the schema {"properties": {name: {"type": ...}}, "required": [...]}, and the value parsed (or the text)."""
    if arguments is None:
        return False, None
    try:
        value = json.loads(arguments, parse_float=_number, parse_constant=_refused, object_pairs_hook=_once)
        canonical(value).encode()
    except (ValueError, RecursionError):
        return False, arguments
    if schema is None or not isinstance(value, dict):
        return False, value
    known = schema.get("properties", {})
    good = all(k in value for k in schema.get("required", [])) and all(k in known and _is(v, known[k]["type"]) for k, v in value.items())
    return good, value


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of `calls` (conv_id, call_id, needs): 0 without needs, else one more than the largest of what is needed. One round a level, each over what is left; all rounds write into one folder."""
    spark = calls.sparkSession
    key = ["conv_id", "call_id"]
    ids = calls.select(*key).where("call_id IS NOT NULL").distinct()
    edges = calls.where("call_id IS NOT NULL").select(*key, F.explode("needs").alias("need")).distinct()
    edges = materialise(edges.join(ids.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_semi"), "needs")
    folder, level, done = shared_path(spark, "levels"), 0, None
    released = ids.join(edges, key, "left_anti")
    while True:
        path = f"{folder}/level={level}"
        released.write.parquet(path)
        if done is not None:
            forget(done)
        released = spark.read.schema(ids.schema).parquet(path)
        if edges.isEmpty() or released.isEmpty():  # what is left is in a cycle or needs one
            return spark.read.schema(StructType([*ids.schema.fields, StructField("level", IntegerType())])).option("basePath", folder).parquet(folder)
        left = materialise(edges.join(released.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti"), "needs")
        released = edges.select(*key).distinct().join(left, key, "left_anti")
        done, edges, level = edges, left, level + 1


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, call_id, turn, result_turn, tool, status, level, valid, json), a row for each call and each result that no call takes."""
    python_ready(calls.sparkSession)
    key = ["conv_id", "call_id"]
    # rows get numbers, so that of equal ones just one is taken; written, as the numbers have to stay
    calls = materialise(calls.select(*key, "turn", "tool", "arguments", "needs").withColumn("row", F.monotonically_increasing_id()), "calls")
    results = materialise(results.select(*key, "turn", "content").withColumn("row", F.monotonically_increasing_id()), "results")
    firsts = calls.where("call_id IS NOT NULL").groupBy(*key).agg(F.min(F.struct("turn", "tool", "arguments", "needs", "row")).alias("f")).select(*key, F.col("f.turn").alias("first"), F.col("f.row").alias("first_row"))
    firsts = materialise(firsts, "first-calls")
    after = results.join(firsts, key).where(F.col("turn") > F.col("first")).groupBy(*key).agg(F.min(F.struct("turn", "content", "row")).alias("r"))
    after = materialise(after.select(*key, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), F.col("r.row").alias("result_row")), "first-results")
    both = calls.join(firsts, key, "left").join(after, key, "left").join(levels(calls), key, "left")
    own = F.coalesce(F.col("row") == F.col("first_row"), F.lit(False))
    taken = own & F.col("result_row").isNotNull()
    status = F.when(taken, "linked").when(~own & F.col("call_id").isNotNull(), "repeated").otherwise("unanswered")
    rows = both.select(*key, "turn", F.when(taken, F.col("result_turn")).alias("result_turn"), "tool", "arguments", F.when(taken, F.col("content")).alias("content"), status.alias("status"), "level", F.lit(True).alias("called"))
    used = after.select(*key, "result_row")
    rest = results.join(used, key, "left").where(F.col("result_row").isNull() | (F.col("result_row") != F.col("row")))
    none = lambda kind: F.lit(None).cast(kind)
    lost = rest.select(*key, none("long").alias("turn"), F.col("turn").alias("result_turn"), none("string").alias("tool"), none("string").alias("arguments"), "content", F.when(F.col("result_row").isNull(), "orphan").otherwise("repeated").alias("status"), none("int").alias("level"), F.lit(False).alias("called"))

    @F.pandas_udf("valid boolean, json string")
    def serialised(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for ids, tools, arguments, contents, statuses, called in batches:
            out = []
            for i, tool, given, content, status, call in zip(ids, tools, arguments, contents, statuses, called):
                if not call:
                    out.append((None, canonical({"result": {"content": content, "id": i}})))
                    continue
                good, value = check(given, schemas.get(tool))
                message = {"call": {"arguments": value, "id": i, "name": tool}}
                if status == "linked":
                    message["result"] = {"content": content, "id": i}
                out.append((good, canonical(message)))
            yield pd.DataFrame({"valid": pd.Series([g for g, _ in out], dtype="object"), "json": [j for _, j in out]})

    done = rows.union(lost).withColumn("s", serialised("call_id", "tool", "arguments", "content", "status", "called"))
    return done.select(*key, "turn", "result_turn", "tool", "status", "level", F.col("s.valid").alias("valid"), F.col("s.json").alias("json"))


#: The conversations carry no tool calls: each user turn is taken as a call of `reply`, answered by the assistant's next turn under the same identifier; the system turn is a call that all of the conversation's replies need.
SCHEMAS = {
    "reply": {"properties": {"prompt": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["prompt", "turn"]},
    "instruct": {"properties": {"prompt": {"type": "string"}}, "required": ["prompt"]},
}


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table (conv_id, turn, role, text)."""
    name = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    asked = turns.where(F.col("role").isin("user", "system"))
    systems = turns.where(F.col("role") == "system").groupBy("conv_id").agg(F.min("turn").alias("_sys"))
    asked = asked.join(systems, "conv_id", "left")
    user = F.col("role") == "user"
    # a null text is left out of the arguments, which makes them invalid
    given = F.when(user, F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))).otherwise(F.to_json(F.struct(F.col("text").alias("prompt"))))
    needs = F.when(user & F.col("_sys").isNotNull(), F.array(name(F.col("_sys")))).otherwise(F.array().cast("array<string>"))
    calls = asked.select("conv_id", name(F.col("turn")).alias("call_id"), F.col("turn").cast("long").alias("turn"), F.when(user, "reply").otherwise("instruct").alias("tool"), given.alias("arguments"), needs.alias("needs"))
    results = turns.where(F.col("role") == "assistant").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("turn").cast("long").alias("turn"), F.col("text").alias("content"))
    return calls, results


SQL = r"""
WITH sys AS (SELECT conv_id, min(turn) AS s FROM conversations WHERE role = 'system' GROUP BY conv_id),
calls AS (
  SELECT c.conv_id, c.conv_id || '-' || turn AS call_id, turn, role, CASE WHEN role = 'user' THEN 'reply' ELSE 'instruct' END AS tool,
    CASE WHEN role = 'user' AND s IS NOT NULL THEN 1 ELSE 0 END AS level, text
  FROM conversations c LEFT JOIN sys USING (conv_id) WHERE role IN ('user', 'system')),
res AS (SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, turn, text FROM conversations WHERE role = 'assistant'),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, r.turn AS result_turn, c.tool, c.level, c.text AS prompt, r.text AS content, c.call_id IS NOT NULL AS called, r.call_id IS NOT NULL AS answered
  FROM calls c FULL JOIN res r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT conv_id, call_id, turn, result_turn, CASE WHEN NOT called THEN 'orphan' WHEN answered THEN 'linked' ELSE 'unanswered' END AS status, level,
  CASE WHEN called THEN prompt IS NOT NULL END AS valid,
  sha256(CASE WHEN called THEN '{"call":{"arguments":{"prompt":' || to_json(prompt)::VARCHAR || CASE WHEN tool = 'reply' THEN ',"turn":' || turn ELSE '' END || '},"id":"' || call_id || '","name":"' || tool || '"}'
      || CASE WHEN answered THEN ',"result":{"content":' || to_json(content)::VARCHAR || ',"id":"' || call_id || '"}}' ELSE '}' END
    ELSE '{"result":{"content":' || to_json(content)::VARCHAR || ',"id":"' || call_id || '"}}' END) AS json_sha256
FROM j
"""


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = from_conversations(table(spark, sf_dir, "conversations"))
    return link(calls, results, SCHEMAS).select("conv_id", "call_id", "turn", "result_turn", "status", "level", "valid", F.sha2(F.col("json").cast("binary"), 256).alias("json_sha256"))
