import json

from millrace.llm import tool_calls as C

CALLS = "conv_id long, call_id string, turn long, tool string, arguments string, needs array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"add": {"properties": {"a": {"type": "integer"}, "b": {"type": "number"}}, "required": ["a"]}}


def linked(spark, calls, results):
    return {(r.call_id, r.turn, r.result_turn): r for r in C.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()}


def test_links_orders_validates_and_serialises(spark):
    calls = [(1, "a", 0, "add", '{"b": 2.5, "a": 1}', []), (1, "b", 2, "add", '{"a": true}', ["a"]), (1, "c", 3, "add", "not json", ["a", "b"]), (1, "d", 4, "other", "{}", ["gone"]), (1, "e", 5, "add", None, ["f"]), (1, "f", 6, "add", '{"a": 1, "z": 2}', ["e"])]
    got = linked(spark, calls, [(1, "a", 1, "zażółć"), (1, "x", 9, "lost"), (2, "b", 3, "other conversation")])
    a = got["a", 0, 1]
    assert (a.status, a.level, a.valid) == ("linked", 0, True)
    assert a.json == '{"call":{"arguments":{"a":1,"b":2.5},"id":"a","name":"add"},"result":{"content":"zażółć","id":"a"}}'
    assert {k[0]: (r.status, r.level, r.valid) for k, r in got.items() if k[1] is not None and k[0] != "a"} == {"b": ("unanswered", 1, False), "c": ("unanswered", 2, False), "d": ("unanswered", 0, False), "e": ("unanswered", None, False), "f": ("unanswered", None, False)}
    assert got["x", None, 9].status == "orphan" and got["b", None, 3].status == "orphan" and got["x", None, 9].valid is None


def test_repeated_and_null_identifiers(spark):
    calls = [(1, "a", 0, "add", '{"a": 1}', []), (1, "a", 4, "add", '{"a": 2}', []), (1, None, 5, "add", '{"a": 3}', [])]
    got = linked(spark, calls, [(1, "a", 2, "first"), (1, "a", 3, "second"), (1, None, 6, "nothing")])
    assert {k: r.status for k, r in got.items()} == {("a", 0, 2): "linked", ("a", 4, None): "repeated", (None, 5, None): "unanswered", ("a", None, 3): "repeated", (None, None, 6): "orphan"}


def test_empty_tables_and_long_texts(spark):
    assert linked(spark, [], []) == {}
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "x" * 300_000), (1, 2, "assistant", "y"), (1, 3, "user", None)], "conv_id long, turn long, role string, text string")
    calls, results = C.from_conversations(turns)
    got = {r.turn: r for r in C.link(calls, results, C.SCHEMAS).collect()}
    assert got[1].status == "linked" and got[1].level == 1 and got[3].valid is False and got[0].level == 0
    assert json.loads(got[1].json)["result"]["content"] == "y"


def test_equal_calls_and_results_have_a_row_each(spark):
    call = (1, "a", 0, "add", '{"a": 1}', [])
    rows = C.link(spark.createDataFrame([call, call, (1, "a", 0, "add", '{"a": 0}', [])], CALLS), spark.createDataFrame([(1, "a", 2, "yes"), (1, "a", 2, "no"), (1, "a", 2, "no"), (1, "a", 0, "early")], RESULTS), SCHEMAS).collect()
    assert sorted((r.turn is None, r.status, r.json) for r in rows) == [
        (False, "linked", '{"call":{"arguments":{"a":0},"id":"a","name":"add"},"result":{"content":"no","id":"a"}}'),
        (False, "repeated", '{"call":{"arguments":{"a":1},"id":"a","name":"add"}}'),
        (False, "repeated", '{"call":{"arguments":{"a":1},"id":"a","name":"add"}}'),
        (True, "repeated", '{"result":{"content":"early","id":"a"}}'),
        (True, "repeated", '{"result":{"content":"no","id":"a"}}'),
        (True, "repeated", '{"result":{"content":"yes","id":"a"}}'),
    ]


def test_arguments_that_are_no_plain_json(spark):
    bad = ['{"a": NaN}', '{"a": 1, "b": 1e400}', '{"a": -Infinity}', '{"a": 1, "b": "\\ud800"}', '{"a": 1, "a": 2}', "[" * 100_000, "[" * 900 + "]" * 900, '{"a": ' + "9" * 5000 + "}", "", None]
    good = ['{"a": 1.0, "b": 2.50}', '{"a": 10e1, "b": 0.1e-6}', '{"a": -0.0}', '{"b": 1e22, "a": ' + "9" * 30 + "}"]
    calls = [(1, f"c{i}", i, "add", x, []) for i, x in enumerate(bad + good)]
    got = {k[1]: r for k, r in linked(spark, calls, []).items()}
    assert [got[i].valid for i in range(len(bad))] == [False] * len(bad)
    assert all(json.loads(r.json)["call"]["arguments"] == x or i == 6 for (i, r), x in zip(sorted(got.items()), bad))
    assert [got[len(bad) + i].json.split('"arguments":')[1].split(',"id"')[0] for i in range(4)] == ['{"a":1,"b":2.5}', '{"a":100,"b":1e-07}', '{"a":0}', '{"a":' + "9" * 30 + ',"b":1e+22}']
    assert all(got[len(bad) + i].valid for i in range(4))


def test_a_chain_of_calls_and_clashing_columns(spark):
    calls = spark.createDataFrame([(1, f"c{i:02}", i, "add", '{"a": 1}', [f"c{i - 1:02}"] if i else [], "x", 5) for i in range(12)], CALLS + ", content string, row long")
    results = spark.createDataFrame([(1, "c03", 20, "r", "y")], RESULTS + ", first string")
    got = {r.call_id: (r.level, r.status) for r in C.link(calls, results, SCHEMAS).collect()}
    assert got == {f"c{i:02}": (i, "linked" if i == 3 else "unanswered") for i in range(12)}
