import json

from revloom.operators import inspect


def test_blobs_and_sessions(spark):
    rows = spark.createDataFrame([("a", bytearray(b"text \n")), ("b", bytearray(b"a\0b")), ("c", bytearray(b"\x10\x01")), ("d", bytearray(b""))], "id string, body binary")
    got = {r.id: json.loads(r.shown) for r in inspect.blobs(rows).collect()}
    assert got["a"] == {"id": "a", "kind": "blob", "size": 6, "binary": False, "text": "text \n"} and got["b"] == {"id": "b", "kind": "blob", "size": 3, "binary": True}
    assert got["c"]["binary"] is False and got["d"]["text"] == ""
    sessions = spark.createDataFrame([("s", "task", "m", "l", "green", 5, None, ["x", "y"], None)], "id string, task string, model string, lesson string, verified string, tokens_in long, tokens_out long, tool_calls array<string>, tool_results array<string>")
    assert json.loads(inspect.sessions(sessions).collect()[0].shown) == {"id": "s", "kind": "session", "task": "task", "model": "m", "lesson": "l", "verified": "green", "tokens_in": 5, "tokens_out": None, "tool_calls": 2, "tool_results": 0}
