import json

from pyspark.sql import functions as F

from tracegraph.operators import reports as R


def test_transcripts(spark):
    use = lambda i, name, **x: {"type": "tool_use", "id": i, "name": name, "input": x}
    result = lambda i, content: {"type": "tool_result", "tool_use_id": i, "content": content}
    messages = [[use("1", "Bash", command="/usr/bin/rg x | head\nls"), use("2", "Read", path="p")], [result("1", "abcd"), result("2", [{"type": "text", "text": "xyz"}, {"content": [{"text": "12"}]}])], [use("3", "Bash", command="python3 tool.py callers f"), use("4", "LSP", operation="refs"), use("5", "Bash", command="  ")], [result("3", None)]]
    lines = [("s", json.dumps({"message": {"content": m}})) for m in messages] + [("s", "not json"), ("s", '{"message": {"content": "text"}}'), ("t", "{}")]
    calls = R.transcript_calls(spark.createDataFrame(lines, "session string, value string"), {"tool.py": "graph"})
    assert {(r.id, r.sig, r.operation, r.bytes) for r in calls.collect()} == {("1", "grep", None, 4), ("2", "Read", None, 5), ("3", "graph:callers", None, 0), ("4", "other-tool:LSP", "refs", 0), ("5", "(empty)", None, 0)}
    runs = spark.createDataFrame([("s",), ("t",)], "session string")
    assert [r.session for r in R.unused(runs, calls, "LSP").collect()] == ["t"]
    top = R.top_signatures(calls, "session", 2).collect()
    assert [(r.sig, r.bytes) for r in sorted(top, key=lambda r: -r.bytes)] == [("Read", 5), ("grep", 4)]


def test_scores(spark):
    scores = spark.createDataFrame([("q1", "a", 3), ("q1", "a", 1), ("q1", "a", 2), ("q1", "b", 3), ("q1", "b", 3), ("q1", "b", 2), ("q2", "a", 1)], "question string, arm string, score int")
    m = R.medians(scores)
    assert {tuple(r) for r in m.collect()} == {("q1", "a", 2, True), ("q1", "b", 3, False)}
    paid = R.points(m, spark.createDataFrame([("a", 1.0), ("a", 3.0)], "arm string, cost double"))
    assert {(r.arm, r.points, r.cost_per_point) for r in paid.collect()} == {("a", 2, 2.0), ("b", 3, None)}
    wide = R.by_question(m, "question", "arm", ["a", "b"], F.col("score")).first()
    assert (wide.a, wide.b) == (2, 3)
    assert {(r.arm, r.runs, r.score) for r in R.sums(scores, "arm", ["score"]).collect()} == {("a", 4, 7), ("b", 3, 8)}


def test_run_matrix(spark):
    matrix = spark.createDataFrame([(q, a) for q in "xy" for a in "ab"], "q string, a string")
    done = spark.createDataFrame([("x", "a", 1, 0), ("x", "a", 2, 1), ("y", "b", 1, 0)], "q string, a string, v int, at int")
    assert {tuple(r) for r in R.waiting(matrix, done, ["q", "a"]).collect()} == {("x", "b"), ("y", "a")}
    assert {(r.q, r.v) for r in R.latest(done, ["q", "a"], F.col("at")).collect()} == {("x", 2), ("y", 1)}
    entries = spark.createDataFrame([("/old/w", "a.c", ["cc", "-I/old/i"], None)], "directory string, file string, arguments array<string>, command string")
    assert tuple(R.moved_entries(entries, "/old", "/new").first()) == ("/new/w", "a.c", ["cc", "-I/new/i"], None)
    lines = spark.createDataFrame([("PASS: built",), ("FAIL x",), ("PASSED",), ("other",)], "value string")
    assert {tuple(r) for r in R.verdicts(lines).collect()} == {("PASS", "built"), ("FAIL", "x")}


def test_embedding():
    import pytest

    text = "a\n<<<\nold\n>>>\nb"
    assert R.embedded(text, "new\nlines", "<<<", ">>>") == "a\n<<<\nnew\nlines\n>>>\nb"
    for bad in ("a\n<<<\nb", ">>>\n<<<", "<<<\n<<<\n>>>"):
        with pytest.raises(ValueError):
            R.embedded(bad, "x", "<<<", ">>>")
    with pytest.raises(ValueError):
        R.embedded(text, "x\n>>>", "<<<", ">>>")
