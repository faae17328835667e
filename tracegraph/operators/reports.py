"""Reports over benchmark runs: sums, top signatures, pivots, medians of repetitions, tool calls of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Commands that stand for themselves.
COMMANDS = {"grep": "grep", "rg": "grep", "awk": "awk", "sed": "sed", "cat": "cat", "find": "find", "ls": "ls", "sqlite3": "sqlite3"}


def sums(runs: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Number of runs and sums by arm; nulls count as 0."""
    return runs.groupBy(by).agg(F.count("*").alias("runs"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in columns))


def top_signatures(calls: DataFrame, by: str, n: int = 12, signature: str = "sig", size: str = "bytes") -> DataFrame:
    """The signatures with most bytes in each arm: (arm, sig, calls, bytes, avg_bytes)."""
    total = calls.groupBy(by, signature).agg(F.count("*").alias("calls"), F.sum(size).alias("bytes"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("bytes"), signature))
    return total.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r").withColumn("avg_bytes", F.col("bytes") / F.col("calls"))


def by_question(runs: DataFrame, question: str, arm: str, arms: list[str], value: Column) -> DataFrame:
    return runs.groupBy(question).pivot(arm, arms).agg(F.first(value))


def medians(scores: DataFrame, reps: int = 3) -> DataFrame:
    """(question, arm, score, wide) of groups with all repetitions: the median, and whether scores are 2 or more apart."""
    each = scores.groupBy("question", "arm").agg(F.count("score").alias("n"), F.floor(F.median("score")).alias("score"), (F.max("score") - F.min("score") >= 2).alias("wide"))
    return each.where(F.col("n") == reps).drop("n")


def points(medians_: DataFrame, costs: DataFrame) -> DataFrame:
    """(arm, points, cost, cost_per_point): sums of medians against what all runs of the arm cost."""
    total = medians_.groupBy("arm").agg(F.sum("score").alias("points"))
    paid = costs.groupBy("arm").agg(F.sum("cost").alias("cost"))
    return total.join(paid, "arm", "left").withColumn("cost_per_point", F.try_divide("cost", "points"))


def signature(command: Column, tools: dict[str, str] | None = None) -> Column:
    """A short name of a shell command. ``tools`` maps a program's file name to a prefix; what follows it in the command is its verb."""
    first = F.regexp_extract(F.trim(F.regexp_extract(F.regexp_replace(command, r"^\s+", ""), r"^([^\n]*)", 1)), r"^(\S*)", 1)
    name = F.substring_index(first, "/", -1)
    known = F.element_at(F.create_map(*(F.lit(x) for kv in COMMANDS.items() for x in kv)), name)
    out = F.coalesce(known, F.concat(F.lit("other:"), name))
    for program, prefix in (tools or {}).items():
        after = F.regexp_extract(command, rf"\Q{program}\E\s+(\S+)", 1)
        out = F.when(F.contains(command, F.lit(program)), F.concat(F.lit(f"{prefix}:"), F.when(after == "", "?").otherwise(after))).otherwise(out)
    return F.when(F.trim(command) == "", "(empty)").otherwise(out)


def _length(content: Column) -> Column:
    """Characters of a result: a text, or a list of blocks with a text or with a list of their own."""
    blocks = F.from_json(content, "array<struct<text:string,content:string>>")
    inner = lambda x: F.aggregate(F.coalesce(F.from_json(x, "array<struct<text:string>>"), F.array().cast("array<struct<text:string>>")), F.lit(0), lambda a, y: a + F.coalesce(F.length(y.text), F.lit(0)))
    listed = F.aggregate(blocks, F.lit(0), lambda a, x: a + F.when(x.text.isNotNull(), F.length(x.text)).when(F.startswith(F.ltrim(x.content), F.lit("[")), inner(x.content)).otherwise(F.coalesce(F.length(x.content), F.lit(0))))
    return F.when(F.startswith(F.ltrim(content), F.lit("[")) & blocks.isNotNull(), listed).otherwise(F.coalesce(F.length(content), F.lit(0)))


def transcript_calls(lines: DataFrame, tools: dict[str, str] | None = None) -> DataFrame:
    """(session, id, name, sig, operation, bytes) of the tool calls in transcript lines (session, value); calls and results are joined by id.
    Lines that aren't JSON or have no list of blocks are skipped; a call without a result has 0 bytes."""
    kind = "struct<message:struct<content:array<struct<type:string,id:string,name:string,input:struct<command:string,operation:string>,tool_use_id:string,content:string>>>>"
    blocks = lines.select("session", F.explode(F.from_json("value", kind, {"mode": "PERMISSIVE"}).message.content).alias("b"))
    used = blocks.where("b.type = 'tool_use'").select("session", "b.id", "b.name", "b.input.command", "b.input.operation")
    sig = F.when(F.col("name") == "Bash", signature(F.coalesce("command", F.lit("")), tools)).when(F.col("name") == "Read", "Read").otherwise(F.concat(F.lit("other-tool:"), "name"))
    results = blocks.where("b.type = 'tool_result'").groupBy("session", F.col("b.tool_use_id").alias("id")).agg(F.max(_length(F.col("b.content"))).alias("bytes"))
    return used.join(results, ["session", "id"], "left").select("session", "id", "name", sig.alias("sig"), "operation", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def unused(runs: DataFrame, calls: DataFrame, name: str) -> DataFrame:
    """Runs (session) whose calls never use a tool."""
    return runs.join(calls.where(F.col("name") == name).select("session"), "session", "left_anti")


def waiting(matrix: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Cells of a run matrix that aren't done."""
    return matrix.join(done.select(*key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__l")).select(*key, "__l.*")


def moved_entries(entries: DataFrame, old: str, new: str) -> DataFrame:
    """Compile entries whose paths point into another tree."""
    put = lambda c: F.replace(c, F.lit(old), F.lit(new))
    out = entries
    for c in ("directory", "file", "command"):
        out = out.withColumn(c, put(F.col(c)))
    return out.withColumn("arguments", F.transform("arguments", put))


def verdicts(lines: DataFrame) -> DataFrame:
    """(verdict, text) of lines that begin with PASS or FAIL."""
    found = F.regexp_extract("value", r"^(PASS|FAIL)\b", 1)
    return lines.where(found != "").select(found.alias("verdict"), F.trim(F.regexp_replace("value", r"^(PASS|FAIL)\b:?", "")).alias("text"))


def dirty(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) of files (path, mtime, size) that aren't as they were."""
    mark = F.struct("mtime", "size")
    a, b = before.select("path", mark.alias("was")), now.select("path", mark.alias("is"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("change")).where("change is not null")


def embedded(text: str, document: str, start: str, end: str) -> str:
    """``text`` with ``document`` between its two guard lines, which must be there once each, in order."""
    lines = text.split("\n")
    if lines.count(start) != 1 or lines.count(end) != 1 or lines.index(start) > lines.index(end):
        raise ValueError(f"the guards {start!r} and {end!r} must be there once each, in order")
    if start in document.split("\n") or end in document.split("\n"):
        raise ValueError("the document has a guard in it")
    return "\n".join([*lines[: lines.index(start) + 1], document, *lines[lines.index(end) :]])
