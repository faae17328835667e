"""Source trees and their lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: What a lexer outside a block comment stops at.
_STOP = re.compile(r"""/\*|//|"(?:\\.|[^"\\])*\\?"?|'(?:\\.|[^'\\])*\\?'?""")


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, content_hash) of C and C++ files below ``root``; paths are relative. Folders and files whose names
    start with a dot or an underscore are hidden from Spark's listing."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{c,h,cc,cpp,hpp}").load(base)
    top = re.sub(r"^\w+:/*", "/", base)
    relative = F.expr("substring(__p, instr(__p, __top) + length(__top) + 1)")
    named = found.withColumn("__p", F.regexp_replace("path", r"^\w+:/*", "/")).withColumn("__top", F.lit(top))
    return named.select(relative.alias("path"), "content", F.sha2("content", 256).alias("content_hash"))


def clean_line(line: str, inside: bool) -> tuple[str, bool]:
    """The line without comments and with empty string literals; whether a block comment goes on."""
    out, at = [], 0
    while True:
        if inside:
            end = line.find("*/", at)
            if end < 0:
                return "".join(out), True
            at, inside = end + 2, False
        stop = _STOP.search(line, at)
        if stop is None:
            return "".join(out) + line[at:], False
        out.append(line[at : stop.start()])
        word = stop.group()
        if word == "//":
            return "".join(out), False
        if word == "/*":
            inside = True
        else:
            out.append(word[0] * 2)
        at = stop.end()


def source_lines(files: DataFrame) -> DataFrame:
    """(file, line, text, clean, seq) of every line of ``files`` (path, content). State crosses the lines of a file, which is one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, inside = [], False
                for n, text in enumerate((content or b"").decode("utf-8", "replace").splitlines(), 1):
                    clean, inside = clean_line(text, inside)
                    rows.append((path, n, text, clean))
                for i in range(0, len(rows), 20_000):
                    columns = list(zip(*rows[i : i + 20_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], ["file", "line", "text", "clean"])

    lines = files.select("path", F.col("content").cast("binary")).mapInArrow(run, "file string, line int, text string, clean string")
    return lines.withColumn("seq", F.col("line").cast("long"))


def mark_static(definitions: DataFrame, lines: DataFrame) -> DataFrame:
    """is_static from the line of each definition and the one before."""
    at = lines.select("file", F.col("line").alias("line_start"), F.col("text").alias("__here"))
    before = lines.select("file", (F.col("line") + 1).alias("line_start"), F.col("text").alias("__above"))
    joined = definitions.drop("is_static").join(at, ["file", "line_start"], "left").join(before, ["file", "line_start"], "left")
    return joined.withColumn("is_static", X.is_static(F.col("__here"), F.col("__above"))).select(*definitions.columns) if "is_static" in definitions.columns else joined.withColumn("is_static", X.is_static(F.col("__here"), F.col("__above"))).drop("__here", "__above")


def lexical_occurrences(lines: DataFrame) -> DataFrame:
    """Calls and includes by their shape alone, for trees without an index. Scopes are left to the enclosing definition; these are
    guesses, not what an indexer would find."""
    name = r"(?U)([A-Za-z_]\w*)\s*\("
    words = ("if", "for", "while", "switch", "return", "sizeof", "defined")
    calls = lines.select("seq", F.lit("call").alias("op"), F.explode(F.regexp_extract_all("clean", F.lit(name), F.lit(1))).alias("name"), F.lit("").alias("scope"), "file", "line", "text").where(~F.col("name").isin(*words))
    spec = X.include_spec(F.col("text"))
    included = lines.where(F.col("text").rlike(X.INCLUDE)).select("seq", F.lit("include").alias("op"), X.basename(spec).alias("name"), F.lit("<global>").alias("scope"), "file", "line", "text")
    return calls.unionByName(included)
