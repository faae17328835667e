"""Uncompressed cross-reference files of format 15.

A file is a header, then a section for each source file. Sections don't depend on each other, so Spark splits the text at
their marks and each becomes one row. A section is read in three passes: a grammar of two items (records and bare marks) gives its symbols in
order, a fold over the symbols gives what each stands in, and the last pass names operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GLOBAL = "<global>"
# The marks of the format, and the header's start and option.
CALL, FUNCTION, FUNCTION_END, MACRO, MACRO_END, INCLUDE = "`", "$", "}", "#", ")", "~"
HEADER, UNCOMPRESSED = "cscope 15 ", " -c "
_ASSIGNS = re.compile(r"^\s*(?:=(?!=)|[+\-*/%&|^]=|<<=|>>=)")
#: A record: its number and text, then pairs of a symbol and the text after it, then an empty line.
_ITEM = re.compile(r"(?P<number>\d+)(?: (?P<text>[^\n]*))?\n(?P<pairs>(?:[^\n]+\n[^\n]*(?:\n|\Z))*)(?:\n|\Z)|\t(?P<mark>[^\n]?)(?P<name>[^\n]*)(?:\n|\Z)|(?P<other>[^\n]*)(?:\n|\Z)")


class CrossrefError(ValueError):
    """The text isn't an uncompressed cross-reference of this format, or is cut off."""


class Symbol(NamedTuple):
    mark: str
    name: str
    after: str
    #: Number and whole text of its record; None for a mark outside of records.
    record: tuple[int, str] | None


def symbols_of(body: str) -> Iterator[Symbol]:
    """The symbols of a section in order."""
    at = 0
    while at < len(body):
        item = _ITEM.match(body, at)
        at = item.end()
        if item["number"]:
            flat = item["pairs"].removesuffix("\n").split("\n") if item["pairs"] else []
            marked = [(w[1:2], w[2:]) if w.startswith("\t") else ("", w) for w in flat[::2]]
            after = flat[1::2] + [""] * (len(marked) - len(flat[1::2]))
            text = (item["text"] or "") + "".join(name + rest for (_, name), rest in zip(marked, after, strict=True))
            record = int(item["number"]), text
            yield from (Symbol(mark, name, rest, record) for (mark, name), rest in zip(marked, after, strict=True))
        elif item["mark"]:
            yield Symbol(item["mark"], item["name"], "", None)
        elif (item["other"] or "")[:1].isdigit():
            raise ValueError(f"not a record: {item['other'][:60]}")


def places_of(symbols: list[Symbol]) -> list[tuple[bool, tuple[str, ...]]]:
    """For each symbol, whether it stands in a macro, and the macro or the functions that it stands in, the latest first.

    A function that begins before another's end leaves open which of the two is real, so both hold. A function's own symbol stands in it,
    a macro's in what is around it.
    """
    out: list[tuple[bool, tuple[str, ...]]] = []
    macro, functions = "", ()
    for s in symbols:
        if s.mark == FUNCTION and s.name:
            macro, functions = "", (s.name, *(f for f in functions if f != s.name))
        elif s.mark == FUNCTION_END:
            functions = ()
        elif s.mark == MACRO_END:
            macro = ""
        out.append((True, (macro,)) if macro else (False, functions))
        if s.mark == MACRO and s.name:
            macro = s.name
    return out


def operations_of(s: Symbol) -> list[str]:
    return ["ref", *(["call"] if s.mark == CALL else []), *(["assign"] if _ASSIGNS.match(s.after) else [])]


def read_section(section: str) -> Iterator[tuple[str, str, str, str, int, str]]:
    """(op, name, scope, file, line, text) of a section that starts with its file's name, once for each record, op, name and scope.

    What stands in nothing is global if its mark is a letter; else it stands where its symbol stood last, macros aside.
    """
    file, _, body = section.partition("\n")
    symbols = list(symbols_of(body))
    latest: dict[str, str] = {}
    told: dict[tuple, None] = {}
    for s, (in_macro, scopes) in zip(symbols, places_of(symbols), strict=True):
        if s.record is None or not s.name or s.mark in (FUNCTION_END, MACRO_END):
            continue
        if s.mark == INCLUDE:
            told[id(s.record), "include", s.name[1:].rpartition("/")[2], GLOBAL, *s.record, len(told)] = None
            continue
        scopes = scopes or (GLOBAL if s.mark.isalpha() else latest.get(s.name, GLOBAL),)
        if not in_macro:
            latest[s.name] = scopes[0]
        told |= {(id(s.record), op, s.name, scope, *s.record): None for scope in scopes for op in operations_of(s)}
    for _, op, name, scope, line, text, *_ in told:
        yield op, name, scope, file, line, text


def read_crossref(spark: SparkSession, path: str) -> DataFrame:
    """Occurrences of a cross-reference file. Checks header and trailer before anything else reads it."""
    rows = spark.read.option("lineSep", "\n\t@").text(path)
    head = [r.value for r in rows.limit(1).collect()]
    if not head or not head[0].startswith(HEADER) or UNCOMPRESSED not in head[0].split("\n")[0]:
        raise CrossrefError(f"not an uncompressed cross-reference of format 15: {head[0][:60] if head else ''!r}")
    sections = rows.where(~F.col("value").startswith(HEADER))
    if sections.where(F.regexp_extract("value", r"^([^\n]*)", 1) == "").isEmpty():
        raise CrossrefError("no trailer; the file is cut off")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["op", "name", "scope", "file", "line", "text"]
        for batch in batches:
            for section in batch.column("value").to_pylist():
                try:
                    found = list(read_section(section)) if section and not section.startswith("\n") else []
                except (ValueError, IndexError) as e:  # one bad section doesn't fail the build; it is counted
                    found = [("bad", "", GLOBAL, section.split("\n", 1)[0], 0, str(e))]
                for i in range(0, len(found), 20_000):
                    columns = zip(*found[i : i + 20_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "line" else pa.string()) for n, c in zip(names, columns, strict=True)], names)

    return sections.mapInArrow(run, "op string, name string, scope string, file string, line int, text string").withColumn("seq", F.col("line").cast("long"))


def bad_sections(occurrences: DataFrame) -> DataFrame:
    """(file, reason) of sections that couldn't be read."""
    return occurrences.where("op = 'bad'").select("file", F.col("text").alias("reason"))


def wanted(occurrences: DataFrame, definitions: DataFrame) -> DataFrame:
    """Only calls of functions and macros, references and assignments of globals, includes, and sections that couldn't be read. The occurrences
    are gone through once."""
    of = lambda *kinds: F.max(F.col("kind").isin(*kinds))
    names = definitions.groupBy("name").agg(of("function", "macro").alias("__called"), of("global").alias("__used"))
    called, used = F.coalesce("__called", F.lit(False)), F.coalesce("__used", F.lit(False))
    op = F.col("op")
    kept = op.isin("include", "bad") | ((op == "call") & called) | (op.isin("ref", "assign") & used)
    return occurrences.join(names, "name", "left").where(kept).select(*occurrences.columns)
