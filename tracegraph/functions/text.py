"""Column expressions over paths, sites and lines of source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = r"\.(?:h|hpp|hh)$"
SOURCE = r"\.(?:c|h|cc|cpp|hpp)$"
# Patterns of C text.
STATIC = r"(?U)\bstatic\b"
IDENTIFIER = r"(?U)[A-Za-z_]\w*"
REGISTRATION = r"(?U)[.>]\s*(\w+)\s*=\s*&?\s*(\w+)"
DISPATCH = r"(?U)(?:->|\.)\s*(\w+)\s*\("
INCLUDE = r'(?U)#\s*include\s*[<"]([^>"]+)[>"]'
CHANGE = r"\+\+|--|[+\-*/%|&^]=|<<=|>>="
ARGUMENT = r"(?U)[(,&] *([A-Za-z_]\w*)(?= *[,)])"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_header(path: Column) -> Column:
    return path.rlike(HEADER)


def site_key(file: Column, line: Column) -> Column:
    """``file:000000012``, which sorts as text; nulls count as empty and 0."""
    return F.format_string("%s:%09d", F.coalesce(file, F.lit("")), F.coalesce(line, F.lit(0)))


def site_of(key: Column) -> Column:
    """``file:12`` of a site key; null and empty stay."""
    line = F.substring_index(key, ":", -1)
    return F.when(line.rlike(r"^\d+$"), F.concat(F.regexp_replace(key, r":\d+$", ""), F.lit(":"), line.cast("long").cast("string"))).otherwise(key)


def include_matches(spec: Column, header: Column) -> Column:
    """A spec with a directory matches the whole path or its end; one without matches the base name."""
    whole = (header == spec) | F.endswith(header, F.concat(F.lit("/"), spec))
    return F.when(F.instr(spec, "/") > 0, whole).otherwise(basename(header) == spec)


def include_spec(text: Column) -> Column:
    """What an include directive names; null where there is none."""
    found = F.regexp_extract(text, INCLUDE, 1)
    return F.when(text.rlike(INCLUDE), found)


def is_changed_in_place(text: Column, name: Column) -> Column:
    """The line has an operator that reads and writes, or the name twice."""
    quoted = F.concat(F.lit(r"(?U)\b\Q"), name, F.lit(r"\E\b"))
    return text.rlike(CHANGE) | (F.regexp_count(text, quoted) >= 2)


def is_static(line: Column, before: Column) -> Column:
    """The definition's line says static, or the line before it does and isn't a whole statement."""
    above = before.rlike(STATIC) & ~before.rlike(r"[;}{]\s*$")
    return F.coalesce(line.rlike(STATIC), F.lit(False)) | F.coalesce(above, F.lit(False))


def dispatches(clean: Column) -> Column:
    return F.regexp_extract_all(clean, F.lit(DISPATCH), F.lit(1))


def registrations(clean: Column) -> Column:
    """Array of (field, handler)."""
    return F.arrays_zip(F.regexp_extract_all(clean, F.lit(REGISTRATION), F.lit(1)).alias("field"), F.regexp_extract_all(clean, F.lit(REGISTRATION), F.lit(2)).alias("handler"))


def arguments(clean: Column) -> Column:
    """Identifiers that stand alone as an argument."""
    return F.regexp_extract_all(clean, F.lit(ARGUMENT), F.lit(1))


def tags(origins: Column, meta: Column) -> Column:
    """``[origins; ambiguous N candidates; semantic:x]``."""
    many = F.when(meta.ambiguous, F.concat(F.lit("ambiguous "), F.coalesce(meta.candidates.cast("string"), F.lit("?")), F.lit(" candidates")))
    told = F.when(meta.semantic.isNotNull(), F.concat(F.lit("semantic:"), meta.semantic))
    return F.concat(F.lit("["), F.concat_ws("; ", origins, many, told), F.lit("]"))
