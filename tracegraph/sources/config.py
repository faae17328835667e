"""Tag files, the manual table, module rules, compile databases and commit logs."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as X
from ..plans.storage import read_lines, read_text

# Kinds of tags that are definitions.
TAG_KINDS = {"function": "function", "variable": "global", "macro": "macro", "f": "function", "v": "global", "d": "macro"}


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Definitions from tags as JSON lines; lines that aren't tags or JSON are skipped. Their order gives seq."""
    ddl = "_type string, name string, path string, line int, end int, kind string, signature string, _corrupt_record string"
    tags = spark.read.schema(ddl).option("mode", "PERMISSIVE").json(path)
    kinds = F.create_map(*(F.lit(x) for kv in TAG_KINDS.items() for x in kv))
    found = tags.where("_type = 'tag'").withColumn("kind", F.element_at(kinds, F.col("kind"))).where("kind is not null and name is not null")
    return found.select(F.monotonically_increasing_id().alias("seq"), "name", "kind", F.regexp_replace("path", r"^\./", "").alias("file"), F.col("line").alias("line_start"), F.coalesce("end", "line").alias("line_end"), F.lit(False).alias("is_static"), "signature")


def parse_manual(text: str | None) -> tuple[list[tuple], list[tuple], str | None]:
    """(links, registrations, sha256) of the manual table; wrong JSON or a missing field raises."""
    if text is None:
        return [], [], None
    data = json.loads(text)
    links, registrations = [], []
    for x in data.get("links", []):
        if not {"src", "dst"} <= x.keys():
            raise ValueError(f"a link needs src and dst: {x}")
        links.append((x["src"], x["dst"]))
    for x in data.get("registrations", []):
        if not {"field", "handler"} <= x.keys():
            raise ValueError(f"a registration needs field and handler: {x}")
        registrations.append((x["field"], x["handler"], x.get("struct")))
    return links, registrations, hashlib.sha256(text.encode()).hexdigest()


def read_manual(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str | None]:
    """(links, registrations, sha256) as tables; empty if there is no file."""
    links, registrations, digest = parse_manual(read_text(spark, path))
    return spark.createDataFrame(links, schema.LINKS), spark.createDataFrame(registrations, schema.REGISTRATIONS), digest


def parse_module_rules(text: str) -> list[tuple[str, str]]:
    """(pattern, module) in order of priority; blank lines and comments are skipped, wrong ones raise."""
    rules = []
    for n, row in enumerate(csv.reader(io.StringIO(text)), 1):
        if not row or not row[0].strip() or row[0].strip().startswith("#"):
            continue
        if len(row) < 2 or not row[1].strip():
            raise ValueError(f"line {n}: a pattern and a module are needed")
        try:
            re.compile(row[0].strip())
        except re.error as e:
            raise ValueError(f"line {n}: {e}") from e
        rules.append((row[0].strip(), row[1].strip()))
    return rules


def module_of(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The module of the first rule that matches anywhere in the path, in any case; else empty."""
    out = F.lit("")
    for pattern, module in reversed(rules):
        out = F.when(path.rlike(f"(?iu){pattern}"), module).otherwise(out)
    return out


def normal_path(path: Column) -> Column:
    """Without empty and ``.`` parts, and with ``..`` resolved where it can be."""
    absolute = F.startswith(path, F.lit("/"))

    def step(done: Column, part: Column) -> Column:
        up = (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("")), done), -1) != "..")
        keep_up = F.when(absolute, done).otherwise(F.concat(done, F.array(part)))
        return F.when(part.isin("", "."), done).when(part == "..", F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(keep_up)).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def joined_path(directory: Column, file: Column) -> Column:
    return normal_path(F.when(F.startswith(file, F.lit("/")), file).otherwise(F.concat_ws("/", directory, file)))


def read_compile_databases(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Entries of the databases, with the place of each in its database and of that in the list."""
    ddl = "array<struct<directory:string,file:string,arguments:array<string>,command:string>>"
    found = None
    for prio, path in enumerate(paths):
        one = spark.read.text(path, wholetext=True).select(F.lit(prio).alias("db_prio"), F.posexplode(F.from_json("value", ddl, {"mode": "FAILFAST"})).alias("pos", "e")).select("db_prio", "pos", "e.*")
        found = one if found is None else found.unionByName(one)
    return found


def merge_compile_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first entry for each file, entries that give a file another rule)."""
    keyed = entries.withColumn("key", joined_path(F.coalesce("directory", F.lit("")), F.col("file")))
    whole = F.struct("directory", "file", "arguments", "command", "db_prio", "pos")
    first = keyed.groupBy("key").agg(F.min_by(whole, F.struct("db_prio", "pos")).alias("e")).select("key", "e.*")
    rule = F.coalesce(F.to_json("arguments"), F.col("command"))
    ours = first.select("key", rule.alias("__rule"), F.col("db_prio").alias("__d"), F.col("pos").alias("__p"))
    later = keyed.join(ours, "key").where("not (db_prio = __d and pos = __p)")
    return first, later.where(~rule.eqNullSafe(F.col("__rule"))).select("key", "db_prio", "pos")


def synthesize_compile_entries(files: DataFrame, root: str) -> DataFrame:
    """An entry for each C and C++ file, with every folder that has headers as an include path.

    The folders come to the driver as one list: it is part of every entry anyway."""
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    dirs = sorted(r.d for r in files.where(X.is_header(F.col("path"))).select(folder.alias("d")).distinct().collect())
    flags = [f"-I{root}/{d}" if d else f"-I{root}" for d in dirs]
    cpp = F.col("path").rlike(r"\.(?:cc|cpp)$")
    start = F.when(cpp, F.array(F.lit("c++"), F.lit("-std=gnu++17"))).otherwise(F.array(F.lit("cc"), F.lit("-std=gnu11")))
    arguments = F.concat(start, F.array(*map(F.lit, flags)).cast("array<string>"), F.array(F.lit("-c"), F.col("path")))
    return files.where(F.col("path").rlike(r"\.(?:c|cc|cpp)$")).select(F.lit(root).alias("directory"), F.col("path").alias("file"), arguments.alias("arguments"))


def read_commit_log(spark: SparkSession, path: str, window: int = 500) -> DataFrame:
    """(commit_id, path) of the newest ``window`` commits of a name-only log: a line with a hash, then its paths. The log is read up to there,
    however long it is."""
    rows, commit, seen = [], None, 0
    for line in read_lines(spark, path):
        line = line.strip()
        if re.fullmatch(r"[0-9a-f]{40}", line):
            seen += 1
            if seen > window:
                break
            commit = line
        elif line and commit:
            rows.append((commit, line))
    return spark.createDataFrame(rows, schema.COMMITS)
