"""Where intermediate and published tables go."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

TABLES = ("files", "nodes", "edges", "edge_pairs", "file_deps", "meta", "history")
#: Copies of a table by what their rows are sorted by.
LAYOUTS = {"edges": {"": "dst_qname"}, "edge_pairs": {"": "dst_qname", "_by_src": "src_qname"}}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset and the master is local, as in tests, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        found = "file://" + tempfile.mkdtemp(prefix="tracegraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and renamed over what is there: a reader sees the old text or the new one."""
    fs, _ = _hadoop(spark, path)
    _, beside = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    _replace(spark, f"{beside}", path)


def _replace(spark: SparkSession, old: str, new: str) -> None:
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, target = _hadoop(spark, new)
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(jvm.org.apache.hadoop.fs.Path(old), target, options)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)  # Spark's own readers hide names that start with an underscore
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_lines(spark: SparkSession, path: str) -> Iterator[str]:
    """The lines of a file, read as far as they are asked for; none where there is no file."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return
    java = spark.sparkContext._jvm.java.io
    reader = java.BufferedReader(java.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        while (line := reader.readLine()) is not None:
            yield line
    finally:
        reader.close()


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> str:
    """Write all tables of a new version, then point ``_CURRENT`` at it: readers see the old graph or the new one, whole.

    Edges are laid out by kind and ranges of their target, pairs also by ranges of their source, so that a filter on names reads one kind and few row
    groups. Versions before the last one are removed; a reader may still be at that. The folder holds products only, so version
    control is told to ignore it.
    """
    before = (pointer(spark, folder) or {}).get("version")
    version = uuid.uuid4().hex
    for name, df in tables.items():
        path = f"{folder}/{version}/{name}"
        for copy, end in LAYOUTS.get(name, {"": ""}).items():
            if end:  # a name with very many edges fills several ranges
                other = "src_qname" if end == "dst_qname" else "dst_qname"
                df.repartitionByRange("kind", end, other).sortWithinPartitions("kind", end).write.partitionBy("kind").parquet(f"{path}{copy}")
            else:
                df.write.parquet(f"{path}{copy}")
    write_text(spark, f"{folder}/.gitignore", "*\n")
    write_text(spark, f"{folder}/_CURRENT", json.dumps({"version": version, "schema_version": schema.SCHEMA_VERSION}))
    fs, root = _hadoop(spark, folder)
    for found in fs.listStatus(root):
        if found.isDirectory() and found.getPath().getName() not in (version, before):
            fs.delete(found.getPath(), True)
    return version


def pointer(spark: SparkSession, folder: str) -> dict | None:
    """What ``_CURRENT`` says: version and schema_version."""
    text = read_text(spark, f"{folder}/_CURRENT")
    return None if text is None else json.loads(text)


def current(spark: SparkSession, folder: str) -> str | None:
    found = pointer(spark, folder)
    if found is not None:
        schema.check_version(found.get("schema_version"))
    return found and found["version"]


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the published graph."""
    version = current(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no graph in {folder}")
    fs, _ = _hadoop(spark, folder)
    out = {}
    for name in TABLES:
        for copy in LAYOUTS.get(name, {"": ""}):
            _, p = _hadoop(spark, f"{folder}/{version}/{name}{copy}")
            if fs.exists(p):
                out[name + copy] = spark.read.parquet(f"{folder}/{version}/{name}{copy}")
    return out


def drop(spark: SparkSession, folder: str) -> list[str]:
    """Delete every product under ``folder``; the names of what was deleted."""
    fs, p = _hadoop(spark, folder)
    if not fs.exists(p):
        return []
    gone = sorted(s.getPath().getName() for s in fs.listStatus(p))
    fs.delete(p, True)
    return gone


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def kv(spark: SparkSession, pairs: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(pairs.items()), "key string, value string").select("key", F.col("value"))


def products(spark: SparkSession, folder: str) -> list[dict]:
    """path and size of what is under ``folder``, one for each version or file."""
    fs, p = _hadoop(spark, folder)
    if not fs.exists(p):
        return []
    found = sorted((s.getPath() for s in fs.listStatus(p)), key=lambda x: x.getName())
    return [{"path": x.toString(), "size": fs.getContentSummary(x).getLength()} for x in found]
