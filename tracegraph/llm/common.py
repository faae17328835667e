"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python operator handles at once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset and the master is local, as in tests, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        found = "file://" + tempfile.mkdtemp(prefix="tracegraph-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file in any file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a small table for each file that it is written to.
SMALL = 2000


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage, so that a lost executor costs no recomputation. ``rows`` is about how many
    there are, if few: they go to fewer files."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return (df if rows is None else df.coalesce(rows // SMALL + 1)).checkpoint(eager=True)


def forget(spark: SparkSession, times: int = 1) -> None:
    """Have Spark remove the shuffle files and checkpoints of tables that nothing refers to any more; else they stay until the driver's heap is full.
    Spark removes them by and by: ``times`` is more where much must have gone before work goes on."""
    for k in range(times):
        gc.collect()
        time.sleep(0.3)  # what Python let go of is told to the JVM by another thread
        spark.sparkContext._jvm.System.gc()
        if times > 1:
            time.sleep(1)


def give_back(spark: SparkSession) -> None:
    """Have the executors' JVMs collect garbage, so that heap that earlier stages grew goes back to the system before Python workers need it: a
    task for each core, which Spark spreads over the executors that are free."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.call_function("reflect", F.lit("java.lang.System"), F.lit("gc"))).collect()


#: A key is hot if it has more than 1 / HEAVY of all rows, and more than LEAST.
HEAVY, LEAST = 10_000, 1000


def hot_keys(rows: DataFrame, key: list[str], copies: str | None = None) -> DataFrame:
    """The hot keys of ``rows``, which has been written, ``HEAVY`` at most, and in how many parts (__parts) to deal each out. A row
    stands for as many as its column ``copies`` says."""
    n = F.coalesce(F.sum(copies), F.lit(0)) if copies else F.count("*")
    least = max(LEAST, rows.agg(n.alias("n")).first().n // HEAVY)
    counts = rows.groupBy(*key).agg(n.alias("__parts")).where(F.col("__parts") > least)
    return checkpoint(counts.withColumn("__parts", F.ceil(F.col("__parts") / least).cast("int")))


def join_dealt(rows: DataFrame, table: DataFrame, key: list[str], hot: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined with ``table``, which has a row for each key at most. The rows of hot keys are dealt out by a hash of their columns
    ``by``, and the table's row goes to each part, so that no task has many more rows than others; that makes ``HEAVY`` more rows at most."""
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    spread = table.join(F.broadcast(hot), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(spread, [*key, "__part"], how).drop("__part")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; rows of fold 0 are held out of every training set."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``limit`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def release(whole: bool = True) -> None:
    """Give memory that is no longer used back to the system; workers outlive their tasks."""
    if whole:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, column: str = "text", limit: int = BATCH_BYTES) -> DataFrame:
    """Run ``make()`` once a task, and what it returns on bounded parts of each Arrow batch.

    Batches that Spark sends are held to ``BATCH_BYTES`` by a session setting, unless it is set lower already.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("bB") if conf.get(key).rstrip("bB").isdigit() else 1 << 60) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in pieces(batch, column, limit):
                yield work(part)
                release(whole=False)
            release()
        del work
        release()

    return df.mapInArrow(run, schema)
