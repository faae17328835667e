"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Each step works on what the one before could not tell apart. Rows whose length no other row has are settled by the first scan;
the second takes the prefix hash of the others, and rows whose (length, prefix hash) no other row has are settled too; the
third takes the full SHA-256 of what is left. The steps hand on bitmaps of bounded size (see ``bitmap``), so no text is moved. Groups are
pre-aggregated before each shuffle. Rows then meet their groups: groups of more than 1 / ``HEAVY`` of all rows, ``HEAVY`` at most, are
broadcast, so that no join key has more rows than that.

Null texts count as empty. Texts are equal when identical after no change. Of equal texts the row with the largest
doc_id (a long) stays; a null doc_id is smaller than any other. Every input row gives a row: rows that repeat a doc_id
with the same text all count in ``group_size`` and share one decision; rows that repeat a doc_id with other texts are decided each by its text. An
empty table gives an empty result. Carried columns that are named like the result's own give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .common import checkpoint

PREFIX_CHARS = 256
#: A group is hot if it has more than 1 / HEAVY of all rows, and more than LEAST.
HEAVY, LEAST = 10_000, 1000


def _keys(docs: DataFrame, prefix_chars: int, carry: dict[str, Column]) -> DataFrame:
    """doc_id, __text, __size (a hash of its length) and __prefix (of length and prefix), with the carried expressions."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long")
    return docs.select("doc_id", text.alias("__text"), F.xxhash64(size).alias("__size"), F.xxhash64(size, F.substring(text, 1, prefix_chars)).alias("__prefix"), *(c.alias(k) for k, c in carry.items()))


def _repeated(rows: DataFrame, key: str) -> bitmap.Bitmap:
    counts = checkpoint(rows.groupBy(key).agg(F.count("*").alias("__c")).where("__c > 1").select(key))
    return bitmap.build(counts, key, counts.count())


def _rows(docs: DataFrame, carry: dict[str, Column], prefix_chars: int) -> DataFrame:
    """doc_id, __key (of the text; a settled row has one of its own), __open, __row and the carried expressions."""
    keyed = _keys(docs, prefix_chars, {})
    lengths = _repeated(keyed, "__size")
    prefixes = _repeated(bitmap.maybe_in(keyed, lengths, "__size", "__same").where("__same"), "__prefix")
    rows = bitmap.maybe_in(_keys(docs, prefix_chars, carry), lengths, "__size", "__same")
    rows = bitmap.maybe_in(rows, prefixes, "__prefix", "__alike").withColumn("__open", F.col("__same") & F.col("__alike")).withColumn("__row", F.monotonically_increasing_id())
    key = F.when(F.col("__open"), F.sha2(F.col("__text"), 256)).otherwise(F.concat(F.lit("row "), F.col("__row").cast("string")))
    return checkpoint(rows.select("doc_id", key.alias("__key"), "__open", "__row", *carry))


def exact_dedup(docs: DataFrame, carry: dict[str, Column] | None = None, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the ``carry`` expressions (evaluated over ``docs``) for each row."""
    own = ("doc_id", "keep_id", "group_size", "kept")
    carry = {k: c for k, c in (carry or {}).items() if k not in own}
    extra = {f"__x{i}": c for i, c in enumerate(carry.values())}
    rows = _rows(docs, extra, prefix_chars)
    groups = checkpoint(rows.where("__open").groupBy("__key").agg(F.max("doc_id").alias("__keep"), F.count("*").alias("__size")).where("__size > 1"))
    least = max(LEAST, rows.count() // HEAVY)
    heavy = groups.where(F.col("__size") > least).select("__key", F.col("__keep").alias("__hkeep"), F.col("__size").alias("__hsize"))
    apart = rows.join(F.broadcast(heavy), "__key", "left")
    apart = apart.withColumn("__key", F.when(F.col("__hsize").isNull(), F.col("__key")).otherwise(F.concat(F.lit("row "), F.col("__row").cast("string"))))
    out = apart.join(groups.where(F.col("__size") <= least), "__key", "left").withColumns({"__keep": F.coalesce("__hkeep", "__keep"), "__size": F.coalesce("__hsize", "__size")})
    keep = F.when(F.col("__size").isNull(), F.col("doc_id")).otherwise(F.col("__keep"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("__size", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), *(F.col(k).alias(name) for k, name in zip(extra, carry, strict=True)))


def keep_one(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row of ``docs`` for each text. Of rows that repeat a doc_id with the same text, one stays."""
    cheap, full = bitmap.identity(F.col("text"), F.col("doc_id"))
    decided = checkpoint(exact_dedup(docs, {"__cheap": cheap, "__full": full}, prefix_chars).select("__cheap", "__full", F.col("kept").alias("__keep")))
    return bitmap.keep_rows(docs, decided)
