"""A bitmap of hashed keys with a bounded size, to tell cheaply which rows cannot be in a set of any size.

It has a power of two of bits in rows of 64, ``MOST`` at most, so what is broadcast never exceeds ``MOST / 64`` rows of two longs. A
bit that several keys share lets a row through that isn't in the set; whoever uses it decides exactly afterwards. A set of many
more keys than bits lets all rows through, which is slower and still right.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Bits where the number of keys isn't known, and the bounds where it is.
BITS, LEAST, MOST = 1 << 23, 1 << 16, 1 << 26


@dataclass
class Bitmap:
    words: DataFrame  # __word, __bits
    bits: int


def _slot(key: Column, bits: int) -> tuple[Column, Column]:
    at = F.pmod(key, F.lit(bits))
    return F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")


def bits_for(keys: int) -> int:
    """Sixteen bits a key or more, within the bounds."""
    return max(LEAST, min(MOST, 1 << (16 * max(1, keys) - 1).bit_length()))


def build(keys: DataFrame, key: str, count: int | None = None) -> Bitmap:
    """Of the hashed keys in the long column ``key``; ``count`` is about how many there are, where that is known."""
    bits = BITS if count is None else bits_for(count)
    word, bit = _slot(F.col(key), bits)
    return Bitmap(keys.groupBy(word.alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__bits")), bits)


def maybe_in(df: DataFrame, bitmap: Bitmap, key: str, out: str) -> DataFrame:
    """Adds the boolean ``out``: false for rows whose ``key`` is certainly not in the set."""
    word, bit = _slot(F.col(key), bitmap.bits)
    joined = df.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(bitmap.words), "__word", "left")
    hit = F.coalesce(F.call_function("shiftright", F.col("__bits"), F.col("__bit")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return joined.withColumn(out, hit).drop("__word", "__bit", "__bits")


def identity(text: Column, doc_id: Column) -> list[Column]:
    """What tells the rows of a table apart by doc_id and text: a cheap long, and a string that is compared where it can't decide."""
    text, doc_id = F.coalesce(text, F.lit("")), F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("none"))
    return [F.xxhash64(text, doc_id), F.concat(F.sha2(text, 256), doc_id)]


def keep_rows(df: DataFrame, decided: DataFrame) -> DataFrame:
    """One row of ``df`` for each identity (of its columns text and doc_id) that ``decided`` keeps.

    ``decided`` has a row (__cheap, __full, __keep) for each row of ``df`` and has been written. Rows that aren't in the bitmap of what
    goes, or is there twice, stay where they are. Rows in it go at once, unless they are in a second bitmap, of all that stay although the
    first has them: only these few are shuffled, for an exact decision.
    """
    cheap, _ = identity(F.col("text"), F.col("doc_id"))
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row")  # apart from our own columns
    once = decided.groupBy("__cheap").agg(F.min("__keep").alias("__keep"), F.count("*").alias("__n"))
    apart = checkpoint(once.where("not __keep or __n > 1").select("__cheap"))
    gone = build(apart, "__cheap", apart.count())
    again = F.xxhash64(F.lit(1), "__cheap").alias("__again")
    unsure = checkpoint(maybe_in(decided.where("__keep"), gone, "__cheap", "__maybe").where("__maybe").select("__full", again).distinct())
    spared = build(unsure, "__again", unsure.count())
    seen = maybe_in(df.select(whole, cheap.alias("__cheap")), gone, "__cheap", "__maybe")
    clear = seen.where("not __maybe").select("__row")
    few = maybe_in(seen.where("__maybe").withColumn("__again", again), spared, "__again", "__spared").where("__spared")
    few = few.withColumn("__full", identity(F.col("__row.text"), F.col("__row.doc_id"))[1]).dropDuplicates(["__full"]).join(unsure.select("__full"), "__full", "left_semi")
    return clear.union(few.select("__row")).select("__row.*")
