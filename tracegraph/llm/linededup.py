"""Near-duplicate lines, by an exact set-similarity join in DataFrame and SQL functions only.

A line's tokens are its distinct words (between spaces). Two lines match when the Jaccard similarity of their token
sets is 0.8 or more. A line is removed when an earlier line (by doc_id, then place, null doc_ids first) matches it, removed or not;
so what stays doesn't depend on the order of work. Of lines with one text only the first can stay. Whether it does is decided by a join:

1. Tokens are ordered by rarity (counts of 2^16 hash buckets, a table of fixed size), then by hash. A match of two lines
   shows in their prefixes: the n - ceil(0.8 n) + 1 rarest tokens of each.
2. A semi-join of prefix tokens finds, for each line and token, whether any partner is likely. Its condition has the length filter, the
   positional filter (exact at the first common token), a bound of the overlap from 128-bit signatures, and that the tokens before differ (if they
   are the same, the pair has met there). It yields no pairs.
3. Only those lines carry their tokens into a second semi-join on those tokens, whose condition verifies the Jaccard similarity and the
   order, after the bound from signatures. It stops at the first earlier match.

Only the first line of a text goes into the joins. Texts with many copies, which would fill one task with rows of one token, are told
by a table of at most ``HEAVY`` rows: texts with more than 1 / ``HEAVY`` of all lines. What tells other copies and lines apart before a join are
bitmaps of bounded size; copies that they can't tell go into the first join too, which is slower and still right.

Tokens are compared as 56-bit hashes within a pair of lines, texts as 128-bit hashes. A word whose 64-bit hash is zero or the empty word's is no token. Lines without words are never
removed. Null texts have no lines, empty texts one. Rows that repeat a doc_id are one document whose lines count together; lines
at equal places are both first. An empty table gives an empty result. ``doc_id`` is a long; other columns are carried, whatever their names. Texts
are read whole; a very long line takes about 30 bytes a word in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .common import checkpoint, forget

BUCKETS = 1 << 16
#: A text is hot if it is more than 1 / HEAVY of all lines, and more than LEAST.
HEAVY, LEAST = 10_000, 1000


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc")


def _split(docs: DataFrame) -> DataFrame:
    """(doc, at, line) of all lines."""
    return docs.where("text is not null").select(_doc(), F.posexplode(F.split("text", "\n")).alias("at", "line"))


def _hashed(rows: DataFrame) -> DataFrame:
    """With h1 and h2, hashes of the line."""
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


_WORDS = "trim(line) != ''"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, at, line, h1, h2) of lines that have words."""
    return _hashed(_split(docs).where(_WORDS))


def _places(docs: DataFrame) -> DataFrame:
    """(doc, at, h1, h2, words, lines) of lines that have words, and of each text's first line. ``lines`` is how many the text has at its first line, else 0."""
    texts = docs.where("text is not null").select(_doc(), F.split("text", "\n").alias("all"))
    rows = texts.select("doc", F.size("all").alias("lines"), F.posexplode("all").alias("at", "line")).withColumn("words", F.expr(_WORDS)).where("words or at = 0")
    return checkpoint(_hashed(rows).select("doc", "at", "h1", "h2", "words", F.expr("if(at = 0, lines, 0)").alias("lines")))


def _ranks(lines: DataFrame) -> Column:
    """The rank of each hash bucket by how often its words occur, as an array. A row for each bucket comes to the driver."""
    word = lines.select(F.explode(F.split("line", " ")).alias("w"))
    counts = word.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("id")).agg(F.count("*").alias("c"))
    ranks = [0] * BUCKETS
    for r in counts.select("id", F.least(F.floor(3 * F.log2(F.col("c") + 1)), F.lit(120)).alias("r")).collect():
        ranks[r.id] = r.r
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")


def _sets(lines: DataFrame, ranks: Column) -> DataFrame:
    """``lines`` with t, the distinct tokens of ``line`` by rarity (rank in the high bits, hash below), how many they are (n), and their signatures: 64 bits
    for hashes below zero (s1), 64 for those above (s2). Arrays of longs without nulls are made distinct, sorted and cut at zero by compiled code."""
    zero, none = F.lit(0).cast("long"), F.xxhash64(F.lit(""))
    hashes = F.concat(F.transform(F.split("line", " "), lambda w: F.xxhash64(w)), F.array(zero, none))
    kept = [F.col(c) for c in lines.columns if c != "line"]
    sets = lines.select(*kept, F.sort_array(F.array_remove(F.array_distinct(hashes), none)).alias("u"))
    cut = sets.select(*kept, "u", F.array_position("u", zero).cast("int").alias("k"))
    cut = cut.select(*kept, F.array_remove("u", zero).alias("u"), F.expr("slice(u, 1, k - 1)").alias("below"), F.expr("slice(u, k + 1, size(u) - k)").alias("above"))

    def token(h: Column) -> Column:
        rank = F.coalesce(F.get(ranks, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), zero)
        return F.shiftleft(rank, 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))

    def signature(half: str) -> Column:
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate(half, zero, lambda a, x: a.bitwiseOR(bit(x)))

    return cut.select(*kept, F.sort_array(F.transform("u", token)).alias("t"), F.size("u").alias("n"), signature("below").alias("s1"), signature("above").alias("s2"))


def _prefix() -> Column:
    return F.slice("t", F.lit(1), (F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1).cast("int"))


_LENGTH = "5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)"
_PLACE = "9 * least(x.n - x.i, y.n - y.i) >= 4 * (x.n + y.n)"
# bits of one line that the other hasn't are tokens that it hasn't
_SIGN = "9 * least(x.n - bit_count(x.s1 & ~y.s1) - bit_count(x.s2 & ~y.s2), y.n - bit_count(y.s1 & ~x.s1) - bit_count(y.s2 & ~x.s2)) >= 4 * (x.n + y.n)"
# where the tokens before are the same, the pair has met there already
_FIRST = "not (x.p <=> y.p and x.p is not null)"
_EARLIER = "(y.doc, y.at, y.h1) < (x.doc, x.at, x.h1)"
_VERIFIED = "9 * size(array_intersect(x.t, y.t)) >= 4 * (x.n + y.n)"


def _packed(condition: str) -> str:
    """With n and i read from the halves of ``m``: these rows are many, so each is as short as can be."""
    return re.sub(r"\b([xy])\.i\b", r"(\1.m & 4294967295)", re.sub(r"\b([xy])\.n\b", r"shiftright(\1.m, 32)", condition))


def _likely(lines: DataFrame, ranks: Column) -> DataFrame:
    """(h1, tokens): the prefix tokens of a line at which some other line may match."""
    marked = _sets(lines.select("h1", "line"), ranks).select("h1", "n", "s1", "s2", _prefix().alias("p"))
    posts = marked.select("h1", "n", "s1", "s2", F.posexplode(F.arrays_zip(F.col("p").alias("t"), F.concat(F.array(F.lit(None).cast("long")), F.expr("slice(p, 1, size(p) - 1)")).alias("p"))).alias("i", "e"))
    m = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i").cast("long")).alias("m")
    posts = posts.select("h1", m, "s1", "s2", F.col("e.t").alias("token"), F.col("e.p").alias("p"))
    x, y = posts.alias("x"), posts.alias("y")
    found = x.join(y, F.expr(_packed(f"x.token = y.token and x.h1 != y.h1 and {_LENGTH} and {_PLACE} and {_FIRST} and {_SIGN}")), "left_semi")
    return found.groupBy("h1").agg(F.collect_set("token").alias("tokens"))


def _beaten(rows: DataFrame, ranks: Column, likely: DataFrame) -> DataFrame:
    """(doc, at) of the lines of ``likely`` (h1, doc, at, tokens) that an earlier one of another text matches. ``rows`` are all lines; those at other
    places are told before anything is made of them."""
    place = F.xxhash64("doc", "at").alias("__place")
    marks = bitmap.build(likely.select(place), "__place", likely.count())
    some = _hashed(bitmap.maybe_in(rows.select("*", place), marks, "__place", "__maybe").where("__maybe").where(_WORDS))
    sets = _sets(some.select("doc", "at", "h1", "line"), ranks).join(likely, ["h1", "doc", "at"])
    posts = sets.select("doc", "at", "h1", "t", "n", "s1", "s2", F.explode("tokens").alias("token")).withColumn("i", F.array_position("t", F.col("token")) - 1)
    x, y = posts.alias("x"), posts.alias("y")
    return x.join(y, F.expr(f"x.token = y.token and {_LENGTH} and {_PLACE} and {_EARLIER} and {_SIGN} and {_VERIFIED}"), "left_semi").select("doc", "at").distinct()


def _without(lines: DataFrame, again: DataFrame, first: DataFrame) -> DataFrame:
    """``lines`` without those at the places of ``again`` (doc, at), which has been written. All at the places of ``first`` stay: a second bitmap has
    those that the first can't tell from places of ``again``. Copies that it can't tell apart either stay too, which is slower and still right."""
    place, other = F.xxhash64("doc", "at").alias("__place"), F.xxhash64(F.lit(1), "__place").alias("__other")
    gone = bitmap.build(again.select(place), "__place", again.count())
    spared = checkpoint(bitmap.maybe_in(first.select("f.doc", "f.at").select(place), gone, "__place", "__maybe").where("__maybe").select(other))
    seen = bitmap.maybe_in(lines.select("*", place), gone, "__place", "__gone").select("*", other)
    return bitmap.maybe_in(seen, bitmap.build(spared, "__other", spared.count()), "__other", "__spared").where("not __gone or __spared").select(*lines.columns)


def removed_lines(docs: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(doc, at) of every line that an earlier one matches. ``doc`` is doc_id, the least long for null. ``places``: of ``_places``, if they are there already."""
    lines = _lines(docs.select("doc_id", "text"))
    places = (_places(docs) if places is None else places).where("words").select("doc", "at", "h1", "h2")
    first = checkpoint(places.groupBy("h1", "h2").agg(F.min(F.struct("doc", "at")).alias("f"), F.count("*").alias("copies")))
    forget(docs.sparkSession)
    least = max(LEAST, places.count() // HEAVY)
    heavy = first.where(F.col("copies") > least).select("h1", "h2", F.col("f.doc").alias("fdoc"), F.col("f.at").alias("fat"))
    one = lines.join(F.broadcast(heavy), ["h1", "h2"], "left").where("fdoc is null or (fdoc = doc and fat = at)").drop("fdoc", "fat")
    again = checkpoint(places.join(first, ["h1", "h2"]).where("f.doc != doc or f.at != at").select("doc", "at"))
    one = _without(one, again, first)
    ranks = _ranks(one)
    # only the first line of a text can stay, and no other beats what it doesn't
    likely = checkpoint(_likely(one, ranks).join(first.select("h1", "f.doc", "f.at"), "h1"))
    forget(docs.sparkSession, 3)  # the prefix tokens, before the next join writes its own
    beaten = _beaten(_split(docs), ranks, likely)
    return again.union(beaten).distinct()


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (places from 0, comma-joined) of each document."""
    places = _places(docs)
    gone = removed_lines(docs, places).groupBy("doc").agg(F.count("*").alias("n_removed"), F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x.cast("string")), ",").alias("removed"))
    ids, sizes = docs.select(_doc(), F.col("doc_id"), F.lit(0).alias("lines")), places.where("at = 0").select("doc", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "lines")
    each = ids.union(sizes).groupBy("doc").agg(F.max("doc_id").alias("doc_id"), F.sum("lines").alias("n_lines"))
    return each.join(gone, "doc", "left").select("doc_id", "n_lines", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("removed", F.lit("")).alias("removed"))


def remove_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed lines; texts that keep all of theirs don't move."""
    gone = checkpoint(removed_lines(docs).groupBy("doc").agg(F.collect_set("at").alias("__gone")).withColumnRenamed("doc", "__doc"))
    doc = _doc()
    marks = bitmap.build(gone.select(F.xxhash64("__doc").alias("__key")), "__key", gone.count())
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")  # apart from our own columns
    seen = bitmap.maybe_in(docs.select(whole, doc.alias("__doc"), F.xxhash64(doc).alias("__key")), marks, "__key", "__maybe")
    moved = seen.where("__maybe").join(gone, "__doc", "left")
    text = F.array_join(F.filter(F.split("__row.text", "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    row = F.col("__row").withField("text", F.when(F.col("__gone").isNull(), F.col("__row.text")).otherwise(text)).alias("__row")
    return seen.where("not __maybe").select("__row").union(moved.select(row)).select("__row.*")
