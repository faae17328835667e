"""SimHash near-duplicates, linked by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes of the text's three-word
shingles. Two fingerprints within distance r share a point within r/2 of both, so for r = 2 every distinct fingerprint
emits itself and its 64 one-bit variants. Fingerprints that meet on a variant (65 at most) are within r of each
other; each is linked to the one of them with the least doc_id, and the link is verified. Links of a meeting connect all
of it, so components need no other pairs.

Null and empty texts have fingerprint zero, which is linked like any other. Texts of fewer than three words are one
shingle. Repeated rows give a row each. An empty table gives an empty result. Rows with a null doc_id are kept out
of links and get their own null component. ``doc_id`` is a long; ``near_duplicates`` reads it and text only, ``keep_one`` carries other columns, whatever their
names. Texts are read whole; a very long one takes about 100 bytes a word in one worker.

The pipeline's stage (``keep_one``) has another rule: texts are near copies if their sets of five-word shingles have Jaccard
0.8 or more. At 0.8 two fingerprints differ by about ten of 64 bits, which no ball reaches, so fingerprints (of five words)
only propose pairs, as do 32 bands of four min-hashes; a pair of Jaccard 0.8 meets in no band with a chance of 5e-8. Every
proposed pair is decided by its exact Jaccard. Each text first meets one other: of its ball, or the one that it shares most bands with. Bands that then
have texts of different components go on: up to ``CROWD`` pairs meet, of larger bands each text meets one of the largest component, in two rounds, and
what is still apart goes through an exact set-similarity join. So neither a large group of copies nor a passage that many texts share makes a
square of pairs.

Rows of one text are one node. One row of each component stays: of the least doc_id, null last, then of the least text hash. Texts without words
are near copies of one another. Rows that repeat a doc_id with other texts are decided each by its text.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .common import checkpoint, forget, map_texts
from .components import connected_components, merged

SHINGLE, RADIUS, SEED = 3, 2, 42
#: The stage's shingles, and its bands of min-hashes.
WIDE, BANDS, ROWS = 5, 32, 4
#: A band in which more pairs of different components would meet is crowded: its texts are joined by ``joined``.
CROWD = 12

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


_rng = np.random.default_rng(SEED)
_FLIP, _TIMES = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32), _rng.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
#: Orders of the nodes: in each round, crowded bands choose another of their nodes for the others to meet.
_ORDERS = (0, 0x2545F4914F6CDD1D)


def hashes(text: str | None, size: int) -> np.ndarray:
    """Of each shingle in turn; none for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # at \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, "<u8")
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else iter([b" ".join(words)])
    return np.fromiter(map(_hash, shingles), "<u8", max(1, len(words) - size + 1))


def majority(found: np.ndarray) -> int:
    n = len(found)
    if not n:
        return 0
    bits = np.unpackbits(found.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    if n % 255:  # sums of 255 rows fit a byte
        bits = np.concatenate([bits, np.zeros((-n % 255, 64), np.uint8)])
    counts = bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    return majority(hashes(text, size))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes."""
    least, low = np.full(BANDS * ROWS, ~np.uint32(0)), found.astype(np.uint32)
    for i in range(0, len(low), 1024):
        least = np.minimum(least, ((low[i : i + 1024, None] ^ _FLIP) * _TIMES).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) for i in range(BANDS)], np.uint64).view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return map_texts(docs.select("doc_id", "text"), lambda: work, "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Verified links (a, b) between representatives, of the distinct fingerprints ``fps`` (fp, rep)."""
    bits = F.array(*(F.lit(0 if i < 0 else 1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(-1, 64)))
    # a variant tells its fingerprint by the bit that differs
    balls = fps.select("fp", "rep", F.posexplode(bits).alias("bit", "flip")).select("rep", "bit", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
    met = balls.withColumn("m", F.expr("min(struct(rep, bit)) over (partition by v)")).where("m.rep != rep")
    fp = lambda bit: F.col("v").bitwiseXOR(F.element_at(bits, bit + 1))
    near = F.bit_count(fp(F.col("bit")).bitwiseXOR(fp(F.col("m.bit")))) <= RADIUS
    return met.where(near).select(F.col("rep").alias("a"), F.col("m.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links reach, for every row."""
    rows = checkpoint(fingerprints(docs))
    reps = checkpoint(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(checkpoint(links(reps)))
    named = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = rows.join(named, "fp", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), own.alias("component_id"))


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, cheap, full, fp, n, keys): the row's identity, the five-word fingerprint, the number of distinct shingles, the band keys."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp, n, keys = [], [], []
        for t in batch.column("text").to_pylist():
            found = hashes(t, WIDE)
            apart = np.unique(found)
            fp.append(majority(found))
            n.append(len(apart))
            keys.append(bands(apart))
        columns = [*(batch.column(c) for c in ("doc_id", "cheap", "full")), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "cheap", "full", "fp", "n", "keys"])

    cheap, full = bitmap.identity(F.col("text"), F.col("doc_id"))
    return map_texts(docs.select("doc_id", "text", cheap.alias("cheap"), full.alias("full")), lambda: work, "doc_id long, cheap long, full string, fp long, n int, keys array<long>")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(full, shingles): the five-word shingles of the texts of ``nodes`` (cheap, full), and of few others. Other texts aren't read as words. Rows
    that repeat an identity repeat its set."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(hashes(t, WIDE).view(np.int64)) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("full"), pa.array(sets, pa.list_(pa.int64()))], ["full", "shingles"])

    marks = bitmap.build(nodes, "cheap", nodes.count())
    cheap, full = bitmap.identity(F.col("text"), F.col("doc_id"))
    asked = bitmap.maybe_in(docs.select("text", full.alias("full"), cheap.alias("cheap")), marks, "cheap", "__maybe").where("__maybe")
    return map_texts(asked.select("full", "text"), lambda: work, "full string, shingles array<long>")


_ALIKE = "9 * size(array_intersect(x, y)) >= 4 * (size(x) + size(y))"


def similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, repeats: bool) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose sets of five-word shingles have Jaccard 0.8 or more. Two empty sets are alike. ``repeats`` says
    that rows of ``docs`` may repeat an identity."""
    n = pairs.count()
    asked = checkpoint(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")), "node", "left_semi").select("node", "cheap", "full"), 2 * n)
    sets = _sets(docs, asked)
    sets = sets.dropDuplicates(["full"]) if repeats else sets
    names = asked.select("node", "full")
    named = pairs.join(names.toDF("a", "fa"), "a").join(names.toDF("b", "fb"), "b")
    met = named.join(sets.toDF("fa", "x"), "fa").join(sets.toDF("fb", "y"), "fb")
    found = checkpoint(met.where(_ALIKE).select("a", "b"), n)
    forget(docs.sparkSession)
    return found


def joined(sets: DataFrame) -> DataFrame:
    """All pairs (a, b) of ``sets`` (node, shingles, group) of Jaccard 0.8 or more and of different groups, by an exact set-similarity join.

    Shingles are ordered by rarity. Of a match, the longer set has a common shingle among its n - ceil(0.8 n) + 1 rarest, the shorter
    among its n - ceil(8 n / 9) + 1 rarest; so what a group shares meets nothing, unless it is nearly all of its texts.
    """
    each = sets.select("node", "group", F.explode("shingles").alias("s"))
    counts = each.groupBy("s").agg(F.count("*").alias("c"))
    ordered = each.join(counts, "s").groupBy("node", "group").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("t"))
    posts = ordered.select("node", "group", F.size("t").alias("n"), F.posexplode(F.expr("slice(t, 1, size(t) - cast(ceil(0.8 * size(t) - 1e-9) as int) + 1)")).alias("i", "e"))
    posts = checkpoint(posts.where("e.c > 1").select("node", "group", "n", "i", F.col("e.s").alias("s")))
    # within the largest group of a shingle nothing is compared
    largest = posts.groupBy("s", "group").agg(F.count("*").alias("c")).groupBy("s").agg(F.max(F.struct("c", "group")).alias("big"), F.count("*").alias("groups")).where("groups > 1")
    marked = checkpoint(posts.join(largest.select("s", F.col("big.group").alias("big")), "s"))
    near = F.expr("x.s = y.s and x.group != y.group and (y.n, y.node) < (x.n, x.node) and 5 * y.n >= 4 * x.n and 9 * least(x.n - x.i, y.n - y.i) >= 4 * (x.n + y.n)")

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.alias("x").join(y.where("9 * (n - i) >= 8 * n").alias("y"), near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    small, large = marked.where("group != big"), marked.where("group = big")
    pairs = meet(small, marked).union(meet(large, small)).distinct()
    plain = sets.select("node", "shingles")
    return pairs.join(plain.toDF("a", "x"), "a").join(plain.toDF("b", "y"), "b").where(_ALIKE).select("a", "b")


def _rooted(frame: DataFrame, labels: DataFrame) -> DataFrame:
    """``frame`` with the root of each node's component, itself where nothing links it."""
    return frame.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _parted(placed: DataFrame, order: int, rows: int) -> DataFrame:
    """Of ``placed`` (key, node, n, root) the keys with several components, with the largest (big), one of its nodes (first), the rows (c) and
    those of others."""
    mine = F.col("node").bitwiseXOR(F.lit(order))
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("c"), F.min(mine).alias("first"))
    several = parts.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    sized = parts.join(several, "key", "left_semi").groupBy("key").agg(F.max(F.struct("c", "root", "first")).alias("big"), F.sum("c").alias("c"))
    first = F.col("big.first").bitwiseXOR(F.lit(order)).alias("first")
    return checkpoint(placed.join(sized.select("key", F.col("big.root").alias("big"), first, "c", (F.col("c") - F.col("big.c")).alias("others")), "key"), rows)


def near_copies(docs: DataFrame, nodes: DataFrame, repeats: bool) -> DataFrame:
    """(node, root): the components of ``nodes`` (node, cheap, full, fp, n, keys) by pairs of Jaccard 0.8 or more, of nodes that have any."""
    # 1: each node meets one other, of its ball or else the one that it shares most bands with, of those that are most central in them
    reps = checkpoint(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    ball = nodes.join(reps, "fp").select(F.col("node").alias("a"), F.col("rep").alias("b")).where("a != b").union(links(reps)).withColumn("c", F.lit(BANDS + 1).cast("long"))
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    groups = checkpoint(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    some = bitmap.maybe_in(keyed, bitmap.build(groups, "key", groups.count()), "key", "__maybe").where("__maybe").drop("__maybe")
    shared = checkpoint(some.join(groups, "key"))
    central = shared.groupBy("node").agg(F.sum("c").alias("s"))  # an original is in the large bands of all its copies
    pivots = shared.join(central, "node").groupBy("key").agg(F.max_by(F.struct(F.col("node").alias("m"), F.col("n").alias("k")), "s").alias("p")).select("key", "p.*")
    stars = shared.join(pivots, "key").where("node != m and 5 * least(n, k) >= 4 * greatest(n, k)").groupBy("node", "m").agg(F.count("*").alias("c"))
    met = ball.unionByName(stars.select(F.col("node").alias("a"), F.col("m").alias("b"), "c"))
    labels = connected_components(similar(docs, nodes, checkpoint(met.groupBy("a").agg(F.max_by("b", "c").alias("b"))), repeats))

    # 2: of bands with several components, all pairs of different ones where they are few, else each node and one of the largest component, in rounds
    left = shared.select("key", "node", "n")
    for order in _ORDERS:
        n = left.count()
        left = _parted(_rooted(left.select("key", "node", "n"), labels), order, n)
        crowded = left.where(f"others * c > {CROWD}")
        wide = crowded.where("root != big").groupBy("node", "first").agg(F.count("*").alias("c")).groupBy("node").agg(F.max_by("first", "c").alias("b"))
        x, y = left.where(f"others * c <= {CROWD} and root != big").alias("x"), left.alias("y")
        small = x.join(y, "key").where("x.root != y.root and (y.root = y.big or x.node < y.node) and 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)")
        met = wide.select(F.col("node").alias("a"), "b").union(small.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
        pairs = checkpoint(met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), n)
        if pairs.isEmpty() or (found := similar(docs, nodes, pairs, repeats)).isEmpty():
            break
        labels = merged(labels, found)
        left = crowded

    # 3: what crowded bands still have of different components, by an exact join
    n = crowded.count()
    left = _parted(_rooted(crowded.select("key", "node", "n"), labels), 0, n)
    asked = left.select("node", F.col("root").alias("group")).distinct()
    asked = checkpoint(nodes.join(asked, "node").select("node", "group", "cheap", "full"), n)
    if asked.isEmpty():
        return labels
    sets = _sets(docs, asked)
    sets = sets.dropDuplicates(["full"]) if repeats else sets
    return merged(labels, checkpoint(joined(checkpoint(sets.join(asked, "full").select("node", "group", "shingles")))))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of near copies: of the least doc_id, null last. Of rows that share that doc_id one stays."""
    rows = checkpoint(_sketches(docs).withColumn("row", F.monotonically_increasing_id()))
    text = F.substring("full", 1, 64)
    texts = checkpoint(rows.groupBy(text.alias("text")).agg(F.min("row").alias("row"), F.count("*").alias("copies")), rows.count())
    # the rows of one text are one node
    repeats = not texts.where("copies > 1").isEmpty()
    nodes = checkpoint(rows.join(texts.select("row"), "row", "left_semi")) if repeats else rows
    nodes = nodes.withColumnRenamed("row", "node")
    roots = near_copies(docs, nodes, repeats)
    named = texts.select("text", F.col("row").alias("node"), "copies").join(roots, "node", "left").where("copies > 1 or root is not null")
    some = rows.select("doc_id", "cheap", "full", text.alias("text")).join(named.select("text", F.coalesce("root", "node").alias("root")), "text", "left")
    linked = some.where("root is not null")
    best = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "full")).alias("best"))
    # all rows of the best identity are kept here, and one of them by keep_rows
    identity = [F.col("cheap").alias("__cheap"), F.col("full").alias("__full")]
    decided = linked.join(best, "root").select(*identity, (F.col("best.full") == F.col("full")).alias("__keep"))
    alone = some.where("root is null").select(*identity, F.lit(True).alias("__keep"))  # they have no key to be dealt by
    return bitmap.keep_rows(docs, checkpoint(decided.union(alone)))
