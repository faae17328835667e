"""Benchmark decontamination by Wu-Manber search over words.

The test strings are the windows of the benchmark items: ``n`` consecutive words, or all words of an item that
has fewer. Windows of one length share a searcher. It looks at the block of words that ends at the current
position. A shift table says how far the position can move before any window could end there; most blocks occur in
no window and move it by nearly a whole window. Where the shift is zero, the bucket of that suffix block holds
the candidate windows, and comparing words confirms them. Words are numbers, so that a word of the benchmark costs about 300 bytes.

Texts are searched in slabs, so that a very long one takes no more memory than its own bytes. A benchmark of more than ``block_chars`` is searched for
in several passes, of which each is written before the next, so that a worker never holds more than one block.

Nulls and texts without words have no hits. Items without words have no windows. Items without an id have hits and count together as
one item, null, the first of ``items``. Repeated documents give a row each; items that share a window are all reported. An empty benchmark gives rows
without hits, an empty table an empty result. Columns to keep that are named like the new ones give way to them.
"""

from __future__ import annotations

import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_texts

WINDOW = 10
#: Characters of benchmark text that are searched for in one pass over the documents.
BLOCK_CHARS = 4_000_000
#: Bytes of a text whose words are held at once.
SLAB = 1 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def slabs_of(text: str | None) -> Iterator[list[bytes]]:
    """Lower-cased A-Z; a word is a run of digits, letters and non-ASCII characters."""
    raw, at = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD), 0
    while at < len(raw):
        end = raw.find(b" ", at + SLAB)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class Searcher:
    """Windows of ``m`` words each. ``block`` is the number of words looked at: two where windows are long enough."""

    def __init__(self, m: int, windows: dict[tuple[int, ...], set[int]], words: int):
        self.m, self.block, self.words = m, min(2, m), words
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, int | list[int]] = {}
        #: Window w is flat[w * m : (w + 1) * m], of the items owner[first[w] : first[w + 1]].
        self.flat, self.owner, self.first = array("i"), array("i"), array("q", [0])
        for w, (window, items) in enumerate(windows.items()):
            self.flat.extend(window)
            self.owner.extend(sorted(items))
            self.first.append(len(self.owner))
            for end in range(self.block, m + 1):
                key = self._key(window[end - self.block], window[end - 1])
                self.shift[key] = min(self.shift.get(key, m), m - end)
            had = self.bucket.get(key)  # of the last block
            self.bucket[key] = w if had is None else [*had, w] if isinstance(had, list) else [had, w]

    def _key(self, first: int, last: int) -> int:
        return first * self.words + last if self.block == 2 else last

    def find(self, ids: array) -> Iterator[tuple[int, int]]:
        """(first word, window) of each occurrence, in order. A negative number is a word that no item has."""
        m, two, shift, n, flat = self.m, self.block == 2, self.shift.get, len(ids), self.flat
        default = m - self.block + 1
        at = m
        while at <= n:
            last = ids[at - 1]
            if last < 0:
                at += m
                continue
            if two:
                key = ids[at - 2]
                move = default if key < 0 else shift(key := key * self.words + last, default)
            else:
                move = shift(key := last, default)
            if move:
                at += move
                continue
            found = self.bucket[key]
            here = ids[at - m : at]
            for w in found if isinstance(found, list) else (found,):
                if flat[w * m : (w + 1) * m] == here:
                    yield at - m, w
            at += 1

    def items(self, window: int) -> array:
        return self.owner[self.first[window] : self.first[window + 1]]


class Block:
    """What is searched for in one pass."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.n, self.names = n, [i for i, _ in items]
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for k, (_, text) in enumerate(items):
            ids = [self.words[w] for slab in slabs_of(text) for w in slab]
            m = min(n, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                by_length[m][tuple(ids[i : i + m])].add(k)
        self.words.default_factory = None
        self.searchers = [Searcher(m, windows, len(self.words)) for m, windows in sorted(by_length.items())]

    def search(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str | None]]:
        """(number of words, spans of hit words, items)"""
        n, spans, found, held = 0, [], set(), array("i")
        seen: set[tuple[int, int]] = set()
        for slab in slabs_of(text):
            number = self.words.get
            base = n - len(held)
            ids = held + array("i", [number(w, -1) for w in slab])
            n += len(slab)
            for k, s in enumerate(self.searchers):
                for start, window in s.find(ids):
                    start += base
                    if spans and spans[-1][0] <= start <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], start + s.m))
                    else:
                        spans.append((start, start + s.m))
                    if (k, window) not in seen:
                        seen.add((k, window))
                        found.update(self.names[i] for i in s.items(window))
            held = ids[max(0, len(ids) - self.n + 1) :]
        return n, merge(spans), found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark's items in blocks of bounded size, one at least: (item id as text, text)."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t is not null").toLocalIterator():
        if held and size + len(row.t) > limit:
            yield held
            held, size = [], 0
        held.append((row.i, row.t))
        size += len(row.t)
    yield held


_built: dict[str, Block] = {}


def _block(name: str, sent, n: int) -> Block:
    """One for each worker, which serves all its tasks."""
    if name not in _built:
        _built.clear()
        _built[name] = Block(sent.value, n)
    return _built[name]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, keep: list[str], n: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``keep`` columns and ``text`` of ``docs``, with n_words, hits (word spans, end exclusive, merged) and items (sorted ids).

    One pass over the documents for each block of the benchmark. What is sent to the executors is one block, of at
    most ``block_chars`` characters or one item.
    """
    kept = [c for c in dict.fromkeys(keep) if c not in ("text", "n_words", "hits", "items")]
    out = docs.select(*kept, "text", F.lit(0).cast("long").alias("__words"), F.array().cast("array<struct<a:int,b:int>>").alias("__hits"), F.array().cast("array<string>").alias("__items"))
    schema = out.schema
    arrow = pa.struct([("a", pa.int32()), ("b", pa.int32())])
    for k, block in enumerate(_blocks(benchmark, block_chars)):
        sent, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def make(sent=sent, name=name):
            search = _block(name, sent, n).search

            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                names = batch.schema.names
                counts, hits, items = [], [], []
                for text, old, had in zip(batch.column("text").to_pylist(), batch.column("__hits").to_pylist(), batch.column("__items").to_pylist(), strict=True):
                    count, spans, found = search(text)
                    counts.append(count)
                    hits.append([{"a": a, "b": b} for a, b in (merge([(x["a"], x["b"]) for x in old] + spans) if old else spans)])
                    items.append(sorted(found.union(had), key=lambda x: (x is not None, x or "")))
                new = {"__words": pa.array(counts, pa.int64()), "__hits": pa.array(hits, pa.list_(arrow)), "__items": pa.array(items, pa.list_(pa.string()))}
                return pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names)

            return work

        out = map_texts(checkpoint(out) if k else out, make, schema)
    return out.withColumnsRenamed({"__words": "n_words", "__hits": "hits", "__items": "items"})
