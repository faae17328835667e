"""Sampled SentencePiece segmentations: Gumbel top-k without replacement by perturbed best-first search.

A text becomes a lattice of pieces, cut before every space that follows another character, since pieces have spaces at their start only. Its segmentations have a
distribution: products of piece probabilities, normalised over the lattice by backward sums. Each segmentation's log
probability is perturbed by Gumbel noise and the k largest are wanted. The search keeps a heap of disjoint regions of
the lattice: "agrees with a known segmentation before piece t and takes none of these edges there". The bound of a
region is the maximum of its perturbed scores, drawn from the region's total probability and truncated at the score of
the region that it was split from. That bound is exact, so A* pops regions in order of score and draws the
segmentation that attains it: an excluded-edge draw at t, then a free walk by the backward sums. The rest of the
region is split along the new segmentation. All regions that leave one segmentation are held together, under the bound
of their union, until it is popped; then the one that attains it is drawn by share and the others stay together.

Results: distinct segmentations by falling score. ``inclusion`` is 1 - exp(-exp(log_prob - threshold)), where the
threshold is the (k+1)-th score; if the lattice has no more than k segmentations, all are given with inclusion 1.
All noise is a hash of the seed, the row's key, the sample and the position: rows don't depend on partitions, and rows
with equal key and text give equal samples.

Null counts as empty; an empty text has one segmentation, without pieces. Characters without a piece are byte
pieces, so decoding gives every text back. Whole texts are encoded; a very long one takes about 100 bytes a character in one worker. Repeated rows give
their samples each; an empty table gives an empty result. ``doc_id``, or another key, is a long.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BATCH_BYTES, map_texts
from .vocabulary import LITERAL, SPACE, Trie, default_model, firsts, log_sums, vocabulary

SAMPLES, SEED = 2, 17
#: Edges that a task keeps for words that it has seen; beyond, it starts anew (which changes no result).
KEPT_EDGES = 300_000

_CUT = re.compile(r"(?<=[^ ]) ")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_M = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _mix1(x: int) -> int:
    x = (x ^ (x >> 30)) * int(_B) & _M
    x = (x ^ (x >> 27)) * int(_C) & _M
    return x ^ (x >> 31)


def _uniform(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    return ((_mix(seed + counter.astype(np.uint64) * _A) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def _uniform1(seed: int, counter: int) -> float:
    return ((_mix1((seed + counter * int(_A)) & _M) >> 11) + 0.5) * 2.0**-53


def words_of(text: str) -> list[str]:
    """What stands between the cuts; a run of spaces is one cut and belongs to the word after it."""
    if not text:
        return []
    return _CUT.split(text) if "  " in text or text[0] == " " else text.split(" ")


@lru_cache(1)
def _trie(model: str) -> Trie:
    return Trie(vocabulary(model).normal)


class Lattices:
    """The lattices of the words seen so far, one after the other: state = position, edges by state."""

    def __init__(self, model: str):
        self.vocabulary = vocabulary(model)
        self.trie = _trie(model)
        self.clear()

    def clear(self) -> None:
        self.word: defaultdict[str, int] = defaultdict()
        self.word.default_factory = self.word.__len__
        self.start = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)  # edge of each state, and the end
        self.within, self.stop, self.piece, self.log = np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)

    def built(self, words: list[str], base: int, edge: int) -> tuple[np.ndarray, ...]:
        """The lattices of new words (without their SPACE), whose first state is ``base`` and first edge ``edge``."""
        text = SPACE + SPACE.join(words)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        start = np.cumsum(size) - size
        literal = chars == ord(SPACE)
        literal[start] = False
        chars[literal] = LITERAL
        chars[chars == 32] = ord(SPACE)
        end = np.repeat(start + size, size)
        a, b, v = self.trie.edges(chars, end)
        log = self.vocabulary.log[np.maximum(v, 0)]
        for i in np.flatnonzero(v < 0):
            ids = self.vocabulary.fallback(-1 - int(v[i]))
            log[i] = self.vocabulary.byte_log * len(ids)
            if len(ids) == 1:
                v[i] = ids[0]
        sums = log_sums(a, b, log, end)
        last = b == end[a]
        log = log + np.where(last, 0.0, sums[np.where(last, 0, b)]) - sums[a]
        first = firsts(a, len(chars))
        single = (first[1:] - first[:-1]) == 1
        log[single[a]] = 0.0
        top = np.flatnonzero(log == np.maximum.reduceat(log, first[:-1])[a])
        top = top[np.concatenate([[True], a[top[1:]] != a[top[:-1]]])]
        for x in (log, b, v, last):  # the likeliest edge of a state comes first
            x[first[:-1]], x[top] = x[top], x[first[:-1]]
        share = np.exp(log)
        run = np.cumsum(share)
        within = run - np.concatenate([[0.0], run])[first[a]]
        within[first[1:] - 1] = 2.0  # more than any draw
        return within.astype(np.float32), np.where(last, -1, b + base).astype(np.int32), v.astype(np.int32), log.astype(np.float32), first[1:] + edge, start + base

    def add(self, words: list[str]) -> None:
        parts, base, edge = [], len(self.first) - 1, len(self.within)
        for i in range(0, len(words), 5_000):
            parts.append(self.built(words[i : i + 5_000], base, edge))
            base, edge = base + len(parts[-1][4]), edge + len(parts[-1][0])
        for name, *new in zip(("within", "stop", "piece", "log", "first", "start"), *parts, strict=True):
            setattr(self, name, np.concatenate([getattr(self, name), *new]))

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the number of each word."""
        if len(self.within) > KEPT_EDGES:
            self.clear()
        known, had = self.word, len(self.word)
        numbers = [np.fromiter(map(known.__getitem__, words_of(t)), np.int64) for t in texts]
        self.add(list(islice(known, had, None)))
        return numbers

    def walk(self, state: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw edges from each state to the end of its word. (edges of all walks in turn, number of each)"""
        state = state.copy()
        shift = place - state
        acts, taken = [], []
        act = np.arange(len(state))
        while len(act):
            at = state[act]
            goal = _uniform(seed[act], shift[act] + at)
            e = self.first[at]
            hard = np.flatnonzero(self.within[e] <= goal)
            while len(hard):
                e[hard] += 1
                hard = hard[self.within[e[hard]] <= goal[hard]]
            acts.append(act)
            taken.append(e)
            to = self.stop[e].astype(np.int64)
            state[act] = to
            act = act[to >= 0]
        count = np.zeros(len(state), np.int64)
        for k, a in enumerate(acts):
            count[a] = k + 1
        offset = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for k, (a, e) in enumerate(zip(acts, taken, strict=True)):
            out[offset[a] + k] = e
        return out, count


class _Path:
    """A segmentation: its edges, the first of each word, and its log probability."""

    __slots__ = ("edges", "offset", "log", "score")

    def __init__(self, edges: np.ndarray, count: np.ndarray, log: np.ndarray, score: float):
        self.edges, self.offset, self.score = edges, np.concatenate([[0], np.cumsum(count)]), score
        self.log = float(log[edges].sum(dtype=float))


class _Search:
    """The heap of one text. An entry: -bound, number, log probability, what.

    ``what`` is a region (path, piece t, edges not to take at t, log probability of what comes before t), or a group
    of them (path, first piece, log probability before it, pieces already taken out).
    """

    def __init__(self, key: int, seed: int):
        self.seed = _mix1((key & _M) ^ _mix1(seed))
        self.heap: list[tuple] = []
        self.drawn = 0

    def noise(self) -> float:
        self.drawn += 1
        return _uniform1(self.seed, self.drawn + (1 << 62))

    def push(self, mass: float, limit: float, what: tuple) -> None:
        """The bound is a Gumbel variable at ``mass``, given that it is at most ``limit``."""
        low = math.log(-math.log(self.noise())) - mass if mass > -math.inf else math.inf
        if low < math.inf:
            bound = -(max(-limit, low) + math.log1p(math.exp(-abs(-limit - low))))
            heapq.heappush(self.heap, (-bound, self.drawn, what))

    def along(self, path: _Path, t: int, before: float, limit: float, log: np.ndarray) -> None:
        """Everything that leaves ``path`` at piece t or later."""
        rest = min(0.0, float(log[path.edges[t:]].sum(dtype=float)))
        if rest < 0:
            self.push(before + math.log(-math.expm1(rest)), limit, (path, t, before, ()))

    def pop(self, log: np.ndarray) -> tuple | None:
        """(score, path, t, edges not to take, log probability before t) of the best region."""
        if not self.heap:
            return None
        bound, _, what = heapq.heappop(self.heap)
        if len(what) == 5:
            return -bound, *what[:4]
        path, t, before, out = what
        part = np.minimum(log[path.edges[t:]].astype(float), 0.0)
        share = np.exp(np.cumsum(part) - part) * -np.expm1(part)
        share[[x - t for x in out]] = 0.0
        run = np.cumsum(share)
        at = min(int(np.searchsorted(run, run[-1] * self.noise(), side="right")), int(np.flatnonzero(share)[-1]))
        left = float(run[-1] - share[at])
        if left > 0:
            self.push(before + math.log(left), -bound, (path, t, before, (*out, t + at)))
        return -bound, path, t + at, (int(path.edges[t + at]),), before + float(part[:at].sum())


def sample(lattices: Lattices, keys: list[int], texts: list[str], k: int, seed: int) -> list[list[tuple[_Path, float]]]:
    """For each text, up to k (segmentation, inclusion), by falling score."""
    numbers = lattices.numbers(texts)
    states = np.diff(np.append(lattices.start, len(lattices.first) - 1))
    places = [np.cumsum(states[x]) - states[x] for x in numbers]  # a word has its own range of counters
    searches = [_Search(key, seed) for key in keys]
    log = lattices.log

    def walks(tasks: list[tuple[int, np.ndarray, np.ndarray, int]]):
        """tasks: text, states, places, sample; the edges and counts of each."""
        if not tasks:
            return []
        size = [len(x[1]) for x in tasks]
        seeds = np.repeat(np.array([_mix1((searches[i].seed + n) & _M) for i, _, _, n in tasks], np.uint64), size)
        edges, count = lattices.walk(np.concatenate([x[1] for x in tasks]), seeds, np.concatenate([x[2] for x in tasks]))
        by_task = np.split(count, np.cumsum(size)[:-1])
        return zip(np.split(edges, np.cumsum([int(c.sum()) for c in by_task])[:-1]), by_task, strict=True)

    found: list[list[_Path]] = []
    tasks = [(i, lattices.start[numbers[i]], places[i], 1) for i in range(len(texts))]
    for s, (edges, count) in zip(searches, walks(tasks), strict=True):
        top = -math.log(-math.log(s.noise()))
        found.append([_Path(edges, count, log, top)])
    for i, s in enumerate(searches):
        s.along(found[i][0], 0, 0.0, found[i][0].score, log)
    for n in range(2, k + 1):
        tasks, heads = [], []
        for i, s in enumerate(searches):
            region = s.pop(log)
            if region is None:
                continue
            score, path, t, banned, before = region
            word = int(np.searchsorted(path.offset, t, side="right")) - 1
            state = int(np.searchsorted(lattices.first, path.edges[t], side="right")) - 1
            lo, hi = int(lattices.first[state]), int(lattices.first[state + 1])
            share = np.exp(log[lo:hi].astype(float))
            share[[e - lo for e in banned]] = 0.0
            run = np.cumsum(share)
            edge = lo + min(int(np.searchsorted(run, run[-1] * _uniform1(s.seed, (n << 48) + t), side="right")), int(np.flatnonzero(share)[-1]))
            left = share.sum() - share[edge - lo]
            if left > 1e-300:
                s.push(before + math.log(left), score, (path, t, (*banned, edge), before, None))
            to = int(lattices.stop[edge])
            states, at = lattices.start[numbers[i][word + 1 :]], places[i][word + 1 :]
            if to >= 0:
                states = np.concatenate([[to], states])
                at = np.concatenate([[places[i][word] + to - lattices.start[numbers[i][word]]], at])
            tasks.append((i, states, at, n))
            heads.append((i, score, path, t, edge, word, to, before))
        for (i, score, path, t, edge, word, to, before), (edges, count) in zip(heads, walks(tasks), strict=True):
            head = path.edges[:t]
            counts = np.diff(path.offset)[:word].tolist()
            inside = t - int(path.offset[word]) + 1
            if to >= 0:
                inside += int(count[0])
                count = count[1:]
            new = _Path(np.concatenate([head, [edge], edges]), np.concatenate([counts, [inside], count]).astype(np.int64), log, score)
            found[i].append(new)
            searches[i].along(new, t + 1, before + float(log[edge]), score, log)
    out = []
    for s, paths in zip(searches, found, strict=True):
        threshold = -s.heap[0][0] if s.heap else -math.inf
        out.append([(p, -math.expm1(-math.exp(min(700.0, p.log - threshold)))) for p in paths])
    return out


def ids_of(lattices: Lattices, path: _Path) -> np.ndarray:
    ids = lattices.piece[path.edges]
    if len(ids) and ids.min() < 0:
        return np.array([x for i in ids.tolist() for x in ([i] if i >= 0 else lattices.vocabulary.fallback(-1 - i))], "<u4")
    return ids.astype("<u4")



def encode(docs: DataFrame, keep: list[str], k: int = SAMPLES, seed: int = SEED, model: str | None = None, key: str = "doc_id", verify: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` once for each sample, with sample (1 to k), ids (32-bit little-endian), log_prob,
    score and inclusion. ``key`` is a long column that seeds the row; null counts as 0. With ``verify`` also ``exact``:
    whether decoding the ids gives the text. Columns to keep that are named like these give way to them."""
    model = model or default_model()
    keep = [c for c in keep if c not in ("sample", "ids", "log_prob", "score", "inclusion", "exact")]
    seen = docs.select(*dict.fromkeys([*keep, key, "text"]))
    fields = [f for f in seen.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sample int, ids binary, log_prob double, score double, inclusion double" + ", exact boolean" * verify
    names = [f.name for f in fields] + ["sample", "ids", "log_prob", "score", "inclusion"] + ["exact"] * verify

    def make():
        lattices = Lattices(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            drawn = sample(lattices, [x or 0 for x in batch.column(key).to_pylist()], texts, k, seed)
            flat = [(i, n + 1, p, q) for i, ps in enumerate(drawn) for n, (p, q) in enumerate(ps)]
            take = pa.array([x[0] for x in flat], pa.int32())
            ids = [ids_of(lattices, x[2]).tobytes() for x in flat]
            new = [pa.array([x[1] for x in flat], pa.int32()), pa.array(ids, pa.binary()), pa.array([x[2].log for x in flat], pa.float64()), pa.array([x[2].score for x in flat], pa.float64()), pa.array([x[3] for x in flat], pa.float64())]
            if verify:
                new.append(pa.array([decode_ids(x, model) == texts[f[0]] for x, f in zip(ids, flat, strict=True)], pa.bool_()))
            return pa.RecordBatch.from_arrays([*(batch.column(f.name).take(take) for f in fields), *new], names)

        return work

    return map_texts(seen, make, schema, limit=BATCH_BYTES // 8)


def decode_ids(ids: bytes | None, model: str) -> str | None:
    if ids is None:
        return None
    raw = vocabulary(model).raw
    text = b"".join(map(raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "surrogatepass")
    return text[1:]


def decode(encoded: DataFrame, keep: list[str], model: str | None = None) -> DataFrame:
    """``keep`` columns of ``encoded`` and the decoded ``text`` of its ``ids``."""
    model = model or default_model()
    keep = [c for c in keep if c != "text"]
    fields = [f for f in encoded.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [decode_ids(x, model) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(texts, pa.string())], [*(f.name for f in fields), "text"])

    return map_texts(encoded.select(*dict.fromkeys([*keep, "ids"])), lambda: work, schema, "ids", BATCH_BYTES // 2)
