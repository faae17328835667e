"""Language identification by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary (lower-cased pieces of letters). A word
is a run of letters; its probability in a language is the sum over all its segmentations of the product of piece
probabilities, from a backward sum over the lattice. The log probabilities of all words of a text are added, and the
score is the posterior of the best language under equal priors.

The probabilities are fitted by expectation-maximisation on the word counts of a sample of rows outside fold 0 with a
language: up to about ``SAMPLE_ROWS`` whole texts of each language, chosen by a hash of doc_id. Only the fit uses a
sample; every text is scored whole. A text that is null or has no letter, or a table without any learned language,
gives ``und`` and score 0. Ties go to the first language by name. Repeated rows give a row each; an empty table gives an empty result. Rows with a
null doc_id are scored and never learned from. Whole texts are scored; a very long one takes a few times its size in one worker. Words longer than
``LONGEST`` letters are scored in parts of that length.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, map_texts
from .vocabulary import SPACE, Trie, default_model, firsts, log_sums, vocabulary

SAMPLE_ROWS = 600
ROUNDS = 3
#: Pseudo-counts that the vocabulary's own weights get in each language.
PRIOR = 500.0
#: Log probability of a letter that no piece has.
UNKNOWN = -16.0
#: Words that a task keeps the sums of; beyond, it starts anew (which changes no result).
KEPT_WORDS = 200_000

#: Letters of a word whose lattice is built at once.
LONGEST = 1000
_WORDS = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


@dataclass
class Model:
    languages: list[str]
    log: np.ndarray  # pieces x languages
    vocabulary: str


def _pieces(path: str) -> tuple[dict[str, int], np.ndarray]:
    """Lower-cased pieces of letters, with numbers of their own, and the vocabulary's weights of them."""
    v = vocabulary(path)
    numbers: dict[str, int] = {}
    weight: list[float] = []
    for name, i in v.normal.items():
        word = name.lower()
        if word.removeprefix(SPACE).isalpha() or word == SPACE:
            at = numbers.setdefault(word, len(numbers))
            if at == len(weight):
                weight.append(0.0)
            weight[at] += float(np.exp(v.log[i]))
    w = np.array(weight)
    return numbers, w / w.sum()


@lru_cache(1)
def _trie(path: str) -> Trie:
    return Trie(_pieces(path)[0])


def _lattice(trie: Trie, words: list[str]):
    """(starts, stops, pieces, ends, start of each word) of all words, one after the other."""
    chars = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    end = np.repeat(start + size, size)
    return *trie.edges(chars, end), end, start


def learn(counts: dict[str, dict[str, int]], path: str, rounds: int = ROUNDS, prior: float = PRIOR) -> Model:
    """Piece probabilities of each language from its word counts."""
    numbers, base = _pieces(path)
    trie, languages = Trie(numbers), sorted(counts)
    out = np.zeros((len(numbers), len(languages)))
    for k, name in enumerate(languages):
        words = list(counts[name])
        log = np.log(base)
        for _ in range(rounds):
            got = np.zeros(len(numbers))
            for i in range(0, len(words), 10_000):
                part = words[i : i + 10_000]
                a, b, v, end, start = _lattice(trie, part)
                w = np.where(v >= 0, log[np.maximum(v, 0)], UNKNOWN)
                sums = log_sums(a, b, w, end)
                last = b == end[a]
                share = np.exp(w + np.where(last, 0.0, sums[np.where(last, 0, b)]) - sums[a])
                reach = np.zeros(len(end) + 1)  # expected visits of each position
                reach[start] = [counts[name][x] for x in part]
                first = firsts(a, len(end))
                off = np.arange(len(end)) - np.repeat(start, np.diff(np.append(start, len(end))))
                order = np.argsort(off, kind="stable")
                flow = np.zeros(len(a))
                for group in np.split(order, np.flatnonzero(np.diff(off[order])) + 1):
                    lo, n = first[group], first[group + 1] - first[group]
                    e = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
                    flow[e] = np.repeat(reach[group], n) * share[e]
                    inner = e[~last[e]]
                    np.add.at(reach, b[inner], flow[inner])
                got += np.bincount(v[v >= 0], weights=flow[v >= 0], minlength=len(numbers))
            log = np.log((got + prior * base) / (got.sum() + prior))
        out[:, k] = log
    return Model(languages, out, path)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, model: str | None = None) -> Model:
    """Learn from text and non-null lang of documents outside fold 0."""
    known = docs.where((fold_of(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r.lang: min(1.0, rows / r.n) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Model([], np.zeros((0, 0)), model or default_model())
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    limit = F.element_at(F.from_json(F.lit(json.dumps(share)), "map<string,double>"), F.col("lang"))
    picked = known.where(draw < limit).select("lang", "text")

    def count(batches):
        for batch in batches:
            held: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held[lang].update(words_of(text))
            flat = [(lang, w, n) for lang, ws in held.items() for w, n in ws.items()]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x[0] for x in flat], pa.string()), "word": pa.array([x[1] for x in flat], pa.string()), "n": pa.array([x[2] for x in flat], pa.int64())})

    counts: dict[str, dict[str, int]] = {lang: {} for lang in share}
    for r in picked.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").toLocalIterator():
        counts[r.lang][r.word] = r.n
    return learn(counts, model or default_model())


class Scorer:
    """Keeps the log probabilities of words that it has seen."""

    def __init__(self, model: Model):
        self.model, self.trie = model, _trie(model.vocabulary)
        self.clear()

    def clear(self) -> None:
        self.word: defaultdict[str, int] = defaultdict()
        self.word.default_factory = self.word.__len__
        self.sums = np.zeros((0, len(self.model.languages)))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [("und", 0.0)] * len(texts)
        if len(self.word) > KEPT_WORDS:
            self.clear()
        had, get = len(self.word), self.word.__getitem__
        numbers = [np.fromiter(map(get, words_of(t)), np.int64) for t in texts]
        fresh = list(islice(self.word, had, None))
        parts = [self.sums]
        for i in range(0, len(fresh), 10_000):
            a, b, v, end, start = _lattice(self.trie, fresh[i : i + 10_000])
            parts.append(np.stack([log_sums(a, b, np.where(v >= 0, self.model.log[np.maximum(v, 0), k], UNKNOWN), end)[start] for k in range(len(self.model.languages))], axis=1))
        self.sums = np.concatenate(parts)
        out = []
        for n in numbers:
            if not len(n):
                out.append(("und", 0.0))
                continue
            total = self.sums[n].sum(axis=0)
            best = int(total.argmax())
            out.append((self.model.languages[best], round(float(1 / np.exp(total - total[best]).sum()), 6)))
        return out


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs``, lang_pred and score, for every row. Columns to keep that are named like these give way to them."""
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    seen = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = [f for f in seen.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary's size times the number of languages

    def make():
        scorer = Scorer(sent.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            done = scorer.score(batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.float64())], [*(f.name for f in fields), "lang_pred", "score"])

        return work

    return map_texts(seen, make, schema)
