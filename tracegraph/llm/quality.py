"""Quality scores by regularised quadratic discriminant analysis over transformed document statistics.

Each class (quality 0 and 1) has a mean and a covariance of the statistics. The covariance is shrunk towards the
pooled one and towards a multiple of the identity. A score is the logistic function of the difference of the two
Mahalanobis log densities plus the log prior odds; the Cholesky factors are computed once and kept in the model.

The moments are sums over all labelled rows outside fold 0, gathered task by task: what comes to the driver has a
fixed size. Only texts that may have a label (by a bitmap of bounded size, see ``bitmap``) are read as words for them. The smoothing and the weights below were
chosen by cross-validation over folds 1 to 4; fold 0 was looked at afterwards only. Labels other than 0 and 1, null labels and null texts are not learned from; a document with several labels
counts once for each. A null or empty text is scored like an empty one. If a class has no rows, every score is the
share of class 1, or 0.5 without any labels. Rows with a null doc_id are scored and never learned from. Repeated rows give a row each and, with a
label, count once each; an empty table gives an empty result. Equal texts have equal scores. A text is read whole; a very long one takes a few times its size.
``doc_id`` is a long. A column to keep that is named ``__score`` gives way to the score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .common import checkpoint, fold_of, map_texts

#: Weight of the pooled covariance, and of the identity, in each class covariance.
POOLED, IDENTITY = 0.05, 0.005
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.intp)  # 0 space, 1 lower or non-ASCII letter, 2 upper, 3 digit, 4 full stop or comma, 5 other
_CLASS[:] = 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[44, 46]] = 4
_STRIP = bytes(c if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Of a share: what a usual text has, and how many cases of it are mixed in, so that short texts stay near the middle.
WORDS, CHARACTERS, LINES = 25, 120, 6
STATISTICS = {"word length": 5.5, "upper": 0.025, "digits": 0.002, "stops": 0.03, "other": 0.002, "symbol words": 0.01, "repeated words": 0.2, "top word": 0.08, "runs": 0.01, "repeated lines": 0.05, "upper words": 0.01, "short words": 0.35}


def _share(name: str, x: float, n: float, mixed: int) -> float:
    """Log odds of x in n."""
    p = STATISTICS[name]
    return float(np.log((x + mixed * p) / (max(n - x, 0) + mixed * (1 - p))))


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    of = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=6)
    words = raw.split()
    n, solid = len(words), float(of[1:].sum())
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = raw.translate(_STRIP).split()
    plain = sum(1 for w in words if w[-1:].isalnum() or w[-1] >= 128 or w[-1] in b".,")
    return [
        float(np.log((solid + WORDS * STATISTICS["word length"]) / (n + WORDS))),
        _share("upper", of[2], solid, CHARACTERS),
        _share("digits", of[3], solid, CHARACTERS),
        _share("stops", of[4], solid, CHARACTERS),
        _share("other", of[5], solid, CHARACTERS),
        _share("symbol words", n - plain, n, WORDS),
        _share("repeated words", n - len(counts), n, WORDS),
        _share("top word", max(counts.values(), default=0), n, WORDS),
        _share("runs", sum(map(bytes.__eq__, words, words[1:])), n, WORDS),
        _share("repeated lines", len(lines) - len(set(lines)), len(lines), LINES),
        _share("upper words", sum(map(bytes.isupper, letters)), len(letters), WORDS),
        _share("short words", sum(1 for w in letters if len(w) < 4), len(letters), WORDS),
    ]


@dataclass
class Model:
    mean: list[np.ndarray] | None
    inverse: list[np.ndarray] | None  # of the Cholesky factors
    constant: list[float]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None or not len(x):
            return np.full(len(x), self.prior)
        log = [c - 0.5 * (((x - m) @ i.T) ** 2).sum(axis=1) for m, i, c in zip(self.mean, self.inverse, self.constant, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def model_of(n: list[float], s: list[np.ndarray], ss: list[np.ndarray], pooled: float = POOLED, identity: float = IDENTITY) -> Model:
    total = sum(n)
    prior = n[1] / total if total else 0.5
    if min(n) < 2:
        return Model(None, None, [], prior)
    mean = [s[k] / n[k] for k in (0, 1)]
    cov = [ss[k] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    both = sum(n[k] * cov[k] for k in (0, 1)) / total
    inverse, constant = [], []
    for k in (0, 1):
        c = (1 - pooled) * cov[k] + pooled * both
        p = len(c)
        c = (1 - identity) * c + identity * (np.trace(c) / p + 1e-9) * np.eye(p)
        factor = np.linalg.cholesky(c)
        inverse.append(np.linalg.inv(factor))
        constant.append(float(np.log(n[k] / total) - np.log(np.diag(factor)).sum()))
    return Model(mean, inverse, constant, prior)


def fit(docs: DataFrame, labels: DataFrame, pooled: float = POOLED, identity: float = IDENTITY) -> Model:
    """Learn from ``labels`` (doc_id, quality) of documents outside fold 0."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [statistics(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    learn = fold_of(F.col("doc_id")) != 0
    marked = checkpoint(labels.where(learn & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y")))
    marks = bitmap.build(marked.select(F.xxhash64("doc_id").alias("__key")), "__key", marked.count())
    some = bitmap.maybe_in(docs.where(learn & F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("doc_id").alias("__key")), marks, "__key", "__maybe").where("__maybe")
    seen = map_texts(some.select("doc_id", "text"), lambda: work, "doc_id long, x array<double>")

    def moments(batches):
        held = {}
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float)
            y = np.array(batch.column("y").to_pylist())
            for k in set(y.tolist()):
                part = np.concatenate([np.ones((int((y == k).sum()), 1)), x[y == k]], axis=1)
                held[k] = held.get(k, 0) + part.T @ part
        for k, m in held.items():
            yield pa.RecordBatch.from_pydict({"y": pa.array([k] * m.size, pa.int32()), "i": pa.array(range(m.size), pa.int32()), "v": pa.array(m.ravel())})

    # written first: where the join is a broadcast, one task would else hold a Python worker for each of the two functions
    known = checkpoint(seen.join(marked, "doc_id").select("x", "y"))
    rows = known.mapInArrow(moments, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    p = len(STATISTICS) + 1
    m = [np.zeros(p * p), np.zeros(p * p)]
    for r in rows:
        m[r.y][r.i] = r.v
    m = [x.reshape(p, p) for x in m]
    return model_of([x[0, 0] for x in m], [x[0, 1:] for x in m], [x[1:, 1:] for x in m], pooled, identity)


def score(docs: DataFrame, model: Model, keep: list[str], least: float | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` and ``__score`` of each row; with ``least``, only rows that have it."""
    keep = [c for c in keep if c != "__score"]
    seen = docs.select(*dict.fromkeys([*keep, "text"]))
    out = [f for f in seen.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", __score double"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in batch.column("text").to_pylist()], float)
        s = np.round(model.score(x), 6)
        done = pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in out), pa.array(s)], [*(f.name for f in out), "__score"])
        return done if least is None else done.filter(pa.array(s >= least))

    return map_texts(seen, lambda: work, schema)
