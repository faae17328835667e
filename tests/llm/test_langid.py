import itertools
import math

import pytest
from pyspark.sql import functions as F

from tracegraph.llm import langid as L
from tracegraph.llm.common import fold_of, table
from tracegraph.llm.vocabulary import SPACE, default_model

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(table(spark, DATA, "documents"))


def test_held_out_accuracy(spark, model):
    docs = table(spark, DATA, "documents")
    out = L.predict(docs, model, ["doc_id", "lang"]).where(fold_of(F.col("doc_id")) == 0)
    n = out.count()
    assert n > 150 and out.where("lang = lang_pred").count() / n > 0.98


def test_word_sums_equal_all_segmentations(model):
    pieces = L._pieces(default_model())[0]
    for word in ("then", "ñandú", "le", "a"):
        text = SPACE + word
        for k in range(len(model.languages)):
            total = 0.0
            for cuts in itertools.product((0, 1), repeat=len(text) - 1):
                parts, at = [], 0
                for i, c in enumerate([*cuts, 1], 1):
                    if c:
                        parts.append(text[at:i])
                        at = i
                if all(p in pieces or len(p) == 1 for p in parts):
                    total += math.exp(sum(model.log[pieces[p], k] if p in pieces else L.UNKNOWN for p in parts))
            s = L.Scorer(model)
            s.score([word])
            assert s.sums[0, k] == pytest.approx(math.log(total), abs=1e-6)


def test_one_round_of_fitting_equals_enumeration():
    """Expected counts over all segmentations, of each word as often as it occurs."""
    numbers, base = L._pieces(default_model())
    counts = {"xx": {"the": 5, "a": 2, "then": 1}, "yy": {"an": 3}}
    got = L.learn(counts, default_model(), rounds=1, prior=50.0)
    for k, name in enumerate(got.languages):
        expected = [0.0] * len(numbers)
        for word, n in counts[name].items():
            text, found = SPACE + word, []
            for cuts in itertools.product((0, 1), repeat=len(text) - 1):
                parts, at = [], 0
                for i, c in enumerate([*cuts, 1], 1):
                    if c:
                        parts.append(text[at:i])
                        at = i
                if all(p in numbers for p in parts):
                    found.append((math.prod(base[numbers[p]] for p in parts), parts))
            total = sum(p for p, _ in found)
            for p, parts in found:
                for x in parts:
                    expected[numbers[x]] += n * p / total
        want = [(e + 50.0 * b) / (sum(expected) + 50.0) for e, b in zip(expected, base, strict=True)]
        assert max(abs(math.exp(g) / w - 1) for g, w in zip(got.log[:, k], want, strict=True) if w > 0) < 1e-6


def test_long_words_and_null_ids(spark, model):
    df = spark.createDataFrame([(None, "the and of " * 30), (1, "x" * 5000)], "doc_id long, text string")
    rows = L.predict(df, model, ["doc_id"]).collect()
    assert all(r.lang_pred in model.languages for r in rows)
    assert sum(map(len, L.words_of("é" * 2500))) == 2500 and len(L.words_of("é" * 2500)) == 3


def test_odd_rows(spark, model, odd_docs, no_docs):
    rows = L.predict(odd_docs, model, ["doc_id"]).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert by[0] == by[1] == by[2] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in by.values())
    assert L.predict(no_docs, model, ["doc_id"]).count() == 0
    none = L.fit(no_docs)
    assert {r.lang_pred for r in L.predict(odd_docs, none, ["doc_id"]).collect()} == {"und"}
