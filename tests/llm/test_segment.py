import itertools
import math
from collections import Counter

import numpy as np
import pytest

from tracegraph.llm import segment as S
from tracegraph.llm.vocabulary import vocabulary

from .conftest import ODD

MODEL = S.default_model()


@pytest.fixture(scope="module")
def lattices():
    return S.Lattices(MODEL)


def all_segmentations(word):
    """Every segmentation of one word and its probability."""
    v, text, out = vocabulary(MODEL), "▁" + word, {}
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(text[at:i])
                at = i
        if all(p in v.normal for p in parts):
            ids = tuple(v.normal[p] for p in parts)
            out[ids] = math.exp(sum(v.log[i] for i in ids))
    total = sum(out.values())
    return {k: p / total for k, p in out.items()}


@pytest.mark.parametrize(("text", "words"), [("a b", ["a", "b"]), ("a  b", ["a", " b"]), (" a", [" a"]), ("a ", ["a", ""]), ("a   ", ["a", "  "]), ("  ", ["  "]), ("", [])])
def test_cuts(text, words):
    assert S.words_of(text) == words


def test_pieces_of_several_spaces_are_drawn(lattices):
    """A run of spaces and the word after it are one lattice, whose segmentations have their distribution."""
    v, text = vocabulary(MODEL), "▁▁▁b"
    p = {}
    for cuts in itertools.product((0, 1), repeat=3):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(text[at:i])
                at = i
        if all(x in v.normal for x in parts):
            ids = tuple(v.normal[x] for x in parts)
            p[ids] = math.exp(sum(v.log[i] for i in ids))
    p = {k: x / sum(p.values()) for k, x in p.items()}
    assert any(v.normal["▁▁"] in k for k in p) or any(v.normal["▁▁▁"] in k for k in p)
    n = 3000
    drawn = S.sample(lattices, list(range(n)), ["  b"] * n, 1, 5)
    found = Counter(tuple(S.ids_of(lattices, d[0][0]).tolist()) for d in drawn)
    assert set(found) <= set(p)
    for k, q in p.items():
        assert abs(found[k] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 2 / n


def test_first_and_second_draws_have_their_distribution(lattices):
    word = "then"
    p = all_segmentations(word)
    n = 4000
    drawn = S.sample(lattices, list(range(n)), [word] * n, 2, 5)
    first, second = Counter(), Counter()
    for (a, _), (b, _) in drawn:
        ia, ib = tuple(S.ids_of(lattices, a).tolist()), tuple(S.ids_of(lattices, b).tolist())
        assert ia != ib and a.score >= b.score
        assert math.exp(a.log) == pytest.approx(p[ia], rel=1e-3)
        first[ia] += 1
        second[ib] += 1
    for k, q in p.items():
        want2 = sum(q * r / (1 - r) for j, r in p.items() if j != k)  # without replacement
        for got, want in ((first[k], q), (second[k], want2)):
            assert abs(got / n - want) < 5 * math.sqrt(want * (1 - want) / n) + 2 / n


def test_inclusion_weights_are_unbiased(lattices):
    """The estimate of 1 as the sum of p / inclusion over the drawn segmentations."""
    n = 3000
    drawn = S.sample(lattices, list(range(n)), ["these"] * n, 3, 8)
    estimate = np.array([sum(math.exp(p.log) / q for p, q in d) for d in drawn])
    assert abs(estimate.mean() - 1) < 5 * estimate.std() / math.sqrt(n)


def test_scores_are_gumbel(lattices):
    top = np.array([d[0][0].score for d in S.sample(lattices, list(range(4000)), ["of the people"] * 4000, 1, 3)])
    assert abs(top.mean() - 0.5772) < 0.1 and abs(top.var() - math.pi**2 / 6) < 0.2


def test_distinct_round_trips(lattices):
    texts = [t or "" for t in ODD] + ["ab cd" * 3, "日 ▁ x", "a  b   c", "   ", " x ", "\n  \n    if x:  # two  ", " ▁ "]
    for key, (text, drawn) in enumerate(zip(texts, S.sample(lattices, list(range(len(texts))), texts, 4, 1), strict=True)):
        ids = [S.ids_of(lattices, p).tobytes() for p, _ in drawn]
        assert len(set(ids)) == len(ids) and all(S.decode_ids(x, MODEL) == text for x in ids), key
        assert [p.score for p, _ in drawn] == sorted((p.score for p, _ in drawn), reverse=True)


def test_all_of_a_small_lattice(lattices):
    (drawn,) = S.sample(lattices, [1], ["a"], 9, 1)
    assert len(drawn) == len(all_segmentations("a")) and all(q == 1.0 for _, q in drawn)
    assert sum(math.exp(p.log) for p, _ in drawn) == pytest.approx(1, abs=1e-5)


def test_seeded_by_key_alone(spark, odd_docs, no_docs):
    one = {(r.doc_id, r.sample, r.ids, r.score) for r in S.encode(odd_docs, ["doc_id"]).collect()}
    two = {(r.doc_id, r.sample, r.ids, r.score) for r in S.encode(odd_docs.repartition(7), ["doc_id"]).collect()}
    assert one == two
    back = S.decode(S.encode(odd_docs, ["doc_id"]), ["doc_id", "sample"]).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert all(r.text == texts[r.doc_id] for r in back) and {r.doc_id for r in back} == set(texts)
    assert all(r.exact and r.score < 50 for r in S.encode(odd_docs, ["score", "doc_id"], verify=True).collect())
    assert S.encode(no_docs, ["doc_id"]).count() == 0


def test_small_caches_change_nothing(monkeypatch):
    texts = [f"word{i} and some more words {i * 7}" for i in range(50)]
    take = lambda: [[(S.ids_of(ls, p).tolist(), p.score) for p, _ in d] for k in range(0, 50, 5) for d in S.sample(ls, list(range(k, k + 5)), texts[k : k + 5], 2, 4)]
    ls = S.Lattices(MODEL)
    want = take()
    monkeypatch.setattr(S, "KEPT_EDGES", 10)
    ls = S.Lattices(MODEL)
    assert take() == want
