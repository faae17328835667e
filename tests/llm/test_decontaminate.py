import random
import re

from tracegraph.llm import decontaminate as D

from .conftest import SCHEMA


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for item_id, t in items:
        v = words(t)
        m = min(n, len(v))
        windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
        for i in range(len(w) - m + 1) if m else ():
            if tuple(w[i : i + m]) in windows:
                hit.update(range(i, i + m))
                found.add(item_id if item_id is None else str(item_id))
    return len(w), len(hit), sorted(found, key=lambda x: (x is not None, x or ""))


def tables(spark, docs, items):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string")


def got(found):
    return {r.doc_id: (r.n_words, sum(x.b - x.a for x in r.hits), r["items"]) for r in found.collect()}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["the", "of", "A", "b", "Cé", "d1", "99", "e"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 9, 10, 11, 30])))) for i in range(25)] + [(9, "again; the same"), (100, None), (101, "..."), (None, "the of"), (None, "99 99 e")]
    docs = []
    for i in range(120):
        parts = [rng.choice(vocabulary + [", ", ".\n"]) for _ in range(rng.randrange(40))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(items[:25])[1].upper())
        docs.append((i, " ".join(parts)))
    d, b = tables(spark, docs, items)
    want = {i: brute(t, items) for i, t in docs}
    assert got(D.find_overlaps(d, b, ["doc_id"])) == want
    assert any(None in w[2] for w in want.values())
    monkeypatch.setattr(D, "SLAB", 7)
    assert all((x[0], sum(b - a for a, b in x[1]), sorted(x[2], key=lambda i: (i is not None, i or ""))) == want[i] for block in [D.Block([(j if j is None else str(j), t) for j, t in items if t], 10)] for i, t in docs for x in [block.search(t)])
    # many small blocks of the benchmark give the same
    assert got(D.find_overlaps(d, b, ["doc_id"], block_chars=150)) == want


def test_odd_rows(spark, odd_docs, no_docs):
    _, b = tables(spark, [], [(1, "word " * 12), (2, "")])
    out = D.find_overlaps(odd_docs, b, ["doc_id", "score"]).collect()
    assert len(out) == odd_docs.count() and {r.score for r in out} == {1}
    by = {r.doc_id: r for r in out}
    assert by[1].n_words == 0 and by[10].n_words == 9000 and [tuple(x) for x in by[10].hits] == [(0, 9000)] and by[10]["items"] == ["1"]
    assert D.find_overlaps(no_docs, b, ["doc_id"]).count() == 0
    empty = D.find_overlaps(odd_docs, b.where("false"), ["doc_id"]).collect()
    assert len(empty) == len(out) and all(not r.hits for r in empty) and {r.doc_id: r.n_words for r in empty}[10] == 9000
