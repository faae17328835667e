import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tracegraph.llm import bitmap, exact_dedup, simhash
from tracegraph.llm.components import connected_components, merged

from .conftest import SCHEMA


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("least", [1000, 20])
def test_exact_against_groups(spark, monkeypatch, least):
    monkeypatch.setattr(exact_dedup, "LEAST", least)
    rng = random.Random(2)
    pool = ["", "a", "b" * 300 + "x", "b" * 300 + "y", "c", None, "é", "é"]
    rows = [(i, rng.choice([*pool, f"own {i}"])) for i in range(300)]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs_of(spark, rows)).collect()}
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))


def kept(frame):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in frame.collect())


def one_of_each(rows):
    """Brute force: of equal texts the largest doc_id, null least; rows alike count once."""
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    return sorted((i == -1, max(i, 0), t) for t, i in best.items())


@pytest.mark.parametrize("bits", [None, 64])
def test_a_full_bitmap_changes_nothing(spark, monkeypatch, bits):
    rows = [(i, f"text {i % 40}") for i in range(100)] + [(7, "another"), (None, "text 3"), (None, "alone"), (None, "alone"), (7, None), (8, "")]
    want = {tuple(r) for r in exact_dedup.exact_dedup(docs_of(spark, rows)).collect()}
    if bits:
        monkeypatch.setattr(bitmap, "LEAST", bits)
        monkeypatch.setattr(bitmap, "MOST", bits)
    assert {tuple(r) for r in exact_dedup.exact_dedup(docs_of(spark, rows)).collect()} == want
    assert kept(exact_dedup.keep_one(docs_of(spark, rows))) == one_of_each(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "a"), (1, "unique b"), (2, "a")],
        [(None, "a"), (2, "a")],
        [(2, None), (2, "")],
        [(5, "a"), (7, "a"), (5, "b"), (7, "b"), (6, "b")],
        [(None, "a"), (None, "a"), (None, "b")],
        [(3, "a"), (3, "a"), (4, "b"), (4, "b"), (2, "b")],
    ],
)
def test_exact_decides_by_id_and_text(spark, rows):
    assert kept(exact_dedup.keep_one(docs_of(spark, rows))) == one_of_each(rows)


def test_exact_odd_rows(spark, odd_docs, no_docs):
    out = exact_dedup.exact_dedup(odd_docs, {"text_sha256": F.sha2(F.coalesce("text", F.lit("")), 256)}).collect()
    assert len(out) == odd_docs.count()
    by = {r.doc_id: r for r in out}
    assert by[0].keep_id == 1 and by[0].group_size == 2 and not by[0].kept and by[7].group_size == 3
    kept = exact_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and len({r.text or "" for r in odd_docs.collect()}) == kept.count()
    assert exact_dedup.exact_dedup(no_docs).count() == 0 and exact_dedup.keep_one(no_docs).count() == 0


def test_one_of_rows_that_repeat_stays(spark):
    rows = [(1, "x"), (5, "x"), (5, "x"), (6, "y"), (6, "y")]
    assert sorted((r.doc_id, r.text) for r in exact_dedup.keep_one(docs_of(spark, rows)).collect()) == [(5, "x"), (6, "y")]


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "One", "a b", "a b c", "A b C d\te\n\nf", "x " * 700, "é É ß\x1cnot\x85cut", " ".join(map(str, range(1000)))])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == fingerprint(text)


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    want = components(linked, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_against_all_pairs(spark):
    rng = random.Random(9)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(6):
            fps.add(f)
            for _ in range(rng.randrange(4)):
                f ^= 1 << rng.randrange(64)
    signed = [(f - (1 << 64) if f >> 63 else f) for f in sorted(fps)]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    want = components(range(len(signed)), [(i, j) for i in range(len(signed)) for j in range(i) if ((signed[i] ^ signed[j]) & (1 << 64) - 1).bit_count() <= 2])
    got = {r.node: r.root for r in connected_components(simhash.links(df)).collect()}
    assert {i: got.get(i, i) for i in range(len(signed))} == want


def test_near_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].component_id == by[1].component_id == by[3].component_id == 0 and by[0].fingerprint == "0" * 16
    assert by[8].component_id == 7 and by[5].component_id == 4 and by[None].component_id is None
    assert all(int(r.fingerprint, 16) == fingerprint(t.text) for r in rows for t in odd_docs.where(F.col("doc_id") == r.doc_id).limit(1).collect())
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups(rows):
    """Brute force: of each component of Jaccard 0.8 or more, the least doc_id, null last, then one text."""
    sets = [shingles(t) for _, t in rows]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root, groups = components(range(len(sets)), near), {}
    for i, r in root.items():
        groups.setdefault(r, []).append(rows[i])
    return groups.values()


def edited(rng, chains=12, length=8):
    texts = []
    for _ in range(chains):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 30, 80, 300]))]
        for _ in range(length):
            texts.append(" ".join(words))
            words = words[:]
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(5000)}"
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("crowd", [100, 12, 0])
def test_near_copies_against_all_pairs(spark, monkeypatch, crowd):
    """Edited copies of one another, in chains; without and with the join of crowded bands."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    texts = edited(random.Random(6))
    groups = near_groups(list(enumerate(texts)))
    assert sorted(r.doc_id for r in simhash.keep_one(docs_of(spark, list(enumerate(texts)))).collect()) == sorted(min(i for i, _ in g) for g in groups)
    alike = [(a, b) for g in groups for a in g for b in g if a[0] < b[0] and shingles(a[1]) & shingles(b[1])]
    assert any((simhash.fingerprint(a[1]) ^ simhash.fingerprint(b[1])).bit_count() > 2 for a, b in alike)


def test_near_copies_with_repeated_and_null_ids(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, 1, 2, 3, rng.randrange(40)]), t) for t in edited(rng, 10, 6)]
    rows += rng.sample(rows, 12) + [(3, "words of no other row at all"), (None, None), (4, " "), (4, "")]
    got = kept(simhash.keep_one(docs_of(spark, rows)))
    groups = near_groups(rows)
    least = [min((i is None, i or 0) for i, _ in g) for g in groups]
    assert sorted(x[:2] for x in got) == sorted(least)
    held = {x for g in groups for x in [frozenset((i is None, i or 0, t or "") for i, t in g)]}
    assert all(sum(x in g for x in got) == 1 for g in held)


def test_join_of_crowded_bands_against_all_pairs(spark):
    """A passage that all texts share, a large group of near copies, and texts of other lengths."""
    rng = random.Random(8)
    sets = []
    core = [rng.getrandbits(62) for _ in range(60)]
    for i in range(60):
        sets.append(core[: rng.choice([30, 55, 60])] + [rng.getrandbits(62) for _ in range(rng.choice([0, 2, 8, 14, 40]))])
    for i in range(40):
        sets.append(sets[-1][: -rng.randrange(1, 5)] + [rng.getrandbits(62)])
    sets = [sorted(set(s)) for s in sets] + [[], []]
    df = spark.createDataFrame([(i, s, i if i % 7 else 0) for i, s in enumerate(sets)], "node long, shingles array<long>, group long")
    group = [i if i % 7 else 0 for i in range(len(sets))]
    want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if sets[i] and group[i] != group[j] and 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))}
    assert {frozenset((r.a, r.b)) for r in simhash.joined(df).collect()} == want and len(want) > 100


def test_recall_of_bands():
    """Sets of Jaccard 0.8 share a min-hash as often."""
    rng = random.Random(5)
    n = met = 0
    for _ in range(60):
        a = [rng.getrandbits(64) for _ in range(200)]
        b = a[:178] + [rng.getrandbits(64) for _ in range(22)]
        x, y = (simhash.bands(simhash.np.array(s, simhash.np.uint64)) for s in (a, b))
        n, met = n + len(x), met + int((x == y).sum())
    assert abs(met / n - 0.8**4) < 0.06


def test_a_cluster_needs_a_shared_folder():
    from tracegraph.llm import common

    class Nothing:
        master = "yarn"

        def get(self, *_):
            return None

        def getCheckpointDir(self):
            return None

    session = type("Session", (), {"conf": Nothing(), "sparkContext": Nothing()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)


def test_labels_take_up_links(spark):
    """Components by parts are those of all links at once."""
    rng = random.Random(12)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    frames = [spark.createDataFrame([e for e in part if e[0] != e[1]], "a long, b long") for part in (edges[:20], edges[20:40], edges[40:])]
    labels = connected_components(frames[0])
    for more in frames[1:]:
        labels = merged(labels, more)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert {r.node: r.root for r in labels.collect()} == components(linked, [e for e in edges if e[0] != e[1]])
    assert labels.count() == len(linked)
