import random
import re

from tracegraph.llm import linededup as L

from .conftest import SCHEMA


def brute(rows):
    """(doc_id, place) of lines that an earlier line matches."""
    lines = []
    for doc_id, text in rows:
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            words = {w for w in line.split(" ") if w}
            if words:
                lines.append((-(1 << 63) if doc_id is None else doc_id, at, words))
    lines.sort(key=lambda x: x[:2])
    return {(d, a) for i, (d, a, w) in enumerate(lines) if any((e, b) < (d, a) and 10 * len(w & v) >= 8 * len(w | v) for e, b, v in lines[:i])}


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def test_against_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 20 + ["of"] * 10
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))] for _ in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            words = list(rng.choice(base))
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines)))
    got = {tuple(r) for r in L.removed_lines(docs_of(spark, rows)).collect()}
    assert got == brute(rows) and 20 < len(got)


def test_hot_lines_are_cut_to_their_first(spark, monkeypatch):
    monkeypatch.setattr(L, "LEAST", 3)
    rows = [(i, f"a hot line of every text\nown{i} word{i} x{i}\na hot line of every text now{i}") for i in range(40)]
    assert {tuple(r) for r in L.removed_lines(docs_of(spark, rows)).collect()} == brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    unique = list(dict.fromkeys(rows))
    want = brute(unique)
    report = {r.doc_id: r for r in L.line_report(odd_docs).collect()}
    assert len(report) == len({d for d, _ in rows})
    assert {(-(1 << 63) if d is None else d, int(a)) for d, r in report.items() for a in r.removed.split(",") if a} == want
    assert report[1].n_lines == 0 and report[0].n_lines == 1 and report[8].removed == "0"
    assert L.line_report(no_docs).count() == 0
    clean = L.remove_lines(odd_docs)
    assert clean.columns == odd_docs.columns and clean.count() == len(rows)
    assert {r.doc_id: r.text for r in clean.collect()}[8] == ""


def test_columns_of_clashing_names_are_carried(spark):
    rows = [(1, "a b c d e f\nown line of one", 7, 8), (2, "a b c d e f\nand another of two", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__doc` int, at int").selectExpr("*", "9 as `x.y`")
    out = {r.doc_id: r for r in L.remove_lines(df).collect()}
    assert out[2].text == "and another of two" and out[1].text == rows[0][1]
    assert L.remove_lines(df).columns == df.columns and all(tuple(r)[2:] == (7, 8, 9) for r in out.values())


def test_matches_that_share_their_first_tokens(spark):
    """Lines whose rarest tokens are the same, in runs with a difference at each place."""
    base = [f"r{i}" for i in range(30)]
    rows = [(0, " ".join(base))]
    for i in range(30):
        for k in (1, 2, 3, 4):
            words = list(base)
            words[i : i + k] = [f"n{i}x{k}x{j}" for j in range(len(words[i : i + k]))]
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, " ".join(base[: 24 + i])) for i in range(6)]
    assert {tuple(r) for r in L.removed_lines(docs_of(spark, rows)).collect()} == brute(rows)


def test_copies_stay_out_of_the_joins(spark, monkeypatch):
    """Of lines that are there several times, too few to be hot, only the first is tokenised; no first line is lost to a collision."""
    base = [" ".join(f"b{i}w{j}" for j in range(12)) for i in range(20)]
    rows = [(i, "\n".join([base[i % 20], f"own{i} line{i} of{i}", base[(i + 7) % 20] + f" more{i}"])) for i in range(60)]
    seen, likely = [], L._likely
    monkeypatch.setattr(L, "_likely", lambda lines, tokens: seen.append(lines.select("doc", "at", "line").collect()) or likely(lines, tokens))
    monkeypatch.setattr(L.bitmap, "LEAST", 64)
    monkeypatch.setattr(L.bitmap, "MOST", 1 << 20)
    assert {tuple(r) for r in L.removed_lines(docs_of(spark, rows)).collect()} == brute(rows)
    first = {}
    for d, text in rows:
        for a, line in enumerate(text.split("\n")):
            first.setdefault(line, (d, a))
    went = {(r.doc, r.at) for r in seen[0]}
    assert set(first.values()) <= went and len(went) < len(first) + 20
    monkeypatch.setattr(L.bitmap, "MOST", 64)  # full bitmaps let copies through
    assert {tuple(r) for r in L.removed_lines(docs_of(spark, rows)).collect()} == brute(rows)
    assert set(first.values()) <= {(r.doc, r.at) for r in seen[1]}


def test_report_counts_lines_without_reading_texts_again(spark, tmp_path):
    """Only the second join's two sides read texts in the report's plan, and the counts hold for blank lines, repeated and null ids and long lines."""
    long = [f"v{i}" for i in range(7_000)]
    texts = ["\n\n", "\na b c d e f\n", None, " ", "a b c d e f\n\n", "", " ".join(long) + "\nx", "y\n" + " ".join(long[:6_000])]
    rows = list(enumerate(texts)) + [(4, "a b c d e g\nq"), (4, None), (None, "\nq"), (None, "z")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/docs")
    report = L.line_report(spark.read.parquet(f"{tmp_path}/docs"))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ReadSchema: struct<[^>]*\btext:", plan)) == 2
    got = {r.doc_id: r for r in report.collect()}
    want = {}
    for d, text in rows:
        want[d] = want.get(d, 0) + (0 if text is None else text.count("\n") + 1)
    assert {d: r.n_lines for d, r in got.items()} == want
    assert {(-(1 << 63) if d is None else d, int(a)) for d, r in got.items() for a in r.removed.split(",") if a} == brute(rows)
