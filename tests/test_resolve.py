import random

from pyspark.sql import functions as F

from tracegraph import schema
from tracegraph.operators import assemble, resolve, traverse
from tracegraph.plans import storage


def definitions(rng, n=120):
    return [(i, f"f{rng.randrange(25)}", rng.choice(["function", "global"]), rng.choice(["a.c", "b.c", "c.h", "d/e.hh"]), s := rng.randrange(60), s + rng.randrange(9), rng.random() < 0.4, None) for i in range(n)]


def named(spark, rows):
    return resolve.qualify(spark.createDataFrame(rows, schema.DEFINITIONS))


def test_qualify(spark):
    rows = [(0, "f", "function", "a.c", 1, 2, False, None), (1, "g", "function", "a.c", 5, 6, True, None), (2, "h", "function", "a.c", 8, 9, False, None), (3, "h", "function", "b.c", 1, 2, False, None), (4, "h", "function", "b.c", 4, 6, False, None), (5, "f", "macro", "z.h", 1, 1, False, None)]
    assert [r.qname for r in named(spark, rows).orderBy("seq").collect()] == ["f", "a.c::g", "a.c::h", "b.c::h", "b.c::h:4", "f"]


def test_sources_by_ladder(spark):
    rng = random.Random(5)
    rows = [r for r in definitions(rng) if r[2] == "function"]
    d = named(spark, rows)
    q = {r.seq: r.qname for r in d.collect()}
    sites = [(i, "call", "x", f"f{rng.randrange(28)}", rng.choice(["a.c", "b.c", "c.h", "z.c"]), rng.randrange(70), "") for i in range(800)]
    want = {}
    for i, _, _, scope, file, line, _ in sites:
        cands = [r for r in rows if r[1] == scope]
        for tier in ([r for r in cands if r[3] == file and r[4] <= line <= r[5]], [r for r in cands if r[3] == file], cands):
            if len(tier) == 1:
                want[i] = q[tier[0][0]]
                break
    got = resolve.attribute_sources(spark.createDataFrame(sites, schema.OCCURRENCES), d)
    assert {r.seq: r.src_qname for r in got.collect()} == want


def test_targets_by_visibility(spark):
    rng = random.Random(6)
    rows = definitions(rng)
    d = named(spark, rows)
    q = {r.seq: r.qname for r in d.collect()}
    sites = [(i, "call", f"f{rng.randrange(28)}", "s", rng.choice(["a.c", "b.c", "z.c"]), 1, "") for i in range(300)]
    want = set()
    for i, _, name, _, file, _, _ in sites:
        seen = [r for r in rows if r[1] == name and (not r[6] or r[3] == file or r[3].endswith((".h", ".hh")))]
        want |= {(i, q[r[0]], len(seen)) for r in seen}
    got = resolve.choose_targets(spark.createDataFrame(sites, schema.OCCURRENCES), d)
    assert {(r.seq, r.dst_qname, r.candidates) for r in got.collect()} == want


def test_enclosing_takes_the_first_defined(spark):
    rng = random.Random(7)
    rows = [(i, f"f{i}", "function", rng.choice("ab"), s := rng.randrange(3000), s + rng.randrange(1200), False, None) for i in range(60)]
    d = named(spark, rows)
    sites = [(i, rng.choice("abz"), rng.randrange(4200)) for i in range(500)]
    want = {}
    for i, file, line in sites:
        around = [r for r in rows if r[3] == file and r[4] <= line <= r[5]]
        if around:
            want[i] = min(around)[1]
    got = resolve.enclosing(spark.createDataFrame(sites, "seq long, file string, line int"), d)
    assert {r.seq: r.src_name for r in got.collect()} == want


def test_first_wins_whatever_the_partitions(spark):
    rows = [("a", "f", "b", "f", "calls", "cscope", None, None, r, f"m{r}") for r in range(20)] + [("a", "f", "b", "f", "calls", "cscope", "x.c", 1, 3, "x")]
    df = spark.createDataFrame(rows, "src_qname string, src_kind string, dst_qname string, dst_kind string, kind string, origin string, file string, line int, rank int, meta string")
    for n in (1, 3, 7):
        assert {(r.file, r.meta) for r in assemble.first_wins(df.repartition(n)).collect()} == {(None, "m0"), ("x.c", "x")}


def test_truncation_is_told(spark):
    df = spark.range(50).withColumn("g", F.lit("x"))
    cut = assemble.truncated(df, [F.col("id")], 40, ["g"]).collect()
    assert len(cut) == 40 and {(r.total, r.truncated) for r in cut} == {(50, True)}
    assert {(r.total, r.truncated) for r in assemble.truncated(df, [F.col("id")], 0, ["g"]).collect()} == {(50, False)}
    assert {(r.total, r.truncated) for r in assemble.truncated(df, [F.col("id")], 50, ["g"]).collect()} == {(50, False)}
    assert assemble.truncated(df, [F.col("id")], 7).count() == 7


def test_reach_equals_breadth_first(spark):
    rng = random.Random(8)
    steps = {(rng.randrange(60), rng.randrange(60)) for _ in range(110)}
    df = spark.createDataFrame(sorted(steps), "a long, b long")
    for seed in (0, 7, 20):
        want, frontier = {}, {seed}
        for level in (1, 2, 3, 4):
            frontier = {b for a, b in steps if a in frontier} - want.keys()
            want |= dict.fromkeys(frontier, level)
        got = traverse.reach(spark.createDataFrame([(seed,)], "id long"), df, 4, storage.checkpoint)
        assert {r.id: r.depth for r in got.collect()} == want
    assert traverse.clamp(0) == 1 and traverse.clamp(99) == 10
