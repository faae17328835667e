import re
from pathlib import Path

import corpus_pipeline as C
from tracegraph.llm import queries

from .conftest import SCHEMA


def test_stages_take_effect(spark, tmp_path):
    """The small tables, with a copy, a near copy and a leak of our own."""
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    good = "The rest of the words are plain and their order is usual, as in any text that people write for others to read. " * 4
    own = spark.createDataFrame([(9001, good, "en", "t", 1), (9002, good, "en", "t", 1), (9003, good.upper(), "en", "t", 1), (9004, f"{good} {item}", "en", "t", 1)], SCHEMA)
    names = [n for n, _ in C.STAGES]
    assert [re.sub(r"\W.*", "", n) for n in names] == ["quality", "exact", "SimHash", "benchmark", "SentencePiece"]
    frame = docs.unionByName(own)
    ids = {}
    for name, stage in C.STAGES[1:4]:
        frame = stage(spark, frame, "/root/testdata/sf0.001")
        assert frame.columns == docs.columns
        ids[name] = {r.doc_id for r in frame.collect()}
    assert 9001 not in ids["exact dedup"] and 9002 in ids["exact dedup"]
    assert 9002 in ids["SimHash near-dedup"] and 9003 not in ids["SimHash near-dedup"] and 9004 in ids["SimHash near-dedup"]
    assert 9004 not in ids["benchmark decontamination"] and 9002 in ids["benchmark decontamination"]
    out = C.STAGES[4][1](spark, frame, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in out} == ids["benchmark decontamination"]


def test_run_equals_stages_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf)
    want = sorted((r.doc_id, r.sample, bytes(r.ids)) for r in docs.collect())
    assert sorted((r.doc_id, r.sample, bytes(r.ids)) for r in C.run(spark, sf).collect()) == want and want


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.001"
    docs = odd_docs.selectExpr("*", "2 as `row`", "3 as `__score`", "4 as hits", "5 as `a.b`")
    texts = {r.text or "" for r in docs.collect()}
    for name, stage in C.STAGES[1:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns[-4:] == ["row", "__score", "hits", "a.b"], name
        rows = docs.collect()
        assert {tuple(r)[-4:] for r in rows} == {(2, 3, 4, 5)} and {r.text or "" for r in rows} <= texts
        if name == "exact dedup":
            assert len(rows) == len(texts)
    kept = C.STAGES[0][1](spark, odd_docs.selectExpr("*", "3 as `__score`"), sf)
    assert kept.columns[-1] == "__score" and kept.where("`__score` != 3").isEmpty()
    out = C.STAGES[4][1](spark, odd_docs, sf).collect()
    assert all(r.exact for r in out) and {r.doc_id for r in out} == {r.doc_id for r in odd_docs.collect()}
    for _, stage in C.STAGES:
        assert stage(spark, no_docs, sf).count() == 0


def test_run_removes_all_but_the_last_stage(spark):
    from tracegraph.llm.common import shared_dir

    C.run(spark, "/root/testdata/sf0.001")
    folders = [p for p in Path(shared_dir(spark).removeprefix("file://")).glob("corpus-pipeline-*")]
    assert folders and all([x.name for x in p.iterdir()] == [str(len(C.STAGES) - 1)] for p in folders)


def test_heaps_are_given_back_before_the_last_stage(spark, no_docs):
    def collections():
        beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep"))

    before = collections()
    assert C.STAGES[4][1](spark, no_docs, "").isEmpty() and collections() > before


def test_every_operator_is_registered():
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES}) == list(range(1, 11))
