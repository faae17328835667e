import numpy as np
from pyspark.sql import functions as F

from tracegraph.llm import quality as Q
from tracegraph.llm.common import fold_of, table

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = Q.fit(docs, labels)
    out = Q.score(docs, model, ["doc_id"]).join(labels, "doc_id").where(fold_of(F.col("doc_id")) == 0)
    rows = [(r.quality, int(r["__score"] >= Q.THRESHOLD)) for r in out.collect()]
    assert len(rows) > 50 and sum(a == b for a, b in rows) / len(rows) > 0.95
    assert sum(a == b for a, b in rows if a == 1) / sum(a == 1 for a, _ in rows) > 0.97


def test_scores_equal_densities():
    rng = np.random.default_rng(1)
    x = [rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (100, 3))]
    m = Q.model_of([len(a) for a in x], [a.sum(0) for a in x], [a.T @ a for a in x])
    n, both = 300, sum(len(a) * np.cov(a.T, bias=True) for a in x) / 300
    log = []
    for a in x:
        c = (1 - Q.POOLED) * np.cov(a.T, bias=True) + Q.POOLED * both
        c = (1 - Q.IDENTITY) * c + Q.IDENTITY * (np.trace(c) / 3 + 1e-9) * np.eye(3)
        z = np.ones(3) - a.mean(0)
        log.append(np.log(len(a) / n) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * z @ np.linalg.inv(c) @ z)
    assert np.allclose(m.score(np.ones((1, 3))), 1 / (1 + np.exp(log[0] - log[1])))


def plain_statistics(text):
    """The statistics by plain rules over characters and words."""
    raw = (text or "").encode()
    space = b" \t\n\x0b\x0c\r"
    solid = [c for c in raw if bytes([c]) not in [bytes([x]) for x in space]]
    words = raw.split()
    runs, word = [], b""
    for c in [*raw, 32]:
        if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128:
            word += bytes([c])
        elif word:
            runs, word = [*runs, word], b""
    lines = [x for x in raw.split(b"\n") if x.strip()]

    def share(name, x, n, mixed):
        p = Q.STATISTICS[name]
        return np.log((x + mixed * p) / (n - x + mixed * (1 - p)))

    top = max([words.count(w) for w in set(words)], default=0)
    ends = sum(not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in (b".", b",")) for w in words)
    return [
        np.log((len(solid) + 25 * 5.5) / (len(words) + 25)),
        share("upper", sum(65 <= c <= 90 for c in solid), len(solid), 120),
        share("digits", sum(48 <= c <= 57 for c in solid), len(solid), 120),
        share("stops", sum(c in b".," for c in solid), len(solid), 120),
        share("other", sum(c < 128 and not chr(c).isalnum() and c not in b".," for c in solid), len(solid), 120),
        share("symbol words", ends, len(words), 25),
        share("repeated words", len(words) - len(set(words)), len(words), 25),
        share("top word", top, len(words), 25),
        share("runs", sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words), 25),
        share("repeated lines", len(lines) - len(set(lines)), len(lines), 6),
        share("upper words", sum(w.isupper() for w in runs), len(runs), 25),
        share("short words", sum(len(w) < 4 for w in runs), len(runs), 25),
    ]


def test_statistics_against_plain_rules():
    from .conftest import ODD

    for text in [*ODD[:9], *ODD[11:], "THE End. the end, the the\nthe end\nthe end\n$$$ 12% x", "É é !!\n\n!!"]:
        assert np.allclose(Q.statistics(text), plain_statistics(text)), text


def test_fit_equals_moments_of_the_labelled_rows(spark):
    import zlib

    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(quality[r.doc_id], Q.statistics(r.text)) for r in docs.collect() if quality.get(r.doc_id) in (0, 1) and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    x = [np.array([s for y, s in rows if y == k]) for k in (0, 1)]
    want, got = Q.model_of([len(a) for a in x], [a.sum(0) for a in x], [a.T @ a for a in x]), Q.fit(docs, labels)
    assert got.prior == want.prior and np.allclose(got.mean, want.mean) and np.allclose(got.inverse, want.inverse) and np.allclose(got.constant, want.constant)


def test_no_task_of_the_fit_runs_two_python_functions(spark, monkeypatch):
    """Each function of a task holds a worker, and workers stay; a broadcast join puts what is on both its sides into one task."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans = []

    def seen(method):
        def run(self, *args, **kwargs):
            plans.append(self._jdf.queryExecution().executedPlan().toString())
            return method(self, *args, **kwargs)

        return run

    for name in ("collect", "checkpoint"):
        monkeypatch.setattr(DataFrame, name, seen(getattr(DataFrame, name)))
    sf = "/root/testdata/sf0.001"
    Q.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert max(p.count("MapInArrow") for p in plans) == 1 and sum(p.count("MapInArrow") for p in plans) == 2


def test_labels_outside_fold_0_only(spark):
    docs = table(spark, DATA, "documents")
    labels = table(spark, DATA, "labels")
    flipped = labels.withColumn("quality", F.when(fold_of(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.fit(docs, labels), Q.fit(docs, flipped)
    assert np.allclose(a.constant, b.constant) and np.allclose(a.mean[0], b.mean[0])


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)] + [(3, None), (4, 7), (None, 1), (5, 1), (5, 1)], "doc_id long, quality int")
    for model in (Q.fit(odd_docs, labels), Q.fit(no_docs, labels), Q.fit(odd_docs, labels.where("quality = 1"))):
        out = Q.score(odd_docs, model, ["doc_id", "score"]).collect()
        assert len(out) == odd_docs.count() and all(0 <= r["__score"] <= 1 for r in out) and {r.score for r in out} == {1}
        assert Q.score(no_docs, model, ["doc_id"]).count() == 0
        clash = Q.score(odd_docs.withColumn("__score", F.lit("x")), model, ["doc_id", "__score"])
        assert dict(clash.dtypes)["__score"] == "double" and clash.count() == len(out)
    assert Q.fit(no_docs, labels).prior == 0.5 and Q.fit(odd_docs, labels.where("quality = 1")).prior == 1.0
