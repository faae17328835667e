"""The registered queries: one for each operator, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, langid, linededup, pii, quality, secretscan, segment, simhash, tokenfiles
from .common import fold_of, shared_dir, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), {"text_sha256": F.sha2(text, 256)})


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x.b - x.a)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs), ["doc_id"])
    return found.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), folder)
    return tokenfiles.read_tokens(spark, folder)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.a.cast("string"), x.b.cast("string"))), ",")

    base = F.filter("findings", lambda x: x.kind != "literal")
    counts = [F.expr(f"cast(size(filter(findings, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a key of one's own goes into the session's settings
    return pii.replace_entities(table(spark, sf_dir, "documents"), ["doc_id"], spark.conf.get("tracegraph.surrogate.key", "key of the test tables"))


def op10_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = segment.encode(table(spark, sf_dir, "documents"), ["doc_id"], verify=True)
    return encoded.select("doc_id", "sample", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), *(F.round(c, 6).alias(c) for c in ("log_prob", "score", "inclusion")), "exact")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_exact_dedup, op3_decontaminate, op4_langid, op5_token_files, op6_simhash, op7_quality, op8_secrets, op9_pii, op10_segment)}

ORACLES = {
    "op1_line_dedup": """
        WITH line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
        tok AS (SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) AS id, list_distinct(list_filter(string_split(l, ' '), lambda x: x <> '')) AS w FROM line),
        freq AS (SELECT t, count(*) AS c FROM (SELECT unnest(w) AS t FROM tok) GROUP BY t),
        long AS (SELECT id, t, len(w) AS n, row_number() OVER (PARTITION BY id ORDER BY c, t) AS r FROM (SELECT id, w, unnest(w) AS t FROM tok) JOIN freq USING (t)),
        pre AS (SELECT id, t, n FROM long WHERE r <= n - ceil(0.8 * n - 1e-9) + 1),
        cand AS (SELECT DISTINCT a.id AS x, b.id AS y FROM pre a JOIN pre b ON a.t = b.t AND b.id < a.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
        gone AS (SELECT DISTINCT x FROM cand JOIN tok a ON a.id = x JOIN tok b ON b.id = y WHERE 9 * len(list_intersect(a.w, b.w)) >= 4 * (len(a.w) + len(b.w))),
        each AS (SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS r FROM tok JOIN gone ON x = id GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(r, '') AS removed
        FROM documents d LEFT JOIN each USING (doc_id)""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op3_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bi AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM bi),
        ks AS (SELECT DISTINCT k FROM win),
        di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
        hit AS (SELECT doc_id, di.k, i, item_id FROM di JOIN win ON win.k = di.k AND win.s = array_to_string(list_slice(w, i, i + di.k - 1), ' ')),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
               sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
