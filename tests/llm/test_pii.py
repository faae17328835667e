import random

import pytest
import regex as re
from pyspark.sql import functions as F

from tracegraph.llm import pii

from .conftest import SCHEMA

KEY = "a key of the tests"


def replaced(spark, texts, key=KEY):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    return [r.text for r in pii.replace_entities(df, ["doc_id"], key).orderBy("doc_id").collect()]


def luhn(number):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(number))) % 10 == 0


def test_layout_and_coreference(spark):
    texts = ["ring +1 (212) 555-0100 or +1 212-555-0100", "mail Ann.Lee@Example.org, ANN.LEE@EXAMPLE.ORG", "pay 4111 1111 1111 1111 or 4111111111111111", "at 10.0.0.1 and 192.168.1.254", "Mr. John Smith and Mr Smith, Mrs Smith", "Госпожа Анна Иванова", "ssn 123-45-6789"]
    out = replaced(spark, texts)
    shape = lambda t: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", t)))
    for i in (0, 1, 2, 3, 6):
        assert out[i] != texts[i] and shape(out[i].lower() if i == 1 else out[i]) == shape(texts[i].lower() if i == 1 else texts[i])
    a, b = re.findall(r"\+1.*?(?= or|$)", out[0])
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and a.startswith("+1 (")
    a, b = re.findall(r"\S+@[^,\s]+", out[1])
    assert a.upper() == b and a.endswith(".org")
    a, b = re.findall(r"\d[\d ]{14,}\d", out[2])
    assert a.replace(" ", "") == b and luhn(b) and b != "4111111111111111"
    names = re.match(r"Mr\. (\w+) (\w+) and Mr (\w+), Mrs (\w+)", out[4]).groups()
    assert names[0] in pii.GIVEN["latin", "m"] and names[1] == names[2] != names[3] and "Smith" not in out[4]
    assert re.fullmatch(r"Госпожа [А-Я][а-я]+ [А-Я][а-я]+а", out[5]) and "Иванова" not in out[5]
    assert replaced(spark, texts) == out and replaced(spark, texts, "another")[0] != out[0]


def test_entities_are_found_and_clean_text_stays(spark):
    clean = ["version 4.0.1 and 1.2.3.4.5", "token 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "on 12.11.2024, 3 - 4 o'clock", "Mr and Mrs", "a@b", "", None, "Über Straße 1234567890"]
    assert replaced(spark, clean) == clean
    hit = ["x +44 20 7946 0958 y", "(017) 555-7713", "212.555.0199", "4845168114407329!!", "of.55@mail9.example.com", "DE89 3704 0044 0532 0130 00", "a 255.1.0.9.", "Herr Groß-Klein", "by Maria Garcia Lopez, or John F. Smith", "1-800-555-0100", "(212) 555 0100"]
    assert all(a != b for a, b in zip(replaced(spark, hit), hit, strict=True))


def test_gender_and_script_of_names(spark):
    out = replaced(spark, ["Maria Garcia met Mr Garcia", "John Smith and John Smith", "Иван Петров", "Frau Anna Schmidt", "John Nobody's, Smith Anna"])
    first = lambda t: t.split()[0]
    assert first(out[0]) in pii.GIVEN["latin", "f"] and out[0].split()[1] != out[0].split()[4]
    assert first(out[1]) in pii.GIVEN["latin", "m"] and out[1].split(" and ")[0] == out[1].split(" and ")[1] and "Smith" not in out[1]
    assert first(out[2]) in pii.GIVEN["cyrillic", "m"] and re.fullmatch(r"[А-Я][а-я]+ [А-Я][а-я]+", out[2])
    assert out[3].split()[0] == "Frau" and out[3].split()[1] in pii.GIVEN["latin", "f"] and "Schmidt" not in out[3]
    assert "Nobody" not in out[4] and out[4].endswith("Smith Anna")


def test_distinct_entities_stay_distinct(spark, monkeypatch):
    """Few replacements for many entities: draws repeat until none is shared and none is an entity."""
    texts = [f"from 1.{i % 10}.{i // 10}.9" for i in range(100)] + [f"{a}@b{c}.cc" for a in "abcdefgh" for c in range(10)]
    out = replaced(spark, texts)
    assert len(set(out)) == len(texts) and not set(out) & set(texts)


def test_no_python_in_plans(spark):
    df = spark.createDataFrame([(1, "a@b.cc", None, None, None)], SCHEMA)
    plan = pii.replace_entities(df, ["doc_id"], KEY)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = pii.replace_entities(odd_docs, ["doc_id", "score"], KEY).collect()
    assert len(rows) == odd_docs.count()
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted((r.doc_id or -1, r.text or "") for r in odd_docs.collect())
    assert {r.doc_id: r.text for r in rows}[1] is None and all(r.n_entities == 0 for r in rows)
    assert pii.replace_entities(no_docs, ["doc_id"], KEY).count() == 0
    twice = spark.createDataFrame([(i % 2, "to a@b.cc", None, None, None) for i in range(4)], SCHEMA)
    out = pii.replace_entities(twice, ["doc_id"], KEY).collect()
    assert len(out) == 4 and len({r.text for r in out}) == 1 and all(r.n_entities == 1 for r in out)


@pytest.mark.parametrize("n", [1, 2])
def test_hot_texts(spark, n):
    df = spark.createDataFrame([(i, "call (212) 555-0100" if i % 3 else f"t{i}@x.org", None, None, None) for i in range(60 * n)], SCHEMA)
    out = pii.replace_entities(df, ["doc_id"], KEY).collect()
    assert len(out) == 60 * n and len({r.text for r in out if r.doc_id % 3}) == 1 and len({r.text for r in out if r.doc_id % 3 == 0}) == 20 * n


def test_people_of_one_surname_stay_distinct(spark):
    """All given names of the pools, more than the pools hold, and middle initials."""
    people = [f"{n} Smith" for g in "mf" for n in pii.GIVEN["latin", g]] + [f"{n} Иванов" for n in pii.GIVEN["cyrillic", "m"]]
    people += [f"Mr {a}{b} Smith" for a in ("Zor", "Quil", "Bran", "Tev", "Osk") for b in ("an", "el", "ik", "or", "us", "ain", "ett", "ob", "ym", "ax", "il", "en")] + ["John F. Smith"]
    out = replaced(spark, [*people, "JOHN SMITH", "Mr John Smith"])
    assert len(set(out[: len(people)])) == len(people) and not set(out) & set(people)
    assert out[-1] == "Mr " + out[people.index("John Smith")]


def entities(text):
    """Brute force: the pattern by another engine, and kinds by plain rules."""
    out = []
    for m in re.finditer(pii.PATTERN, text or ""):
        w = m.group()
        digits = re.sub(r"\D", "", w)
        if "@" in w:
            kind = "email"
        elif w[0].isalpha():
            kind = "iban" if w[:2].isascii() and w[:2].isupper() and w[2:4].isdigit() else "name"
        elif re.fullmatch(r"\d+(\.\d+){3}", w) and len(digits) <= 12 and all(int(x) < 256 for x in w.split(".")):
            kind = "ip"
        elif re.fullmatch(r"\d{3}-\d{2}-\d{4}", w):
            kind = "ssn"
        else:
            kind = "phone" if w[0] in "+(" or re.fullmatch(r"(1[.-])?\d{3}[.-]\d{3}[.-]\d{4}", w) else "card"
        out.append((m.start(), m.end(), kind))
    return out


def test_spans_against_brute_force(spark):
    """All places, kinds and what is between them, for random texts and the test table."""
    rng = random.Random(4)
    parts = ["Mr", "Mrs.", "Dr", "Herr", "Frau", "John", "Maria", "Smith", "Garcia", "Groß-Klein", "Иван", "Петров", "Госпожа", "a.b@c.org", "X@y-z.co.uk", "@", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", "123-45-6789", "+1 (212) 555-0100", "+44 20 7946 0958", "(212) 555-0100", "212.555.0199", "4111 1111 1111 1111", "4845168114407329", "12345678901234567890", "DE89 3704 0044 0532 0130 00", "word", "the", ",", ".", "-", "F.", "\n", "é", "7"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "", "  "]) for _ in range(rng.randrange(1, 14))) for _ in range(600)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in pii.replace_entities(df, ["doc_id"], KEY).collect()}
    assert sum(len(entities(t)) for t in texts) > 500
    for i, t in enumerate(texts):
        found = entities(t)
        assert (got[i].n_entities, got[i].kinds) == (len(found), ",".join(sorted({k for _, _, k in found}))), t
        between = [t[a:b] for a, b in zip([0] + [b for _, b, _ in found], [a for a, _, _ in found] + [len(t or "")], strict=True)] if t else []
        assert t is None or re.fullmatch(".+?".join(map(re.escape, between)), got[i].text, re.S), t


def test_many_names_stay_distinct(spark):
    """More names than three syllables can make, with given names of all sorts."""
    n = 100_000
    surnames = spark.range(n).select(F.concat(F.lit("m latin name"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("canonical"))
    given = spark.range(2000).select(F.lit("given").alias("kind"), F.concat(F.lit("f latin g"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("canonical"))
    out = pii.surrogates(surnames.select(F.lit("name").alias("kind"), "canonical").union(given), KEY)
    assert out.count() == n + 2000 and out.groupBy("kind").agg(F.count_distinct("surrogate").alias("n")).agg(F.sum("n")).first()[0] == n + 2000
    assert out.where(~F.col("surrogate").rlike(r"^\p{Lu}\p{Ll}+$")).isEmpty()


def test_a_full_layout_keeps_replacements_distinct(spark, monkeypatch):
    """All one-digit numbers of a layout are entities."""
    monkeypatch.setattr(pii, "FULL", 2)
    cards = spark.createDataFrame([("other", str(i)) for i in range(10)], "kind string, canonical string")
    out = pii.surrogates(cards, KEY).collect()
    assert sorted(r.surrogate for r in out) == [str(i) for i in range(10)]


def test_no_given_name_replaces_itself(spark):
    names = [f"{n} Smith" for g in "mf" for n in pii.GIVEN["latin", g]]
    for key in ("k1", "k2", "k3"):
        assert all(a.split()[0] != b.split()[0] for a, b in zip(names, replaced(spark, names, key), strict=True))


def test_clashing_names_and_hot_entities(spark, monkeypatch):
    from tracegraph.llm import common

    monkeypatch.setattr(common, "LEAST", 5)
    rows = [(i, f"to all@b.cc and u{i}@b.cc, John Smith" if i % 3 else "to all@b.cc") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as n_entities", "'x' as kinds", "7 as new", "8 as __text")
    out = {r.doc_id: r for r in pii.replace_entities(df, df.columns, KEY).collect()}
    assert len(out) == 60 and all(r.n_entities == (3 if i % 3 else 1) and r.new == 7 and r["__text"] == 8 for i, r in out.items())
    assert len({r.text.split()[1] for r in out.values()}) == 1 and len({r.text for r in out.values()}) == 41
