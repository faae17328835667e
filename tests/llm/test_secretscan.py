import random
import re

import pytest
from pyspark.sql import functions as F

from tracegraph.llm import secretscan as S


def base(text):
    out = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(S.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_base_patterns_against_plain_regexes():
    rng = random.Random(3)
    parts = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "ſecret", "toKen", " ", "  ", "=", ":", '"', "'", "abcdef12", "0123456789abcdef0", "AKIA", "AKIAQWERTY012345", "é", "😀", "\n", "x"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert [x for x in S.scan(text) if x[0] != "literal"] == base(text), text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('db_password = "hunter2hunter2!"', ["hunter2hunter2!"]),
        ('x = "s3cr3tV4lue99"\nauth_token = x\n', ["s3cr3tV4lue99"]),
        ('signing_key := "abcDEF12345" + "ghiJKL67890"', ["abcDEF12345", "ghiJKL67890"]),
        ('{"credentials": "pA55-word-99x"}', ["pA55-word-99x"]),
        ("PRIVATE_KEY=Zm9vYmFyYmF6MTIz\n", ["Zm9vYmFyYmF6MTIz"]),
        ('password = "changeme"', []),
        ('title = "a perfectly usual title"', []),
        ("the key: of all", []),
    ],
)
def test_assignments_to_sensitive_names(text, want):
    assert [text[a:b] for k, a, b in S.scan(text) if k == "literal"] == want


V = "Zm9vYmFy-99xK2"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"Don't use signing_key = \"{V}\" as it's bad", 1),
        (f'Note: signing_key = "{V}"', 1),
        (f"it's 5 o'clock and signing_key = '{V}', isn't it", 1),
        (f'signing_key: str = "{V}"', 1),
        (f'a = signing_key = b = "{V}"', 1),
        (f'signing_key: {V}', 1),
        (f'signing_key = b"{V}"', 1),
        (f'signing_key = """{V}"""', 1),
        ('signing_key = self.settings.signing.material', 0),
        ('signing_key = load_key_99(path)', 0),
        # comments are read, and reach no code
        (f'# signing_key = "{V}"', 1),
        (f'/* signing_key = "{V}" */ x = 1', 1),
        (f'# k = "{V}"\nsigning_key = k\n', 0),
        (f'k = "{V}"\n// k = "none of it at all"\nsigning_key = k\n', 1),
        (f"see http://host/a and signing_key = '{V}'", 1),
        # scopes
        (f'void f() {{ k = "{V}"; }}\nvoid g() {{ signing_key = k; }}', 0),
        (f'void f() {{ k = "{V}"; signing_key = k; }}', 1),
        (f'k = "{V}";\nvoid g() {{ signing_key = k; }}', 1),
        (f'if (x) {{ k = "{V}"; }}\nsigning_key = k;', 1),
        (f'def f():\n    k = "{V}"\n\ndef g():\n    signing_key = k\n', 0),
        (f'def f():\n    k = "{V}"\n    signing_key = k\n', 1),
        (f'k = "{V}"\ndef f():\n    k = "no secret but long"\nsigning_key = k\n', 1),
        (f'{{"k": "{V}", "signing_key": k}}\n', 1),
        (f'{{"k": "{V}"}}\nsigning_key = k\n', 0),
        ("}}}{{{ )))((( ''' \"\"\" /* <!-- ", 0),
    ],
)
def test_lexer(text, want):
    found = [text[a:b] for k, a, b in S.scan(text) if k == "literal"]
    assert (found == [V] if want else V not in found and not found)


@pytest.mark.parametrize("unit", ["{", "}", "'", '"', "/* ", "# ", "''' ", "\\", "k = k + ", "def f\n", "(", "key: ", "-- "])
def test_time_in_proportion_to_length(unit):
    import time

    def took(n):
        text = "token " + unit * n + ' = "x"'
        best = 9.0
        for _ in range(2):
            t = time.perf_counter()
            S.literals(text)
            best = min(best, time.perf_counter() - t)
        return best

    assert took(40_000) < 12 * took(10_000) + 0.2


def test_odd_rows(spark, odd_docs, no_docs):
    rows = S.find_secrets(odd_docs, ["doc_id", "score"]).collect()
    assert len(rows) == odd_docs.count() and all(r.findings == [] for r in rows)
    assert S.find_secrets(no_docs, ["doc_id"]).where(F.size("findings") > 0).count() == 0


def test_constants_of_many_parts():
    parts = [f"pArt-{i:02}-of-Key{i * 7919}" for i in range(12)]
    whole = " + ".join(f'"{p}"' for p in parts)
    found = lambda text: [text[a:b] for k, a, b in S.scan(text) if k == "literal"]
    assert found(f"private_key = {whole}") == found(f"block = {whole}\nprivate_key = block\n") == parts
    lines = [f'c{i} = "{p}"' for i, p in enumerate(parts)] + ["all = " + " + ".join(f"c{i}" for i in range(12)), "private_key = all"]
    assert found("\n".join(lines)) == parts
    grown = ['x = "pArt-00-of-Key99"'] + ["x = x + x"] * 200 + ["private_key = x"]
    assert found("\n".join(grown)) == ["pArt-00-of-Key99"]


@pytest.mark.parametrize("name", ["pass_word", "PASS_PHRASE", "pass-wd", '"pass word"'])
def test_names_whose_parts_are_apart(name):
    text = f'{name} = "hunter2hunter2!"'
    assert [text[a:b] for k, a, b in S.scan(text) if k == "literal"] == ["hunter2hunter2!"]
