"""Surrogates for personal data, by DataFrame and SQL functions only.

Kinds: e-mail addresses, IBANs, IPv4 addresses, social security numbers, phone numbers, card numbers, and names: after a
form of address, or a common given name with a surname. Every distinct entity gets a replacement that is a keyed hash of its kind and canonical form, in the
entity's own layout: digits for digits, letters of the same case for letters, the same punctuation, top-level domain and
country code, a valid Luhn digit if there was one, octets of as many digits. A name keeps its form of address and gets a
given name of the same gender and a surname in the same script. Given names (with any middle ones) are entities of their own, so that
people of one surname stay apart; when a draw from the pool fails ``LOOSE`` times, a name is made of syllables. There are more syllables
the more names there are, and after each ``LOOSE`` draws.

Coreference: forms that differ in layout or case only (``+1 (212) 555-0100``, ``+1 212-555-0100``) are one entity and get one
replacement, written in the layout of each place. Distinctness: replacements that two entities share, or that are an
entity themselves, are drawn again until there are none. Only where ``FULL`` draws fail, since the numbers of one layout are nearly all
taken, a replacement may be another entity, but never another's replacement. No given name replaces itself.

The key is a secret that the caller gives: who has it can find replacements of guessed entities. Entities and texts with very many places are dealt out
over tasks (see ``common.join_dealt``).

Occurrences are found once for each distinct text. Texts without any never move: a bitmap of fixed size (see ``bitmap``)
tells them apart; only the others are shuffled, to meet their replacements by the hash of the text.
Null texts stay null with no entities. Repeated rows give a row each. An empty table gives an empty result. Whole texts are searched, very long ones in
one task. Columns to keep that are named like the new ones give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .common import checkpoint, hot_keys, join_dealt

#: Draws after which layouts may give way, and after which a replacement may be another entity.
LOOSE, FULL = 4, 40
#: Replacements that still wait are sent to what is settled up to this number, as a broadcast.
FEW = 100_000

# Forms of address, by gender.
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа")
NEUTRAL = ("Dr", "Prof")
# Given names, by script and gender.
GIVEN = {
    ("latin", "m"): ("Adam", "Albert", "Alexander", "Andrew", "Anthony", "Antonio", "Benjamin", "Bruno", "Carl", "Carlos", "Charles", "Christian", "Christopher", "Daniel", "David", "Edward", "Emil", "Felix", "François", "Friedrich", "George", "Hans", "Hugo", "Jacques", "James", "Javier", "Jean", "John", "Jonas", "José", "Joseph", "Juan", "Jürgen", "Klaus", "Leon", "Louis", "Luis", "Martin", "Matthew", "Michael", "Miguel", "Oscar", "Paul", "Peter", "Philippe", "Pierre", "Richard", "Robert", "Simon", "Stefan", "Thomas", "William"),
    ("latin", "f"): ("Alice", "Amélie", "Anna", "Barbara", "Bella", "Camille", "Carmen", "Caroline", "Charlotte", "Clara", "Claudia", "Diana", "Elena", "Elizabeth", "Emily", "Emma", "Flora", "Greta", "Hannah", "Heike", "Helen", "Irene", "Isabel", "Jane", "Jennifer", "Jessica", "Julia", "Karen", "Laura", "Linda", "Lucía", "Maria", "María", "Marie", "Marta", "Mary", "Monika", "Nancy", "Olivia", "Patricia", "Sabine", "Sarah", "Sofia", "Sophie", "Susan", "Ursula"),
    ("latin", "u"): ("Alex", "Casey", "Jamie", "Jordan", "Kim", "Robin", "Sam", "Taylor"),
    ("cyrillic", "m"): ("Алексей", "Андрей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Олег", "Павел", "Сергей"),
    ("cyrillic", "f"): ("Анна", "Вера", "Екатерина", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"),
    ("cyrillic", "u"): ("Саша", "Женя", "Валя"),
}

_TITLE = "(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)) + r")\.?"
_COMMON = "(?:" + "|".join(sorted((n for (_, g), pool in GIVEN.items() if g != "u" for n in pool), key=len, reverse=True)) + ")"
_CAPITAL = r"\p{Lu}\p{Ll}+"
_NAME = rf"(?<![\p{{L}}\d])(?:{_TITLE} {_CAPITAL}(?:[ -]{_CAPITAL}){{0,2}}|{_COMMON}(?: \p{{Lu}}\.)?(?:[ -]{_CAPITAL}){{1,2}})(?!\p{{L}})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERN = "|".join(
    (
        r"(?<![\p{L}\d._%+-])[\p{L}\d._%+-]++@[A-Za-z\d-]+(?:\.[A-Za-z\d-]+)*\.[A-Za-z]{2,24}(?![A-Za-z\d])",
        r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![\p{L}\d])",
        rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
        r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
        r"(?<![\p{L}\d+])\+\d{1,3}[ -]?\(\d{1,4}\)[ -]?\d{3}[ .-]?\d{4}(?!\d)",
        r"(?<![\p{L}\d+])\+\d{1,3}(?:[ -]?\d{2,4}){2,4}(?!\d|\.\d)",
        r"(?<![\p{L}\d])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
        r"(?<![\p{L}\d.-])(?:1[.-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\p{L}\d-])",
        r"(?<![\p{L}\d])\d{4}(?:[ -]?\d{4}){3}(?![\p{L}\d])",
        r"(?<![\p{L}\d])\d{13,19}(?![\p{L}\d])",
        _NAME,
    )
)


def _kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(r"^\p{L}"), "name")
        .when(m.rlike(r"^[+(]|^(?:1[.-])?\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .otherwise("card")
    )


def _gender(m: Column) -> Column:
    title = F.regexp_extract(m, rf"^({_TITLE}) ", 1)
    word = F.regexp_replace(title, r"\.$", "")
    given = F.regexp_extract(m, rf"^(?:{_TITLE} )?(\p{{L}}+)", 1)
    men, women = ([n for (_, g), pool in GIVEN.items() if g == k for n in pool] for k in "mf")
    return F.when(word.isin(*MALE), "m").when(word.isin(*FEMALE), "f").when(given.isin(*men), "m").when(given.isin(*women), "f").otherwise("u")


def _script(m: Column) -> Column:
    return F.when(m.rlike(r"[\x{400}-\x{4FF}]"), "cyrillic").otherwise("latin")


def _canonical(kind: Column, m: Column) -> Column:
    """What forms of one entity have in common. A phone number keeps its plus and the length of its country code; a name is
    its gender, script and surname."""
    code = F.length(F.regexp_extract(m, r"^\+(\d{1,3})(?=[ (-])", 1))
    return (
        F.when(kind == "email", F.lower(m))
        .when(kind == "name", F.concat_ws(" ", _gender(m), _script(m), F.lower(F.regexp_extract(m, r"(\p{L}+)$", 1))))
        .when(kind == "phone", F.concat(F.when(m.startswith("+"), F.concat(F.lit("+"), code.cast("string"), F.lit(" "))).otherwise(""), F.regexp_replace(m, r"\D", "")))
        .when(kind == "ip", m)
        .otherwise(F.regexp_replace(m, r"[^A-Z\d]", ""))
    )


def _given(m: Column) -> Column:
    """What stands between the form of address and the surname."""
    return F.regexp_extract(m, rf"^(?:{_TITLE} )?((?:\p{{L}}+\.?[ -])*)\p{{L}}+$", 1)


def _canonical_given(kind: Column, m: Column) -> Column:
    """Gender, script and the given names; null where there is none."""
    words = F.trim(F.regexp_replace(F.lower(_given(m)), r"[^\p{L}]+", " "))
    return F.when((kind == "name") & (words != ""), F.concat_ws(" ", _gender(m), _script(m), words))


def _byte(i: Column) -> Column:
    return F.conv(F.substring(F.col("__hash"), (F.pmod(i, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _one_of(alphabet: str, i: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(_byte(i), F.lit(len(alphabet))) + 1, F.lit(1))


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"


def _redrawn(text: Column, salt: int) -> Column:
    """Each digit and letter replaced by one of its sort."""

    def char(c: Column, i: Column) -> Column:
        at = i + salt
        return F.when(c.rlike(r"\d"), _one_of("0123456789", at)).when(c.rlike("[a-z]"), _one_of(_LOWER, at)).when(c.rlike("[A-Z]"), _one_of(_UPPER, at)).when(c.rlike(r"[\x{400}-\x{4FF}]"), _one_of(_CYRILLIC, at)).when(c.rlike(r"\p{Ll}"), _one_of(_LOWER, at)).when(c.rlike(r"\p{Lu}"), _one_of(_UPPER, at)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), char), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum mod 10."""
    doubled = F.transform(F.reverse(F.transform(F.split(digits, ""), lambda c: c.cast("int"))), lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10


_SOUNDS = {"latin": ("BCDFGHKLMNPRSTVW", "aeiou", "lmnrst", "aeo", "bdgkmt", "aei", "nrs"), "cyrillic": ("БВГДЗКЛМНПРСТ", "аеиоу", "лмнрст", "аео", "бдгкмт", "ои", "вн")}
#: Numbers of one kind of made-up name, and how many times more a syllable makes them.
_MADE, _MORE = 20_000, 16


def _made(script: str, syllables: Column) -> Column:
    """A name of syllables, the given number more than three."""
    first = F.concat(*(_one_of(x, F.lit(i)) for i, x in enumerate(_SOUNDS[script])))
    vowels, consonants = _SOUNDS[script][1], _SOUNDS[script][2]
    more = F.transform(F.sequence(F.lit(0), syllables), lambda i: F.when(i == 0, "").otherwise(F.concat(_one_of(vowels, i * 2 + 20), _one_of(consonants, i * 2 + 21))))
    return F.concat(first, F.array_join(more, ""))


def _surrogate(syllables: Column) -> Column:
    """From kind, canonical, __hash, __card and __try. Of a phone, card, social security number or IBAN: its digits and letters in turn."""
    c, loose = F.col("canonical"), F.col("__try") >= LOOSE
    local, domain = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    labels = F.expr("substring(canonical, instr(canonical, '@') + 1, length(canonical) - instr(canonical, '@') - length(substring_index(canonical, '.', -1)))")
    email = F.concat(_redrawn(local, 0), F.when(loose, F.substring(F.col("__hash"), F.lit(100), 6 + F.col("__try"))).otherwise(""), F.lit("@"), _redrawn(labels, 29), F.substring_index(domain, ".", -1))

    def octet(o: Column, i: Column) -> Column:
        b = _byte(i * 3 + 1) + _byte(i * 3 + 2) * 256
        return F.when(loose | (F.length(o) == 3), F.when(loose, 1 + b % 254).otherwise(100 + b % 156)).when(F.length(o) == 2, 10 + b % 90).otherwise(1 + b % 9).cast("string")

    ip = F.array_join(F.transform(F.split(c, r"\."), octet), ".")
    code = F.when(c.startswith("+"), F.substring(c, 2, 1).cast("int")).otherwise(0)
    number = F.regexp_replace(c, r"^\+\d ", "")
    phone = F.concat(F.substring(number, F.lit(1), code), _redrawn(F.substring(number, code + 1, F.lit(40)), 3))
    stem = F.expr("substring(__card, 1, length(__card) - 1)")
    check = F.pmod(10 - _luhn(F.concat(stem, F.lit("0"))), F.lit(10)).cast("string")
    card = F.when(_luhn(c) == 0, F.concat(stem, check)).otherwise(F.col("__card"))
    iban = F.concat(F.substring(c, 1, 2), _redrawn(F.substring(c, 3, 40), 5))
    parts = F.split(c, " ")
    more = syllables + F.floor(F.col("__try") / LOOSE).cast("int")
    made = F.when(parts[1] == "cyrillic", _made("cyrillic", more)).otherwise(_made("latin", more))
    surname = F.concat(made, F.when((parts[1] == "cyrillic") & (parts[0] == "f"), "а").otherwise(""))
    given = made
    h = F.conv(F.substring("__hash", 1, 12), 16, 10).cast("long")
    for (script, gender), pool in GIVEN.items():
        pick = F.element_at(F.array(*map(F.lit, pool)), (F.pmod(h, F.lit(len(pool))) + 1).cast("int"))
        given = F.when(~loose & (parts[0] == gender) & (parts[1] == script), pick).otherwise(given)
    kind = F.col("kind")
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban).when(kind == "name", surname).when(kind == "given", given).otherwise(_redrawn(c, 7))


def _plain(kind: Column, canonical: Column) -> Column:
    """An entity as a replacement would show it."""
    return F.when(kind == "name", F.initcap(F.substring_index(canonical, " ", -1))).when(kind == "phone", F.regexp_replace(canonical, r"^\+\d ", "")).otherwise(canonical)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) for the distinct (kind, canonical): no two alike within a kind, and none an entity
    (a given name may be another's: the surname beside it is nobody's)."""
    entities = checkpoint(entities)
    # a name's space has sixteen places for each name, or more
    names = entities.where("kind in ('name', 'given')").count()
    syllables = 0
    while _MADE * _MORE**syllables < 16 * names:
        syllables += 1
    replacement = _surrogate(F.lit(syllables))
    drawn_card = F.concat(F.substring("canonical", 1, 1), _redrawn(F.substring("canonical", 2, 40), 5))
    own = (F.col("kind") == "given") & (F.lower("surrogate") == F.split("canonical", " ")[2])
    real = checkpoint(entities.where("kind != 'given'").select("kind", _plain(F.col("kind"), F.col("canonical")).alias("surrogate")))
    waiting, settled, tries, left = entities, None, 0, None
    while left is None or left:
        salt = F.sha2(F.concat_ws("\x01", F.lit(key), "kind", "canonical", F.lit(str(tries))), 512)
        drawn = waiting.withColumn("__try", F.lit(tries)).withColumn("__hash", salt).withColumn("__card", drawn_card).withColumn("surrogate", replacement)
        drawn = checkpoint(drawn.select("kind", "canonical", "surrogate", (~own).alias("__ok")))
        wanted = drawn.select("kind", "surrogate")
        parts = ([real] if tries < FULL else []) + ([settled.select("kind", "surrogate")] if settled is not None else [])
        taken = drawn.select("kind", "surrogate").where("false")
        for part in parts:  # what is settled stays where it is if few are asked for
            taken = taken.unionByName(part.join(F.broadcast(wanted) if left is not None and left <= FEW else wanted, ["kind", "surrogate"], "left_semi"))
        free = drawn.where("__ok").join(taken.distinct(), ["kind", "surrogate"], "left_anti")
        won = checkpoint(free.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical")).select("kind", "canonical", "surrogate"))
        settled = won if settled is None else settled.unionByName(won)
        waiting = checkpoint(waiting.join(won, ["kind", "canonical"], "left_anti").select("kind", "canonical"))
        tries, left = tries + 1, waiting.count()
    return settled


def _rendered(m: Column, kind: Column, surrogate: Column, names: Column) -> Column:
    """The surrogate in the layout of the place ``m``."""
    fill = F.aggregate(
        F.split(m, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
        lambda a, c: F.when(c.rlike(r"[A-Za-z\d]"), F.struct(F.concat(a.s, F.substring(surrogate, a.k, F.lit(1))).alias("s"), (a.k + 1).alias("k"))).otherwise(F.struct(F.concat(a.s, c).alias("s"), a.k.alias("k"))),
        lambda a: a.s,
    )
    title = F.regexp_extract(m, rf"^({_TITLE} )", 1)
    given = _given(m)
    # as many given names as there were, with what stood between them
    seps = F.regexp_replace(given, r"[\p{L}.]", "")
    name = F.concat(title, F.when(given == "", "").otherwise(F.concat(names, F.when(F.length(seps) > 1, F.concat(F.substring(seps, 1, 1), F.concat(F.substring(names, 1, 1), F.lit(".")))).otherwise(""), F.substring(seps, -1, 1))), surrogate)
    cased = F.when((kind == "email") & (m == F.upper(m)), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), fill).when(kind == "name", name).otherwise(cased)


def places_of(docs: DataFrame) -> DataFrame:
    """(__text, copies, at, m, kind, canonical, given) of each entity of each distinct text with any; __text is its SHA-256."""
    found = docs.select("text", F.expr(f"regexp_extract_all(text, r'{PATTERN}', 0)").alias("m")).where("size(m) > 0")
    by_text = found.groupBy(F.sha2("text", 256).alias("__text")).agg(F.first("m").alias("m"), F.count("*").alias("copies"))
    places = by_text.select("__text", "copies", F.posexplode("m").alias("at", "m"))
    return places.withColumn("kind", _kind(F.col("m"))).withColumn("canonical", _canonical(F.col("kind"), F.col("m"))).withColumn("given", _canonical_given(F.col("kind"), F.col("m")))


def replace_entities(docs: DataFrame, keep: list[str], key: str) -> DataFrame:
    """``keep`` columns of ``docs``, ``text`` with replacements, n_entities and kinds (distinct, sorted, comma-joined)."""
    kept = [c for c in dict.fromkeys(keep) if c not in ("text", "n_entities", "kinds")]
    places = checkpoint(places_of(docs))
    givens = places.where("given is not null").select(F.lit("given").alias("kind"), F.col("given").alias("canonical"))
    mapping = surrogates(places.select("kind", "canonical").union(givens).distinct(), key)
    firsts = mapping.where("kind = 'given'").select(F.col("canonical").alias("given"), F.col("surrogate").alias("names"))
    named = places.where("given is not null")
    named = join_dealt(named, firsts, ["given"], hot_keys(named, ["given"]), ["__text", "at"], "inner").drop("given").unionByName(places.where("given is null").drop("given").withColumn("names", F.lit("")))
    new = join_dealt(named, mapping, ["kind", "canonical"], hot_keys(places, ["kind", "canonical"]), ["__text", "at"], "inner")
    new = new.select("__text", "at", "kind", _rendered(F.col("m"), F.col("kind"), F.col("surrogate"), F.col("names")).alias("new"))
    new = checkpoint(new.groupBy("__text").agg(F.array_sort(F.collect_list(F.struct("at", "new", "kind"))).alias("new")))

    marks = bitmap.build(new.select(F.xxhash64("__text").alias("__key")), "__key", new.count())
    names = [f"__k{i}" for i in range(len(kept))]
    hashed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)), F.col("text").alias("__old")).withColumn("__text", F.sha2("__old", 256)).withColumn("__key", F.xxhash64("__text"))
    seen = bitmap.maybe_in(hashed, marks, "__key", "__maybe")
    still = seen.where("not __maybe or __text is null").select(*names, F.col("__old").alias("text"), F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    some = seen.where("__maybe and __text is not null").select(*names, "__old", "__text")
    moved = join_dealt(some, new, ["__text"], hot_keys(places.where("at = 0"), ["__text"], "copies"), names or ["__text"])
    parts = F.arrays_zip(F.expr(f"split(__old, r'{PATTERN}', -1)").alias("a"), F.transform("new", lambda x: x.new).alias("b"))
    text = F.array_join(F.flatten(F.transform(parts, lambda x: F.array(x["a"], x["b"]))), "")
    moved = moved.select(*names, F.when(F.col("new").isNull(), F.col("__old")).otherwise(text).alias("text"), F.greatest(F.coalesce(F.size("new"), F.lit(0)), F.lit(0)).cast("long").alias("n_entities"), F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("new", lambda x: x.kind))), ","), F.lit("")).alias("kinds"))
    return still.unionByName(moved).withColumnsRenamed(dict(zip(names, kept, strict=True)))
