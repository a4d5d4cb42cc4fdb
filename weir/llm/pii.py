"""Surrogates for personal data and secrets, by built-in functions only.

Entities are found by one pattern, each in its kind. What is replaced is an entity's parts: a person's given and
family name, each on its own, or the whole of any other entity. A part's surrogate is made from an HMAC of its
kind and canonical form (country and digits of a phone number, digits of other numbers, lower case of an address,
an iban without spaces, a name without its title), so the same part has the same surrogate everywhere: in any
format, and of a person with or without the given name or a title's dot. Digits become digits and letters letters of
their case; a phone number keeps its country, a card its first digit and a valid check digit, an iban its country
and valid check digits; addresses are of a reserved domain, and names are of the old one's script and of the
gender that its title or the name itself tells.

The collision check runs over the distinct parts of the whole table: where two parts of a kind meet in one
surrogate, or a surrogate is itself a part, all but the first try again with the next attempt, in a space that
grows with the attempt, until none is left. Parts that needed a later attempt are joined back by the text's hash.

Defined cases: a null text stays null; a text without entities is unchanged; a very long text is one row; repeated
rows, and ties in the collision check, change alike everywhere, as the least canonical form comes first; other
columns are returned as they are, whatever they are called, except one called like the result; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, joined_evenly, written

#: Kinds and their patterns, in order of precedence.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}",
    "secret": r"(?<=\b(?i:password|passwd|secret|token|api_key|apikey)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_+/=-]{8,}+|\bAKIA[0-9A-Z]{16}\b|\b(?:ghp_|sk-)[A-Za-z0-9]{16,}+",
    "hex": r"\b[0-9A-Fa-f]{32,64}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}\b|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}\b|\b[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?!\.?[0-9])",
    "card": r"\b(?:[0-9]{4}[ -]){3}[0-9]{1,7}\b|\b[0-9]{13,19}\b",
    "person": r"(?<![\p{L}\p{N}_])(?:Mrs|Mr|Miss|Ms|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|Dr|Prof|Г-н|Г-жа|Д-р)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
_DIGITS = ("ssn", "card")

#: Country calling codes of one and two digits; all others have three.
CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"

#: Given names by script and gender, and syllables of family names by script.
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Eva Ida Julia Lea Lena Lucia Maria Marta Nina Nora Olga Rosa Sara".split(),
    ("latin", "m"): "Adam Anton Bruno David Emil Felix Hugo Ivan Jonas Leo Lukas Martin Oscar Paul Simon Victor".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга Полина Раиса Софья Тамара Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Степан Юрий".split(),
}
SYLLABLES = {
    "latin": "ba be da do ka ke la lo ma mi na no ra ri ta to".split(),
    "cyrillic": "ба бе да до ка ке ла ло ма ми на но ра ри та то".split(),
}
FEMALE = "Mrs Ms Miss Frau Madame Mme Señora Sra Г-жа".split()
NEUTRAL = "Dr Prof Д-р".split()

ATTEMPTS = 64

_ALL = "|".join(f"(?:{p})" for p in KINDS.values())
_PART = "struct<kind:string,canon:string>"
_FOUND = f"array<struct<kind:string,entity:string,parts:array<{_PART}>>>"


def _kind(entity: Column) -> Column:
    """The kind of an entity that was found; a secret is known by what stood before it, so it is what is left."""
    out = None
    for kind, p in KINDS.items():
        if kind == "secret":
            p = r"AKIA[0-9A-Z]{16}|(?:ghp_|sk-)[A-Za-z0-9]{16,}"
        hit = entity.rlike(f"^(?:{p})$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("secret")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _letters(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _parts(kind: Column, entity: Column) -> Column:
    """What is replaced on its own, as (kind, canonical form)."""
    part = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    phone = F.when(entity.startswith("+"), F.regexp_replace(_digits(entity), f"^({CALLING})", "$1:")).otherwise(F.concat(F.lit("1:"), _digits(entity)))
    words = F.split(entity, " ")
    title, family = F.regexp_replace(words[0], r"\.$", ""), F.element_at(words, -1)
    script = lambda x: F.when(x.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    named = lambda g: words[1].isin(*GIVEN["latin", g], *GIVEN["cyrillic", g])
    gender = F.when(title.isin(*FEMALE), "f").when(~title.isin(*NEUTRAL), "m").when(named("f"), "f").when(named("m"), "m").otherwise("n")
    last = part(F.lit("family"), F.concat_ws(":", script(family), family))
    first = part(F.lit("given"), F.concat_ws(":", script(words[1]), gender, words[1]))
    plain = F.when(kind.isin(*_DIGITS), _digits(entity)).when(kind == "email", F.lower(entity)).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit(""))).when(kind == "phone", phone).otherwise(entity)
    return F.when(kind != "person", F.array(part(kind, plain))).when(F.size(words) > 2, F.array(first, last)).otherwise(F.array(last))


def _shown(kind: Column, canon: Column) -> Column:
    """How a part would look if it were a surrogate."""
    return F.when(kind == "phone", F.replace(canon, F.lit(":"), F.lit(""))).when(kind.isin("given", "family"), F.element_at(F.split(canon, ":"), -1)).otherwise(canon)


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA512 in hexadecimal."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 512))), 512)


def _surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of a part; a struct holds the arguments, as each is used many times."""
    seed = lambda n: F.concat_ws("\x1f", kind, attempt.cast("string"), F.lit(n), canon)
    h = F.concat(_hmac(key, seed("1")), _hmac(key, seed("2")))
    return F.transform(F.array(F.struct(kind.alias("k"), canon.alias("c"), attempt.alias("a"), h.alias("h"))), _made)[0]


def _luhn(body: Column) -> Column:
    """body with its check digit."""
    n = F.length(body)
    doubled = lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 1, c.cast("int") * 2).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(_letters(body), doubled), F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return F.concat(body, F.pmod(-total, F.lit(10)).cast("string"))


def _mod97(x: Column) -> Column:
    """An iban's number, letters as 10 to 35, modulo 97."""
    digit = lambda c: c.rlike("[0-9]")
    return F.aggregate(_letters(x), F.lit(0), lambda a, c: F.pmod(F.when(digit(c), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97)))


def _made(x: Column) -> Column:
    kind, canon, attempt, h = x["k"], x["c"], x["a"], x["h"]
    # a number below 256 for the i-th character
    number = lambda i: F.conv(F.substr(h, F.pmod(i * 2, F.lit(254)) + 1, F.lit(2)), 16, 10).cast("int")
    pick = lambda n, of: F.substr(F.lit(of), F.pmod(n, F.lit(len(of))) + 1, F.lit(1))
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    lower_hex = canon.rlike("^[0-9a-f]+$") & kind.isin("hex", "secret")
    upper_hex = canon.rlike("^[0-9A-F]+$") & kind.isin("hex", "secret")
    chars = F.transform(
        _letters(canon),
        lambda c, i: F.when(lower_hex, pick(number(i), "0123456789abcdef"))
        .when(upper_hex, pick(number(i), "0123456789ABCDEF"))
        .when(c.rlike("[0-9]"), pick(number(i), digit))
        .when(kind == "hex", F.when(c.rlike("[a-f]"), pick(number(i), "abcdef")).otherwise(pick(number(i), "ABCDEF")))
        .when(c.rlike("[a-z]"), pick(number(i), low))
        .when(c.rlike("[A-Z]"), pick(number(i), up))
        .otherwise(c),
    )
    text = F.array_join(chars, "")
    letters = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: pick(number(i), low)), "")
    email = F.concat(letters, F.lit("."), F.lpad(F.pmod(number(F.lit(10)), F.lit(100)).cast("string"), 2, "0"), F.lit("@mail"), F.pmod(number(F.lit(11)), F.lit(10)).cast("string"), F.lit(".example.net"))
    # private addresses first, then reserved ones, then any
    octet = F.when(attempt < 4, F.lit(10)).when(attempt < 8, 240 + F.pmod(number(F.lit(3)), F.lit(15))).otherwise(number(F.lit(3)))
    ip = F.concat_ws(".", octet.cast("string"), *[number(F.lit(k)).cast("string") for k in range(3)])
    code = F.locate(":", canon)
    phone = F.concat(F.substr(canon, F.lit(1), code - 1), F.substr(text, code + 1))
    card = _luhn(F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(text, F.lit(2), F.length(canon) - 2)))
    country, own = F.substr(canon, F.lit(1), F.lit(2)), F.substr(text, F.lit(5))
    check = 98 - _mod97(F.concat(own, country, F.lit("00")))
    iban = F.concat(country, F.lpad(check.cast("string"), 2, "0"), own)
    secret = F.when((kind == "secret") & canon.rlike("^AKIA"), F.concat(F.lit("AKIA"), F.substr(text, F.lit(5)))).otherwise(text)
    cyrillic = canon.startswith("cyrillic:")
    gender = F.split(canon, ":")[1]
    of = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), F.pmod(n, F.lit(len(names))) + 1)
    names = lambda g, n: F.when(cyrillic, of(sum((GIVEN["cyrillic", x] for x in g), []), n)).otherwise(of(sum((GIVEN["latin", x] for x in g), []), n))
    one = lambda i: F.when(gender == "f", names("f", number(i))).when(gender == "m", names("m", number(i))).otherwise(names("fm", number(i)))
    given = F.array_join(F.transform(F.sequence(F.lit(0), 1 + attempt), one), "-")
    syllable = lambda i: F.when(cyrillic, of(SYLLABLES["cyrillic"], number(i))).otherwise(of(SYLLABLES["latin"], number(i)))
    family = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), 5 + attempt), syllable), ""))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card)
    return out.when(kind == "iban", iban).when(kind == "given", given).when(kind == "family", family).otherwise(secret)


def _formatted(kind: Column, entity: Column, made: Column) -> Column:
    """An entity with its parts' surrogates: digits and an iban's signs in the places of the old ones, the last ones
    if there are fewer places, and a person's behind the title as it was written."""
    surrogate = made[0]

    def filled(gone: str) -> Column:
        before = lambda i: F.length(F.regexp_replace(F.substr(entity, F.lit(1), i + 1), gone, ""))
        ahead = F.length(surrogate) - F.length(F.regexp_replace(entity, gone, ""))
        return F.array_join(F.transform(_letters(entity), lambda c, i: F.when(c.rlike(gone), c).otherwise(F.substr(surrogate, ahead + before(i), F.lit(1)))), "")

    person = F.concat_ws(" ", F.split(entity, " ")[0], F.array_join(made, " "))
    return F.when(kind.isin("phone", *_DIGITS), filled("[^0-9]")).when(kind == "iban", filled(" ")).when(kind == "person", person).otherwise(surrogate)


def _found(text: Column) -> Column:
    """The entities of a text, in order."""
    some = text.rlike("[0-9@]|(?i:pass|secret|token|api)|ghp_|sk-|AKIA|Mr|Ms|Mi|Herr|Frau|Mon|Mad|Mme|Se|Sr|Dr|Pro|Г-|Д-")
    return F.when(some, F.regexp_extract_all(text, F.lit(_ALL), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _described(entities: Column) -> Column:
    kinded = F.transform(entities, lambda e: F.struct(_kind(e).alias("kind"), e.alias("entity")))
    return F.transform(kinded, lambda x: F.struct(x["kind"].alias("kind"), x["entity"].alias("entity"), _parts(x["kind"], x["entity"]).alias("parts")))


def later_attempts(parts: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of those parts (kind, canon) whose first surrogate collides."""
    known = written(parts.distinct().withColumn("attempt", F.lit(0)))
    for _ in range(ATTEMPTS):
        made = known.withColumn("s", _surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        twice = made.groupBy("kind", "s").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "canon")).alias("first")).where("n > 1")
        taken = known.select("kind", _shown(F.col("kind"), F.col("canon")).alias("s")).distinct()
        bad = made.join(twice, ["kind", "s"]).where(F.col("canon") != F.col("first.canon")).select("kind", "canon")
        bad = written(bad.union(made.join(taken, ["kind", "s"], "left_semi").select("kind", "canon")).distinct())
        if bad.isEmpty():
            return known.where("attempt > 0")
        known = written(known.join(bad.withColumn("again", F.lit(1)), ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")))
    raise ValueError(f"surrogates still collide after {ATTEMPTS} attempts")


def surrogates(docs: DataFrame, key: str, text: str = "text", into: str = "pii") -> DataFrame:
    """docs, entities of the text replaced, with a struct `into`: n_entities and kinds (sorted, distinct)."""
    t = F.col(f"`{text}`")
    held = docs.where(t.isNotNull()).select(F.xxhash64(t).alias("h"), F.hash(t).alias("g"), F.explode(_described(_found(t))).alias("e"))
    held = written(held.select("h", "g", F.explode("e.parts").alias("p")).select("h", "g", "p.kind", "p.canon").groupBy("h", "g", "kind", "canon").agg(F.count("*").alias("n")))
    late = written(later_attempts(held.select("kind", "canon"), key))
    name = lambda k, c: F.concat_ws("\x1f", k, c)
    tries = F.map_from_entries(F.collect_list(F.struct(name(F.col("kind"), F.col("canon")), F.col("attempt"))))
    per = written(held.join(late, ["kind", "canon"]).groupBy("h", "g").agg(tries.alias("attempts"), F.max("n").alias("n")))
    own = {c: fresh(docs, f"_pii_{c}") for c in ("h", "g", "attempts", "n", "found", "made")}
    per = per.select(*[F.col(c).alias(own[c]) for c in ("h", "g", "attempts", "n")])
    step = joined_evenly(docs, per, {own["h"]: F.coalesce(F.xxhash64(t), F.lit(0)), own["g"]: F.coalesce(F.hash(t), F.lit(0))}, own["n"], "left")
    found, attempts = F.col(own["found"]), F.col(own["attempts"])
    step = step.withColumn(own["found"], F.when(t.isNotNull(), _described(_found(t))))
    tried = lambda x: F.coalesce(F.try_element_at(attempts, name(x["kind"], x["canon"])), F.lit(0))
    new = F.transform(found, lambda x: _formatted(x["kind"], x["entity"], F.transform(x["parts"], lambda y: _surrogate(key, y["kind"], y["canon"], tried(y)))))
    step = step.withColumn(own["made"], F.when(F.size(found) > 0, new))
    pieces = F.split(t, _ALL, -1)
    rebuilt = F.array_join(F.zip_with(pieces, F.col(own["made"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    keep = [c for c in docs.columns if c.lower() != into.lower()]
    info = F.struct(
        F.when(F.size(found) > 0, F.size(found)).otherwise(0).cast("bigint").alias("n_entities"),
        F.array_sort(F.array_distinct(F.transform(F.coalesce(found, F.array().cast(_FOUND)), lambda x: x["kind"]))).alias("kinds"),
    )
    return step.select(*[F.when(F.size(found) > 0, rebuilt).otherwise(t).alias(c) if c == text else F.col(f"`{c}`") for c in keep], info.alias(into))
