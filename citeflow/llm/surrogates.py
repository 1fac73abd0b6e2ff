"""Operator 1: surrogates for personal data (DataFrame and SQL functions only).

* Detection. One pattern finds e-mail addresses, telephone, card, account (IBAN) and
  social security numbers, IPv4 addresses, access keys, named secrets and names
  after one or more titles (initials and any number of words, the last of them the
  family name; names without a title are not looked for). A mention has a type and a canonical value (digits only, lower
  case, ...), so differently written mentions of one entity are one entity.
* Surrogate. Keyed by SHA-512 of (secret key, type, value, attempt): digits become
  digits and letters letters of the same case; a card keeps its issuer digit and a
  valid check digit, an IBAN its country with right check digits, a telephone
  number its country code, an address four octets; social security numbers get an
  area that is never issued, e-mail hosts a reserved domain (one per real host).
  Names are built from syllables of the mention's script with an ending of the
  title's gender; every given name and the family name are entities of their own,
  so ``Mr J. Smith`` and ``Mr Smith`` stay the same person. An initial becomes a
  whole name.
* Collisions. Candidates of all distinct entities are grouped by surrogate; of those
  that clash with each other all but one, and every one that equals an entity of the
  input, get a further attempt, until none clashes. Distinct entities therefore stay
  distinct, equal ones equal, over the whole input. A hot entity is one row here.
* Rendering. A surrogate is written into the mention's own layout (separators,
  brackets, quotes, upper case); the rest of the text stays byte for byte. Only texts
  with a mention are joined to their surrogates; the others pass through.

Rows: a null text stays null (no entities), an empty one empty. Null ids and rows
that repeat an id are replaced one by one with the same surrogates. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import common as C

KEY = "change-me"               # the default secret; production passes its own
MAX_ROUNDS = 64
_MALE = "Mr|Herr|Monsieur|Señor|Sr|г-н"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа"
_TITLE = f"(?:(?:{_FEMALE}|{_MALE}|Dr|Prof)\\.?)"
_TITLES = f"{_TITLE}(?: {_TITLE}(?= ))*+"
_WOMAN = f"^(?:{_TITLE} )*?(?:{_FEMALE})(?![\\p{{L}}])"
_MAN = f"^(?:{_TITLE} )*?(?:{_MALE})(?![\\p{{L}}])"
_NAME_WORD = rf"(?!{_TITLE}(?![\p{{L}}'’\-]))\p{{Lu}}[\p{{L}}'’\-]*+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {                    # in the order in which a mention is classified
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_\-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9/+_\-.]{8,}[\"']?",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\d+(])(?:\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}"
             # national numbers; never a part of a longer row of digits
             r"|(?<!\d[ .\-/])(?<![A-Za-z.])(?:\d{3} \d{3}[ .\-]\d{4}|[2-9]\d{9}|0[1-9]\d{7,10}|0\d{1,4}[ /\-]\d{5,8}"
             r"|0\d{1,4}(?:[ .\-/]\d{2,4}){2,4})(?![ .\-/]?\d|[A-Za-z]))(?!\d)",
    "card": r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d\-])",
    "name": rf"(?<!\p{{L}}){_TITLES}(?:(?: (?:\p{{Lu}}\.-?)+)* {_NAME_WORD})++",
}
# no mention starts inside a lower-case word, which is where most characters are; the first test of
# every alternative is on its first character
_STARTS = {"ip": r"\d", "access_key": "A", "secret": "[pPsStTaA]", "iban": "[A-Z]", "ssn": r"\d", "phone": r"[\d+(]", "card": r"\d",
           "name": "[MHFSDPг]"}
MENTION = r"(?!(?<=[a-z])[a-z])(?:" + "|".join(
    f"(?={_STARTS[k]})(?:{p})" if k in _STARTS else f"(?:{p})" for k, p in PATTERNS.items()) + ")"
_LATIN = ("ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro "
          "sa se si so ta te ti to va ve vi vo").split(" ")
_CYRILLIC = "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то".split(" ")
_EACH = r"(?!^)(?!\z)"          # splits a string into its characters
_unit = "struct<type:string,value:string>"


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(r"\D"), F.lit(""))


def _kind(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, p in reversed(PATTERNS.items()):
        out = F.when(m.rlike(f"^(?:{p})$"), F.lit(k)).otherwise(out)
    return out


def _parts(m: Column) -> Column:
    """The words of a name mention without its titles, the family name last."""
    return F.split(F.regexp_replace(m, F.lit(f"^{_TITLES} "), F.lit("")), " ")


def _plain(word: Column) -> Column:
    return F.replace(word, F.lit("."), F.lit(""))


def _secret(m: Column) -> Column:
    return F.regexp_extract(m, r"[=:][ \t]{0,3}[\"']?([A-Za-z0-9/+_\-.]{8,})[\"']?$", 1)


def _units(m: Column) -> Column:
    """The entities of a mention: array of (type, canonical value)."""
    one = lambda t, v: F.array(F.struct(F.lit(t).alias("type"), v.alias("value")))
    gender = F.when(m.rlike(_WOMAN), "given_f").when(m.rlike(_MAN), "given_m").otherwise("given")
    words = _parts(m)
    family = F.lower(F.element_at(words, -1))
    last = F.struct(F.lit("family").alias("type"), F.when(gender == "given_f", F.regexp_replace(family, "(ов|ев|ин)а$", "$1"))
                    .otherwise(family).alias("value"))
    name = F.concat(F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: F.struct(
        gender.alias("type"), F.lower(_plain(w)).alias("value"))), F.array(last))
    kind = _kind(m)
    return (F.when(kind == "email", one("email", F.lower(m)))
             .when(kind == "phone", one("phone", F.right(F.regexp_replace(_digits(m), "^0+", ""), F.lit(10))))
             .when(kind.isin("ssn", "card"), F.array(F.struct(kind.alias("type"), _digits(m).alias("value"))))
             .when(kind == "iban", one("iban", F.replace(m, F.lit(" "), F.lit(""))))
             .when(kind == "secret", one("secret", _secret(m)))
             .when(kind == "name", name)
             .otherwise(F.array(F.struct(kind.alias("type"), m.alias("value")))).cast(f"array<{_unit}>"))


# ---- surrogates --------------------------------------------------------------------
def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _alike(value: Column, stream: Column) -> Column:
    """Digits to digits, letters to letters of the same case (hex text stays hex), the rest as it is."""
    hexed = value.rlike("^[0-9a-f]+$") & value.rlike("[a-f]") & value.rlike("[0-9]")
    chars = F.split(value, _EACH)

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        pick = lambda s: F.substring(F.lit(s), F.pmod(b, F.lit(len(s))) + 1, F.lit(1))
        return (F.when(hexed, pick("0123456789abcdef")).when(c.rlike("[0-9]"), pick("0123456789"))
                 .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz"))
                 .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c))
    return F.array_join(F.transform(chars, one), "")


def _number(stream: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                                    lambda i: F.pmod(_byte(stream, i), F.lit(10)).cast("string")), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check of a digit string, from the right; 0 modulo 10 if valid."""
    each = F.transform(F.split(F.reverse(digits), _EACH), lambda d, i: let(
        d.cast("int") * (F.pmod(i, F.lit(2)) + 1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    return F.aggregate(F.split(F.regexp_replace(text, " ", ""), _EACH), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))))


def _syllables(value: Column, stream: Column, ending: Column) -> Column:
    def of(table: list[str]) -> Column:
        t = F.array(*[F.lit(x) for x in table])
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.element_at(
            t, F.pmod(_byte(stream, i * 2) * 256 + _byte(stream, i * 2 + 1), F.lit(len(table))) + 1)), "")
    return F.when(value.rlike(r"\p{IsCyrillic}"), F.concat(of(_CYRILLIC), F.element_at(ending, 2))) \
            .otherwise(F.concat(of(_LATIN), F.element_at(ending, 1)))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of a canonical value."""
    keyed = lambda *c: F.sha2(F.concat_ws("|", F.lit(key), *c).cast("binary"), 512)
    end = lambda latin, cyrillic: F.array(F.lit(latin), F.lit(cyrillic))

    def of(stream: Column) -> Column:
        number = _number(stream, F.length(value))
        card = F.concat(F.substring(value, 1, 1), F.substr(number, F.lit(2)))
        body = F.substr(card, F.lit(1), F.length(card) - 1)
        check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
        bban = _alike(F.substr(value, F.lit(5)), stream)
        iban_check = F.lit(98) - _mod97(F.concat(bban, F.substring(value, 1, 2), F.lit("00")))
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(
            i == 0, F.pmod(_byte(stream, i), F.lit(99)) + 11).otherwise(_byte(stream, i)).cast("string")), ".")
        host = F.concat(F.lit("@h"), F.substring(keyed(F.lit("host"), F.substring_index(value, "@", -1)), 1, 12), F.lit(".example.org"))
        return (F.when(kind == "email", F.concat(_alike(F.substring_index(value, "@", 1), stream), host))
                 .when(kind == "phone", F.concat((F.pmod(_byte(stream, F.lit(60)), F.lit(8)) + 2).cast("string"), F.substr(number, F.lit(2))))
                 .when(kind == "card", F.when(F.pmod(_luhn(value), F.lit(10)) == 0, F.concat(body, check.cast("string"))).otherwise(card))
                 .when(kind == "ssn", F.concat(F.lit("9"), F.substr(number, F.lit(2))))
                 .when(kind == "ip", octets)
                 .when(kind == "iban", F.concat(F.substring(value, 1, 2), F.lpad(iban_check.cast("string"), 2, "0"), bban))
                 .when(kind == "access_key", F.concat(F.substring(value, 1, 4), _alike(F.substr(value, F.lit(5)), stream)))
                 .when(kind == "given_f", _syllables(value, stream, end("na", "на")))
                 .when(kind == "given_m", _syllables(value, stream, end("rd", "р")))
                 .when(kind == "given", _syllables(value, stream, end("s", "с")))
                 .when(kind == "family", _syllables(value, stream, end("nd", "нов")))
                 .otherwise(_alike(value, stream)))
    return let(keyed(kind, value, attempt.cast("string")), of)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(type, value, surrogate) of distinct (type, value) rows, free of collisions."""
    made = C.scratch(entities.withColumn("attempt", F.lit(0)).withColumn(
        "surrogate", surrogate(F.col("type"), F.col("value"), F.col("attempt"), key)), "pii-try")
    taken = entities.select("type", F.col("value").alias("surrogate"))
    for _ in range(MAX_ROUNDS):
        same = made.groupBy("type", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("keeps"), F.count(F.lit(1)).alias("n"))
        clash = (made.join(same.where("n > 1"), ["type", "surrogate"])
                     .where(F.struct("attempt", "value") != F.col("keeps")).select("type", "value")
                     .unionByName(made.join(taken, ["type", "surrogate"], "left_semi").select("type", "value")).distinct())
        clash = C.scratch(clash.withColumn("clash", F.lit(True)), "pii-clash")
        if clash.isEmpty():
            return made.select("type", "value", "surrogate")
        again = (made.join(clash, ["type", "value"], "left")
                     .withColumn("attempt", F.when(F.col("clash"), F.col("attempt") + 1).otherwise(F.col("attempt"))))
        made = C.scratch(again.withColumn("surrogate", F.when(
            F.col("clash"), surrogate(F.col("type"), F.col("value"), F.col("attempt"), key)).otherwise(F.col("surrogate")))
            .drop("clash"), "pii-try")
    raise RuntimeError("surrogates still collide: a type has more entities than surrogates")


# ---- rendering ---------------------------------------------------------------------
def _laid_out(mention: Column, digits: Column) -> Column:
    """The digits of a surrogate in the mention's layout; a longer mention keeps its leading digits."""
    n = F.length(_digits(mention))
    full = F.concat(F.substr(_digits(mention), F.lit(1), F.greatest(n - F.length(digits), F.lit(0))), digits)
    return let(full, lambda d: F.array_join(F.transform(F.split(mention, _EACH), lambda c, i: F.when(
        c.rlike("[0-9]"), F.substring(d, F.length(_digits(F.substring(mention, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), ""))


def _cased(word: Column, like: Column) -> Column:
    return F.when((F.length(like) > 1) & (F.upper(like) == like), F.upper(word)).otherwise(F.initcap(word))


def _rendered(m: Column, of) -> Column:
    """A mention with its surrogates; ``of(unit)`` looks one up."""
    def by_units(u: Column) -> Column:
        first = of(F.element_at(u, 1))
        kind = _kind(m)
        words = _parts(m)
        woman = m.rlike(_WOMAN) & F.element_at(words, -1).rlike("(ов|ев|ин)а$")
        last = of(F.element_at(u, -1))
        last = _cased(F.when(woman, F.concat(last, F.lit("а"))).otherwise(last), F.element_at(words, -1))
        given = F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w, i: F.when(
            F.contains(w, F.lit(".")), F.initcap(of(F.element_at(u, i + 1)))).otherwise(_cased(of(F.element_at(u, i + 1)), w)))
        name = F.concat_ws(" ", F.regexp_extract(m, f"^{_TITLES}(?= )", 0), given, last)
        iban = F.when(F.contains(m, F.lit(" ")), F.trim(F.regexp_replace(first, F.lit("(.{4})"), F.lit("$1 ")))).otherwise(first)
        return (F.when(kind == "email", F.when(F.upper(m) == m, F.upper(first)).otherwise(first))
                 .when(kind.isin("phone", "ssn", "card"), _laid_out(m, first))
                 .when(kind == "iban", iban).when(kind == "secret", F.replace(m, _secret(m), first))
                 .when(kind == "name", name).otherwise(first))
    return let(_units(m), by_units)


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """One row per document: doc_id, n_entities (mentions replaced), text (with surrogates)."""
    ensure_checkpoint_dir(docs.sparkSession)
    d = C.pick(docs, doc_id="long", text="string")
    found = d.withColumn("mentions", F.coalesce(F.regexp_extract_all("text", F.lit(MENTION), F.lit(0)),
                                                F.array().cast("array<string>")))
    has = found.where(F.size("mentions") > 0).withColumn(
        "key", F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2(F.col("text").cast("binary"), 256)))
    # the mentions are a small part of the text; written once, they serve both the collision check and the texts
    units = C.scratch(has.select("key", F.explode(F.array_distinct(F.flatten(F.transform("mentions", _units)))).alias("u"))
                         .select("key", "u.type", "u.value").distinct(), "pii-units")
    table = C.scratch(assign(units.select("type", "value").distinct(), key), "pii-surrogates")
    name = F.concat_ws("|", "type", "value")
    maps = (units.join(table, ["type", "value"]).groupBy("key")
                 .agg(F.map_from_entries(F.collect_set(F.struct(name.alias("n"), F.col("surrogate").alias("s")))).alias("by")))
    gaps = F.split("text", MENTION, -1)
    of = lambda u: F.element_at(F.col("by"), F.concat_ws("|", u["type"], u["value"]))
    new = F.concat(F.element_at(gaps, 1), F.array_join(F.zip_with(
        F.transform("mentions", lambda m: _rendered(m, of)), F.slice(gaps, F.lit(2), F.size("mentions")),
        lambda s, g: F.concat(s, g)), ""))
    changed = has.join(maps, "key").select("doc_id", F.size("mentions").cast("long").alias("n_entities"), new.alias("text"))
    same = found.where(F.size("mentions") == 0).select("doc_id", F.lit(0).cast("long").alias("n_entities"), "text")
    return changed.unionByName(same)


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(C.documents(spark, sf_dir))


QUERIES = {"op1_surrogates": op1_surrogates}
ORACLE = {}
