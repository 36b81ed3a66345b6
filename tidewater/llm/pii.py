"""PII surrogates (built-in expressions only).

Detected entities are replaced by surrogates of the same type. The corpus-wide table of
distinct entities (type and canonical value) is made first, so one entity has one
surrogate everywhere, however its occurrences are written: numbers are compared by their
digits (North American ones with or without country code), addresses and names without
regard to case, names also without title, and the surrogate is written back in the form
of each occurrence. A name is found after a title; a full name of two words and more is
then found in the same text without one too. Its gender is that of its titles, if they
agree. Characters come from a keyed digest of the entity: letters
stay letters of their script, digits stay digits, card numbers keep their checksum state,
names get names of the gender of their title.

Distinctness is checked, not hoped for: entities whose surrogates collide with each
other's, or with a value that is itself in the corpus, try again with the next digest
until none collide; from the ninth try on the format is widened by digits, so small
formats can't run out.

Only texts with entities are shuffled, and only their (hash, place, entity) rows meet the
table. An entity may be in a third of all texts; rows are combined before the shuffle and
skewed joins are split.

Defined results: a null text stays null and counts as empty; repeated rows, ties and null
ids get equal results for equal texts; texts of any length are scanned whole, in linear
time; other columns pass through, but those named pi_* are dropped; an empty table gives
no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import stored, table, text_or_empty

#: Default key of the surrogates, for tests.
KEY = "surrogates-1"
_SEP = r"[ .\-/#*$%&!]"
_L = r"\p{L}\p{N}"
#: Titles before names, by gender. Fixed values.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita", "Госпожа"],
    "n": ["Dr", "Prof", "Professor"],
}
_FORMS = {g: [*ts, *(t.upper() for t in ts)] for g, ts in TITLES.items()}
_TITLE = "|".join(t for ts in _FORMS.values() for t in sorted(ts, key=len, reverse=True))
#: One title or some ("Prof. Dr."); so many at most that no name has more.
_HEAD = rf"(?:(?:{_TITLE})\b\.? ){{1,4}}+"
_NAME = r"\p{Lu}[\p{L}'’]+(?:[ \-]\p{Lu}[\p{L}'’]+){0,2}"
#: Type -> pattern, in the order in which they are tried at a place.
PATTERNS = {
    "email": rf"(?<![{_L}._+\-])[{_L}._+\-]++@[{_L}\-][{_L}\-.]*\.\p{{L}}{{2,}}",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<!\d)(?:\d{4}(?:[ \-]?\d{4}){3}|\d{13,19})(?!\d)",
    "phone": rf"(?<![{_L}+.\-])(?:\+\d{{8,15}}|\+\d{{1,3}}{_SEP}{{0,3}}(?:\(\d{{1,4}}\)|\d{{1,4}})(?:{_SEP}{{1,3}}\d{{2,4}}){{1,4}}|\(\d{{2,4}}\){_SEP}{{0,3}}\d{{3,4}}{_SEP}{{1,3}}\d{{3,4}}|\d{{3}}[\-. ]\d{{3}}[\-. ]\d{{4}})(?!\p{{N}})",
    "name": rf"\b{_HEAD}{_NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
NUMBERS = ("ssn", "card", "phone")
_TRIES = 8

#: Alphabets that letters are drawn from, by script. Fixed values.
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"
CJK = "安白陈成春东方飞高光海和华金静兰丽林明宁平青清石思天文小雨玉"
#: Syllables of made-up names, and their endings by gender. Fixed values.
SYLLABLES = {"latin": [c + v for c in "bdfgklmnprstvz" for v in "aeiou"], "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеио"]}
ENDINGS = {"latin": {"m": "n", "f": "a", "n": "l"}, "cyrillic": {"m": "н", "f": "на", "n": "л"}}


def kind_of(match: Column) -> Column:
    """The type of a match: the first pattern that it fits as a whole."""
    whole = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}
    return reduce(lambda rest, k: F.when(match.rlike(whole[k]), k).otherwise(rest), reversed(list(whole)), F.lit("name"))


def _title(match: Column) -> Column:
    return F.regexp_extract(match, rf"^{_HEAD}", 0)


def _untitled(match: Column) -> Column:
    return F.regexp_replace(match, rf"^{_HEAD}", "")


def canonical(kind: Column, match: Column) -> Column:
    """The value by which occurrences are the same entity: names without title and case, North American numbers without country code."""
    digits = F.concat(F.when(match.startswith("+"), "+").otherwise(""), F.regexp_replace(match, r"\D", ""))
    phone = F.regexp_replace(digits, r"^\+1(?=\d{10}$)", "")
    return F.when(kind == "phone", phone).when(kind.isin(*NUMBERS), digits).when(kind == "name", F.lower(_untitled(match))).otherwise(F.lower(match))


def gender(match: Column) -> Column:
    """m or f by the first title of a match that tells, else null."""
    telling = "|".join(sorted([*_FORMS["m"], *_FORMS["f"]], key=len, reverse=True))
    title = F.regexp_extract(_title(match), rf"(?:^| )({telling})\b\.?(?= )", 1)
    return F.when(title.isin(_FORMS["m"]), "m").when(title.isin(_FORMS["f"]), "f")


def pattern_of(text: Column) -> Column:
    """The pattern of a text: that of all types, and full names that stand after a title in it, in any case, wherever they stand."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0)), lambda m: F.lower(_untitled(m))))
    full = F.filter(names, lambda n: n.rlike("[ -]"))
    longest = F.reverse(F.array_sort(F.transform(full, lambda n: F.struct(F.length(n).alias("n"), n.alias("s")))))
    more = F.concat(F.lit(rf"{ANY}|(?<![{_L}])(?=\p{{Lu}})(?iu:"), F.array_join(F.transform(longest, lambda x: x["s"]), "|"), F.lit(rf")(?![{_L}])"))
    return F.when(text.rlike(PATTERNS["name"]) & (F.size(full) > 0), more).otherwise(F.lit(ANY))


def shown(kind: Column, value: Column) -> Column:
    """A value without the gender that stands before names."""
    return F.when(kind == "name", F.substr(value, F.lit(3))).otherwise(value)


def _draw(digest: Column, i: Column, most: int) -> Column:
    """The i-th number below ``most`` of a digest of 128 hexadecimal digits (used again and again)."""
    return (F.conv(F.substring(digest, i % 62 * 2 + 1, F.lit(4)), 16, 10).cast("int") % most).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), n + 1, F.lit(1))


def _recharactered(value: Column, digest: Column) -> Column:
    """Each letter and digit replaced by one of its kind and script; all else stays."""
    sub = lambda c, i: (
        F.when(c.rlike(r"^\d$"), _draw(digest, i, 10).cast("string"))
        .when(c.rlike(r"^\p{IsCyrillic}$"), _pick(CYRILLIC, _draw(digest, i, len(CYRILLIC))))
        .when(c.rlike(r"^\p{IsGreek}$"), _pick(GREEK, _draw(digest, i, len(GREEK))))
        .when(c.rlike(r"^\p{IsHan}$"), _pick(CJK, _draw(digest, i, len(CJK))))
        .when(c.rlike(r"^\p{L}$"), _pick(LATIN, _draw(digest, i, 26)))
        .otherwise(c)
    )
    return F.array_join(F.transform(F.split(value, ""), sub), "")


def _luhn(digits: Column) -> Column:
    """Checksum of a string of digits, 0 if valid as a card number."""
    double = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _name(value: Column, digest: Column) -> Column:
    """Made-up names, one for each word, of the script of the first letter and the gender before the colon."""
    sex, words = F.substring(value, 1, 1), F.split(F.substr(value, F.lit(3)), r"(?<=[ \-])")

    def made(script: str) -> Column:
        syllables = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        end = reduce(lambda rest, g: F.when(sex == g, ENDINGS[script][g]).otherwise(rest), ("m", "f"), F.lit(ENDINGS[script]["n"]))
        part = lambda i, k: F.get(syllables, _draw(digest, i * 5 + k, len(SYLLABLES[script])))
        return F.array_join(F.transform(words, lambda w, i: F.concat(part(i, 0), part(i, 1), part(i, 2), end, F.regexp_extract(w, r"[ \-]$", 0))), "")

    letters = F.substr(value, F.lit(3))
    other = letters.rlike(r"^[\p{IsHan}\p{IsGreek}]")
    return F.concat(sex, F.lit(":"), F.when(letters.rlike(r"^\p{IsCyrillic}"), made("cyrillic")).when(other, _recharactered(letters, digest)).otherwise(made("latin")))


def candidate(kind: Column, value: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate of an entity at one attempt, in canonical form."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string")), 512)
    octets = F.concat_ws(".", *[(_draw(digest, F.lit(i), 254) + 1).cast("string") for i in range(4)])
    wide = F.when(attempt > _TRIES, _draw(digest, F.lit(60), 10000).cast("string")).otherwise("")
    host = F.regexp_extract(value, r"\.\p{L}+$", 0)
    email = F.concat(_recharactered(F.regexp_replace(value, r"@.*$", ""), digest), wide, F.lit("@"), _recharactered(F.regexp_replace(F.regexp_replace(value, r"^.*@", ""), r"\.\p{L}+$", ""), F.sha2(F.concat_ws("|", F.lit(key), F.lit("host"), F.regexp_replace(value, r"^.*@", "")), 512)), host)
    lead = F.regexp_extract(value, r"^\+?\d?", 0)
    phone = F.when(value.startswith("+"), F.concat(lead, _recharactered(F.regexp_replace(value, r"^\+\d?", ""), digest))).otherwise(_recharactered(value, digest))
    body = _recharactered(F.regexp_replace(value, r"\d$", ""), digest)
    shift = F.pmod(_luhn(value) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = F.concat(body, shift)
    name = _name(value, digest)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", octets)
        .when(kind == "card", F.concat(card, wide))
        .when(kind == "phone", F.concat(phone, wide))
        .when(kind == "name", F.concat(name, wide))
        .otherwise(F.concat(_recharactered(value, digest), wide))
    )


def surrogate_table(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(pi_kind, pi_value) -> pi_surrogate, all different from each other and from every value.

    One round settles all entities whose candidates collide with nothing; those left, few
    and fewer, go on with the next attempt against all that are settled.
    """
    kind = F.col("pi_kind")
    values = entities.select("pi_kind", shown(kind, F.col("pi_value")).alias("pi_shown"))
    waiting, settled, attempt = entities, None, 0
    while True:
        tried = waiting.withColumn("pi_surrogate", candidate(F.col("pi_kind"), F.col("pi_value"), F.lit(attempt), key))
        tried = tried.withColumn("pi_shown", shown(kind, F.col("pi_surrogate")))
        taken = values if settled is None else values.union(settled.select("pi_kind", shown(kind, F.col("pi_surrogate"))))
        first = F.row_number().over(Window.partitionBy("pi_kind", "pi_shown").orderBy("pi_value")) == 1
        tried = stored(
            tried.join(taken.distinct().withColumn("pi_used", F.lit(True)), ["pi_kind", "pi_shown"], "left")
            .withColumn("pi_good", first & F.col("pi_used").isNull())
            .drop("pi_used", "pi_shown")
        )
        good = tried.filter("pi_good").select("pi_kind", "pi_value", "pi_surrogate")
        settled = good if settled is None else settled.union(good)
        waiting = tried.filter("not pi_good").select("pi_kind", "pi_value")
        if waiting.isEmpty():
            return settled
        attempt += 1


def rendered(kind: Column, match: Column, surrogate: Column) -> Column:
    """The surrogate in the form of one occurrence: its separators, title and case."""
    plain_digits = F.regexp_replace(surrogate, r"\D", "")
    country = (kind == "phone") & match.startswith("+1") & (F.length(F.regexp_replace(match, r"\D", "")) == 11) & (F.length(plain_digits) < 11)
    digits = F.when(country, F.concat(F.lit("1"), plain_digits)).otherwise(plain_digits)
    filled = F.aggregate(
        F.split(match, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
        lambda acc, c: F.struct(
            F.concat(acc["s"], F.when(c.rlike(r"^\d$"), F.substring(digits, acc["k"], F.lit(1))).otherwise(c)).alias("s"),
            (acc["k"] + F.when(c.rlike(r"^\d$"), 1).otherwise(0)).alias("k"),
        ),
        lambda acc: F.concat(acc["s"], F.substring(digits, acc["k"], F.lit(99))),
    )
    title = _title(match)
    plain = _untitled(match)
    cased = lambda like, s: F.when((like == F.upper(like)) & (like != F.lower(like)), F.upper(s)).otherwise(s)
    proper = F.array_join(F.transform(F.split(shown(kind, surrogate), r"(?<=[ \-])"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")
    return F.when(kind.isin(*NUMBERS), filled).when(kind == "name", F.concat(title, cased(plain, proper))).otherwise(cased(match, surrogate))


def with_surrogates(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, and pi_counts, the entities of each type (a map)."""
    own = [c for c in docs.columns if not c.startswith("pi_")]
    given = docs.select(*own)
    has = F.coalesce(F.col(text).rlike(ANY), F.lit(False))
    found = given.filter(has).withColumn("pi_a", F.xxhash64(text)).withColumn("pi_b", F.hash(text))
    pattern = pattern_of(F.col(text))
    each = found.select("pi_a", "pi_b", F.posexplode(F.regexp_extract_all(text, pattern, F.lit(0))).alias("pi_at", "pi_match"))
    # texts that are equal have equal matches: one row for each text and place, and few in all
    each = stored(each.distinct().withColumn("pi_kind", kind_of(F.col("pi_match"))).withColumn("pi_value", canonical(F.col("pi_kind"), F.col("pi_match"))))
    sexes = F.collect_set(F.when(F.col("pi_kind") == "name", gender(F.col("pi_match")))).alias("pi_sexes")
    sex = F.when(F.size("pi_sexes") == 1, F.col("pi_sexes")[0]).otherwise("n")
    full = F.when(F.col("pi_kind") == "name", F.concat(sex, F.lit(":"), "pi_value")).otherwise(F.col("pi_value")).alias("pi_value")
    names = surrogate_table(each.groupBy("pi_kind", "pi_value").agg(sexes).select("pi_kind", full), key)
    names = names.withColumn("pi_value", shown(F.col("pi_kind"), F.col("pi_value")))
    placed = each.join(names, ["pi_kind", "pi_value"]).select("pi_a", "pi_b", F.struct("pi_at", "pi_kind", rendered(F.col("pi_kind"), F.col("pi_match"), F.col("pi_surrogate")).alias("new")).alias("pi_one"))
    by_text = placed.groupBy("pi_a", "pi_b").agg(F.array_sort(F.collect_list("pi_one")).alias("pi_all"))
    joined = found.join(by_text, ["pi_a", "pi_b"])
    gaps = F.split(F.col(text), pattern, -1)
    filled = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size("pi_all")), F.col("pi_all"), lambda g, e: F.concat(g, e["new"])), ""), F.element_at(gaps, -1))
    count = lambda k: F.size(F.filter("pi_all", lambda e: e["pi_kind"] == k)).cast("long")
    tally = F.map_from_arrays(F.array(*[F.lit(k) for k in PATTERNS]), F.array(*[count(k) for k in PATTERNS]))
    zero = F.map_from_arrays(F.array(*[F.lit(k) for k in PATTERNS]), F.array(*[F.lit(0).cast("long") for _ in PATTERNS]))
    replaced = joined.select(*[filled.alias(text) if c == text else F.col(c) for c in own], tally.alias("pi_counts"))
    return replaced.union(given.filter(~has).select(*own, zero.alias("pi_counts")))


def secret_key(spark: SparkSession) -> str:
    """The session's ``tidewater.surrogate.key``, to be set to a secret in production."""
    return spark.conf.get("tidewater.surrogate.key", KEY)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), key=secret_key(spark))
    return out.select("doc_id", *[F.col("pi_counts")[k].alias(f"n_{k}") for k in PATTERNS], text_or_empty().alias("text"))
