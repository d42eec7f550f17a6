"""Personal data replaced by format-preserving Feistel pseudonyms, in DataFrame functions only.

Values are found by pattern and validated (card numbers by their check digit, addresses by their octets,
dates by the calendar, and so on); what fails is left as it is. A value is written as an array of digits with
a radix each, and ROUNDS times one half of the array is shifted by a keyed hash of the other half. That is a
permutation of the values of one format: equal values get equal pseudonyms in every document, different
ones different pseudonyms, and each is again a valid value of its format.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256
from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.arrow import documents

ROUNDS = 10
KEY_SETTING = "spark.threadlake.pseudonym.key"

# Bounded repeats and look-behinds keep the search linear in very long texts.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
SECRET = r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_DATE = r"(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9./]*[0-9])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
PHONE = r"(?<![0-9+])\+?[0-9]{1,3}[ .-]?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
WORLD_PHONE = r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-][0-9]{2,8}){2,5}(?![0-9])"
PLAIN_PHONE = r"(?<![0-9.-])[0-9]{3}([.-])[0-9]{3}\2[0-9]{4}(?![0-9]|[.-][0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
ANY = "|".join((EMAIL, SECRET, ISO_DATE, DAY_DATE, ADDRESS, PHONE, WORLD_PHONE, PLAIN_PHONE, SOCIAL, CARD))

# 400 Gregorian years are 146097 = 189 * 773 days
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
# and 4800 months, whose days after the 12th are 146097 - 57600 = 88497 = 9 * 9833
MONTHS, LATE_DAYS = 4800, (9, 9833)
LOWER, UPPER, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def permute(values: Column, radix: Column, kind: str, key: str | Column) -> Column:
    """A keyed permutation of arrays of digits: values[i] in 0..radix[i]-1. Positions of radix 1 stay 0."""

    def one(v: Column, r: Column) -> Column:
        half = F.floor(F.size(v) / 2).cast("int")
        first = r % 2 == 0
        other = F.when(first, F.slice(v, half + 1, F.size(v) - half)).otherwise(F.slice(v, 1, half))
        shape = F.array_join(radix.cast("array<string>"), ".")
        digest = F.sha2(F.concat_ws(":", F.lit(key) if isinstance(key, str) else key, F.lit(kind), r.cast("string"), shape, F.array_join(other.cast("array<string>"), ",")), 512)

        def shift(d: Column) -> Column:
            def digit(x: Column, i: Column) -> Column:
                step = F.conv(F.substring(d, i % 32 * 4 + 1, 4), 16, 10).cast("int")
                return F.when((i < half) == first, (x + step) % F.get(radix, i)).otherwise(x)

            return F.transform(v, digit)

        return _let(digest, shift)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, one)


def _characters(m: Column, kind: str, key: str | Column, fixed_from: Column | None = None) -> Column:
    """Digits, lower-case and upper-case letters permuted each within its kind; all else, and what lies from
    `fixed_from` on, stays."""
    whole = F.split(m, "")

    def classed(c: Column, i: Column) -> Column:
        free = F.lit(True) if fixed_from is None else i < fixed_from
        return F.when(free & c.rlike("^[0-9]$"), 0).when(free & c.rlike("^[a-z]$"), 1).when(free & c.rlike("^[A-Z]$"), 2).otherwise(3)

    def rebuilt(kinds: Column) -> Column:
        radix = F.transform(kinds, lambda k: F.when(k == 0, 10).when(k == 3, 1).otherwise(26))
        values = F.transform(
            whole,
            lambda c, i: F.when(F.get(kinds, i) == 0, F.ascii(c) - 48).when(F.get(kinds, i) == 1, F.ascii(c) - 97).when(F.get(kinds, i) == 2, F.ascii(c) - 65).otherwise(0),
        )
        start = lambda k: F.when(k == 0, 48).when(k == 1, 97).otherwise(65)
        return _let(
            permute(values, radix, kind, key),
            lambda out: F.array_join(F.transform(whole, lambda c, i: F.when(F.get(kinds, i) == 3, c).otherwise(F.char(F.get(out, i) + start(F.get(kinds, i))))), ""),
        )

    return _let(F.transform(whole, classed), rebuilt)


def _hex(m: Column, key: str | Column) -> Column:
    low = F.lower(m)
    values = F.transform(F.split(low, ""), lambda c: F.conv(c, 16, 10).cast("int"))
    out = permute(values, F.transform(values, lambda _: F.lit(16)), "secret", key)
    text = F.array_join(F.transform(out, lambda x: F.substring(F.lit(HEX), x + 1, 1)), "")
    # of mixed case: each place that was an upper-case letter has an upper-case one, if it has a letter
    mixed = F.array_join(F.zip_with(F.split(m, ""), out, lambda c, x: F.when(c.rlike("^[A-F]$"), F.substring(F.lit(HEX.upper()), x + 1, 1)).otherwise(F.substring(F.lit(HEX), x + 1, 1))), "")
    return F.when(m == low, text).when(m == F.upper(m), F.upper(text)).otherwise(mixed)


def _digits(m: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(m, "[^0-9]", ""), ""), lambda c: c.cast("int"))


def _luhn(digits: Column) -> Column:
    """The sum that a valid number makes a multiple of ten; the last digit counts once."""
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _in_place(m: Column, digits: Column) -> Column:
    """m with its digits replaced, in order."""
    whole = F.split(m, "")
    taken = F.aggregate(
        whole,
        F.struct(F.lit("").alias("s"), F.lit(0).alias("n")),
        lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a["s"], F.get(digits, a["n"]).cast("string")).alias("s"), (a["n"] + 1).alias("n"))).otherwise(
            F.struct(F.concat(a["s"], c).alias("s"), a["n"].alias("n"))
        ),
    )
    return taken["s"]


def _card(m: Column, key: str | Column) -> Column:
    def valid(digits: Column) -> Column:
        body = F.slice(digits, 1, F.size(digits) - 1)
        fresh = permute(body, F.transform(body, lambda _: F.lit(10)), "card", key)
        check = lambda x: F.concat(x, F.array((F.lit(10) - _luhn(F.concat(x, F.array(F.lit(0)))) % 10) % 10))
        return F.when(_luhn(digits) % 10 == 0, _in_place(m, _let(fresh, check))).otherwise(m)

    return _let(_digits(m), valid)


def _address(m: Column, key: str | Column) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    out = permute(octets, F.array(*[F.lit(256)] * 4), "address", key)
    return F.when(F.forall(octets, lambda x: x < 256), F.array_join(out.cast("array<string>"), ".")).otherwise(m)


def _date(date: Column, key: str | Column) -> Column:
    """Dates of 1800 to 2199 become others of these; null for all else."""
    day = F.datediff(date, F.lit(FIRST_DAY).cast("date"))
    q, r = DAYS
    fresh = permute(F.array(F.floor(day / r).cast("int"), (day % r).cast("int")), F.array(F.lit(q), F.lit(r)), "date", key)
    return F.when(day.between(0, q * r - 1), _let(fresh, lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), F.get(x, 0) * r + F.get(x, 1))))


def _late_date(date: Column, key: str | Column) -> Column:
    """Dates of 1800 to 2199 after the 12th become others of these: as mm/dd they cannot be read as dd/mm, nor can their pseudonyms.

    Their rank leaves out the first twelve days of each month. Back from a rank, the month is the last of the few around the mean that
    begins at or before it.
    """
    first = F.lit(FIRST_DAY).cast("date")
    begins = lambda m: F.datediff(F.add_months(first, m), first) - 12 * m
    month = (F.year(date) - F.year(first)) * 12 + F.month(date) - 1
    rank = F.datediff(date, first) - 12 * (month + 1)
    q, r = LATE_DAYS
    fresh = permute(F.array(F.floor(rank / r).cast("int"), (rank % r).cast("int")), F.array(F.lit(q), F.lit(r)), "late date", key)

    def back(x: Column) -> Column:
        near = F.transform(F.array(*(F.lit(k) for k in (-2, -1, 0, 1, 2))), lambda k: F.greatest(F.lit(0), F.floor(x * MONTHS / (q * r)).cast("int") + k))
        month = F.array_max(F.filter(near, lambda m: begins(m) <= x))
        return _let(month, lambda m: F.date_add(F.add_months(first, m), 12 + x - begins(m)))

    return F.when(month.between(0, MONTHS - 1) & (F.dayofmonth(date) > 12), _let(_let(fresh, lambda v: F.get(v, 0) * r + F.get(v, 1)), back))


def _social(m: Column, key: str | Column) -> Column:
    """Areas 001-899 without 666, groups 01-99 and serials 0001-9999 are valid."""
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(k)).cast("int") for k in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = F.when(area < 666, area - 1).otherwise(area - 2)
    out = permute(F.array(rank, group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), "social", key)
    back = lambda x: F.format_string("%03d-%02d-%04d", F.when(F.get(x, 0) < 665, F.get(x, 0) + 1).otherwise(F.get(x, 0) + 2), F.get(x, 1) + 1, F.get(x, 2) + 1)
    return F.when(valid, _let(out, back)).otherwise(m)


def pseudonym(m: Column, key: str | Column) -> Column:
    """The pseudonym of one found value; the value itself if it isn't valid."""
    iso = _date(F.try_to_date(m, "yyyy-MM-dd"), key)
    dotted = _date(F.try_to_date(F.translate(m, "/", "."), "dd.MM.yyyy"), key)
    other = _late_date(F.try_to_date(m, "MM/dd/yyyy"), key)  # where the second number is no month
    sep = F.substring(m, 3, 1)
    return (
        F.when(m.contains("@"), _characters(m, "email", key, F.instr(m, "@") - 1))
        .when(m.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.coalesce(F.date_format(iso, "yyyy-MM-dd"), m))
        .when(m.rlike("^[0-9]{2}[./][0-9]{2}[./][0-9]{4}$"), F.coalesce(F.regexp_replace(F.date_format(dotted, "dd.MM.yyyy"), F.lit(r"\."), sep), F.date_format(other, "MM/dd/yyyy"), m))
        .when(m.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), _address(m, key))
        .when(m.contains("("), F.concat(F.substring_index(m, "(", 1), _characters(F.substr(m, F.instr(m, "(")), "phone", key)))
        .when(m.startswith("+"), F.concat(F.regexp_extract(m, "^[+][0-9]+", 0), _characters(F.regexp_replace(m, "^[+][0-9]+", ""), "phone", key)))
        .when(m.rlike("^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"), _characters(m, "phone", key))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _social(m, key))
        .when(m.rlike("^[0-9A-Fa-f]{32,64}$"), _hex(m, key))
        .otherwise(_card(m, key))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Each row of `docs` with its text pseudonymised, and n_private, the number of values replaced.

    Who has `key` can undo the permutations, so it must be kept as a secret. It reaches the tasks as a row of its own that a
    subquery reads, and so stands in no plan, log or page of the UI. Emails keep their domain, phone numbers their country code.
    Hexadecimal secrets that differ in case only get pseudonyms that do. A null text stays null and an empty one empty,
    with n_private 0; texts are read whole, however long. Repeated rows are treated alike, an empty table stays empty; a column
    named n_private is replaced, columns of all other names are carried on. Nothing is shuffled.
    """
    own = [c for c in docs.columns if c != "n_private"]
    source = F.col("__source")
    secret = docs.sparkSession.createDataFrame([(key,)], "key string").select("key").scalar()
    base = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns}).withColumns({"__source": F.col(f"__own_{text}"), "__key": secret})
    some = F.coalesce(source.rlike("[0-9@]"), F.lit(False))
    found = base.withColumn("__found", F.when(some, F.regexp_extract_all("__source", F.lit(ANY), 0)).otherwise(F.array().cast("array<string>")))
    fresh = found.withColumn("__fresh", F.transform("__found", lambda m: pseudonym(m, F.col("__key"))))
    gaps = F.split(source, ANY, -1)
    woven = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("__fresh", i), F.lit("")))), "")
    replaced = F.size(F.filter(F.zip_with("__found", "__fresh", lambda a, b: a != b), lambda x: x)).cast("long")
    out = fresh.withColumn("__text", F.when(F.size("__found") > 0, woven).otherwise(source))
    return out.select(*((F.col("__text") if c == text else F.col(f"__own_{c}")).alias(c) for c in own), replaced.alias("n_private"))


def key_id(key: str) -> str:
    """A fingerprint of the key: results with the same one are linked."""
    return sha256(f"key of pseudonyms: {key}".encode()).hexdigest()[:12]


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_private, the text with pseudonyms, and key_id.

    The key is the session's, or else a fresh one: then key_id differs from run to run, and values are linked within this result only.
    """
    key = spark.conf.get(KEY_SETTING, None) or token_hex(32)
    found = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key)
    return found.select("doc_id", "n_private", "text", F.lit(key_id(key)).alias("key_id"))
