"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame functions only.

E-mail addresses, IPv4 addresses, dates, social security numbers, card numbers
and phone numbers are found in each whole text. Those that pass validation
(ranges, calendar, Luhn check digit, lengths) are permuted within their own
format under a key: equal values stay equal in all documents, others stay
different, and whoever holds the key can go back.

A value is split in two halves that are changed in turn by a keyed SHA-256 of
the other half: numbers L below a and R below b modulo a and b, the users of
addresses character by character within capitals, small letters and digits.
That is a permutation whatever the hash is. Cut hashes don't show the state
they came from, so the key is simply put before what is hashed.

Formats: ``user@domain`` with users of at most 64 and domains of at most 255
characters and two labels (the domain and marks in the user stay); ``1.2.3.4``
without leading zeros;
calendar dates of the years 1 to 9999, year first, with ``-``, ``/`` or ``.``
(they stay within 1-1899, 1900-2105 or 2106-9999); ``123-45-6789``; cards of 13
to 19 digits in one run or in the usual groups; phone numbers of ten digits in
three groups, or of several groups after ``+`` and a country code, which
stays. Dates with the day or the month first are ambiguous and stay.

Null texts stay null and hold nothing, as do empty ones. Texts without digits
or @ are left as they are. The patterns give nothing back once they have read
it and don't start within a run, so time follows the length of a text, whatever
it holds. Every row has its own result, also with repeated or null ids.
Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
LONGEST_USER, LONGEST_DOMAIN = 64, 255

# Patterns of the formats, tried in this order at every place.
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}+\.){3}+[0-9]{1,3}+(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9-])[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{2}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4})(?![0-9])",
}
_ANY = "(?:" + "|".join(FORMATS.values()) + ")"
#: Ranges of dates as the first day and two factors of the number of days.
DATES = (("0001-01-01", 745, 931), ("1900-01-01", 264, 285), ("2106-01-01", 1532, 1882))


def _bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _keyed_hash(key: str, *parts: Column) -> Column:
    """A number of 60 bits from the key and the parts."""
    return F.conv(F.left(F.sha2(F.concat_ws(":", F.lit(key), *(p.cast("string") for p in parts)), 256), F.lit(15)), 16, 10).cast("long")


def _rounds(inverse: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def feistel(value: Column, a: Column, b: Column, key: str, tweak: Column, inverse: bool = False) -> Column:
    """``value`` (0 to a * b - 1) permuted by alternating rounds on value div b and value mod b."""
    div = F.call_function("try_divide", (value - F.pmod(value, b)).cast("decimal(20,0)"), b.cast("decimal(20,0)")).cast("long")
    start = F.struct(div.alias("l"), F.pmod(value, b).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        def step(x: Column, other: Column, m: Column) -> Column:
            change = F.pmod(_keyed_hash(key, tweak, i, other), m)
            return F.pmod(x - change if inverse else x + change, m)

        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(F.when(even, step(s["l"], s["r"], a)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(step(s["r"], s["l"], b)).alias("r"))

    return _bound(F.aggregate(_rounds(inverse), start, turn), lambda s: s["l"] * b + s["r"])


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _permuted_digits(digits: Column, key: str, kind: str, inverse: bool) -> Column:
    """A string of digits permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.element_at(F.array(*(F.lit(10**i) for i in range(13))), k + 1)
    out = feistel(digits.cast("long"), power(n - half), power(half), key, F.concat(F.lit(kind), n), inverse)
    return F.lpad(out.cast("string"), n, "0")


def _filled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in turn by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
    step = lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substr(digits, s["next"], F.lit(1))).alias("out"), (s["next"] + 1).alias("next"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["next"].alias("next")))
    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """The Luhn check digit of a string of digits that lacks it."""
    worth = lambda c, i: F.when(i % 2 == 0, F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), worth), F.lit(0), lambda s, x: s + x)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _day(hit: Column) -> Column:
    """The calendar date that a hit with the year first names, or null."""
    return F.try_to_date(F.regexp_replace(hit, "[/.]", "-"), "yyyy-MM-dd")


def _kind(hit: Column) -> Column:
    """The format of a hit if it is valid, else null."""
    digits = _digits(hit)
    card = F.length(digits).between(13, 19) & (F.right(digits, F.lit(1)) == _luhn(F.left(digits, F.length(digits) - 1)))
    octets = F.forall(F.split(hit, r"\."), lambda o: (o.cast("int") <= 255) & ~o.rlike("^0[0-9]"))
    full = lambda kind: hit.rlike(f"^{FORMATS[kind]}$")
    at = F.instr(hit, "@")
    email = at.between(2, LONGEST_USER + 1) & (F.length(hit) - at <= LONGEST_DOMAIN)
    ssn = ~F.left(hit, F.lit(3)).isin("000", "666") & (F.left(hit, F.lit(1)) != "9") & (F.substr(hit, F.lit(5), F.lit(2)) != "00") & (F.right(hit, F.lit(4)) != "0000")
    return (
        F.when(at > 0, F.when(email, F.lit("email")))
        .when(full("ip"), F.when(octets, F.lit("ip")))
        .when(full("date"), F.when((F.left(hit, F.lit(4)) != "0000") & _day(hit).isNotNull(), F.lit("date")))
        .when(full("ssn"), F.when(ssn, F.lit("ssn")))
        .when(full("phone"), F.lit("phone"))
        .when(full("card"), F.when(card, F.lit("card")))
    )


def _date(hit: Column, key: str, inverse: bool) -> Column:
    """A date of the same range, written like ``hit``."""

    def moved(day: Column) -> Column:
        out = F.lit(None).cast("date")
        for first, a, b in DATES:
            start = F.lit(first).cast("date")
            x = feistel(F.date_diff(day, start).cast("long"), F.lit(a).cast("long"), F.lit(b).cast("long"), key, F.lit(first), inverse)
            out = F.when(day.between(start, F.date_add(start, a * b - 1)), F.date_add(start, x.cast("int"))).otherwise(out)
        return out

    digits = lambda d: F.concat(F.lpad(F.year(d).cast("string"), 4, "0"), F.lpad(F.month(d).cast("string"), 2, "0"), F.lpad(F.day(d).cast("string"), 2, "0"))
    return _bound(_bound(_day(hit), moved), lambda d: _filled(hit, digits(d)))


def _pseudonym(hit: Column, kind: Column, key: str, inverse: bool) -> Column:
    digits = _digits(hit)
    part = lambda i: F.element_at(F.split(hit, r"\."), i).cast("long")
    number = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
    half = F.lit(65536).cast("long")
    ip = _bound(feistel(number, half, half, key, F.lit("ip"), inverse), lambda x: F.concat_ws(".", *(F.pmod(F.shiftright(x, s), F.lit(256)) for s in (24, 16, 8, 0))))
    card = _bound(_permuted_digits(F.left(digits, F.length(digits) - 1), key, "card", inverse), lambda x: _filled(hit, F.concat(x, _luhn(x))))
    country = F.length(F.regexp_extract(hit, r"^\+[0-9]{1,3}", 0))
    own = F.substr(hit, country + 1)
    phone = F.concat(F.left(hit, country), _bound(_permuted_digits(_digits(own), key, "phone", inverse), lambda x: _filled(own, x)))
    # The valid numbers, counted: areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
    of = lambda i, n: F.substr(hit, F.lit(i), F.lit(n)).cast("long")
    area = of(1, 3) - 1 - (of(1, 3) > 666).cast("int")
    big, small = F.lit(898 * 99).cast("long"), F.lit(9999).cast("long")
    counted = feistel((area * 99 + of(5, 2) - 1) * 9999 + of(8, 4) - 1, big, small, key, F.lit("ssn"), inverse)

    def written(x: Column) -> Column:
        serial = F.pmod(x, F.lit(9999)) + 1
        left = F.floor((x - serial + 1) / 9999).cast("long")
        group = F.pmod(left, F.lit(99)) + 1
        a = F.floor((left - group + 1) / 99).cast("long") + 1
        a = a + (a >= 666).cast("int")
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad(group.cast("string"), 2, "0"), F.lpad(serial.cast("string"), 4, "0"))

    user, domain = F.split_part(hit, F.lit("@"), F.lit(1)), F.split_part(hit, F.lit("@"), F.lit(2))
    email = F.concat(_permuted_user(user, key, F.lower(domain), inverse), F.lit("@"), domain)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "date", _date(hit, key, inverse)).when(kind == "card", card).when(kind == "ssn", _bound(counted, written)).when(kind == "phone", phone).otherwise(hit)


_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def _permuted_user(user: Column, key: str, domain: Column, inverse: bool) -> Column:
    """A user permuted among those whose capitals, small letters, digits and marks stand at the same places, for one domain."""
    half = F.floor(F.length(user) / 2).cast("int")
    start = F.struct(F.left(user, half).alias("l"), F.substr(user, half + 1).alias("r"))

    def shifted(text: Column, seed: Column) -> Column:
        def move(c: Column, i: Column) -> Column:
            by, out = _keyed_hash(key, seed, i), c
            for alphabet in _ALPHABETS:
                n, at = len(alphabet), F.instr(F.lit(alphabet), c) - 1
                out = F.when(at >= 0, F.substr(F.lit(alphabet), (F.pmod(at - by if inverse else at + by, F.lit(n)) + 1).cast("int"), F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), move), "")

    def turn(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        seed = lambda other: F.concat_ws(":", F.lit("user"), domain, i, other)
        return F.struct(F.when(even, shifted(s["l"], seed(s["r"]))).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(shifted(s["r"], seed(s["l"]))).alias("r"))

    return _bound(F.aggregate(_rounds(inverse), start, turn), lambda s: F.concat(s["l"], s["r"]))


def _marked(text: Column, key: str, inverse: bool) -> Column:
    """Hits of a text as (value, kind, pseudonym)."""
    hits = F.regexp_extract_all(text, F.lit(_ANY), 0)
    named = F.transform(hits, lambda h: F.struct(h.alias("value"), _kind(h).alias("kind")))
    return F.transform(named, lambda s: F.struct(s["value"].alias("value"), s["kind"].alias("kind"), _pseudonym(s["value"], s["kind"], key, inverse).alias("pseudonym")))


def find_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``found`` (array of value, kind, pseudonym, in order, valid ones only) and ``text`` with pseudonyms.

    ``key`` is a secret of the caller; ``inverse`` puts the values back.
    """
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # Without a digit or an @ nothing can match.
    rows = rows.withColumn("_all", F.when(text.rlike("[0-9@]"), _marked(text, key, inverse)))
    pieces = F.split(text, _ANY, -1)
    put = F.concat(pieces[0], F.array_join(F.zip_with("_all", F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda h, p: F.concat(h["pseudonym"], p)), ""))
    changed = F.when(F.size("_all") > 0, put).otherwise(text)
    valid = F.coalesce(F.filter("_all", lambda s: s["kind"].isNotNull()), F.array().cast("array<struct<value: string, kind: string, pseudonym: string>>"))
    return rows.select(F.col("_id").alias(id_col), valid.alias("found"), changed.alias("text"))
