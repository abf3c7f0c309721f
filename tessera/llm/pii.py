"""Format-preserving pseudonyms for personal data: validated values are permuted, under a key, within their format.

A value's kind fixes a domain of a * b values; an index in it is split into two parts that a Feistel
network of ROUNDS keyed rounds permutes (x = (x + F(y)) mod a, then y = (y + F(x)) mod b, in turn). Each
kind maps its domain onto itself, so equal values get equal pseudonyms in every document, different
strings get different ones, and the pseudonym has the same format and passes the same validation:

* ``email``: runs of letters and of digits of the local part keep their lengths and case; the domain stays;
* ``phone``: NANP numbers; area and exchange codes keep a first digit of 2 to 9;
* ``ip``: IPv4, octets 0 to 255 without leading zeros (text length may change);
* ``card``: 13 to 19 digits, bare or in groups of 4-4-4-4 or 4-6-5, that pass the Luhn check; the check digit is made anew;
* ``ssn``: ddd-dd-dddd with area 001 to 899 without 666, group and serial not zero;
* ``date``: 1900-01-01 to 2100-05-02 as YYYY-MM-DD, DD.MM.YYYY or DD/MM/YYYY, which share one permutation of days, so
  that a day stays linked across them; and to 2100-01-31 as MM/DD/YYYY where only that is a date, that is, with a
  day over 12: those strings are permuted among themselves.

What does not validate stays as it is. All of it is column expressions on each row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import located, rewritten

ROUNDS = 10
KINDS = ("email", "phone", "ip", "card", "ssn", "date")

#: The shapes, before validation, in the order of KINDS.
SHAPES = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    r"(?<![A-Za-z0-9])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?[A-Za-z0-9])",
    r"(?<![A-Za-z0-9])(?:(?:\d{4}[ -]){3}\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-])",
    r"(?<![A-Za-z0-9./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![A-Za-z0-9/-]|\.\d)",
)
ANY = "|".join(f"(?:{s})" for s in SHAPES)
_FIRST_DAY, _DAYS = "1900-01-01", (270, 271)
#: Months from 1900-01 of MM/DD/YYYY with a day over 12, and the number of such strings as a product.
_MONTHS, _LATE_DAYS = 2401, (204, 217)


def _one(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def feistel(x: Column, y: Column, a, b, tweak: Column, key: str) -> Column:
    """struct<x, y>: a keyed permutation of the pairs with 0 <= x < a and 0 <= y < b."""
    a, b = (v if isinstance(v, Column) else F.lit(v) for v in (a, b))
    a, b = a.cast("long"), b.cast("long")

    def mix(r, v):
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), v.cast("string")).cast("binary"), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def step(s, r):
        left, right = F.pmod(s["x"] + F.pmod(mix(r, s["y"]), a), a), F.pmod(s["y"] + F.pmod(mix(r, s["x"]), b), b)
        even = F.pmod(r, F.lit(2)) == 0
        return F.struct(F.when(even, left).otherwise(s["x"]).alias("x"), F.when(even, s["y"]).otherwise(right).alias("y"))

    zero = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), zero, step)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _power(base: int, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(base**i) for i in range(14 if base == 10 else 13)]), (n + 1).cast("int"))


def _div(x: Column, y: Column) -> Column:
    """x / y, whole, for x >= 0 and y > 0; floor(x / y) would go through doubles."""
    return F.call_function("div", x, y)


def _pair(s: Column, f) -> Column:
    """f(struct<n, u, v>) for the length of s and of its two parts."""
    n = F.char_length(s)
    return _one(F.struct(n.alias("n"), F.floor(n / 2).cast("int").alias("u"), (n - F.floor(n / 2)).cast("int").alias("v")), f)


def permute_digits(s: Column, tweak: Column, key: str) -> Column:
    """Digits of up to 19 places to as many digits."""

    def go(p):
        x = F.coalesce(F.substring(s, F.lit(1), p["u"]).try_cast("long"), F.lit(0))
        y = F.substring(s, p["u"] + 1, p["v"]).cast("long")
        out = feistel(x, y, _power(10, p["u"]), _power(10, p["v"]), F.concat_ws(":", tweak, p["n"].cast("string")), key)
        return _one(out, lambda o: F.concat(F.when(p["u"] > 0, F.lpad(o["x"].cast("string"), p["u"], F.lit("0"))).otherwise(""), F.lpad(o["y"].cast("string"), p["v"], F.lit("0"))))

    return _pair(s, go)


def permute_letters(s: Column, tweak: Column, key: str) -> Column:
    """Up to 24 lower-case letters to as many."""
    number = lambda part: F.aggregate(F.filter(F.split(part, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a * 26 + (F.ascii(c) - 97))

    def letters(v, n):
        places = F.when(n > 0, F.sequence(n - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(places, lambda i: F.char(F.pmod(_div(v, _power(26, i)), F.lit(26)) + 97)), "")

    def go(p):
        x, y = number(F.substring(s, F.lit(1), p["u"])), number(F.substring(s, p["u"] + 1, p["v"]))
        out = feistel(x, y, _power(26, p["u"]), _power(26, p["v"]), F.concat_ws(":", tweak, p["n"].cast("string")), key)
        return _one(out, lambda o: F.concat(letters(o["x"], p["u"]), letters(o["y"], p["v"])))

    return _pair(s, go)


def luhn_digit(payload: Column) -> Column:
    """The check digit (int) for the digits before it."""
    digits = F.reverse(F.filter(F.split(payload, ""), lambda c: c != ""))

    def worth(c, i):
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, v: a + v)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def _fill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, one by one, by digits."""
    step = lambda s, c: F.struct(F.when(c.rlike("[0-9]"), s["i"] + 1).otherwise(s["i"]).alias("i"), F.concat(s["o"], F.when(c.rlike("[0-9]"), F.substring(digits, s["i"] + 1, F.lit(1))).otherwise(c)).alias("o"))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit(0).alias("i"), F.lit("").alias("o")), step)["o"]


def _day_number(s: Column, fmt: str) -> Column:
    return F.datediff(F.try_to_date(s, fmt), F.lit(_FIRST_DAY).cast("date"))


def _day(s: Column) -> Column:
    """The number of the day of a date with the year or the day first; null out of the domain."""
    day = F.when(s.rlike("-"), _day_number(s, "yyyy-MM-dd")).when(s.rlike("/"), _day_number(s, "dd/MM/yyyy")).otherwise(_day_number(s, "dd.MM.yyyy"))
    return F.when((day >= 0) & (day < _DAYS[0] * _DAYS[1]), day)


def _month_start(m: Column) -> Column:
    """The first of the month m months after 1900-01, as a number of days, less the 12 days of each month that do not count."""
    return F.datediff(F.add_months(F.lit(_FIRST_DAY).cast("date"), m), F.lit(_FIRST_DAY).cast("date")) - 12 * m


def _late_day(s: Column) -> Column:
    """The number of MM/DD/YYYY among the dates with a day over 12; null out of the domain, or where DD/MM/YYYY is a date."""
    month = (F.substring(s, 7, 4).try_cast("int") - 1900) * 12 + F.substring(s, 1, 2).try_cast("int") - 1
    valid = s.rlike("/") & F.try_to_date(s, "MM/dd/yyyy").isNotNull() & (F.substring(s, 4, 2).try_cast("int") > 12)
    return F.when(valid & (month >= 0) & (month < _MONTHS), _day_number(s, "MM/dd/yyyy") - 12 * (month + 1))


def _late_text(number: Column) -> Column:
    """The MM/DD/YYYY of a number that _late_day gives."""
    # Months have 16 to 19 such days, so the even share of the number is at most one month off.
    guess = F.floor(number * _MONTHS / (_LATE_DAYS[0] * _LATE_DAYS[1])).cast("int")
    month = lambda n: F.array_max(F.filter(F.sequence(guess - 2, guess + 2), lambda m: (m >= 0) & (_month_start(m) <= n)))
    date = lambda m: F.date_add(F.add_months(F.lit(_FIRST_DAY).cast("date"), m), (number - _month_start(m) + 12).cast("int"))
    return _one(month(number), lambda m: F.date_format(date(m), "MM/dd/yyyy"))


def kind_of(s: Column) -> Column:
    """The kind of a match of ANY, or null where it fails validation."""
    d = _digits(s)
    octets_ok = F.forall(F.split(s, r"\."), lambda o: (o.cast("int") <= 255) & ~o.rlike("^0."))
    phone = F.substring(d, -10, 10)
    return (
        F.when(s.rlike("@"), F.lit("email"))
        .when(s.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.when(octets_ok, F.lit("ip")))
        .when(s.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})$"), F.when(_day(s).isNotNull() | _late_day(s).isNotNull(), F.lit("date")))
        .when(s.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(s.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"), F.lit("ssn")))
        .when(F.char_length(d) >= 13, F.when(luhn_digit(F.substring(d, F.lit(1), F.char_length(d) - 1)) == F.substring(d, -1, 1).cast("int"), F.lit("card")))
        .otherwise(F.when(phone.rlike(r"^[2-9]\d\d[2-9]\d{6}$"), F.lit("phone")))
    )


def pseudonym(s: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a validated value."""
    d = _digits(s)

    def card():
        body = permute_digits(F.substring(d, F.lit(1), F.char_length(d) - 1), F.lit("card"), key)
        return _one(body, lambda p: _fill(s, F.concat(p, luhn_digit(p).cast("string"))))

    def phone():
        n = F.substring(d, -10, 10)
        part = lambda at, size: F.substring(n, at, size).cast("long")
        new = feistel((part(1, 3) - 200) * 100 + F.floor((part(4, 3) - 200) / 8), F.pmod(part(4, 3) - 200, F.lit(8)) * 10000 + part(7, 4), 80_000, 80_000, F.lit("phone"), key)
        whole = lambda o: F.concat(F.substring(d, F.lit(1), F.char_length(d) - 10), (F.floor(o["x"] / 100) + 200).cast("string"), (F.pmod(o["x"], F.lit(100)) * 8 + F.floor(o["y"] / 10000) + 200).cast("string"), F.lpad(F.pmod(o["y"], F.lit(10000)).cast("string"), 4, "0"))
        return _one(new, lambda o: _fill(s, whole(o)))

    def ip():
        o = F.split(s, r"\.")
        at = lambda i: F.element_at(o, i).cast("long")
        new = feistel(at(1) * 256 + at(2), at(3) * 256 + at(4), 65536, 65536, F.lit("ip"), key)
        return _one(new, lambda v: F.concat_ws(".", *[f.cast("string") for f in (F.floor(v["x"] / 256), F.pmod(v["x"], F.lit(256)), F.floor(v["y"] / 256), F.pmod(v["y"], F.lit(256)))]))

    def ssn():
        area = F.substring(s, 1, 3).cast("long")
        area = area - 1 - F.when(area > 666, 1).otherwise(0)
        new = feistel(area * 99 + F.substring(s, 5, 2).cast("long") - 1, F.substring(s, 8, 4).cast("long") - 1, 898 * 99, 9999, F.lit("ssn"), key)

        def text(v):
            a = F.floor(v["x"] / 99) + 1
            a = a + F.when(a >= 666, 1).otherwise(0)
            return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.pmod(v["x"], F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((v["y"] + 1).cast("string"), 4, "0"))

        return _one(new, text)

    def date():
        new = feistel(F.floor(_day(s) / _DAYS[1]), F.pmod(_day(s), F.lit(_DAYS[1])), _DAYS[0], _DAYS[1], F.lit("date"), key)
        late = feistel(F.floor(_late_day(s) / _LATE_DAYS[1]), F.pmod(_late_day(s), F.lit(_LATE_DAYS[1])), _LATE_DAYS[0], _LATE_DAYS[1], F.lit("late"), key)

        def text(v):
            at = F.date_add(F.lit(_FIRST_DAY).cast("date"), (v["x"] * _DAYS[1] + v["y"]).cast("int"))
            return F.when(s.rlike("-"), F.date_format(at, "yyyy-MM-dd")).when(s.rlike("/"), F.date_format(at, "dd/MM/yyyy")).otherwise(F.date_format(at, "dd.MM.yyyy"))

        return F.when(_day(s).isNotNull(), _one(new, text)).otherwise(_one(late, lambda v: _late_text(v["x"] * _LATE_DAYS[1] + v["y"])))

    def email():
        at = F.instr(s, "@")
        local = F.substring(s, F.lit(1), at - 1)
        runs = F.regexp_extract_all(local, F.lit(r"[a-z]{1,24}|[A-Z]{1,24}|[0-9]{1,18}|[^A-Za-z0-9]+"), F.lit(0))
        one = lambda r: F.when(r.rlike("[a-z]"), permute_letters(r, F.lit("low"), key)).when(r.rlike("[A-Z]"), F.upper(permute_letters(F.lower(r), F.lit("up"), key))).when(r.rlike("[0-9]"), permute_digits(r, F.lit("local"), key)).otherwise(r)
        return F.concat(F.array_join(F.transform(runs, lambda r: one(r)), ""), F.substring(s, at, F.char_length(s)))

    return F.when(kind == "email", email()).when(kind == "phone", phone()).when(kind == "ip", ip()).when(kind == "card", card()).when(kind == "ssn", ssn()).otherwise(date())


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """docs with text_col pseudonymised and spans_col: array<struct<start, end, m, kind, new>>, offsets in the text as it came.

    key decides the permutations: who has it can undo them, so keep it secret. Whole texts are searched. A null text
    stays null and an empty one empty, both with an empty array. Repeated rows get equal results; other columns stay, one
    named spans_col is replaced.
    """
    if not key:
        raise ValueError("a key is needed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = F.transform(located(text, ANY), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), kind_of(x["m"]).alias("kind")))
    valid = F.filter(kinds, lambda x: x["kind"].isNotNull())
    named = F.transform(valid, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), x["kind"].alias("kind"), pseudonym(x["m"], x["kind"], key).alias("new")))
    return docs.withColumn(spans_col, named).withColumn(text_col, rewritten(F.col(text_col), F.col(spans_col), lambda x: x["new"]))
