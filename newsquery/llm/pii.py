"""Format-preserving pseudonyms: validated numbers, dates and addresses are permuted by keyed Feistel networks.

Everything here is DataFrame functions: no Python runs on the executors. A value is split into two numbers L and R,
and each round adds a keyed hash of one to the other, modulo the number of values it may take. Such rounds can be
undone, so different values of a format never get the same pseudonym, and equal values get equal ones in all
documents, which stay linked. Card numbers keep their first digit and get a right check digit, dates stay dates of
the calendar, addresses stay addresses, and separators stay where they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: The kinds in the order in which a piece of text is tried; all of them are found by one scan of the text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "date": r"(?<![\d./-])(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\d/-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<!\d)(?:\d{4}[ -]\d{6}[ -]\d{5}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3}(?![/.-]?\d))?|\d{13,19})(?!\d)",
    "phone": r"(?<![\d+])(?:(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,4}(?:[ .-]?\(?\d{1,4}\)?){2,6})(?!\d)",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(PATTERNS.values())
#: Days from 1800-01-01 that dates are permuted in, as 400 * 365; those before and after are permuted among themselves.
DATE_HALVES = (400, 365)
#: Days from 0001-01-01 to 9999-12-31, and two halves whose product is little more.
ALL_DAYS, ALL_HALVES = 3652059, (1912, 1911)
#: How long country calling codes are that don't have three digits.
CALLING = {1: "^[17]", 2: "^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"}
#: A walk along a permutation's cycle ends at the first valid value, and takes more steps than this once in 10^20.
WALK = 60


def _mac(key: str, *parts: Column) -> Column:
    """A keyed hash as a number below 2^48."""
    text = F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.sha2(text, 256), F.lit(key)), 256), 1, 12), 16, 10).cast("long")


def _feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """struct(l, r): the pair permuted in [0, a) x [0, b)."""

    def one(state: Column, i: Column) -> Column:
        l2 = F.pmod(state["l"] + F.pmod(_mac(key, tweak, i, F.lit("l"), state["r"]), a), a)
        return F.struct(l2.alias("l"), F.pmod(state["r"] + F.pmod(_mac(key, tweak, i, F.lit("r"), l2), b), b).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), one)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _permuted_digits(digits: Column, key: str, tweak: Column) -> Column:
    """Digits (2 to 36 of them) permuted among all strings of as many digits."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n)
    a, b = F.pow(F.lit(10), half).cast("long"), F.pow(F.lit(10), n - half).cast("long")
    return F.transform(
        F.array(_feistel(left.cast("long"), right.cast("long"), a, b, key, F.concat_ws(":", tweak, n.cast("string")))),
        lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), n - half, "0")),
    )[0]


def _in_format(text: Column, digits: Column) -> Column:
    """The text with its digits replaced in turn."""
    chars = F.split(text, "")
    is_digit = lambda c: c.rlike("^[0-9]$")
    placed = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(is_digit(c), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    return placed["out"]


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of 10 for a valid number."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: F.when(c == "", F.lit(0)).otherwise(_doubled(c.cast("int"), F.pmod(n - 1 - i, F.lit(2)))))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _doubled(digit: Column, twice: Column) -> Column:
    return F.when(twice == 0, digit).otherwise(digit * 2 - F.when(digit > 4, F.lit(9)).otherwise(F.lit(0)))


def _card(text: Column, key: str) -> Column:
    """The first digit stays; those between it and the check digit are permuted, and the check digit is made to fit."""
    d = _digits(text)
    n = F.length(d)
    head = F.substring(d, 1, 1)
    body = F.concat(head, _permuted_digits(F.substring(d, F.lit(2), n - 2), key, F.concat(F.lit("card"), head)))
    return F.transform(F.array(body), lambda b: _in_format(text, F.concat(b, F.pmod(10 - F.pmod(_luhn(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))))[0]


def _octets(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), lambda x: x.cast("int"))


def _ip(text: Column, key: str) -> Column:
    o = _octets(text)
    pair = _feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    return F.transform(F.array(pair), lambda s: F.concat_ws(".", F.floor(s["l"] / 256).cast("string"), F.pmod(s["l"], F.lit(256)).cast("string"), F.floor(s["r"] / 256).cast("string"), F.pmod(s["r"], F.lit(256)).cast("string")))[0]


def _walked(first: Column, again, fine) -> Column:
    """The first value along a permutation's cycle, from ``first`` on, that is ``fine``.

    ``again`` permutes a value. What starts at a valid value ends at one, and different ones end at different ones.
    """
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(fine(x), x).otherwise(again(x)))


def _read_dates(text: Column) -> Column:
    """[the day read with the month behind the day, the day read with the month before it], null where the calendar has none.

    yyyy-MM-dd and yyyy/MM/dd have the first alone; else dd.MM.yyyy and dd/MM/yyyy come before MM.dd.yyyy and MM/dd/yyyy.
    """
    year_first = text.rlike("^[0-9]{4}")
    part = lambda at, n: F.substring(text, at, n)
    day = lambda *parts: F.try_to_timestamp(F.concat_ws("-", *parts), F.lit("yyyy-MM-dd")).cast("date")
    return F.array(
        F.when(year_first, day(part(1, 4), part(6, 2), part(9, 2))).otherwise(day(part(7, 4), part(4, 2), part(1, 2))),
        F.when(~year_first, day(part(7, 4), part(1, 2), part(4, 2))),
    )


def _is_date(text: Column) -> Column:
    return F.exists(_read_dates(text), lambda d: d.isNotNull() & (F.year(d) >= 1))


def _moved_day(day: Column, key: str, fine=lambda day: F.lit(True)) -> Column:
    """A day permuted among those of 1800-2199, or among all others of the calendar; only ``fine`` ones if it is one."""
    start, (a, b), (c, d) = F.lit("1800-01-01").cast("date"), DATE_HALVES, ALL_HALVES
    at = lambda s, n: s["l"] * n + s["r"]
    near = lambda x: F.transform(F.array(_feistel(F.floor(F.datediff(x, start) / b), F.pmod(F.datediff(x, start), F.lit(b)), F.lit(a), F.lit(b), key, F.lit("date"))), lambda s: F.date_add(start, at(s, b).cast("int")))[0]
    # far days are numbered, as some numbers stand for no day
    one = F.lit("0001-01-01").cast("date")
    as_day = lambda n: F.date_add(one, n.cast("int"))
    far = lambda n: F.transform(F.array(_feistel(F.floor(n / d), F.pmod(n, F.lit(d)), F.lit(c), F.lit(d), key, F.lit("far date"))), lambda s: at(s, d))[0]
    is_near = lambda x: F.datediff(x, start).between(0, a * b - 1)
    ends = lambda n: F.when(n < ALL_DAYS, ~is_near(as_day(n)) & fine(as_day(n))).otherwise(F.lit(False))
    return F.when(is_near(day), _walked(near(day), near, fine)).otherwise(as_day(_walked(far(F.datediff(day, one).cast("long")), far, ends)))


def _date(text: Column, key: str) -> Column:
    """The day moved and written as it was; what only reads with the month first stays so."""
    year_first = text.rlike("^[0-9]{4}")
    mark = F.when(year_first, F.substring(text, 5, 1)).otherwise(F.substring(text, 3, 1))
    written = lambda d, *parts: F.concat_ws("", F.date_format(d, parts[0]), mark, F.date_format(d, parts[1]), mark, F.date_format(d, parts[2]))
    read = _read_dates(text)
    usual = lambda x: F.transform(F.array(_moved_day(x[0], key)), lambda d: F.when(year_first, written(d, "yyyy", "MM", "dd")).otherwise(written(d, "dd", "MM", "yyyy")))[0]
    month_first = lambda x: F.transform(F.array(_moved_day(x[1], key, lambda d: F.dayofmonth(d) > 12)), lambda d: written(d, "MM", "dd", "yyyy"))[0]
    return F.transform(F.array(read), lambda x: F.when(x[0].isNotNull(), usual(x)).otherwise(month_first(x)))[0]


def _ssn_valid(digits: Column) -> Column:
    return ~digits.rlike("^(?:000|666|9)|^...00|0000$")


def _ssn(text: Column, key: str) -> Column:
    again = lambda d: _permuted_digits(d, key, F.lit("ssn"))
    return _in_format(text, _walked(again(_digits(text)), again, _ssn_valid))


def _country(text: Column) -> Column:
    """How many digits of a phone number are no national ones: a calling code behind a +, else what comes before the last ten."""
    d = _digits(text)
    coded = F.when(d.rlike(CALLING[1]), 1).when(d.rlike(CALLING[2]), 2).otherwise(3)
    return F.when(text.startswith("+"), coded).otherwise(F.length(d) - 10)


def _phone(text: Column, key: str) -> Column:
    """The national digits permuted; a number has the same with and without its calling code."""
    d, n = _digits(text), _country(text)
    return _in_format(text, F.concat(F.substring(d, F.lit(1), n), _permuted_digits(F.substring(d, n + 1, F.length(d)), key, F.lit("phone"))))


def _shifted(text: Column, by: Column, key: str, tweak: str) -> Column:
    """Each letter and digit of ``text`` moved within its class by a stream keyed with ``by``; other characters stay."""

    def moved(c: Column, base: str, size: int, i: Column) -> Column:
        return F.char(F.ascii(F.lit(base)) + F.pmod(F.ascii(c) - F.ascii(F.lit(base)) + F.pmod(_mac(key, F.lit(tweak), by, i), F.lit(size)), F.lit(size)))

    def one(c: Column, i: Column) -> Column:
        return F.when(c.rlike("^[a-z]$"), moved(c, "a", 26, i)).when(c.rlike("^[A-Z]$"), moved(c, "A", 26, i)).when(c.rlike("^[0-9]$"), moved(c, "0", 10, i)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _email(text: Column, key: str) -> Column:
    """The part before the last two labels of the domain, as two strings that shift each other; the case doesn't matter for the shifts."""
    tail = F.regexp_extract(text, r"[A-Za-z0-9-]+\.[A-Za-z0-9-]+$", 0)
    body = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
    half = F.floor(F.length(body) / 2).cast("int")
    state = F.struct(F.substring(body, F.lit(1), half).alias("l"), F.substring(body, half + 1, F.length(body)).alias("r"), F.lower(tail).alias("t"))

    def one(s: Column, i: Column) -> Column:
        l2 = F.array_join(F.transform(F.array(s["l"]), lambda x: _shifted(x, F.concat_ws("|", i.cast("string"), F.lower(s["r"]), s["t"]), key, "l")), "")
        return F.transform(F.array(l2), lambda y: F.struct(y.alias("l"), _shifted(s["r"], F.concat_ws("|", i.cast("string"), F.lower(y), s["t"]), key, "r").alias("r"), s["t"].alias("t")))[0]

    return F.transform(F.array(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), state, one)), lambda s: F.concat(s["l"], s["r"], tail))[0]


def _iban_valid(text: Column) -> Column:
    """Remainder 1 by 97 with the first four characters last and letters as numbers from 10."""
    s = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).when(value(c) < 10, F.pmod(r * 10 + value(c), F.lit(97))).otherwise(F.pmod(r * 100 + value(c), F.lit(97))))
    return F.length(s).between(15, 34) & (rest == 1)


def _iban(text: Column, key: str) -> Column:
    """Country and letters stay; the other digits are permuted and the check digits made to fit."""
    s = F.regexp_replace(text, " ", "")
    rest = F.substring(s, F.lit(5), F.length(s))
    shape = F.regexp_replace(rest, "[0-9]", "0")
    d = _digits(rest)
    many = F.when(F.length(d) < 2, d).otherwise(_permuted_digits(d, key, F.concat_ws(":", F.lit("iban"), F.substring(s, 1, 2), shape)))
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)

    def checked(moved: Column) -> Column:
        turned = F.concat(moved, F.substring(s, 1, 2), F.lit("00"))
        left = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).when(value(c) < 10, F.pmod(r * 10 + value(c), F.lit(97))).otherwise(F.pmod(r * 100 + value(c), F.lit(97))))
        return F.concat(F.lpad((98 - left).cast("string"), 2, "0"), _digits(moved))

    return F.transform(F.array(_in_format(rest, many)), lambda moved: _in_format(text, checked(moved)))[0]


def kind_of(text: Column) -> Column:
    """The kind of a piece found by ``ANY``, or null if it fails its kind's validation."""
    d = _digits(text)
    whole = {k: text.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    valid = {
        "email": F.lit(True),
        "date": _is_date(text),
        "ip": F.forall(_octets(text), lambda x: x <= 255) & ~text.rlike(r"(?:^|\.)0[0-9]"),
        "ssn": _ssn_valid(d),
        "iban": _iban_valid(text),
        "card": F.length(d).between(13, 19) & (F.pmod(_luhn(d), F.lit(10)) == 0),
        "phone": F.when(text.startswith("+"), (F.length(d) - _country(text)).between(7, 12) & (F.length(d) <= 15)).otherwise(F.length(d).between(10, 13) & (text.rlike("[^0-9]") | (F.length(d) == 10))),
    }
    return reduce(lambda w, k: w.when(whole[k] & valid[k], k), KINDS[1:], F.when(whole["email"] & valid["email"], "email"))


def pseudonym(text: Column, kind: Column, key: str) -> Column:
    """The pseudonym of one value of a kind; values without a kind stay."""
    return (
        F.when(kind == "email", _email(text, key))
        .when(kind == "date", _date(text, key))
        .when(kind == "ip", _ip(text, key))
        .when(kind == "ssn", _ssn(text, key))
        .when(kind == "iban", _iban(text, key))
        .when(kind == "card", _card(text, key))
        .when(kind == "phone", _phone(text, key))
        .otherwise(text)
    )


def _value_in(match: Column) -> Column:
    """struct(m, v, k): a match of ``ANY``, the value that it begins with, and its kind.

    That is the whole match, or else the longest part that is valid with up to four groups at the end cut off: these
    may be the number behind a card, or the words behind an IBAN. Sixteen digits in fours go before the same with up
    to three more, so that a card has one pseudonym whatever follows it. No kind: no part is valid.
    """
    cut = match
    parts = [match]
    for _ in range(4):
        cut = F.regexp_replace(cut, "[ .-][A-Za-z0-9]{1,4}$", "")
        parts.append(cut)
    longer = match.rlike("^[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}$")
    tried = F.transform(F.when(longer, F.array(parts[1], match)).when(match.rlike("^[A-Z0-9+(][^@]*[ .-][A-Za-z0-9]{1,4}$"), F.array_distinct(F.array(*parts))).otherwise(F.array(match)), lambda x: F.struct(x.alias("v"), kind_of(x).alias("k")))
    best = F.filter(tried, lambda x: x["k"].isNotNull())
    return F.transform(F.array(F.get(best, F.lit(0))), lambda x: F.struct(match.alias("m"), F.coalesce(x["v"], match).alias("v"), x["k"].alias("k")))[0]


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = "found") -> DataFrame:
    """``docs`` with the values in ``text_col`` replaced by pseudonyms, all other columns and rows as they are.

    With ``found_col``, a column of that name (it replaces one that has it) lists (kind, value's pseudonym) of the
    values replaced. One narrow stage of expressions; texts without a digit or an @ aren't scanned further. ``key``
    is the secret: it is part of the plan, so take it from a secret store and keep plans and logs private.

    Null texts stay null with a null list, empty ones empty with an empty list. What looks like a value but fails
    validation (an octet over 255, a day that isn't in the calendar, a wrong check digit) is left alone. The last two
    labels of an e-mail's domain, a card's first digit, an IBAN's country and letters and a phone's calling code stay.
    """
    text = F.col(text_col).cast("string")
    may = text.rlike("[0-9]|@")
    # names that no column of the frame has
    pieces, replaced = (next(n for k in range(len(docs.columns) + 1) if (n := f"__{base}{k}") not in docs.columns) for base in ("pieces", "done"))
    matches = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), _value_in)
    done = F.transform(pieces, lambda x: F.struct(x["k"].alias("kind"), pseudonym(x["v"], x["k"], key).alias("pseudonym"), F.substring(x["m"], F.length(x["v"]) + 1, F.length(x["m"])).alias("rest")))
    rows = docs.withColumn(pieces, F.when(may, matches)).withColumn(replaced, F.when(F.exists(pieces, lambda x: x["k"].isNotNull()), done))
    between = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(between, replaced, lambda a, b: F.concat(a, F.coalesce(b["pseudonym"], F.lit("")), F.coalesce(b["rest"], F.lit("")))), "")
    # the list first: it is read from the pieces, which go
    listed = F.transform(F.filter(replaced, lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["pseudonym"].alias("pseudonym")))
    out = rows if found_col is None else rows.withColumn(found_col, F.when(text.isNotNull(), F.coalesce(listed, F.expr("cast(array() as array<struct<kind: string, pseudonym: string>>)"))))
    return out.withColumn(text_col, F.when(F.col(replaced).isNotNull(), joined).otherwise(text)).drop(pieces, replaced)
