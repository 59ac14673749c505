import hashlib
import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from newsquery.llm import pii

KEY = "test key"


def mac(*parts):
    inner = hashlib.sha256("|".join([KEY, *map(str, parts)]).encode()).hexdigest()
    return int(hashlib.sha256(f"{inner}|{KEY}".encode()).hexdigest()[:12], 16)


def feistel(left, right, a, b, tweak):
    for i in range(1, pii.ROUNDS // 2 + 1):
        left = (left + mac(tweak, i, "l", right)) % a
        right = (right + mac(tweak, i, "r", left)) % b
    return left, right


def digits(d, tweak):
    half = len(d) // 2
    a, b = feistel(int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half), f"{tweak}:{len(d)}")
    return str(a).zfill(half) + str(b).zfill(len(d) - half)


def luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10


def in_format(text, d):
    d = iter(d)
    return re.sub("[0-9]", lambda m: next(d), text)


def card(text):
    d = re.sub(r"\D", "", text)
    body = d[0] + digits(d[1:-1], "card" + d[0])
    return in_format(text, body + str(-luhn(body + "0") % 10))


def phone(text):
    d = re.sub(r"\D", "", text)
    return in_format(text, d[:-10] + digits(d[-10:], "phone"))


def ip(text):
    o = [int(x) for x in text.split(".")]
    a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
    return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"


def iso(text):
    day = (date.fromisoformat(text) - date(1800, 1, 1)).days
    a, b = feistel(day // 365, day % 365, 400, 365, "date")
    return (date(1800, 1, 1) + timedelta(a * 365 + b)).isoformat()


CASES = [("4111 1111 1111 1111", "card", card), ("4111111111111111", "card", card), ("378282246310005", "card", card), ("+1 (988) 555-2485", "phone", phone), ("988-555-2485", "phone", phone), ("70.123.182.155", "ip", ip), ("2024-02-29", "date", iso), ("1800-01-01", "date", iso)]


def ssn(text):
    d = "".join(re.findall(r"\d", text))
    while True:
        d = digits(d, "ssn")
        if not re.search(r"^(?:000|666|9)|^...00|0000$", d):
            return in_format(text, d)


def american(text):
    """Walks the permutation of days until one reads with the month first only."""
    day = (date(int(text[6:]), int(text[:2]), int(text[3:5])) - date(1800, 1, 1)).days
    while True:
        a, b = feistel(day // 365, day % 365, 400, 365, "date")
        day = a * 365 + b
        d = date(1800, 1, 1) + timedelta(day)
        if d.day > 12:
            return d.strftime(f"%m{text[2]}%d{text[2]}") + f"{d.year:04}"


def far(text):
    n = (date(int(text[6:]), int(text[3:5]), int(text[:2])) - date(1, 1, 1)).days
    while True:
        a, b = feistel(n // 1911, n % 1911, 1912, 1911, "far date")
        n = a * 1911 + b
        if n < 3652059:
            d = date(1, 1, 1) + timedelta(n)
            if not 0 <= (d - date(1800, 1, 1)).days < 146000:
                return f"{d.day:02}.{d.month:02}.{d.year:04}"


def national(code):
    return lambda text: in_format(text, code + digits("".join(re.findall(r"\d", text))[len(code) :], "phone"))


CASES += [(v, "ssn", ssn) for v in ("078-05-1120", "219-09-9999", "001-01-0001", "899-99-9999")]
CASES += [("12/31/1999", "date", american), ("02.28.2020", "date", american), ("31.12.1799", "date", far), ("01.01.2500", "date", far)]
CASES += [("+49 30 1234567", "phone", national("49")), ("+33 1 42 68 53 00", "phone", national("33")), ("+44 20 7946 0958", "phone", national("44")), ("+354 512 3456", "phone", national("354")), ("+1 212 555 0187", "phone", national("1"))]


@pytest.mark.parametrize("value,kind,plain", CASES)
def test_values_against_plain_python(spark, value, kind, plain):
    df = spark.createDataFrame([(f"before {value}, after", "x")], "text string, found string")
    row = pii.pseudonymise(df, KEY).first()
    assert row["text"] == f"before {plain(value)}, after" != f"before {value}, after"
    assert [(x["kind"], x["pseudonym"]) for x in row["found"]] == [(kind, plain(value))]


def test_whole_texts(spark):
    rng = random.Random(1)
    values = {"a.b77@mail8.example.com": "email", "DE89 3704 0044 0532 0130 00": "iban", "31.12.1999": "date", "01/02/2003": "date", "4111111111111111": "card"}
    bad = ["300.1.1.1", "1.2.3.4.5", "4111111111111112", "2023-02-30", "000-12-3456", "12345", "v1.2.3", "DE88 3704 0044 0532 0130 00", "a@b"]
    texts = [" ".join(rng.choice(["the", "\n", *values, *bad]) for _ in range(60)) for _ in range(20)] + [None, "", "no digits", "4111111111111111", "x" * 200000 + " 31.12.1999"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, KEY).collect()}
    again = {}
    for i, t in enumerate(texts):
        if not t:
            assert got[i]["text"] == t and got[i]["found"] == (None if t is None else [])
            continue
        before, after = re.split(r"(?<=[\s])", t), re.split(r"(?<=[\s])", got[i]["text"])
        assert len(t) == len(got[i]["text"])
        for v in bad:
            assert t.count(v) <= got[i]["text"].count(v) + sum(v in x and v != x for x in values)
        for v in values:
            assert v not in got[i]["text"]
        if "IBAN" not in t and len(before) == len(after):
            for x, y in zip(before, after):
                if x.strip() in values:
                    assert again.setdefault(x.strip(), y.strip()) == y.strip()
    assert again["31.12.1999"] != "31.12.1999" and re.fullmatch(r"\d\d\.\d\d\.\d{4}", again["31.12.1999"])
    assert re.fullmatch(r"[a-z]\.[a-z]\d\d@[a-z]{4}\d\.example\.com", again["a.b77@mail8.example.com"])
    assert luhn(again["4111111111111111"]) == 0


def test_permutations_hit_no_value_twice(spark):
    small = spark.range(10000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"))
    assert small.select(pii._permuted_digits(F.col("d"), KEY, F.lit("x")).alias("p")).distinct().count() == 10000
    days = spark.range(0, 146000, 7).select(F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    moved = days.select(pii._date(F.col("d"), KEY).alias("p"))
    assert moved.distinct().count() == days.count() and moved.filter("p is null or not p rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'").count() == 0
    mails = spark.range(2000).select(F.concat(F.lit("ab"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("@x.example.com")).alias("m"))
    assert mails.select(pii._email(F.col("m"), KEY).alias("p")).distinct().count() == 2000


def test_iban_stays_valid_and_keys_matter(spark):
    df = spark.createDataFrame([("GB82WEST12345698765432",)], "text string")
    one, other = pii.pseudonymise(df, KEY).first()["text"], pii.pseudonymise(df, "other").first()["text"]
    turned = "".join(str(int(c, 36)) for c in one[4:] + one[:4])
    assert int(turned) % 97 == 1 and one[:2] == "GB" and one[4:8] == "WEST" and one != other


def test_no_python_in_the_plan_and_columns_kept(spark):
    df = spark.createDataFrame([(1, "31.12.1999", 2, None)], "found int, text string, __x int, kind string")
    out = pii.pseudonymise(df, KEY, found_col=None)
    assert out.columns == df.columns and out.first()["found"] == 1
    plan = pii.pseudonymise(df, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert pii.pseudonymise(df.limit(0), KEY).collect() == []


@pytest.mark.parametrize(("text", "value"), [("card 4111 1111 1111 1111 12/25 ok", "4111 1111 1111 1111"), ("pay 4111 1111 1111 1111 123 now", "4111 1111 1111 1111"), ("BE68 5390 0754 7034 BIC GKCC", "BE68 5390 0754 7034"), ("4111-1111-1111-1111-987", "4111-1111-1111-1111"), ("DE89 3704 0044 0532 0130 00 USD", "DE89 3704 0044 0532 0130 00"), ("+44 20 7946 0958 2024", "+44 20 7946 0958")])
def test_what_follows_a_value_stays(spark, text, value):
    df = spark.createDataFrame([(text,), (value,)], "text string")
    whole, alone = (r["text"] for r in pii.pseudonymise(df, KEY).collect())
    assert whole == text.replace(value, alone) and alone != value and len(alone) == len(value)


def test_invalid_values_stay_and_pseudonyms_are_valid(spark):
    rng = random.Random(8)
    ssns = [f"{rng.randint(1, 899):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}" for _ in range(3000)]
    ssns = [x for x in ssns if not x.startswith("666")]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame([(x,) for x in ssns], "text string"), KEY).collect()]
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in got)
    assert len(set(got)) == len(set(ssns))
    days = [f"{d.month:02}/{d.day:02}/{d.year}" for k in range(0, 140000, 97) if (d := date(1800, 1, 1) + timedelta(k)).day > 12]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame([(x,) for x in days], "text string"), KEY).collect()]
    assert len(set(got)) == len(set(days)) and all(int(x[3:5]) > 12 and int(x[:2]) <= 12 for x in got)
    bad = ["666-12-3456", "31.02.2000", "13/32/1999", "00.00.0000", "+12 3", "4111 1111 1111 1112 12/25"]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame([(x,) for x in bad], "text string"), KEY).collect()]
    assert got == bad


def test_clashing_names(spark):
    df = spark.createDataFrame([("31.12.1999", 1, 2, 3)], "text string, __pieces0 int, __done0 int, __pieces int")
    out = pii.pseudonymise(df, KEY)
    assert out.columns == [*df.columns, "found"] and tuple(out.first())[1:4] == (1, 2, 3)
