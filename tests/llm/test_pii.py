"""Pseudonyms: SQL on odd rows, round trips, one-to-one maps, and validity."""

import datetime
import re

import pytest

from driftline.llm import pii

from .test_llm import spark_rows, sql_rows

TEXTS = [
    None, "", " ", "plain words, 12 of them, abc3 44.5 and 2020", "call +1 (523) 555-1055 or 523-555-1055, 1.523.555.1055, (523)555 1055 or 523-155-1055",
    "card 4465758382889437 4465758382889437, 4465-7583-8288-9437, 4465 7583 8288 9437 and 4465758382889438; 3782 822463 10005 3782-822463-10005 x4465758382889437 4465758382889437y",
    "ip 152.143.123.131### 10.0.0.1 256.1.1.1 1.2.3 1.2.3.4.5 01.2.3.4 224.1.1.1", "2020-02-29T10:00 29.02.2020 02/29/2020 2020/2/9 31.02.2020 1.1.1900 12/31/2084 01.01.2085 2019-02-29",
    "GB82 WEST 1234 5698 7654 32 GB82WEST12345698765432 DE89370400440532013000, DE88370400440532013000", "078-05-1120 899-99-9999 667-01-0001 665-01-0001 000-12-1234 666-12-1234 900-12-1234 123-00-1234 123-12-0000",
    'token = "11acdfb36bb72224148e6160f674b4be45601bff" ' + "AB12" * 8 + " " + "aB12" * 8 + " " + "abcd" * 8 + " " + "a1" * 17, "a.B-9@mail3.example.com### x@y me@host.c0m ~q@d.org, Z@d.org.",
    "3/5/2020 3/05/2020 03/5/2020 2/29/2020 29/2/2020 29/02/2020 31/12/2019 31/1/2084 13/13/2019 31/4/2019 2020-3-5 2020-3-05T09 2020-12-5 2020-2-29 5.3.2020 29.2.2000 05.3.2020 5.03.2020 1/31/1900",
    "+1 212 155 1234 +12121551234 +1 212 555 12 2125551234 2121551234 1125551234 12125551234 x2125551234 +1-212-555-1234",
    "+44 20 7946 0958 +33123456789 +1 523 555 1055 +15235551055 +12 +123456789012345678", "4465758382889437 " * 3000, "a" * 30000 + "1" * 40000, "1." * 3000, "é4465758382889437ü\n4465758382889437\x00", "${1} \\1 4465758382889437 $0",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "m", 3, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, m string, n_card int, found string")


def test_same_rows_as_sql(spark):
    docs = frame(spark, [*TEXTS, TEXTS[5], TEXTS[5]])
    got = pii.pseudonymise(docs)
    assert got.columns == ["doc_id", "text", "m", "found", "n_pseudonyms", *[f"n_{k}" for k in pii.KINDS]]
    assert spark_rows(got.drop("m", "found")) == sql_rows(pii.OP1_SQL, documents=docs.select("doc_id", "text"))
    assert pii.pseudonymise(docs.where("false")).count() == 0
    found = got.agg({f"n_{k}": "sum" for k in pii.KINDS}).first()
    assert all(found), found


def test_restored(spark):
    docs = frame(spark, TEXTS)
    other = pii.pseudonymise(docs, "another key")
    back = {r["doc_id"]: r["text"] for r in pii.restore(other, "another key").collect()}
    for i, t in enumerate(TEXTS):
        assert back[i] == t, i
    assert all(re.sub("[0-9]", "0", a["text"]) == re.sub("[0-9]", "0", TEXTS[7]) for a in other.where("doc_id = 7").collect())  # widths stay
    plain = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs).collect()}
    assert all(plain[r["doc_id"]] != r["text"] for r in other.collect() if r["n_pseudonyms"])


def luhn(s):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def card(i):
    body = f"4{i * 7919:014}"
    return body + str(-sum(d if n % 2 else 2 * d - 9 * (d > 4) for n, d in enumerate(map(int, reversed(body)))) % 10)


def iban(i):
    account = f"WEST{i * 104729:014}"
    return f"GB{98 - int(''.join(str(int(c, 36)) for c in account + 'GB00')) % 97:02}{account}"


FIRST = datetime.date(1900, 1, 1)
ALL_DAYS = [FIRST + datetime.timedelta(n) for n in range(pii.DATE_P * pii.DATE_Q)]
#: Values of one format, and whether they are all of it, so that the pseudonyms are the same set.
VALUES = {
    "date wide": ([t.isoformat() for t in ALL_DAYS], True),
    "date short both": ([f"{t.month}/{t.day}/{t.year}" for t in ALL_DAYS if t.month < 10 and t.day < 10], True),
    "date short month": ([f"{t.year}-{t.month}-{t.day:02}" for t in ALL_DAYS if t.month < 10], True),
    "date short day": ([f"{t.day}.{t.month:02}.{t.year}" for t in ALL_DAYS if t.day < 10], True),
    "date day first": ([f"{t.day}/{t.month:02}/{t.year}" for t in ALL_DAYS if t.day > 12], True),
    "date day first short month": ([f"{t.day}/{t.month}/{t.year}" for t in ALL_DAYS if t.day > 12 and t.month < 10], True),
    "ssn": ([f"{a:03}-{g:02}-{s:04}" for a in (1, 665, 667, 899) for g in (1, 50, 99) for s in range(1, 10000, 13)], False),
    "phone plus one": ([f"+1 {a} {b} {n:04}" for a in (200, 212, 999) for b in (200, 555, 999) for n in range(0, 10000, 17)], False),
    "phone bare": ([f"{a}{b}{n:04}" for a in (200, 212, 999) for b in (200, 555, 999) for n in range(0, 10000, 17)], False),
    "phone abroad": ([f"+44{n:06}" for n in range(0, 1000000, 37)] + [f"+15235{n:06}" for n in range(550000, 551000)], False),
    "card": ([card(i) for i in range(3000)], False),
    "ipv4": ([f"{a}.{b}.{c}.7" for a in (1, 127, 223) for b in range(0, 256, 9) for c in range(0, 256, 9)], False),
    "iban": ([iban(i) for i in range(3000)], False),
    "email": ([f"{c}{i}@example.org" for c in ("", "a", "Z.b") for i in range(1000)], False),
    "key": ([f"{i:031x}a" for i in range(1, 3000)], False),
}


@pytest.mark.parametrize("name", VALUES)
def test_one_to_one(spark, name):
    """Each value has a valid pseudonym of its own in the same format, and is restored from it."""
    values, whole = VALUES[name]
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string")
    changed = pii.pseudonymise(docs)
    rows = changed.select("doc_id", "text", f"n_{name.split()[0]}").collect()
    got = [r["text"] for r in rows]
    assert {r[2] for r in rows} == {1} and len(got) == len(values) == len(set(got))
    assert not whole or set(got) == set(values)
    assert [len(r["text"]) for r in rows if name not in ("ipv4",)] == [len(values[r["doc_id"]]) for r in rows if name not in ("ipv4",)]
    assert {r["doc_id"]: r["text"] for r in pii.restore(docs.sparkSession.createDataFrame(rows).select("doc_id", "text")).collect()} == dict(enumerate(values))
    if name == "ssn":
        assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", v) for v in got)


def test_stay_valid_and_linked(spark):
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(frame(spark, TEXTS)).collect()}
    old, new = (re.findall(r"(?<!\w)\d{16}(?!\w)", x[5]) for x in (dict(enumerate(TEXTS)), got))
    assert new[0] == new[1] != old[0] and all(map(luhn, new[:2])) and new[2] == old[2] == "4465758382889438"
    assert "-".join(re.findall("....", new[0])) in got[5] and " ".join(re.findall("....", new[0])) in got[5]
    ibans = re.findall(r"GB\d\d[A-Z]{4}\d{14}|DE\d{20}", got[8])
    assert len(ibans) == 3 and [int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1 for x in ibans] == [True, True, False]
    assert len({*re.findall(r"(?<=[(+1. -])(\d{3})[-). ]*(\d{3})[-. ](\d{4})", got[4].split(" or 523-155")[0])}) == 1
    assert got[4].endswith("523-155-1055") and got[3] == TEXTS[3]
