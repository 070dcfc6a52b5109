"""Pseudonyms: one-to-one maps, formats, and unchanged clean texts."""

import datetime

import pytest

from cartlake.llm import pii

KEY = b"test"


@pytest.fixture(scope="module")
def by():
    return pii.Permutation(KEY)


@pytest.mark.parametrize("radices", [[10, 10, 10], [2], [7, 3], [1, 26, 10], [898, 3]])
def test_the_permutation_is_one_to_one_without_fixed_points(by, radices):
    size = 1
    for r in radices:
        size *= r
    values = [pii._digits(n, radices) for n in range(size)]
    moved = [tuple(by.moved("x", v, radices)) for v in values]
    assert len(set(moved)) == size and set(moved) == set(map(tuple, values))
    assert all(m != tuple(v) for m, v in zip(moved, values))


def test_maps_differ_by_key_and_kind(by):
    values = [pii._digits(n, [10] * 4) for n in range(200)]
    maps = [[p.moved(k, v, [10] * 4) for v in values] for p in (by, pii.Permutation(b"other")) for k in ("a", "b")]
    assert len({str(m) for m in maps}) == 4


GOOD = {
    "card": ["4111111111111111", "5500 0055 5555 5559", "3782-822463-10005"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    "ssn": ["123-45-6789", "899-01-0001"],
    "phone": ["+1 (967) 555-9400", "(555) 123-4567", "555-123-4567", "+44 20 7946 0958"],
    "ip": ["34.200.127.73", "1.0.0.0", "223.255.255.255"],
    "date": ["2020-02-29", "31.12.1999", "1.2.1999", "12/25/1980", "3/14/2001"],
    "email": ["a.b+c@mail3.example.com", "X9@y.org", "müller@x.de", "john.o'neil@mail.com", "иван@почта.рф"],
}
BAD = ["4111111111111112", "0000000000000000", "GB82 WEST 1234 5698 7654 33", "000-45-6789", "666-12-1234", "12.300.1.1",
       "127.0.0.1", "1.2.3.4.5", "2021-02-29", "31.11.2020x", "13/45/2020", "12 apples", "a@b", "version 3.11", "1234567",
       "12345678901234567890123"]


@pytest.mark.parametrize("kind, value", [(k, v) for k, vs in GOOD.items() for v in vs])
def test_values_move_within_their_format(by, kind, value):
    text, spans = pii.pseudonymised(f"see {value}, ok", by)
    assert [s[0] for s in spans] == [kind] and spans[0][1:3] == (4, len(value))
    new = spans[0][3]
    assert text == f"see {new}, ok" and new != value
    # A pseudonym is itself a valid value of its kind.
    assert [s[0] for s in pii.pseudonymised(new, by)[1]] == [kind]
    if kind != "ip":
        assert [c if not c.isalnum() else "" for c in new] == [c if not c.isalnum() else "" for c in value]


@pytest.mark.parametrize("value", BAD)
def test_invalid_forms_stay(by, value):
    assert pii.pseudonymised(f"see {value} ok", by) == (f"see {value} ok", [])


def test_equal_values_stay_linked_in_any_writing(by):
    plain, spaced = (pii.pseudonymised(v, by)[0] for v in ("4111111111111111", "4111 1111 1111 1111"))
    assert spaced.replace(" ", "") == plain


def test_dates_are_one_to_one(by):
    days = [datetime.date.fromordinal(n) for n in range(pii.FIRST_DAY, pii.FIRST_DAY + 3000)]
    for form in ("{0:%Y-%m-%d}", "{0.day}.{0.month}.{0.year}", "{0.month}/{0.day}/{0.year}"):
        new = [pii._date(by, form.format(d)) for d in days]
        assert None not in new and len(set(new)) == len(days)
        assert all(form.format(d) != n for d, n in zip(days, new))


FOLLOWED = [
    ("card", "4111 1111 1111 1111", " 12/27"), ("card", "4111111111111111", " 123"), ("card", "4111-1111-1111-1111", " 2024"),
    ("card", "3782-822463-10005", "-77"), ("card", "4111 1111 1111 1111", " 12 27 345"), ("phone", "+1 (487) 555-7209", " 2024"),
    ("phone", "+1 487 555 7209", ". 12 items"), ("phone", "+44 20 7946 0958", " 12"), ("iban", "ES91 2100 0418 4502 0005 1332", " 2024"),
    ("iban", "BE68 5390 0754 7034", " AND MORE"), ("date", "1990-12-25", "T10:00Z"), ("date", "1990-12-25", " 2024"),
]


@pytest.mark.parametrize("kind, value, rest", FOLLOWED)
def test_values_followed_by_other_numbers(by, kind, value, rest):
    alone = pii.pseudonymised(value, by)[0]
    text, spans = pii.pseudonymised(f"see {value}{rest}", by)
    assert [s[:3] for s in spans] == [(kind, 4, len(value))] and alone != value
    assert text == f"see {alone}{rest}"  # the same pseudonym as elsewhere


def test_a_following_number_that_fits_the_check_digit_by_chance_stays_out(by):
    card = "4111111111111111"
    body = card + "12"
    text = f"{card} 12{pii.luhn_digit(body)}"
    assert pii.pseudonymised(text, by)[0] == pii.pseudonymised(card, by)[0] + text[16:]


@pytest.mark.parametrize("value", ["25/12/1990", "25-12-1990", "12-25-1990", "1990/12/25", "1990/1/5", "5-1-1990", "13/1/2001"])
def test_dates_in_more_orders(by, value):
    text, spans = pii.pseudonymised(f"born {value}, ok", by)
    assert [s[:3] for s in spans] == [("date", 5, len(value))] and text == f"born {spans[0][3]}, ok" and spans[0][3] != value
    assert [s[0] for s in pii.pseudonymised(spans[0][3], by)[1]] == ["date"]


@pytest.mark.parametrize("value", ["31-11-2020", "13-13-2020", "25/13/1990", "1990/13/01", "1990-12-25Tx", "1-2.2020", "3.4-1990"])
def test_impossible_dates_stay(by, value):
    assert pii.pseudonymised(value, by) == (value, [])


def test_dates_of_both_slash_orders_are_one_to_one(by):
    days = [datetime.date.fromordinal(n) for n in range(pii.FIRST_DAY, pii.FIRST_DAY + 1500)]
    old = {form.format(d) for d in days for form in ("{0:%d}/{0:%m}/{0:%Y}", "{0:%m}/{0:%d}/{0:%Y}")}
    new = [pii._date(by, text) for text in sorted(old)]
    assert None not in new and len(set(new)) == len(old) and all(a != b for a, b in zip(sorted(old), new))


def test_masked_table(spark):
    long = "word " * 40_000
    rows = [(1, "mail ann@x.org", "a"), (2, None, None), (3, "", "c"), (4, "clean text é", "d"), (4, "clean text é", "d"),
            (5, long + "4111111111111111", "e"), (None, "again ann@x.org", "f")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, kind int")
    out = pii.masked(docs, KEY)
    assert out.columns == ["doc_id", "source", "kind", "text", "pii_spans"]
    got = sorted(((r.source, r.text, [s.kind for s in r.pii_spans]) for r in out.collect()), key=str)
    by = pii.Permutation(KEY)
    want = sorted(((s, None if t is None else pii.pseudonymised(t, by)[0], {"a": ["email"], "e": ["card"], "f": ["email"]}
                    .get(s, [])) for _, t, s in rows), key=str)
    assert got == want
    assert got[0][1].split()[1] == [g for g in got if g[0] == "f"][0][1].split()[1]
    assert pii.masked(docs.limit(0), KEY).count() == 0


def test_national_and_international_forms_of_a_number_stay_linked(by):
    digits = {"".join(c for c in pii.pseudonymised(v, by)[0] if c.isdigit())[-10:]
              for v in ("(415) 555-0132", "415-555-0132", "+1-415-555-0132", "+1 (415) 555 0132")}
    assert len(digits) == 1


def test_whole_addresses_move(by):
    assert pii.pseudonymised("'a@b.com', x='bob@site.org'", by)[1][0][1:3] == (1, 7)
    for value in ("müller@x.de", "john.o'neil@mail.com"):
        new = pii.pseudonymised(value, by)[0]
        assert all(a != b or not a.isalpha() for a, b in zip(new[:3], value)) or new[:4] != value[:4]
