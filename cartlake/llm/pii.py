"""Format-preserving pseudonyms: validated numbers, dates and addresses are permuted within their format.

A value is found by its form and then validated (check digits, octets, calendar). Its free positions
are digits of a mixed-radix number; a keyed Feistel network permutes the numbers of that format, so
equal values get equal pseudonyms in all documents, different values different ones, and check digits,
separators and lengths keep their form. The network is used as s^-1(s(x) + c): it is a permutation
without a fixed point, so no value stays as it was.

| kind | validated by | kept as it is |
|---|---|---|
| card | 13 to 19 digits, Luhn check digit, first digit 2 to 6 | first digit, separators |
| iban | country, length, remainder modulo 97 | country, blanks |
| ssn | area, group and serial ranges | hyphens |
| phone | national or international form, 10 to 15 digits, as many as the country has | country code, separators |
| ip | four octets, unicast and not loopback | dots |
| date | calendar from 1900 to 2099: y-m-d, y/m/d, d.m.y, d-m-y, m/d/y; d/m/y and m-d-y where the day is above 12 | separators, zero padding |
| email | local part and domain with a top-level label | domain, marks of the local part |

Cards, IBANs and international phones may be followed by other numbers: every end between two groups of
characters is tried, the most usual first.

NULL texts stay NULL with no values found, other columns and repeated rows stay as they are, an empty
table stays empty. Whole texts are searched, however long; texts without a digit or @ are not touched.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartlake.llm.words import flat_bytes, text_chunks

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: Letters of addresses besides A-Z: Latin, Greek and Cyrillic ones.
LETTERS = "À-ÖØ-öø-ɏͰ-ӿ"
CANDIDATES = re.compile(rf"""
    (?P<email>(?<![\w.+%{LETTERS}-])[A-Za-z0-9{LETTERS}](?:'?[\w.+%{LETTERS}-])*@(?:[A-Za-z0-9{LETTERS}-]+\.)+[A-Za-z{LETTERS}]{{2,}}(?![\w{LETTERS}-]))
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?)
  | (?P<ip>(?<![\w.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?![\w]|\.[0-9]))
  | (?P<date>(?<![\w./-])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}
      |[0-9]{{1,2}}(?P<mark>[./-])[0-9]{{1,2}}(?P=mark)[0-9]{{4}})(?!(?!T[0-9])[\w/-]|\.[0-9]))
  | (?P<ssn>(?<![\w-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\w-]))
  | (?P<phone>(?<![\w+])\+[0-9](?:[ ().-]{{0,2}}[0-9]){{9,14}}|(?<![\w(])\([0-9]{{3}}\)[ ]?[0-9]{{3}}[ .-][0-9]{{4}}(?![0-9])
      |(?<![\w.-])[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}(?![\w-]))
  | (?P<card>(?<![\w.-])[2-6](?:[ -]?[0-9]){{12,18}})
""", re.VERBOSE | re.ASCII)

#: Length of an IBAN by country (fixed values of the published registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24,
    "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

#: Digits of an international phone number, with the country code, where nearly all of a country have as many
#: (fixed values of the numbering plans).
PHONE_DIGITS = {
    "1": [11], "7": [11], "20": [12], "27": [11], "30": [12], "31": [11], "32": [11, 10], "33": [11], "34": [11], "36": [11, 10],
    "40": [11], "41": [11], "44": [12], "45": [10], "47": [10], "48": [11], "51": [11, 10], "52": [12], "54": [13, 12], "55": [13, 12],
    "56": [11], "57": [12], "60": [12, 11], "61": [11], "64": [11, 10], "65": [10], "66": [11, 10], "81": [12, 11], "82": [12, 11],
    "84": [11], "86": [13, 12], "90": [12], "91": [12], "92": [12], "351": [12], "353": [12, 11], "380": [12], "420": [12], "421": [12],
    "852": [11], "971": [12, 11], "972": [12, 11],
}
#: Lengths of the groups in which card numbers are written, besides one group.
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)}


# --- the permutation --------------------------------------------------------------------------

class Permutation:
    """Keyed permutations of mixed-radix numbers, one for each kind and list of radices."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self._days: dict[tuple, list[int]] = {}

    def _draw(self, label: str, turn: int, value: int, size: int) -> int:
        text = f"{label}|{turn}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=32).digest()) % size

    def _pass(self, label: str, left: int, right: int, a: int, b: int, sign: int) -> tuple[int, int]:
        for turn in range(ROUNDS)[::sign]:
            if turn % 2:
                right = (right + sign * self._draw(label, turn, left, b)) % b
            else:
                left = (left + sign * self._draw(label, turn, right, a)) % a
        return left, right

    def days(self, widths: tuple[int, int] | None, late: bool) -> list[int]:
        """All days, or those whose month and day are written with so many digits without padding; ``late``: from the 13th on."""
        if (widths, late) not in self._days:
            self._days[widths, late] = [
                n for n in range(FIRST_DAY, LAST_DAY + 1) for d in [datetime.date.fromordinal(n)]
                if (widths is None or (len(str(d.month)), len(str(d.day))) == widths) and (d.day > 12 or not late)]
        return self._days[widths, late]

    def moved(self, kind: str, digits: list[int], radices: list[int]) -> list[int]:
        """Another list of digits with the same radices; the map is one to one and moves every list."""
        half = len(radices) // 2
        a, b = (reduce(lambda x, y: x * y, part, 1) for part in (radices[:half], radices[half:]))
        if a * b == 1:
            return digits
        label = f"{kind}|{','.join(map(str, radices))}"
        left, right = self._pass(label, _number(digits[:half], radices[:half]),
                                 _number(digits[half:], radices[half:]), a, b, 1)
        step = 1 + self._draw(label, ROUNDS, 0, a * b - 1)
        left, right = divmod((left * b + right + step) % (a * b), b)
        left, right = self._pass(label, left, right, a, b, -1)
        return _digits(left, radices[:half]) + _digits(right, radices[half:])


def _number(digits: list[int], radices: list[int]) -> int:
    return reduce(lambda n, x: n * x[1] + x[0], zip(digits, radices), 0)


def _digits(number: int, radices: list[int]) -> list[int]:
    out = []
    for radix in reversed(radices):
        number, digit = divmod(number, radix)
        out.append(digit)
    return out[::-1]


#: Kinds of characters that stay among themselves: first character and how many.
RANGES = [("0", 10), ("a", 26), ("A", 26), ("À", 23), ("Ø", 7), ("à", 23), ("ø", 7), ("α", 25), ("Α", 17), ("А", 32), ("а", 32)]


def _moved_characters(by: Permutation, kind: str, text: str) -> str:
    """Digits, small and capital letters move within their kind and script; all other characters stay."""
    places = []
    for i, c in enumerate(text):
        for base, size in RANGES:
            if 0 <= ord(c) - ord(base) < size:
                places.append((i, ord(base), size))
    moved = by.moved(kind, [ord(text[i]) - base for i, base, _ in places], [size for _, _, size in places])
    out = list(text)
    for (i, base, _), digit in zip(places, moved):
        out[i] = chr(base + digit)
    return "".join(out)


# --- the kinds --------------------------------------------------------------------------------

def _refilled(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order; separators stay."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in form)


def luhn_digit(body: str) -> str:
    """The check digit that belongs behind ``body``."""
    total = 0
    for i, c in enumerate(reversed(body)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def _card(by: Permutation, found: str) -> str | None:
    digits = re.sub("[^0-9]", "", found)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = digits[0] + "".join(map(str, by.moved("card", list(map(int, digits[1:-1])), [10] * (len(digits) - 2))))
    return _refilled(found, body + luhn_digit(body))


def _remainder97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(by: Permutation, found: str) -> str | None:
    plain = found.replace(" ", "")
    if IBAN_LENGTHS.get(plain[:2]) != len(plain) or _remainder97(plain[4:] + plain[:4]) != 1:
        return None
    body = _moved_characters(by, "iban" + plain[:2], plain[4:])
    new = f"{plain[:2]}{98 - _remainder97(body + plain[:2] + '00'):02d}{body}"
    rest = iter(new)
    return "".join(c if c == " " else next(rest) for c in found)


def _ssn(by: Permutation, found: str) -> str | None:
    area, group, serial = map(int, found.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    low = area - 1 - (area > 666)
    low, group, serial = by.moved("ssn", [low, group - 1, serial - 1], [898, 99, 9999])
    return f"{low + 1 + (low >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(by: Permutation, found: str) -> str | None:
    digits = re.sub("[^0-9]", "", found)
    fixed = len(digits) - 10 if digits.startswith("1") and len(digits) == 11 else 2 if found.startswith("+") else 0
    if not 10 <= len(digits) <= 15:
        return None
    # A number in national form is the same as with the country code 1.
    moved = by.moved(f"phone{digits[:fixed] or '1'}", list(map(int, digits[fixed:])), [10] * (len(digits) - fixed))
    return _refilled(found, digits[:fixed] + "".join(map(str, moved)))


def _ip(by: Permutation, found: str) -> str | None:
    octets = found.split(".")
    first, *rest = map(int, octets)
    if any(o != str(int(o)) for o in octets) or max(rest) > 255 or not 1 <= first <= 223 or first == 127:
        return None
    moved = by.moved("ip", [first - 1 - (first > 127), *rest], [222, 256, 256, 256])
    return ".".join(map(str, [moved[0] + 1 + (moved[0] >= 126), *moved[1:]]))


def _date(by: Permutation, found: str) -> str | None:
    mark = next(c for c in found if not c.isdigit())
    parts = found.split(mark)
    order, other = ("ymd", None) if len(parts[0]) == 4 else {"-": ("dmy", "mdy"), ".": ("dmy", None), "/": ("mdy", "dmy")}[mark]
    # A number above 12 in the place of the month is a day; such dates move among themselves.
    late = other is not None and int(parts[order.index("m")]) > 12
    order = other if late else order
    of = dict(zip(order, parts))
    try:
        day = datetime.date(int(of["y"]), int(of["m"]), int(of["d"])).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    # With two digits for both, all days can be written; else only those of the same widths.
    widths = (len(of["m"]), len(of["d"]))
    days = by.days(None if widths == (2, 2) else widths, late)
    at = bisect_left(days, day)
    if at == len(days) or days[at] != day:
        return None  # padded in one place only, such as 01/2 for a day that has a shorter form
    new = datetime.date.fromordinal(days[by.moved(f"date{len(days)}", [at], [len(days)])[0]])
    text = {"y": f"{new.year:04d}", "m": f"{new.month:0{widths[0]}d}", "d": f"{new.day:0{widths[1]}d}"}
    return mark.join(text[c] for c in order)


def _email(by: Permutation, found: str) -> str | None:
    local, _, domain = found.rpartition("@")
    return f"{_moved_characters(by, 'email@' + domain.lower(), local)}@{domain}"


KINDS = {"card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date, "email": _email}


def _ends(text: str, found: re.Match) -> list[int]:
    """Where the value may end, the first choice first: at the end of a group, the longest first within a choice.

    The usual groups of a card and the country's number of digits of a phone come before other ends, so that a
    following number seldom becomes part of a value. An IBAN has the length of its country.
    """
    kind, start, end = found.lastgroup, found.start(), found.end()
    if kind not in ("card", "iban", "phone") or kind == "phone" and text[start] != "+":
        return [end]
    # A card or an IBAN does not end before a letter.
    closed = str.isdigit if kind == "phone" else lambda c: c.isalnum() or c == "_"
    ends = [i for i in range(end, start, -1) if text[i - 1].isalnum() and not (i < len(text) and closed(text[i]))]
    if kind == "card":
        def rank(i: int) -> int:
            groups = tuple(map(len, re.split("[ -]", text[start:i])))
            return len(groups) > 1 and groups not in CARD_GROUPS
    elif kind == "iban":
        return [i for i in ends if i - start - text.count(" ", start, i) == IBAN_LENGTHS.get(text[start:start + 2])]
    else:
        digits = re.sub("[^0-9]", "", text[start:end])
        lengths = next((PHONE_DIGITS[digits[:n]] for n in (1, 2, 3) if digits[:n] in PHONE_DIGITS), [])

        def rank(i: int) -> int:
            return sum(c.isdigit() for c in text[start:i]) not in lengths
    return sorted(ends, key=rank)


def pseudonymised(text: str, by: Permutation) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms, and (kind, start, length, pseudonym) of each value; positions in the old text.

    A form that fails validation at every possible end stays; the search goes on behind its first character.
    """
    out, spans, done, at = [], [], 0, 0
    while found := CANDIDATES.search(text, at):
        kind, start = found.lastgroup, found.start()
        tried = ((end, KINDS[kind](by, text[start:end])) for end in _ends(text, found))
        end, new = next((t for t in tried if t[1] is not None), (start, None))
        if new is None:
            at = start + 1
            continue
        out += [text[done:start], new]
        spans.append((kind, start, end - start, new))
        done = at = end
    return "".join(out) + text[done:], spans


MAY_HOLD = np.zeros(256, bool)
MAY_HOLD[[*range(ord("0"), ord("9") + 1), ord("@")]] = True
SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("length", T.IntegerType()), T.StructField("pseudonym", T.StringType())]))
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()),
                                  ("pseudonym", pa.string())]))


def masked(docs: DataFrame, key: bytes, spans: str = "pii_spans") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and the found values in ``spans``, in place of a column of that name."""
    kept = [f for f in docs.schema if f.name not in ("text", spans)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Permutation(key)
        for batch in batches:
            for part in text_chunks(batch):
                texts = part["text"]
                data, offsets = flat_bytes(texts)
                hits = np.unique(np.searchsorted(offsets, np.flatnonzero(MAY_HOLD[data]), side="right") - 1).tolist()
                found: list = [[]] * len(texts)
                if hits:
                    rows = texts.to_pylist()
                    for i in hits:
                        rows[i], values = pseudonymised(rows[i], by)
                        found[i] = [dict(zip(("kind", "start", "length", "pseudonym"), v)) for v in values]
                    texts = pa.array(rows, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(part[n] for n in names), texts, pa.array(found, SPANS_ARROW)], [*names, "text", spans])

    return docs.select(*names, "text").mapInArrow(
        run, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField(spans, SPANS)]))
