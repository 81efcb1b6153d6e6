"""PII: format-preserving Feistel pseudonyms for validated numbers, dates and addresses.

A value is found by its form, validated (check digits, ranges, calendar), read as
an integer below the size of its format's domain, permuted there by a keyed
Feistel network, and written back in the same form.  The permutation depends on
the key and the kind alone, so equal values become equal pseudonyms in every
document, and different values stay different.  Domains that are no product of
two equal halves are walked: the network is applied again until the result lies
in the domain.

Edge cases: a null text stays null, an empty one empty; very long texts are searched
whole; repeated rows get equal results; where values overlap the earliest counts, then the kind listed first,
but a card, which has a check digit, counts before a phone number;
an empty table gives no rows.  ``pseudonymise`` keeps all columns; the counts
that ``scan`` returns read the id and the text alone.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from codelode.llm import _kernel as K

#: Used if no key is given: links values within this corpus, but protects nothing as it is public.
DEFAULT_KEY = b"codelode public demonstration key"
ROUNDS = 10


class Feistel:
    """A keyed permutation of range(size) for each size and tweak."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _round(self, tweak: bytes, k: int, value: int, modulus: int) -> int:
        seed = tweak + b"\0" + bytes([k]) + value.to_bytes((value.bit_length() + 7) // 8 or 1, "big")
        wide = hashlib.blake2b(seed, key=self.key[:64], digest_size=64).digest()
        return int.from_bytes(wide, "big") % modulus

    def _once(self, value: int, a: int, b: int, tweak: bytes) -> int:
        left, right = divmod(value, b)
        for k in range(0, ROUNDS, 2):
            left = (left + self._round(tweak, k, right, a)) % a
            right = (right + self._round(tweak, k + 1, left, b)) % b
        return left * b + right

    def permute(self, value: int, size: int, tweak: bytes, allowed: Callable[[int], bool] = lambda _: True) -> int:
        """The image of value in range(size), or in the part of it that is allowed (which must hold value)."""
        if size < 2:
            return value
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        value = self._once(value, a, b, tweak)
        while value >= size or not allowed(value):
            value = self._once(value, a, b, tweak)
        return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows these digits."""
    total = sum(sum(divmod(int(d) * (2 if k % 2 == 0 else 1), 10)) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _digits(text: str, new: str) -> str:
    """text with its digits replaced in order."""
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _only(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


# Digits of a card's groups as they are usually written, and how issuers' numbers of 16, 15 and 14 digits begin.
_WRITTEN = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 1), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3), (4, 4, 4, 1), (4, 4, 4, 2), (4, 4, 4, 3))
_ISSUED = {(4, 4, 4, 4): re.compile(r"4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|6011|65|64[4-9]|62|35(?:2[89]|[3-8])"), (4, 6, 5): re.compile("34|37"), (4, 6, 4): re.compile("30|36|38")}


def _cards(run: str, f: Feistel) -> list[tuple[int, int, str]]:
    """(start, end, pseudonym) of the cards in a run of digits with single spaces or dashes, in one pass over its groups.

    A card is 13 to 19 digits without a break, or groups as they are usually written with one kind of break.  Groups that
    other numbers stand beside may be a row of a table: there only lengths and beginnings that issuers use count, and of
    more than five numbers of four digits in a row either all are cards or none is.
    """
    groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", run)]
    out: list[tuple[int, int, str]] = []
    dense = [False] * len(groups)  # in a long row of fours that are not all cards
    for four, own in groupby(range(len(groups)), lambda k: groups[k][1] - groups[k][0] == 4):
        own = list(own)
        if four and len(own) > 5:
            cards = [(groups[k][0], groups[k + 3][1]) for k in own[::4] if k + 3 <= own[-1]]
            every = len(own) % 4 == 0 and all(_ISSUED[4, 4, 4, 4].match(run, s) and _valid(_only(run[s:e])) for s, e in cards)
            for k in own:
                dense[k] = not every
    k = 0
    while k < len(groups):
        forms = [(1, True)] if 13 <= groups[k][1] - groups[k][0] <= 19 else []
        for form in _WRITTEN:
            own = groups[k : k + len(form)]
            if tuple(e - s for s, e in own) == form and len({run[e] for _, e in own[:-1]}) == 1:
                begins = form in _ISSUED and not dense[k] and _ISSUED[form].match(run, own[0][0])
                forms.append((len(form), len(form) == len(groups) or begins))
        for n, counts in forms:
            if counts and (new := _card(run[groups[k][0] : groups[k + n - 1][1]], f)) is not None:
                out.append((groups[k][0], groups[k + n - 1][1], new))
                k += n - 1
                break
        k += 1
    return out


def _valid(d: str) -> bool:
    return 13 <= len(d) <= 19 and luhn_digit(d[:-1]) == d[-1] and len(set(d)) > 1


def _card(text: str, f: Feistel) -> str | None:
    d = _only(text)
    if not _valid(d):
        return None
    body = str(f.permute(int(d[1:-1]), 10 ** (len(d) - 2), b"card%d" % len(d))).zfill(len(d) - 2)
    return _digits(text, d[0] + body + luhn_digit(d[0] + body))


def _ssn(m: re.Match, f: Feistel) -> str | None:
    a, g, s = int(m[1]), int(m[2]), int(m[3])
    if a in (0, 666) or a >= 900 or not g or not s:
        return None
    v = f.permute(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, b"ssn")  # areas 1 to 899 but 666
    v, s = divmod(v, 9999)
    a, g = divmod(v, 99)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def _phone(m: re.Match, f: Feistel) -> str | None:
    whole, country = m[0], m["cc"] or ""
    d = _only(whole[len(country) :])
    if not 7 <= len(d) <= 13 or len(_only(country)) + len(d) > 15 or len(set(d)) == 1:
        return None
    plan = country in ("", "+1") and len(d) == 10  # area and exchange begin with 2 to 9, or the number is outside the plan and stays so
    if plan and d[0] >= "2" and d[3] >= "2":
        area, rest = int(d[:3]) - 200, (int(d[3:6]) - 200) * 10_000 + int(d[6:])
        area, rest = divmod(f.permute(area * 8_000_000 + rest, 800 * 8_000_000, b"nanp"), 8_000_000)
        new = f"{area + 200}{rest // 10_000 + 200}{rest % 10_000:04d}"
    else:
        outside = (lambda v: v // 10**9 < 2 or v // 10**6 % 10 < 2) if plan else (lambda v: len(set(str(v).zfill(len(d)))) > 1)
        new = str(f.permute(int(d), 10 ** len(d), b"phone%d" % len(d), outside)).zfill(len(d))
    return country + _digits(whole[len(country) :], new)


def _ip(m: re.Match, f: Feistel) -> str | None:
    try:
        v = int(ipaddress.IPv4Address(m[0]))
    except ValueError:
        return None
    return str(ipaddress.IPv4Address(f.permute(v, 1 << 32, b"ipv4")))


def _mixed(text: str, f: Feistel, tweak: bytes) -> str:
    """Permutes letters among letters of the same case and digits among digits."""
    form = "".join("0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in text)
    value, size = 0, 1
    for c, kind in zip(text, form, strict=True):
        if kind in "0aA":
            n = 10 if kind == "0" else 26
            value, size = value * n + ord(c) - ord(kind), size * n
    value, out = f.permute(value, size, tweak + form.encode()), []
    for c, kind in zip(reversed(text), reversed(form), strict=True):
        if kind in "0aA":
            value, k = divmod(value, 10 if kind == "0" else 26)
            c = chr(ord(kind) + k)
        out.append(c)
    return "".join(reversed(out))


def _email(m: re.Match, f: Feistel) -> str | None:
    local, _, host = m[0].rpartition("@")
    name, _, top = host.rpartition(".")
    if local[0] == "." or local[-1] == "." or ".." in local or len(local) > 64 or any(not x or x[0] == "-" or x[-1] == "-" for x in name.split(".")):
        return None
    return f"{_mixed(local, f, b'local')}@{_mixed(name, f, b'host')}.{top}"


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _iban(m: re.Match, f: Feistel) -> str | None:
    c = m[0].replace(" ", "")
    if not 15 <= len(c) <= 34 or _iban_check(c[:2], c[4:]) != c[2:4]:
        return None
    body = _mixed(c[4:], f, b"iban" + c[:2].encode())
    it = iter(c[:2] + _iban_check(c[:2], body) + body)
    return "".join(x if x == " " else next(it) for x in m[0])


_FIRST, _LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _day(y: str, m: str, d: str) -> dt.date | None:
    try:
        day = dt.date(int(y), int(m), int(d))
    except ValueError:
        return None
    return day if _FIRST <= day.toordinal() <= _LAST else None


def _date(m: re.Match, f: Feistel) -> str | None:
    """ISO dates, days first with dots, slashes with the month first where that is a date, and month names.

    The new date is written as wide as the old one; a date that would not read back as written is not allowed.
    """
    text = m[0]
    if m["y"]:
        day, write = _day(m["y"], m["m"], m["d"]), lambda x: f"{x.year:04d}-{x.month:02d}-{x.day:02d}"
        ok = lambda x: True
    elif m["name"]:
        day, write = _day(m["ny"], str(_MONTHS.index(m["name"]) + 1), m["nd"]), lambda x: f"{_MONTHS[x.month - 1]} {x.day}, {x.year}"
        ok = lambda x: True
    else:
        a, b, y, sep = m["a"], m["b"], m["ay"], m["sep"]
        month_first = sep == "/" and _day(y, a, b) is not None
        day = _day(y, a, b) if month_first else _day(y, b, a)
        padded = len(a) == 2 and len(b) == 2

        def write(x: dt.date) -> str:
            p, q = (x.month, x.day) if month_first else (x.day, x.month)
            return f"{p:02d}{sep}{q:02d}{sep}{x.year}" if padded else f"{p}{sep}{q}{sep}{x.year}"

        ok = lambda x: (sep != "/" or month_first or x.day > 12) and (padded or len(write(x)) == len(text))
        if day is not None and write(day) != text:
            return None
    if day is None:
        return None
    form = re.sub(r"\d", "0", text).encode() if m["a"] else b"iso" if m["y"] else b"name"
    v = f.permute(day.toordinal() - _FIRST, _LAST - _FIRST + 1, b"date" + form, lambda v: ok(dt.date.fromordinal(v + _FIRST)))
    return write(dt.date.fromordinal(v + _FIRST))


#: Kind, form and the function that validates and rewrites, in order of precedence.
KINDS: tuple[tuple[str, re.Pattern, Callable[[re.Match, Feistel], str | None]], ...] = (
    ("email", re.compile(r"(?a)(?<![\w.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"), _email),
    ("iban", re.compile(r"(?a)\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"), _iban),
    ("card", re.compile(r"(?a)(?<![\w.-])\d(?:[ -]?\d){12,}(?![\w-])"), lambda m, f: None),  # see _cards
    ("ssn", re.compile(r"(?a)(?<![\w-])(\d{3})-(\d{2})-(\d{4})(?![\w-])"), _ssn),
    ("date", re.compile(rf"(?a)(?<![\w./-])(?:(?P<y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}})|(?P<a>\d{{1,2}})(?P<sep>[./])(?P<b>\d{{1,2}})(?P=sep)(?P<ay>\d{{4}})|(?P<name>{'|'.join(_MONTHS)}) (?P<nd>\d{{1,2}}), (?P<ny>\d{{4}}))(?!\w|[./-]\d)"), _date),
    ("ip", re.compile(r"(?a)(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"), _ip),
    ("phone", re.compile(r"(?a)(?<![\w.-])(?:(?P<cc>\+\d{1,3})[ .-]?)?(?:\(\d{2,4}\) ?\d{3}[ .-]?\d{4}|\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4})(?![\w-]|\.\d)|(?P<e>\+\d{8,15})(?!\w)"), lambda m, f: _phone(m, f) if not m["e"] else _plain(m, f)),
)


def _plain(m: re.Match, f: Feistel) -> str | None:
    """+ and digits without breaks: the first two stay."""
    d = m[0][3:]
    return m[0][:3] + str(f.permute(int(d), 10 ** len(d), b"plain%d" % len(d))).zfill(len(d))


def spans(text: str, feistel: Feistel) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the values in a text, without overlaps."""
    found, cards = [], []
    for rank, (kind, form, rewrite) in enumerate(KINDS):
        for m in form.finditer(text):
            if kind == "card":
                own = [(m.start() + s, m.start() + e, new) for s, e, new in _cards(m[0], feistel)]
                cards += own
                found += [(s, rank, e, kind, new) for s, e, new in own]
                continue
            if kind == "phone":
                k = bisect_left(cards, (m.end(),))  # the cards before start before its end
                if k and cards[k - 1][1] > m.start():
                    continue
            new = rewrite(m, feistel)
            if new is not None:
                found.append((m.start(), rank, m.end(), kind, new))
    out, done = [], 0
    for s, _, e, kind, new in sorted(found):
        if s >= done:
            out.append((s, e, kind, new))
            done = e
    return out


def rewritten(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, done = [], 0
    for s, e, _, new in found:
        out += [text[done:s], new]
        done = e
    return "".join([*out, text[done:]])


_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
#: Digits that stand within so many bytes in any value but an address: a date with a month's name has five at least.
_DIGITS, _WITHIN = 5, 24


def _suspects(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text can hold a value: an at sign, digits close to each other, or three dots between digits."""
    digit = _DIGIT[buf]
    sums = np.concatenate([[0], np.cumsum(digit)])
    close = digit & (sums[np.minimum(np.arange(len(buf)) + _WITHIN, len(buf))] - sums[:-1] >= _DIGITS)
    dotted = np.zeros(len(buf), bool)
    dotted[1:-1] = (buf[1:-1] == 0x2E) & digit[:-2] & digit[2:]
    return (K.per_doc(close | (buf == 0x40), offs) > 0) | (K.per_doc(dotted, offs) >= 3)


@lru_cache(4)
def _feistel(key: bytes) -> Feistel:
    return Feistel(key)


def _found(column: pa.Array, key: bytes) -> dict[int, tuple[str, list]]:
    """Text and values of the rows that hold values; only texts that can hold one are decoded."""
    out = {}
    for at, _, buf, offs in K.chunks(column):
        for k in np.flatnonzero(_suspects(buf, offs)):
            text = column[at + int(k)].as_py()
            if found := spans(text, _feistel(key)):
                out[at + int(k)] = (text, found)
    return out


def _replaced(column: pa.Array, found: dict[int, tuple[str, list]]) -> pa.Array:
    flags = np.zeros(len(column), bool)
    flags[list(found)] = True
    return pc.replace_with_mask(column, pa.array(flags), pa.array([rewritten(*found[k]) for k in sorted(found)], column.type))


def pseudonymise(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """The documents with pseudonyms in their texts; all columns stay."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _found(batch.column(at), key)
            yield pa.RecordBatch.from_arrays([_replaced(c, found) if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(K.frugal(run), docs.schema)


_COUNTS = ("n_email", "n_iban", "n_card", "n_ssn", "n_date", "n_ip", "n_phone")


def scan(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """One row for each document: its text with pseudonyms, and the values of each kind that it held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _found(batch.column(1), key)
            counts = np.zeros((len(_COUNTS), batch.num_rows), np.int64)
            for k, (_, values) in found.items():
                for _, _, kind, _ in values:
                    counts[_COUNTS.index(f"n_{kind}"), k] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), _replaced(batch.column(1), found), *map(pa.array, counts)], names=["doc_id", "text", *_COUNTS])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(K.frugal(run), "doc_id long, text string, " + ", ".join(f"{c} long" for c in _COUNTS))
