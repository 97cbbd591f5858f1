"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

A found value is read as a number of its format's own domain, permuted there under the key, and written back in the
same format: separators, lengths, letter case, country codes, domains and check digits stay right. Equal values get
equal pseudonyms in every document whatever separators they are written with, so they stay linked; the permutation
is a bijection, so different values stay different. Numbers are permuted by a balanced network; domains that are no power
of four are walked: the permutation is repeated until it falls inside. Strings are permuted by a network over their two
halves, each character moving within its own kind, in time linear in their length, whatever it is.

A date has one pseudonym in every notation, so a permutation of days keeps which days are above the 12th: where a
notation says month first only because day first would be no date, its pseudonym must read so too. Days and months of one
digit are written with two. A telephone number is known by its digits: the country code is read from them, and ten
digits in groups of three, three and four are a number of country code 1 whether or not it is written.

What is found, with its test: cards (Luhn), IBANs (mod 97), US social security numbers (area, group and serial),
calendar dates (a real day from 1900 to 2099), IPv4 addresses (parts 0 to 255; a first part of 0,
of 1 to 223 and of 224 and more each stay so), telephone numbers (8 to 15 digits), e-mail addresses, and credentials
(access keys, and values after password, token, secret or api key, with digits or without).
Digits that fail their test are left as they are.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b, shake_256

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import slices

KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "date", "credential")
ROUNDS = 10
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days

_DIGIT, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
# The calling codes of one and two digits; all others have three.
_CODE = re.compile(r"1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3}")

_NUMBERS = re.compile(
    r"""(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))
      | (?P<iso>(?<![0-9])[0-9]{4}(?P<s1>[-/.])[0-9]{2}(?P=s1)[0-9]{2}(?![0-9]))
      | (?P<dmy>(?<![0-9])[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)[0-9]{4}(?![0-9]))
      | (?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
      | (?P<nanp>(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]))
      | (?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,5}(?![0-9]))
      | (?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?P<s3>[ -])[0-9]{4}(?P=s3)[0-9]{4}(?P=s3)[0-9]{4}|[0-9]{4}(?P<s4>[ -])[0-9]{6}(?P=s4)[0-9]{5})(?![0-9]))
      | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:[ ][A-Z0-9]{4}){2,7}(?:[ ][A-Z0-9]{1,3})?)(?![A-Za-z0-9]))
      | (?P<akia>(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9]))""",
    re.VERBOSE,
)
_SECRET = re.compile(r"""\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)["']?[ \t]{0,3}[=:][ \t]{0,3}["']?([A-Za-z0-9][A-Za-z0-9_\-+/.!@#$%^*~]{5,})""", re.IGNORECASE)
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9])")
_HAS_CREDENTIAL = re.compile(r"[=:]")


class Feistel:
    """Keyed permutations of [0, n) for any n, by a balanced Feistel network and cycle walking."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        out = blake2b(half.to_bytes(size, "big") + tweak, digest_size=min(64, size + 8), key=self.key, salt=i.to_bytes(16, "big")).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def permute(self, value: int, n: int, tweak: bytes, inside=None, back: bool = False) -> int:
        """The image (`back`: the preimage) of value. `inside` narrows the domain; value must be in it."""
        if n < 2:
            return value
        bits = max(4, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:
            left, right = value >> bits, value & mask
            for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                if back:
                    left, right = right ^ self._round(tweak, i, left, bits), left
                else:
                    left, right = right, left ^ self._round(tweak, i, right, bits)
            value = left << bits | right
            if value < n and (inside is None or inside(value)):
                return value

    def shift(self, places: list[int], sizes: list[int], tweak: bytes, back: bool = False) -> list[int]:
        """The image of a string of places[i] < sizes[i]: by turns its halves are shifted by what the other says."""
        half = len(places) // 2
        parts, radix = [places[:half], places[half:]], [sizes[:half], sizes[half:]]
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            own, other = i % 2, 1 - i % 2
            n = len(parts[own])
            raw = blake2b(bytes(parts[other]) + tweak, key=self.key, salt=i.to_bytes(16, "big")).digest()
            by = array("I", raw if 4 * n <= len(raw) else shake_256(raw).digest(4 * n))
            parts[own] = [(x - d if back else x + d) % m for x, d, m in zip(parts[own], by, radix[own], strict=False)]
        return parts[0] + parts[1]


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for a valid number."""
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(doubled[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _refill(pattern: str, characters: str) -> str:
    """Writes the characters over the letters and digits of pattern."""
    it = iter(characters)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


class Pseudonyms:
    """Replaces personal data in texts; `back` undoes it under the same key."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back

    def _number(self, value: int, n: int, tweak: bytes, inside=None) -> int:
        return self.feistel.permute(value, n, tweak, inside, self.back)

    def characters(self, text: str, tweak: bytes, hexadecimal: bool = False) -> str:
        """Permutes a string among those with the same kinds of character at the same places."""
        alphabets = [_HEX if hexadecimal else _DIGIT if c in _DIGIT else _LOWER if c in _LOWER else _UPPER if c in _UPPER else c for c in text]
        shape = "".join("9" if a is _DIGIT else a[0] if len(a) > 1 else f"={a}" for a in alphabets).encode()
        places = [a.index(c) for a, c in zip(alphabets, text, strict=True)]
        new = self.feistel.shift(places, [len(a) for a in alphabets], tweak + shape, self.back)
        return "".join(a[k] for a, k in zip(alphabets, new, strict=True))

    def email(self, text: str) -> str:
        local, at, domain = text.partition("@")
        new = self.characters(local.lower(), b"email" + domain.lower().encode())
        return "".join(x.upper() if c.isupper() else x for c, x in zip(local, new, strict=True)) + at + domain

    def card(self, text: str) -> str | None:
        digits = "".join(c for c in text if c in _DIGIT)
        if luhn(digits) or len(set(digits)) == 1:
            return None
        body, n = digits[1:-1], len(digits) - 2
        body = f"{self._number(int(body), 10**n, b'card%d' % n):0{n}d}"
        body = digits[0] + body
        return _refill(text, body + str(-luhn(body + "0") % 10))

    def iban(self, text: str) -> str | None:
        while True:  # the next word may look like one more group
            plain = text.replace(" ", "")
            if 15 <= len(plain) <= 34 and _mod97(plain[4:] + plain[:4]) == 1:
                break
            if " " not in text[5:]:
                return None
            text = text[: text.rindex(" ")]
        body = self.characters(plain[4:], b"iban" + plain[:2].encode())
        return _refill(text, plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02d}" + body)

    def ssn(self, text: str) -> str | None:
        def real(v: int) -> bool:
            area, rest = divmod(v, 1_000_000)
            return 0 < area < 900 and area != 666 and rest // 10_000 > 0 and rest % 10_000 > 0

        value = int(text.replace("-", ""))
        return _refill(text, f"{self._number(value, 10**9, b'ssn', real):09d}") if real(value) else None

    def ip(self, text: str) -> str | None:
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255:
            return None
        value = int.from_bytes(bytes(parts), "big")
        low, high = next(x for x in ((0, 1), (1, 224), (224, 256)) if parts[0] < x[1])
        value = self._number(value, 1 << 32, b"ip", lambda v: low <= v >> 24 < high)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def phone(self, text: str, grouped: bool = False) -> str | None:
        """grouped: written in groups of three, three and four digits, after a 1 or not."""
        digits = "".join(c for c in text if c in _DIGIT)
        if not 8 <= len(digits) <= 15:
            return None
        national = grouped and len(digits) == 10
        code = "1" if national or grouped else _CODE.match(digits)[0]
        lead = "" if national else code
        body, n = digits[len(lead) :], len(digits) - len(lead)

        def real(v: int) -> bool:
            return v // 10**9 > 1 and v // 10**6 % 10 > 1

        inside = None
        if code == "1" and n == 10:
            kind = real(int(body))
            inside = lambda v: real(v) == kind
        return _refill(text, lead + f"{self._number(int(body), 10**n, b'phone+' + code.encode(), inside):0{n}d}")

    def day(self, text: str, year_first: bool) -> str | None:
        parts = re.split(r"[-/.]", text)
        mark = next(c for c in text if c in "-/.")
        if year_first:
            orders = ((0, 1, 2),)
        else:
            orders = ((2, 1, 0), (2, 0, 1))  # day first; month first only where day first is no date
        for order in orders:
            try:
                found = date(*(int(parts[i]) for i in order))
            except ValueError:
                continue
            if not 0 <= (value := (found - FIRST_DAY).days) < DAYS:
                return None
            late = found.day > 12
            new = FIRST_DAY + timedelta(self._number(value, DAYS, b"day", lambda v: ((FIRST_DAY + timedelta(v)).day > 12) == late))
            by_part = dict(zip(order, (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"), strict=True))
            return mark.join(by_part[i] for i in range(3))
        return None

    def credential(self, text: str) -> str:
        plain = all(c in _HEX for c in text)
        new = self.characters(text, b"credential", hexadecimal=plain)
        while not plain and all(c in _HEX for c in new):  # those are pseudonyms of hexadecimal values
            new = self.characters(new, b"credential")
        return new

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym), in order and without overlap."""
        found = []
        at, last = text.find("@"), 0
        while at >= 0:
            start = last + len(text[last:at].rstrip(_LOCAL))
            domain = _DOMAIN.match(text, at)
            if start < at and domain:
                found.append((start, domain.end(), "email", self.email(text[start : domain.end()])))
            last, at = at + 1, text.find("@", at + 1)
        if _HAS_CREDENTIAL.search(text):
            for m in _SECRET.finditer(text):
                found.append((m.start(1), m.end(1), "credential", self.credential(m[1])))
        for m in _NUMBERS.finditer(text):
            kind, value = m.lastgroup, m[0]
            if m["iso"] or m["dmy"]:
                kind, new = "date", self.day(value, bool(m["iso"]))
            elif m["card"]:
                kind, new = "card", self.card(value)
            elif m["nanp"] or m["phone"]:
                kind, new = "phone", self.phone(value, bool(m["nanp"]))
            elif m["akia"]:
                kind, new = "credential", value[:4] + self.characters(value[4:], b"access key")
            else:
                new = getattr(self, kind)(value)
            if new is not None:
                found.append((m.start(), m.start() + len(new) if kind == "iban" else m.end(), kind, new))
        found.sort(key=lambda x: (x[0], -x[1]))
        out, end = [], 0
        for x in found:
            if x[0] >= end:
                out.append(x)
                end = x[1]
        return out

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        counts: dict[str, int] = {}
        if not _WORTH.search(text):
            return text, counts
        out, end = [], 0
        for start, stop, kind, new in self.spans(text):
            out += (text[end:start], new)
            end = stop
            counts[kind] = counts.get(kind, 0) + 1
        return "".join(out) + text[end:], counts


#: Every kind holds a digit or an at sign, or stands after an equals sign or a colon.
_WORTH = re.compile(r"[0-9@=:]")


@lru_cache(maxsize=4)
def _pseudonyms(key: bytes, back: bool) -> Pseudonyms:
    return Pseudonyms(key, back)


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", back: bool = False) -> DataFrame:
    """The input with `text` rewritten and `pii_<kind>` counts (long) added, one row per row, in no fixed order.

    A null text stays null, an empty one empty, both with counts of 0. All columns are kept; an input column that
    already has the name of a count is replaced by it. No shuffle.
    """
    names = [f"pii_{k}" for k in KINDS]
    source = docs.drop(*[c for c in names if c in docs.columns])
    schema, at = source.schema, source.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pseudonyms(key, back)
        for batch in batches:
            for part in slices(batch, batch.schema.names[at], 4 << 20):
                texts, counts = [], {k: [] for k in KINDS}
                for x in part.column(at).to_pylist():
                    new, n = (None, {}) if x is None else p.replace(x)
                    texts.append(new)
                    for k in KINDS:
                        counts[k].append(n.get(k, 0))
                columns = part.columns
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[k], pa.int64()) for k in KINDS)], names=[*part.schema.names, *names])

    out = StructType([*schema.fields, *(StructField(name, LongType()) for name in names)])
    return source.mapInArrow(run, out).select(*[F.col(f"`{c}`") for c in [*source.columns, *names]])
