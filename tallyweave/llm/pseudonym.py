"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets.

A found value is validated (checksum, ranges, calendar) and replaced by a keyed permutation of all values of its
format: a Feistel network over its digits or letters. Equal values get equal pseudonyms in every document, different
values different ones, and separators, letter case and lengths stay. Numbers with check digits get new ones that fit;
dates stay dates of the same range, whatever their notation; values outside a range are walked along the cycle until
one is valid.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyweave.llm.common import released

ROUNDS = 10
BLOCK = 128
KINDS = ("email", "phone", "card", "account", "person_number", "address", "date", "secret")
DEMO_KEY = b"replace this key"
#: English names of months.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_SHORT = tuple(name[:3] for name in MONTHS)
_MONTH = "|".join(dict.fromkeys((*MONTHS, *_SHORT)))
#: By kind, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@[\w-]++(?:\.[\w-]++)+(?![\w-])",
    "secret": r"""(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{40}(?:[0-9a-f]{24})?)(?![A-Za-z0-9])
        |(?i:(?<![A-Za-z])(?:password|passwd|pwd|token|secret|api_?key)\s?[=:]\s?)["']?(?P<value>[^\s"'<>,;&|(){}\[\]]*\w)""",
    "address": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "date": rf"""(?<![\w/.-])(?:(?:\d{{4}}-\d\d-\d\d|\d{{4}}/\d\d?/\d\d?|\d\d?/\d\d?/\d{{4}}|\d\d?\.\d\d?\.\d{{4}})
                 (?:(?![\w/-]|\.\d)|(?=[Tt]\d\d:?\d\d))
        |\d\d?[ ](?:{_MONTH})[ ]\d{{4}}(?![\w-])|(?:{_MONTH})[ ]\d\d?,[ ]\d{{4}}(?![\w-]))""",
    "phone": r"""(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\w)
        |(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\w)""",
    "account": r"(?<!\w)[A-Z]{2}\d\d(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)",
    "person_number": r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])",
    "card": r"(?<!\w)(?<!\d\.)\d(?:[ -]?\d){12,18}(?!\w)",
    "plain_phone": r"(?<![\w+])(?<!\d\.)(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w|\.\d)",
}
FOUND = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS.items()), re.X)
_EACH = {kind: re.compile(p if kind == "secret" else f"(?P<value>){p}", re.X) for kind, p in PATTERNS.items()}
#: Every find holds one of these characters.
HINTS = "0123456789@=:"


class Feistel:
    """Keyed permutations of tuples of digits, each with its own radix."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, k: int, value: int) -> int:
        data = b"%d|%d|" % (k, value) + tweak
        return int.from_bytes(hashlib.blake2b(data, key=self.key).digest(), "big")

    def __call__(self, digits: list[int], radices: list[int], tweak: str, back: bool = False) -> list[int]:
        half, tag = len(digits) // 2, tweak.encode()
        parts = [_number(digits[:half], radices[:half]), _number(digits[half:], radices[half:])]
        sizes = [prod(radices[:half]), prod(radices[half:])]
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            step = self._round(tag, k, parts[1 - k % 2])
            parts[k % 2] = (parts[k % 2] + (-step if back else step)) % sizes[k % 2]
        return _digits(parts[0], radices[:half]) + _digits(parts[1], radices[half:])


def _number(digits: list[int], radices: list[int]) -> int:
    value = 0
    for d, r in zip(digits, radices, strict=True):
        value = value * r + d
    return value


def _digits(value: int, radices: list[int]) -> list[int]:
    out = []
    for r in reversed(radices):
        value, d = divmod(value, r)
        out.append(d)
    return out[::-1]


def luhn_digit(digits: list[int]) -> int:
    """The digit that makes ``digits`` plus itself pass the Luhn check."""
    total = sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
    return -total % 10


def account_check(country: str, rest: str) -> str:
    """The two check digits of an account number (ISO 13616, modulo 97)."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


_CLASSES = (("0123456789", 10), ("abcdefghijklmnopqrstuvwxyz", 26), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26))


def _spelled(feistel: Feistel, text: str, kind: str, hexadecimal: bool = False) -> str:
    """Permute digits among digits and letters among letters of their case; all else stays and is part of the key."""
    alphabets = [("0123456789abcdef", 16)] if hexadecimal else _CLASSES
    at, digits, spelling = [], [], []
    for k, c in enumerate(text):
        for letters, radix in alphabets:
            if c in letters:
                at.append(k)
                digits.append(letters.index(c))
                spelling.append((letters, radix))
    out = list(text)
    for k in at:
        out[k] = ""
    frame = "|".join([kind, *(str(len(s[0])) + s[0][0] for s in spelling), "".join(out)])
    for k, d, (letters, _) in zip(at, feistel(digits, [r for _, r in spelling], frame), spelling, strict=True):
        out[k] = letters[d]
    return "".join(out)


def _refill(shape: str, symbols: str) -> str:
    """``shape`` with its letters and digits replaced in order."""
    fresh = iter(symbols)
    return "".join(next(fresh) if c.isalnum() else c for c in shape)


def _email(f: Feistel, m: re.Match) -> str:
    name, _, host = m[0].rpartition("@")
    return f"{_spelled(f, name, 'email@' + host)}@{host}"


def _secret(f: Feistel, m: re.Match) -> str:
    if m["value"] is None:
        if m[0].startswith("AKIA"):
            return "AKIA" + _spelled(f, m[0][4:], "key")
        return _spelled(f, m[0], "secret", hexadecimal=True)
    value = m["value"]
    hexadecimal, out, before = bool(re.fullmatch("[0-9a-f]+", value)), [], b""
    for k in range(0, len(value), BLOCK):  # a long value by blocks, each keyed by what stands before it
        block = value[k:k + BLOCK]
        out.append(_spelled(f, block, "secret" + before.hex(), hexadecimal))
        before = hashlib.blake2b(before + block.encode(), digest_size=16).digest()
    return m[0][: m.start("value") - m.start()] + "".join(out)


def _address(f: Feistel, m: re.Match) -> str | None:
    parts = [int(p) for p in m[0].split(".")]
    if max(parts) > 255:
        return None
    return ".".join(map(str, f(parts, [256] * 4, "address")))


def _phone(f: Feistel, m: re.Match) -> str | None:
    digits = [int(c) for c in m[0] if c.isdigit()]
    if not 10 <= len(digits) <= 15:
        return None
    keep = len(digits) - 10 if len(digits) <= 13 else 3  # the country's digits
    lead = "".join(map(str, digits[:keep]))
    return _refill(m[0], lead + "".join(map(str, f(digits[keep:], [10] * (len(digits) - keep), "phone" + lead))))


def _card(f: Feistel, m: re.Match) -> str | None:
    digits = [int(c) for c in m[0] if c.isdigit()]
    if luhn_digit(digits[:-1]) != digits[-1] or not any(digits):
        return None
    body = f(digits[:-1], [10] * (len(digits) - 1), "card")
    return _refill(m[0], "".join(map(str, body + [luhn_digit(body)])))


def _account(f: Feistel, m: re.Match) -> str | None:
    plain = m[0].replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if account_check(country, rest) != check:
        return None
    fresh = _spelled(f, rest, "account" + country)
    return _refill(m[0], country + account_check(country, fresh) + fresh)


def _person_number(f: Feistel, m: re.Match) -> str | None:
    def valid(d: list[int]) -> bool:
        area = d[0] * 100 + d[1] * 10 + d[2]
        return area not in (0, 666) and area < 900 and d[3:5] != [0, 0] and d[5:] != [0] * 4

    digits = [int(c) for c in m[0] if c.isdigit()]
    if not valid(digits):
        return None
    digits = f(digits, [10] * 9, "person")
    while not valid(digits):
        digits = f(digits, [10] * 9, "person")
    return _refill(m[0], "".join(map(str, digits)))


_SIZE, _FIRST, _LAST = (1912, 1911), date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def _day(f: Feistel, day: int) -> int:
    """Days of 1900 to 2099 among themselves, all others among themselves."""
    usual = _FIRST <= day <= _LAST
    size = (271, 270) if usual else _SIZE
    low, high = (_FIRST, _LAST) if usual else (1, date.max.toordinal())
    value = day - low
    while True:
        value = _number(f(_digits(value, list(size)), list(size), f"date{usual}"), list(size))
        if value <= high - low and (_FIRST <= value + low <= _LAST) == usual:
            return low + value


def _named_date(f: Feistel, text: str) -> str | None:
    """A date with the name of its month, which stays full or short."""
    first, second, year = text.replace(",", "").split(" ")
    day, name = (first, second) if first.isdigit() else (second, first)
    names = MONTHS if name in MONTHS else _SHORT
    try:
        found = date(int(year), names.index(name) + 1, int(day))
    except ValueError:
        return None
    fresh = date.fromordinal(_day(f, found.toordinal()))
    parts = f"{fresh.day:0{len(day)}d}", names[fresh.month - 1]
    return f"{parts[0]} {parts[1]} {fresh.year:04d}" if first.isdigit() else f"{parts[1]} {parts[0]}, {fresh.year:04d}"


def _date(f: Feistel, m: re.Match) -> str | None:
    if " " in m[0]:
        return _named_date(f, m[0])
    mark = next(c for c in m[0] if not c.isdigit())
    parts = [int(p) for p in m[0].split(mark)]
    widths = [len(p) for p in m[0].split(mark)]
    year_first = widths[0] == 4
    year, month, day = parts if year_first else parts[::-1]
    swap = mark == "/" and not year_first and month > 12  # month first; where both fit, the day stands first
    if swap:
        month, day = day, month
    try:
        found = date(year, month, day)
    except ValueError:
        return None
    fresh = date.fromordinal(_day(f, found.toordinal()))
    if year_first:
        return mark.join(f"{p:0{w}d}" for p, w in zip((fresh.year, fresh.month, fresh.day), widths, strict=True))
    front = (fresh.month, fresh.day) if swap else (fresh.day, fresh.month)
    return mark.join(f"{p:0{w}d}" for p, w in zip((*front, fresh.year), (*widths[:2], 4), strict=True))


_MAKERS: dict[str, Callable[[Feistel, re.Match], str | None]] = {
    "email": _email, "phone": _phone, "card": _card, "account": _account, "person_number": _person_number,
    "address": _address, "date": _date, "secret": _secret, "plain_phone": _phone}
#: How the digits of cards are usually grouped.
_USUAL = re.compile(r"\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,4}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5}")
#: Kinds whose pattern may take in what stands beside a value.
_WIDE = ("phone", "account", "card")


def _readings(m: re.Match, kind: str) -> Iterator[re.Match]:
    """The ways to read a find: the whole, and shorter ones up to each boundary; last those that a hyphen goes on from."""
    text, last = m.string, []
    for end in range(m.end(), m.start(), -1) if kind in _WIDE else (m.end(),):
        if end == m.end() or text[end] in " -.":
            found = m if end == m.end() else _EACH[kind].fullmatch(text, m.start(), end)
            if found and text[end:end + 1] == "-":
                last.append(found)
            elif found:
                yield found
    yield from last


def _cards(feistel: Feistel, text: str, at: int, usual: bool) -> Iterator[tuple[re.Match, str]]:
    """The valid readings of a card that begins at a place."""
    if found := _EACH["card"].match(text, at):
        for reading in _readings(found, "card"):
            if (not usual or _USUAL.fullmatch(reading[0])) and (fresh := _card(feistel, reading)):
                yield reading, fresh


def _begins(feistel: Feistel, text: str, at: int) -> bool:
    """Whether a number that is valid by itself begins at a place."""
    if not text[at].isdigit() or text[at - 1].isdigit():
        return False
    return next(_cards(feistel, text, at, True), None) is not None or any(
        (m := _EACH[kind].match(text, at)) and _MAKERS[kind](feistel, m) is not None
        for kind in ("address", "date", "person_number", "plain_phone"))


def _first_valid(feistel: Feistel, m: re.Match) -> tuple[str, int, str] | None:
    """Kind, end and pseudonym of the first valid reading at a place.

    A card in an unusual grouping comes last, and not before another value that begins within it. If another
    valid card goes on beyond the one taken, the digits up to its end are replaced too.
    """
    text, at, kinds = m.string, m.start(), list(PATTERNS)
    for kind in kinds[kinds.index("secret" if m.lastgroup == "value" else m.lastgroup):]:
        if kind != "card":
            if found := _EACH[kind].match(text, at):
                for reading in _readings(found, kind):
                    if (fresh := _MAKERS[kind](feistel, reading)) is not None:
                        return kind.removeprefix("plain_"), reading.end(), fresh
        elif taken := next(_cards(feistel, text, at, True), None):
            return _with_rest(feistel, *taken)
    for taken in _cards(feistel, text, at, False):
        if any(_begins(feistel, text, k) for k in range(at + 1, taken[0].end())):
            return None
        return _with_rest(feistel, *taken)
    return None


def _with_rest(feistel: Feistel, card: re.Match, fresh: str) -> tuple[str, int, str]:
    text, end = card.string, card.end()
    if not _USUAL.fullmatch(card[0]) or " " in card[0] or "-" in card[0]:
        beyond = [r.end() for k in range(card.start() + 1, end) if text[k].isdigit() for r, _ in _cards(feistel, text, k, False)]
        end = max([end, *beyond])
        end = next((k for k in range(card.end(), end) if _begins(feistel, text, k)), end)  # that is replaced as itself
    return "card", end, fresh + _spelled(feistel, text[card.end():end], "card rest")


def replaced(feistel: Feistel, text: str) -> tuple[str, list[str]]:
    """The text with pseudonyms, and the kinds that were replaced, in order."""
    if not any(c in text for c in HINTS):
        return text, []
    kinds: list[str] = []
    out, done, at = [], 0, 0
    while m := FOUND.search(text, at):
        if (valid := _first_valid(feistel, m)) is None:
            at = m.start() + 1  # a valid value may begin within the find
            continue
        kinds.append(valid[0])
        out += text[done:m.start()], valid[2]
        done = at = valid[1]
    return "".join(out) + text[done:], kinds


def with_pseudonyms(docs: DataFrame, key: bytes = DEMO_KEY, counts: bool = True) -> DataFrame:
    """``docs`` with pseudonyms in its column text, and (``counts``) a number per kind found: n_email, n_phone, ….

    All other columns and rows stay as they are; null and empty texts stay so and count nothing. An existing column of
    the name of a count is replaced. Without ``counts`` the columns are those of ``docs``.
    """
    names = [f"n_{k}" for k in KINDS] if counts else []
    base = docs.drop(*names)
    at = base.columns.index("text")
    fields = list(base.schema.fields) + [T.StructField(n, T.LongType()) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        for batch in batches:
            texts, found = [], []
            for value in batch.column(at):
                text = value.as_py()
                text, kinds = (None, []) if text is None else replaced(feistel, text)
                texts.append(text)
                found.append(kinds)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if counts:
                columns += [pa.array([f.count(k) for f in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names + names)

    return base.mapInArrow(released(run), T.StructType(fields))
