"""Format-preserving pseudonyms of numbers and dates in texts, by a keyed Feistel network.

A found value is validated (check digit, calendar, range), its variable part is read as an
integer below the size of its format, and a keyed permutation of that range gives the
pseudonym, written back in the same format. Equal values get equal pseudonyms in every
document under one key, whatever their punctuation.
"""

from __future__ import annotations

import datetime
import hmac
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerline.llm.storage import small_batches
from ledgerline.llm.workers import frugal

ROUNDS = 8
#: Years of the dates that are permuted, and the first of them as a day number.
FIRST_YEAR, LAST_YEAR = 1900, 2099
_DAY0 = datetime.date(FIRST_YEAR, 1, 1).toordinal()
_DAYS = datetime.date(LAST_YEAR, 12, 31).toordinal() - _DAY0 + 1


class Permutation:
    """Keyed permutations of 0..size-1: a balanced Feistel network over bits, walked until it is back in range."""

    def __init__(self, key: bytes):
        self.key = key
        self.known: dict[tuple[str, int, int], int] = {}

    def _round(self, label: bytes, half: int, mask: int) -> int:
        return int.from_bytes(hmac.digest(self.key, label + half.to_bytes(16, "big"), "sha256")[:16], "big") & mask

    def apply(self, kind: str, value: int, size: int) -> int:
        """The pseudonym of ``value`` among ``size`` values of a kind."""
        at = (kind, value, size)
        if at not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[at] = self._walk(kind, value, size)
        return self.known[at]

    def _walk(self, kind: str, value: int, size: int) -> int:
        width = max(1, -(-max(1, (size - 1).bit_length()) // 2))
        mask = (1 << width) - 1
        while True:
            left, right = value >> width, value & mask
            for i in range(ROUNDS):
                left, right = right, left ^ self._round(f"{kind}/{size}/{i}/".encode(), right, mask)
            value = left << width | right
            if value < size:
                return value

    def invert(self, kind: str, value: int, size: int) -> int:
        """The value whose pseudonym is ``value``."""
        width = max(1, -(-max(1, (size - 1).bit_length()) // 2))
        mask = (1 << width) - 1
        while True:
            left, right = value >> width, value & mask
            for i in reversed(range(ROUNDS)):
                left, right = right ^ self._round(f"{kind}/{size}/{i}/".encode(), left, mask), left
            value = left << width | right
            if value < size:
                return value


def luhn_digit(body: str) -> str:
    """The digit that makes body + digit pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


#: What looks like a value; each alternative is validated afterwards. No digit, letter or joined number stands beside one.
_VALUES = re.compile(
    r"(?<![\w+])(?<!\d[.-])(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
    r"|(?P<ymd>\d{4}-\d{2}-\d{2})"
    r"|(?P<dmy>\d{2}(?P<sep>[./])\d{2}(?P=sep)\d{4})"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3})"
    r"|(?P<phone>(?:(?P<country>\+\d{1,3})[ -]?(?:\(\d{2,4}\)|\d{2,4})[ -]?\d{3,4}[ -]?\d{3,4}|(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<number>\d(?:[ -]?\d){12,18})"
    r")(?![\w]|[.-]\d)",
    re.ASCII,
)
#: Words that are a value as a whole: the part of a mail address before its @, and long hexadecimal numbers.
_MAIL = re.compile(r"(?<![\w.%+-])(?P<local>[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?)@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w-])", re.ASCII)
_HEX = re.compile(r"(?<![\w.-])(?:[0-9a-f]{24,128}|[0-9A-F]{24,128})(?![\w-])", re.ASCII)
#: Characters that are permuted as one number, so that a round's input fits a digest.
_RUN = 48
#: Groups of digits that go on from a number's beginning, however many they are.
_GROUPS = re.compile(r"\d+(?:[ -]\d+)*", re.ASCII)
_DIGITS, _JOINED = re.compile(r"\d+", re.ASCII), re.compile(r"\w|\.\d", re.ASCII)
#: Digits of a card or another number.
LEAST_DIGITS, MOST_DIGITS = 13, 19
#: Digits of the groups in which cards are written, besides one group.
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}
KINDS = ("iban", "date", "ip", "phone", "ssn", "card", "number", "mail", "hex")


def _fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order; punctuation stays."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


#: Places of year, month and day in the formats of dates; of two readings of dd/dd/yyyy the first that is a day counts.
_ORDERS = {"ymd": ((0, 5, 8),), "dmy": ((6, 3, 0), (6, 0, 3))}


def _date(p: Permutation, found: str, order: str) -> str | None:
    for year, month, day in _ORDERS[order]:
        try:
            at = datetime.date(int(found[year : year + 4]), int(found[month : month + 2]), int(found[day : day + 2]))
        except ValueError:
            continue
        if not FIRST_YEAR <= at.year <= LAST_YEAR:
            return None
        new = datetime.date.fromordinal(_DAY0 + p.apply("date", at.toordinal() - _DAY0, _DAYS))
        out = list(found)
        for place, digits in ((year, f"{new.year:04}"), (month, f"{new.month:02}"), (day, f"{new.day:02}")):
            out[place : place + len(digits)] = digits
        return "".join(out)
    return None


def _classes(p: Permutation, kind: str, found: str, alphabets: tuple[str, ...]) -> str:
    """``found`` with each character of an alphabet replaced by one of the same; other characters stay."""
    out = list(found)
    places = [(i, a) for i, c in enumerate(found) for a in alphabets if c in a]
    for start in range(0, len(places), _RUN):
        part = places[start : start + _RUN]
        value, size = 0, 1
        for i, a in part:
            value, size = value * len(a) + a.index(found[i]), size * len(a)
        value = p.apply(f"{kind}{start}" if start else kind, value, size)
        for i, a in reversed(part):
            value, at = divmod(value, len(a))
            out[i] = a[at]
    return "".join(out)


def _pseudonym(p: Permutation, m: re.Match) -> tuple[str, str] | None:
    """(kind, pseudonym) of a match, or None if it isn't valid."""
    kind, found = m.lastgroup, m.group()
    digits = re.sub(r"\D", "", found)
    if kind in ("ymd", "dmy"):
        new = _date(p, found, kind)
        return ("date", new) if new else None
    if kind == "ip":
        parts = [int(x) for x in found.split(".")]
        if max(parts) > 255:
            return None
        new = p.apply("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
        return "ip", ".".join(map(str, new.to_bytes(4, "big")))
    if kind == "phone":
        prefix = m.group("country") or ""
        body = re.sub(r"\D", "", found[len(prefix) :])
        if not 7 <= len(body) <= 12:
            return None
        new = str(p.apply("phone", int(body), 10 ** len(body))).zfill(len(body))
        return "phone", prefix + _fill(found[len(prefix) :], new)
    if kind == "ssn":
        new = str(p.apply("ssn", int(digits), 10**9)).zfill(9)
        return "ssn", _fill(found, new)
    raise ValueError(kind)


def _iban(p: Permutation, found: str) -> str | None:
    """The pseudonym of an IBAN: digits become digits and letters letters, and the check digits fit them."""
    country, digits, body = found[:2], found[2:4], re.sub(" ", "", found[4:])
    if _mod97(body + country + digits) != 1:
        return None
    new = _classes(p, "iban" + country, body, (string.digits, string.ascii_uppercase))
    check = 98 - _mod97(new + country + "00")
    it = iter(new)
    return f"{country}{check:02}" + "".join(c if c == " " else next(it) for c in found[4:])


def _mod97(text: str) -> int:
    """Of digits and letters, A as 10 to Z as 35."""
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _ibans(p: Permutation, m: re.Match) -> list[tuple[int, int, str, str]]:
    """The longest valid IBAN of a match that ends where the match or one of its groups ends, as (start, end, kind, pseudonym)."""
    found = m.group()
    for end in [len(found), *(i for i in range(len(found) - 1, 0, -1) if found[i] == " ")]:
        new = _iban(p, found[:end]) if end >= 12 else None
        if new:
            return [(m.start(), m.start() + end, "iban", new)]
    return []


def _card(p: Permutation, found: str) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not LEAST_DIGITS <= len(digits) <= MOST_DIGITS or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    new = str(p.apply("card", int(digits[:-1]), 10 ** (len(digits) - 1))).zfill(len(digits) - 1)
    return _fill(found, new + luhn_digit(new))


def _plain(p: Permutation, found: str) -> str:
    """Not a card: its digits are permuted as a plain number of that length."""
    digits = re.sub(r"\D", "", found)
    return _fill(found, str(p.apply("number", int(digits), 10 ** len(digits))).zfill(len(digits)))


def _numbers(p: Permutation, text: str, m: re.Match) -> list[tuple[int, int, str, str]]:
    """The card in a match, or else the number, as (start, end, kind, pseudonym); a number before the card too.

    A run of groups as cards are written counts first (one group, or CARD_GROUPS), as a longer run passes by chance once in
    ten; then the whole match, then the first run of groups that is one, the longest of those from one start.
    Without a card, a group that is long enough by itself is the number, and else the whole match.
    """
    first, last = m.span()
    run = _GROUPS.match(text, first)
    groups = [(first + g.start(), first + g.end()) for g in _DIGITS.finditer(text[first : min(run.end(), last + 2 * MOST_DIGITS)])]
    # The groups' run may end in one that joins a word or a decimal; that one is no part of a value.
    ends = [k for k, (_, b) in enumerate(groups) if not _JOINED.match(text, b)]
    starts = [k for k, (a, _) in enumerate(groups) if a < last and (k == 0 or text[a - 1] == " ")]
    runs = [(i, k) for i in starts for k in reversed(ends) if i <= k and groups[k][1] <= groups[i][0] + 2 * MOST_DIGITS]
    usual = [(i, k) for i, k in runs if i == k or tuple(b - a for a, b in groups[i : k + 1]) in CARD_GROUPS]
    whole = [(i, k) for i, k in runs if (groups[i][0], groups[k][1]) == (first, last)]
    for i, k in usual + whole + runs:
        a, b = groups[i][0], groups[k][1]
        new = _card(p, text[a:b])
        if new:
            before = text[first:a].rstrip()
            out = [(a, b, "card", new)]
            if sum(c.isdigit() for c in before) >= LEAST_DIGITS:
                out.insert(0, (first, first + len(before), "number", _plain(p, before)))
            return out
    for a, b in groups:
        if b <= last and b - a >= LEAST_DIGITS and (a == first or text[a - 1] == " "):
            return [(a, b, "number", _plain(p, text[a:b]))]
    return [(first, last, "number", _plain(p, m.group()))]


def _whole_words(p: Permutation, text: str) -> list[tuple[int, int, str, str]]:
    """Mail addresses and long hexadecimal numbers, as (start, end, kind, pseudonym).

    Of an address the part before the @ is permuted, in lower case, letters as letters and digits as digits; the domain stays. A hexadecimal number
    has digits and letters both.
    """
    found = []
    if "@" in text:
        for m in _MAIL.finditer(text):
            local = m.group("local")
            new = _classes(p, "mail", local.lower(), (string.digits, string.ascii_lowercase))
            new = "".join(n.upper() if c.isupper() else n for c, n in zip(local, new))
            found.append((m.start(), m.end(), "mail", new + m.group()[len(local) :]))
    for m in _HEX.finditer(text):
        word = m.group().lower()
        if not word.isdigit() and not word.isalpha():
            new = _classes(p, "hex", word, ("0123456789abcdef",))
            found.append((m.start(), m.end(), "hex", new.upper() if m.group().isupper() else new))
    return sorted(found)


def replaced(p: Permutation, text: str) -> tuple[str, dict[str, int]]:
    """A text with all its valid values replaced, and how many of each kind there were."""
    counts = dict.fromkeys(KINDS, 0)
    out, done = [], 0
    for start, end, kind, new in [*_whole_words(p, text), (len(text), len(text), None, "")]:
        out += [_numbers_replaced(p, text[done:start], counts), new]
        done = end
        if kind:
            counts[kind] += 1
    return "".join(out), counts


def _numbers_replaced(p: Permutation, text: str, counts: dict[str, int]) -> str:
    out, done, at = [], 0, 0
    while m := _VALUES.search(text, at):
        if m.lastgroup == "iban":
            got = _ibans(p, m)
        elif m.lastgroup == "number":
            got = _numbers(p, text, m)
        else:
            one = _pseudonym(p, m)
            got = [(*m.span(), *one)] if one else []
        for start, end, kind, new in got:
            out += [text[done:start], new]
            done = end
            counts[kind] += 1
        # What isn't an IBAN may hold another value after its first group; other values that aren't valid hold none.
        at = done if got else m.start() + 4 if m.lastgroup == "iban" else m.end()
    return "".join([*out, text[done:]])


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with the values in ``text_col`` replaced, and n_<kind> counts of them.

    Kinds: iban (mod 97; digits and letters), date (a day of FIRST_YEAR..LAST_YEAR, as yyyy-mm-dd, dd/mm/yyyy or dd.mm.yyyy; what is no day
    so but is one as mm/dd/yyyy is read and written so; of 03/04/1999, the third of April is meant), ip (four
    octets), phone (with country code, or 3-3-4 digits with - or . between), ssn (3-2-4 digits), card (13 to 19 digits that pass the
    Luhn check, as their pseudonyms do; of a longer run of groups, the part that passes) and number
    (13 to 19 other digits, also in what looks like an IBAN but isn't); and, as they are as personal, mail (the part
    of an address before the @) and hex (24 to 128 hexadecimal digits and letters, as keys and tokens are). What looks like another
    value but isn't valid stays. A null text stays null with no values. Rows may repeat; other
    columns pass through; n_<kind> replace columns of those names.
    """
    small_batches(docs.sparkSession)
    new = [f"n_{k}" for k in KINDS]
    kept = docs.select(*[F.col(c).cast("string").alias(c) if c == text_col else docs[c] for c in docs.columns if c not in new])
    schema = StructType(kept.schema.fields + [StructField(c, LongType()) for c in new])
    assert schema[text_col].dataType == StringType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permutation(key)
        for batch in batches:
            texts, counts = [], {k: [] for k in KINDS}
            for text in batch.column(text_col).to_pylist():
                out, n = (None, dict.fromkeys(KINDS, 0)) if text is None else replaced(p, text)
                texts.append(out)
                for k in KINDS:
                    counts[k].append(n[k])
            columns = [pa.array(texts, pa.string()) if f.name == text_col else batch.column(f.name) for f in batch.schema]
            yield pa.record_batch([*columns, *[pa.array(counts[k], pa.int64()) for k in KINDS]], names=[*batch.schema.names, *new])

    return kept.mapInArrow(frugal(run), schema)
