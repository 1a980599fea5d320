"""Personal data replaced by format-preserving Feistel pseudonyms.

Numbers and dates that pass their check are permuted, under a key, within the values of their own format: a card number
becomes another of the same length with a right check digit, a date another day between 1900 and 2099 written alike. Equal
values become equal pseudonyms in all documents, and whoever has the key can undo them (`inverse`). E-mail addresses keep
their form: each letter and digit is replaced by one of its class, the last label of the host stays. A class is the digits,
a-z, A-Z, or, for other letters and digits, those of the same Unicode category among the same 128 code points. Days and
months of dates that begin with the day are written with two digits.

Kinds and checks: card (13 to 19 digits, check digit), iban (check digits), ssn (no reserved group), date (a day of the
calendar; the month may come first where the day is above 12; a time may follow after a T), ip (four numbers up to 255),
phone (with + and 8 to 15 digits, or ten digits in North American groups), email. Other numbers stay. What fails its check
is tried again without its last groups, as each other kind that can begin there, and then from its next group on, so that a
number beside a card or a word after an IBAN doesn't hide these.

Defined results: a null text counts as empty; texts are read whole, whatever their length; rows that share a doc_id are each
returned; other columns, of whatever name, play no part; an empty table gives no rows; an empty key is refused. A
permutation may map a value to itself, as often as chance has it (1 in 73,049 dates, 1 in 10^12 cards or fewer). A whole
text is undone as long as its pseudonyms are found again where they are: where digits stand right beside a number, by chance
a longer run may pass a check.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import string
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landfold.llm.bpe import slices
from landfold.llm.common import table, text_of

KINDS = ("email", "card", "iban", "ssn", "date", "ip", "phone")
#: The key of the registered query; callers give their own.
DEMO_KEY = b"landfold demonstration key"
ROUNDS = 8
LETTERS = 64
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: Taken out of the other classes.
_PLAIN = {ord(c): None for c in string.digits + string.ascii_letters}
_WORTH = re.compile(r"[\d@]")
_PATTERNS = {
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ymd": r"(?<![\w.-])\d{4}(?P<y>[-/.])\d{2}(?P=y)\d{2}(?=T\d\d|(?![\w-]))",
    "dmy": r"(?<![\w.-])\d{1,2}(?P<d>[-/.])\d{1,2}(?P=d)\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w+])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
_ALONE = {kind: re.compile(p, re.A) for kind, p in _PATTERNS.items()}
_FOUND = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in _PATTERNS.items()), re.A)
_WORD = re.compile(r"\w+", re.A)
_LOCAL_SIGNS = frozenset("_.+-'%")
_HOST = re.compile(r"(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)+")
_CLASSES = {c: k for k in (string.digits, string.ascii_lowercase, string.ascii_uppercase) for c in k}


def feistel(value: int, size: int, key: bytes, kind: str, inverse: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced network over the next even number of bits, repeated until it falls
    below size. Keys of any length: those that the hash can't take are hashed down themselves."""
    if not key:
        raise ValueError("a key is needed")
    key = key if len(key) <= 64 else hashlib.blake2b(key).digest()
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8

    def mixed(r: int, x: int) -> int:
        h = hashlib.blake2b(x.to_bytes(width, "big"), key=key, person=f"{kind[:8]}:{r}:{size % 997}".encode()[:16], digest_size=min(64, width + 8))
        return int.from_bytes(h.digest(), "big") & mask

    while True:
        a, b = value >> half, value & mask
        if inverse:
            for r in reversed(range(ROUNDS)):
                a, b = b ^ mixed(r, a), a
        else:
            for r in range(ROUNDS):
                a, b = b, a ^ mixed(r, b)
        value = a << half | b
        if value < size:
            return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows digits."""
    total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _put(form: str, digits: str) -> str:
    """digits in the places of those of form."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


class Cipher:
    """The permutations under a key, forward or inverse."""

    def __init__(self, key: bytes, inverse: bool = False):
        self.key, self.inverse = key, inverse

    def number(self, value: int, size: int, kind: str) -> int:
        return feistel(value, size, self.key, kind, self.inverse)

    def digits(self, digits: str, kind: str) -> str:
        return f"{self.number(int(digits), 10 ** len(digits), kind):0{len(digits)}d}" if digits else ""

    def letters(self, text: str, kind: str) -> str:
        """Letters and digits as one number in mixed places, permuted; other characters stay. A text of over LETTERS
        characters goes in parts, as a round mixes 64 bytes at most."""
        if len(text) > LETTERS:
            return "".join(self.letters(text[k : k + LETTERS], kind) for k in range(0, len(text), LETTERS))
        classes = [letter_class(c) for c in text if c.isalnum()]
        value, size = 0, 1
        for c, of in zip((c for c in text if c.isalnum()), classes, strict=True):
            value, size = value * len(of) + of.index(c), size * len(of)
        value = self.number(value, size, kind) if size > 1 else value
        out = []
        for of in reversed(classes):
            value, k = divmod(value, len(of))
            out.append(of[k])
        return "".join(out.pop() if c.isalnum() else c for c in text)


@functools.lru_cache(4096)
def _other_class(block: int, category: str) -> str:
    return "".join(c for c in map(chr, range(block << 7, (block + 1) << 7)) if unicodedata.category(c) == category and c.isalnum())


def letter_class(c: str) -> str:
    """The characters that c may become, itself among them."""
    return _CLASSES.get(c) or _other_class(ord(c) >> 7, unicodedata.category(c)).translate(_PLAIN)


def _card(text: str, cipher: Cipher) -> str | None:
    digits = _digits(text)
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = cipher.digits(digits[:-1], "card")
    return _put(text, body + luhn_digit(body))


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _iban(text: str, cipher: Cipher) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = cipher.letters(plain[4:], "iban")
    check = 98 - _iban_number(body + plain[:2] + "00") % 97
    it = iter(plain[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(it) for c in text)


def _ssn(text: str, cipher: Cipher) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    digits = _digits(text)
    if not valid(digits):
        return None
    digits = cipher.digits(digits, "ssn")
    while not valid(digits):
        digits = cipher.digits(digits, "ssn")
    return _put(text, digits)


def _day(year: str, month: str, day: str, cipher: Cipher) -> datetime.date | None:
    """A day above 12 stays above 12, and one up to 12 stays so, whatever the form: a date that is written month first can be
    told by its day alone, and is to get the same pseudonym as in other forms."""
    try:
        old = datetime.date(int(year), int(month), int(day))
    except ValueError:
        return None
    n = old.toordinal()
    if not FIRST_DAY <= n <= LAST_DAY:
        return None
    while True:
        n = FIRST_DAY + cipher.number(n - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date")
        new = datetime.date.fromordinal(n)
        if (new.day > 12) == (old.day > 12):
            return new


def _ymd(text: str, cipher: Cipher) -> str | None:
    d = _day(text[:4], text[5:7], text[8:], cipher)
    return d and f"{d.year}{text[4]}{d.month:02d}{text[7]}{d.day:02d}"


def _dmy(text: str, cipher: Cipher) -> str | None:
    sign = next(c for c in text if not c.isdigit())
    day, month, year = text.split(sign)
    d = _day(year, month, day, cipher)
    if d:
        return f"{d.day:02d}{sign}{d.month:02d}{sign}{d.year}"
    d = _day(year, day, month, cipher)  # month first: the day is above 12
    return d and f"{d.month:02d}{sign}{d.day:02d}{sign}{d.year}"


def _ip(text: str, cipher: Cipher) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    return ".".join(map(str, cipher.number(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip").to_bytes(4, "big")))


#: The country codes of one and of two digits; all others have three.
COUNTRY_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(text: str, cipher: Cipher) -> str | None:
    """Behind a plus sign the country's code stays, however the number is spaced."""
    digits = _digits(text)
    if not 8 <= len(digits) <= 15:
        return None
    country = next((n for n in (1, 2) if digits[:n] in COUNTRY_CODES), 3) if text[0] == "+" else 0
    country = min(country, len(digits) - 7)
    return _put(text, digits[:country] + cipher.digits(digits[country:], "phone"))


_BY_KIND = {"card": ("card", _card), "iban": ("iban", _iban), "ssn": ("ssn", _ssn), "ymd": ("date", _ymd), "dmy": ("date", _dmy), "ip": ("ip", _ip), "phone": ("phone", _phone)}


def _shorter(text: str, start: int, limit: int, failed: str, cipher: Cipher) -> tuple[int, str, str] | None:
    """Where the match of kind `failed` from start has failed its check: the first kind that passes there as a whole or
    without its last groups, the longest first; its end, kind and pseudonym."""
    for name, pattern in _ALONE.items():
        m = pattern.match(text, start, limit)
        if not m:
            continue
        kind, change = _BY_KIND[name]
        for stop in reversed([w.end() for w in _WORD.finditer(text, start, m.end())]):
            if (name != failed or stop != m.end()) and pattern.fullmatch(text, start, stop):
                changed = change(text[start:stop], cipher)
                if changed is not None:
                    return stop, kind, changed
    return None


def _numbers(text: str, start: int, end: int, cipher: Cipher) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of what isn't an e-mail address between start and end."""
    while m := _FOUND.search(text, start, end):
        kind, change = _BY_KIND[m.lastgroup]
        found = m.end(), kind, change(m[0], cipher)
        if found[2] is None:
            found = _shorter(text, m.start(), end, m.lastgroup, cipher)
        if found:
            yield m.start(), *found
            start = found[0]
        else:  # on from its next group
            start = _WORD.search(text, m.start()).end()


def pseudonymised(text: str, key: bytes, inverse: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind it had; or with pseudonyms undone."""
    cipher = Cipher(key, inverse)
    counts = dict.fromkeys(KINDS, 0)
    if not _WORTH.search(text):
        return text, counts
    spots: list[tuple[int, int, str]] = []
    at = text.find("@")
    while at >= 0:
        host = _HOST.match(text, at + 1)
        if host:
            start, least = at, spots[-1][1] if spots else 0
            while start > least and (text[start - 1].isalnum() or text[start - 1] in _LOCAL_SIGNS or unicodedata.combining(text[start - 1])):
                start -= 1
            if start < at:
                labels, last = host[0].rsplit(".", 1)
                spots.append((start, host.end(), f"{cipher.letters(text[start:at], 'local')}@{cipher.letters(labels, 'host')}.{last}"))
                counts["email"] += 1
        at = text.find("@", at + 1)
    done, numbers = 0, []
    for start, end, _ in [*spots, (len(text), 0, "")]:
        for a, b, kind, new in _numbers(text, done, start, cipher):
            counts[kind] += 1
            numbers.append((a, b, new))
        done = end
    out, done = [], 0
    for start, end, new in sorted(spots + numbers):
        out += [text[done:start], new]
        done = end
    return "".join([*out, text[done:]]), counts


def pseudonymise(docs: DataFrame, key: bytes, inverse: bool = False) -> DataFrame:
    """doc_id, the text with pseudonyms (or with these undone), and n_ of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                found = [pseudonymised(t, key, inverse) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([t for t, _ in found], pa.string()), *(pa.array([c[k] for _, c in found], pa.int64()) for k in KINDS)], ["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text string, " + ", ".join(f"n_{k} bigint" for k in KINDS))


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0))
    return pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY).withColumns({"n_private": total, "has_private": total > 0})


QUERIES: dict[str, Callable] = {"op4_feistel_pseudonyms": op4_feistel_pseudonyms}
ORACLE_SQL: dict[str, str] = {}
