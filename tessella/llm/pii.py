"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

A detected value is validated (checksums, ranges, calendar), turned into a number within the set of all values of its
format, permuted there by a keyed Feistel network, and written back in the same format. Equal values get equal
pseudonyms in every document, different ones different, and a pseudonym is valid in the same sense as its value:
cards and account numbers get matching check digits, dates stay dates, addresses keep their shape. What does not
validate is left alone.

A date is permuted as its day, however it is written, so ``2024-02-29`` and ``29.02.2024`` stay linked. Only dates that
can be read month first alone (``07/30/2054``) are permuted among themselves: written month first, a pseudonym with a
day of 12 or less would be read as another day.

Defined results: null stays null with zero counts; a text without finds, the empty one included, stays as it is, byte
for byte; repeated rows and values get the same pseudonyms in each; texts and values of any length are taken whole, in
time that grows with their length; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from datetime import date, timedelta
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = b"set a secret key of your own"
ROUNDS = 10
KINDS = ("email", "secret", "iban", "ip", "date", "ssn", "phone", "card")
#: What stands before a secret, and how the ids of access keys begin.
SECRET_WORDS, ACCESS_ID = "p(?:assword|asswd|wd)|s(?:ecret)|t(?:oken)|a(?:pi[_-]?key)|access[_-]?key", "AKIA"
#: Only texts that hold one of these can hold a find; the others do not leave the JVM. A character that the JVM does not
#: know (Cn) may be a digit of a later Unicode version. What stands before a secret counts only if its mark stands there too.
CANDIDATE, SECRET_MARK = r"[\p{Nd}\p{Cn}@]", "[=:]"

#: First and last day of the calendar within which dates are permuted.
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


def _stream(key: bytes, tweak: str, i: int, value: bytes, n: int) -> bytes:
    """n bytes that key, tweak, round and value decide: as many as what they are added to needs, and a margin."""
    head = hashlib.blake2b(f"{tweak}|{i}|{len(value)}".encode(), key=key[:64]).digest()
    return hashlib.shake_256(head + value).digest(n)


def permute(value: int, a: int, b: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(a * b): a Feistel network over the halves of sizes a and b, adding within each."""
    left, right = divmod(value, b)
    n = (max(a, b).bit_length() + 135) // 8  # 16 bytes more than a half has, so that remainders are as good as even

    def step(i: int, half: int) -> int:
        return int.from_bytes(_stream(key, tweak, i, half.to_bytes(n, "big"), n), "big")

    for i in range(0, ROUNDS, 2):
        left = (left + step(i, right)) % a
        right = (right + step(i + 1, left)) % b
    return left * b + right


def permute_range(value: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(n), walking the cycle of a slightly larger Feistel network back into the range."""
    b = max(1, int(n**0.5))
    a = -(-n // b)
    value = permute(value, a, b, key, tweak)
    while value >= n:
        value = permute(value, a, b, key, tweak)
    return value


def permute_digits(digits: Sequence[int], radices: Sequence[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of the strings of digits with these radices: a Feistel network whose halves are strings, each
    digit moved on within its own radix, so that the work grows with the number of digits."""
    half, r = len(digits) // 2, np.asarray(radices, np.uint64)
    left, right = (np.asarray(d, np.uint64) for d in (digits[:half], digits[half:]))
    tweak = f"{tweak}{hashlib.sha256(r.astype('<u8').tobytes()).hexdigest()}"

    def moved(x: np.ndarray, by: np.ndarray, i: int, radix: np.ndarray) -> np.ndarray:
        return (x + np.frombuffer(_stream(key, tweak, i, by.astype("<u8").tobytes(), 8 * len(x)), "<u8") % radix) % radix

    for i in range(0, ROUNDS, 2):
        left = moved(left, right, i, r[:half])
        right = moved(right, left, i + 1, r[half:])
    return [*left.tolist(), *right.tolist()]


def permute_text(text: str, key: bytes, tweak: str, sets: Sequence[str] = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) -> str:
    """Permutes the characters of the sets, each within its own set; all others stay where they are."""
    places = [(i, s) for i, c in enumerate(text) for s in sets if c in s]
    if not places:
        return text
    shape = re.sub(r"[0-9A-Za-z]", "x", text)
    new = permute_digits([s.index(text[i]) for i, s in places], [len(s) for _, s in places], key, tweak + shape)
    out = list(text)
    for (i, s), d in zip(places, new, strict=True):
        out[i] = s[d]
    return "".join(out)


def _fill(text: str, digits: Sequence[int]) -> str:
    rest = iter(digits)
    return "".join(str(next(rest)) if c.isdigit() else c for c in text)


def luhn(digits: Sequence[int]) -> bool:
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0


def _card(text: str, key: bytes) -> str | None:
    digits = [int(c) for c in text if c.isdigit()]
    if not 13 <= len(digits) <= 19 or not luhn(digits) or not any(digits):
        return None
    new = [digits[0], *permute_digits(digits[1:-1], [10] * (len(digits) - 2), key, f"card{digits[0]}")]
    return _fill(text, [*new, next(c for c in range(10) if luhn([*new, c]))])


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
        return None
    account = permute_text(plain[4:], key, f"iban{plain[:2]}")
    rest = iter(plain[:2] + iban_check(plain[:2], account) + account)
    return "".join(c if c == " " else next(rest) for c in text)


def _ip(text: str, key: bytes) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    ranges = [(0, 10) if p < 10 else (10, 90) if p < 100 else (100, 156) for p in parts]  # a number keeps its digits' count
    new = permute_digits([p - a for p, (a, _) in zip(parts, ranges, strict=True)], [n for _, n in ranges], key, "ip")
    return ".".join(str(d + a) for d, (a, _) in zip(new, ranges, strict=True))


#: Shapes of dates: pattern and the order of year, month and day in it.
DATES = ((re.compile(r"(\d{4})([-/.])(\d\d?)\2(\d\d?)\Z"), "ymd"), (re.compile(r"(\d\d?)([-/.])(\d\d?)\2(\d{4})\Z"), "dmy"))


def _day(y: str, mo: str, d: str) -> date | None:
    try:
        day = date(int(y), int(mo), int(d))
    except ValueError:
        return None
    return day if FIRST_DAY <= day <= LAST_DAY else None


def _other_day(day: date, key: bytes) -> date:
    return FIRST_DAY + timedelta(permute_range((day - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, key, "date"))


def _date(text: str, key: bytes) -> str | None:
    for pattern, order in DATES:
        if not (m := pattern.match(text)):
            continue
        a, mark, b, c = m.groups()
        month_first = False
        y, mo, d = (a, b, c) if order == "ymd" else (c, b, a)
        if (day := _day(y, mo, d)) is None and order == "dmy":
            month_first, y, mo, d = True, c, a, b
            day = _day(y, mo, d)
        if day is None:
            return None
        new = _other_day(day, key)
        while month_first and new.day <= 12:  # such days of the calendar are permuted among themselves
            new = _other_day(new, key)
        # a month or day of one digit has no leading zero in its pseudonym either
        y, mo, d = f"{new.year:04d}", f"{new.month:0{len(mo)}d}", f"{new.day:0{len(d)}d}"
        return mark.join((y, mo, d) if order == "ymd" else (mo, d, y) if month_first else (d, mo, y))
    return None


def _ssn(text: str, key: bytes) -> str | None:
    area, group, serial = (int(p) for p in re.split("[- ]", text))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    # areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999
    new = permute_range(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn")
    (new, serial), mark = divmod(new, 9999), text[3]
    area, group = divmod(new, 99)
    return f"{area + 1 + (area >= 665):03d}{mark}{group + 1:02d}{mark}{serial + 1:04d}"


def _phone(text: str, key: bytes) -> str | None:
    digits = [int(c) for c in text if c.isdigit()]
    if not 8 <= len(digits) <= 15:
        return None
    # The country code stays, in so far as it can be told; leading digits of area and exchange stay in 2 to 9.
    keep = len(re.match(r"\+?(\d{0,3})", text)[1]) if text.startswith("+") and not text[1:2].isspace() else 0
    keep = min(keep, len(digits) - 7)
    rest = digits[keep:]
    low = [2 if len(rest) == 10 and k in (0, 3) and rest[0] > 1 and rest[3] > 1 else 0 for k in range(len(rest))]
    new = permute_digits([d - m for d, m in zip(rest, low, strict=True)], [10 - m for m in low], key, f"phone{digits[:keep]}")
    return _fill(text, [*digits[:keep], *(d + m for d, m in zip(new, low, strict=True))])


def _email(text: str, key: bytes) -> str | None:
    local, _, domain = text.rpartition("@")
    labels = domain.split(".")
    if not local or len(labels) < 2 or not all(labels):
        return None
    # The last two labels stay: they say what kind of address it is, not whose.
    host = ".".join([permute_text(".".join(labels[:-2]), key, "host"), *labels[-2:]]) if labels[:-2] else domain
    return f"{permute_text(local, key, f'email{domain}')}@{host}"


def _secret(text: str, key: bytes) -> str | None:
    if re.fullmatch(r"AKIA[0-9A-Z]{16}", text):
        return text[:4] + permute_text(text[4:], key, "aws", ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",))
    if re.fullmatch(r"[0-9a-f]+", text):
        return permute_text(text, key, "hex", ("0123456789abcdef",))
    return permute_text(text, key, "secret")


#: Finds by kind: the pattern (a group named v, else the whole match, is the value) and the pseudonym of a valid value.
#: Patterns start with a character or a small set of them, which is what makes scanning fast; what may stand before a
#: find is checked after its first character. That of cards takes whole runs of groups of digits, see ``_cards``.
FINDS: tuple[tuple[str, re.Pattern, Callable[[str, bytes], str | None]], ...] = (
    ("secret", re.compile(rf"{ACCESS_ID[0]}(?<!\w{ACCESS_ID[0]}){ACCESS_ID[1:]}[0-9A-Z]{{16}}(?!\w)"), _secret),
    ("secret", re.compile(rf"""(?:{SECRET_WORDS})["']?\s{{0,3}}{SECRET_MARK}\s{{0,3}}["']?(?P<v>[\w+/.-]{{8,}}=*)""", re.I), _secret),
    ("email", re.compile(r"(?<![\w.+-])(?P<v>[\w.+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)"), _email),
    ("iban", re.compile(r"[A-Z](?<![\w][A-Z])[A-Z]\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)"), _iban),
    ("date", re.compile(r"\d(?<![\w./-]\d)(?:\d{3}([-/.])\d\d?\1\d\d?|\d?([-/.])\d\d?\2\d{4})(?:(?=[Tt]\d\d)|(?![\w/-]))(?!\.\d)"), _date),
    ("ip", re.compile(r"\d(?<![\w.]\d)\d{0,2}(?:\.\d{1,3}){3}(?![\w])(?!\.\d)"), _ip),
    ("ssn", re.compile(r"\d(?<![\w-]\d)\d\d([- ])\d\d\1\d{4}(?![\w])(?!-\d)"), _ssn),
    ("phone", re.compile(r"\+(?<!\w\+)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"), _phone),
    ("card", re.compile(r"\d(?<!\d\d)(?<!\d[ -]\d)(?:[ -]?\d){12,}"), _card),
    ("phone", re.compile(r"[(\d](?<![\w.(+-][(\d])(?:\d{3}\) ?|(?<=\d)\d\d[ .-])\d{3}[ .-]\d{4}(?!\w)(?!-\d)"), _phone),
)
_DIGITS, _GOES_ON = re.compile(r"\d+"), re.compile(r"\w|\.\d|-\d")
_DIGIT, _KEYWORD = re.compile(r"\d"), re.compile(f"{ACCESS_ID}|{SECRET_WORDS}", re.I)


#: What stands between the groups of a value, and how the digits of a card are grouped if they are.
_MARK, CARD_GROUPS = re.compile(r"[ .()-]+"), {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 5), (4, 4, 4, 4, 3)}


def _shorter(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """The span and its beginnings that end before a mark, longest first."""
    return [(lo, hi), *((lo, m.start()) for m in reversed(list(_MARK.finditer(text, lo + 1, hi))))]


def _cards(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Spans of whole groups within a run of groups of digits that have as many digits as a card.

    All of the run comes first, then groups as they are printed on cards, then more digits before fewer.
    """
    groups = [m.span() for m in _DIGITS.finditer(text, lo, hi)]
    own_start = not (lo and (text[lo - 1] in ".-_" or text[lo - 1].isalnum()))
    own_end = not _GOES_ON.match(text, hi)
    spans = []
    for i, (a, _) in enumerate(groups):
        sizes: list[int] = []
        for j in range(i, len(groups)):
            sizes.append(groups[j][1] - groups[j][0])
            if sum(sizes) > 19:
                break
            if sum(sizes) >= 13 and (i or own_start) and (j < len(groups) - 1 or own_end):
                spans.append((len(sizes) < len(groups), len(sizes) > 1 and tuple(sizes) not in CARD_GROUPS, -sum(sizes), a, groups[j][1]))
    return [s[-2:] for s in sorted(spans)]


def find(text: str, key: bytes = KEY) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the valid finds, in order; of overlapping ones the kind listed first wins."""
    taken: list[tuple[int, int, str, str]] = []
    used = bytearray(len(text))  # 1 where something is taken
    digit, at_sign, keyword = bool(_DIGIT.search(text)), "@" in text, bool(_KEYWORD.search(text))
    for kind, pattern, change in FINDS:
        if kind == "email" and not at_sign or kind == "secret" and not keyword or kind not in ("email", "secret") and not digit:
            continue
        group, at = "v" if "v" in pattern.groupindex else 0, 0
        while m := pattern.search(text, at):
            lo, hi = m.span(group)
            at = max(m.end(), m.start() + 1)
            for a, b in _cards(text, lo, hi) if kind == "card" else _shorter(text, lo, hi) if kind in ("iban", "phone") else [(lo, hi)]:
                if used.find(1, a, b) < 0 and (new := change(text[a:b], key)) is not None:
                    taken.append((a, b, kind, new))
                    used[a:b] = b"\1" * (b - a)
                    if kind != "card":
                        at = max(b, m.start() + 1)
                        break
            else:
                if kind != "card" and (first := _MARK.search(text, lo + 1, hi)):
                    at = first.end()  # what follows the first group may be a find of its own
    return sorted(taken)


def replace(text: str, key: bytes = KEY) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and the number of finds by kind."""
    counts, out, done = dict.fromkeys(KINDS, 0), [], 0
    for lo, hi, kind, new in find(text, key):
        out += [text[done:lo], new]
        counts[kind] += 1
        done = hi
    return "".join([*out, text[done:]]) if out else text, counts


@lru_cache(4)
def _udf(key: bytes) -> Callable:
    schema = "text string, " + ", ".join(f"n_{k} long" for k in KINDS)

    @F.pandas_udf(schema)
    def udf(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            new, counts = (None, dict.fromkeys(KINDS, 0)) if t is None else replace(t, key)
            rows.append((None if new == t else new, *counts.values()))  # an unchanged text needn't come back
        return pd.DataFrame(rows, columns=["text", *(f"n_{k}" for k in KINDS)]).astype({f"n_{k}": "int64" for k in KINDS})

    return udf


def pseudonyms(text: Column, key: bytes = KEY) -> Column:
    """A struct of the replaced text (null if nothing changed) and the number of finds of each kind."""
    secret = text.rlike(SECRET_MARK) & text.rlike(f"(?iu:{SECRET_WORDS})")
    return _udf(key)(F.when(text.rlike(CANDIDATE) | F.contains(text, F.lit(ACCESS_ID)) | secret, text))
