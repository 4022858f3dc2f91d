"""PII: numbers, dates and addresses become pseudonyms of the same format by a keyed Feistel permutation."""

from __future__ import annotations

import datetime
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 8
_FIRST, _LAST = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


class Permutation:
    """Keyed permutations of the integers below n, for any n: a Feistel network, repeated until the result is below n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, i: int, tweak: bytes, x: int, n: int) -> int:
        state = hashlib.blake2b(i.to_bytes(1, "big") + len(tweak).to_bytes(2, "big") + tweak + n.to_bytes((n.bit_length() + 7) // 8 + 1, "big") + b"|" + x.to_bytes((x.bit_length() + 7) // 8 + 1, "big"), key=self.key, digest_size=64)
        return int.from_bytes(state.digest(), "big")

    def __call__(self, x: int, n: int, tweak: bytes) -> int:
        if n < 2:
            return x
        width = math.isqrt(n - 1) + 1  # width * width >= n
        if width.bit_length() > 400:
            raise ValueError("domain too large")
        while True:
            left, right = divmod(x, width)
            for i in range(ROUNDS):
                left, right = right, (left + self._round(i, tweak, right, n)) % width
            x = left * width + right
            if x < n:
                return x


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASS = {c: kind for kind in _CLASSES for c in kind}


def permute_characters(text: str, permute: Permutation, tweak: bytes) -> str:
    """Digits to digits and letters to letters of the same case, 64 at a time; all other characters stay."""
    spots = [i for i, c in enumerate(text) if c in _CLASS]
    out = list(text)
    for at in range(0, len(spots), 64):
        own = spots[at : at + 64]
        x, n = 0, 1
        for i in own:
            kind = _CLASS[text[i]]
            x, n = x * len(kind) + kind.index(text[i]), n * len(kind)
        y = permute(x, n, tweak + at.to_bytes(4, "big"))
        for i in reversed(own):
            kind = _CLASS[text[i]]
            y, d = divmod(y, len(kind))
            out[i] = kind[d]
    return "".join(out)


def _with_digits(text: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _CLASSES[0])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _card(text: str, permute: Permutation) -> str | None:
    own = _digits(text)
    if not 13 <= len(own) <= 19 or not luhn(own) or len(set(own)) == 1:
        return None
    body = permute_characters(own[:-1], permute, b"card")
    return _with_digits(text, body + next(c for c in _CLASSES[0] if luhn(body + c)))


def _iban(text: str, permute: Permutation) -> str | None:
    bare = text.replace(" ", "")
    if not 15 <= len(bare) <= 34 or not iban(bare):
        return None
    body = permute_characters(bare[4:], permute, b"iban" + bare[:2].encode())
    check = 98 - int("".join(str(int(c, 36)) for c in body + bare[:2] + "00")) % 97
    left = iter(f"{bare[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(left) for c in text)


def _ssn(text: str, permute: Permutation) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    x = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, b"ssn")
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(text: str, permute: Permutation) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    x = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(text: str, permute: Permutation) -> str | None:
    mark = re.search(r"[-/.]", text).group()
    parts = text.split(mark)
    orders = ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy") if mark != "/" else ("mdy", "dmy")
    for order in orders:
        by = {k: int(v) for k, v in zip(order, parts)}
        try:
            day = datetime.date(by["y"], by["m"], by["d"])
        except ValueError:
            continue
        if not _FIRST <= day <= _LAST:
            return None
        short = {k for k, v in zip(order, parts) if len(v) == 1}
        new = day
        while True:  # walks on to a date whose one-digit parts are one digit again
            new = _FIRST + datetime.timedelta(permute((new - _FIRST).days, (_LAST - _FIRST).days + 1, b"date"))
            if not ("m" in short and new.month > 9 or "d" in short and new.day > 9):
                break
        values = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return mark.join(values[k][1:] if k in short else values[k] for k in order)
    return None


def _phone(text: str, permute: Permutation) -> str | None:
    own = _digits(text)
    if not 7 <= len(own) <= 15:
        return None
    code = len(_digits(re.match(r"(?:\+\d{1,3}(?=[ .(-]))?", text).group()))
    return _with_digits(text, own[:code] + permute_characters(own[code:], permute, b"phone"))


def _email(text: str, permute: Permutation) -> str | None:
    local, _, domain = text.rpartition("@")
    name, _, top = domain.rpartition(".")
    new = permute_characters(name.lower(), permute, b"domain" + top.lower().encode())
    new = "".join(c.upper() if old.isupper() else c for c, old in zip(new, name))
    return f"{permute_characters(local, permute, b'email' + domain.lower().encode())}@{new}.{top}"


def _secret(text: str, permute: Permutation) -> str | None:
    if not (any(c.isdigit() for c in text) and any(c.isalpha() for c in text)):
        return None
    if re.fullmatch("[0-9a-f]+", text):
        parts = [text[i : i + 64] for i in range(0, len(text), 64)]
        return "".join(f"{permute(int(x, 16), 16 ** len(x), b'hex' + i.to_bytes(4, 'big')):0{len(x)}x}" for i, x in enumerate(parts))
    return permute_characters(text, permute, b"secret")


#: Kinds in the order in which they are tried where they begin at the same place: pattern and pseudonym.
KINDS = {
    "email": (r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),  # from the @ on; the local part is found backwards
    "date": (r"(?<![\d.])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d.]*\d)", _date),
    "ip": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", _ip),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    "phone": (r"(?<![\d])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)", _phone),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    "card": (r"(?<![\d-])\d(?:[ -]?\d){12,}(?![\d-]*\d)", _card),
    "secret": (r"(?<![A-Za-z0-9_=-])(?:[0-9a-f]{32,}|[A-Za-z0-9_-]{36,})(?![A-Za-z0-9_])|(?:(?<=password=)|(?<=passwd=)|(?<=secret=)|(?<=token=)|(?<=api_key=)|(?<=apikey=))[^\s\"']{6,}", _secret),
}
_FIND = {kind: re.compile(pattern) for kind, (pattern, _) in KINDS.items()}
_HINT = re.compile(r"\d")


#: Length of the IBANs of each country, and the usual groups of a card's digits.
_IBAN_LENGTH = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 3, 3, 3)}


def _ibans(text: str, m: re.Match) -> list[tuple[int, int]]:
    """Where an IBAN that begins where m does may end: at the country's length first, then at each space, the last first."""
    ends = [m.end(), *(x.start() for x in reversed(list(re.finditer(" ", m.group()))))]
    ends = [ends[0], *(m.start() + x for x in ends[1:])]
    known = _IBAN_LENGTH.get(m.group()[:2])
    return [(m.start(), e) for e in sorted(ends, key=lambda e: len(text[m.start() : e].replace(" ", "")) != known)]


def _cards(text: str, m: re.Match) -> list[tuple[int, int]]:
    """The runs of whole groups of m that have a card's 13 to 19 digits: usual groups first, then from the left, the longest first."""
    groups = [(x.start(), x.end()) for x in re.finditer(r"\d+", text[m.start() : m.end()])]
    out = []
    for i, (start, _) in enumerate(groups):
        n = 0
        for j in range(i, len(groups)):
            n += groups[j][1] - groups[j][0]
            if n > 19:
                break
            if n >= 13:
                sizes = tuple(e - s for s, e in groups[i : j + 1])
                out.append((i != j and sizes not in _CARD_GROUPS, start, -groups[j][1]))
    return [(m.start() + s, m.start() - e) for _, s, e in sorted(out)]


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str, m: re.Match) -> list[tuple[int, int]]:
    """The address of which m is the end, if a local part stands before it."""
    start = m.start()
    while start and text[start - 1] in _LOCAL:
        start -= 1
    return [(start, m.end())] if start < m.start() else []


#: The parts of a match to try, in order: addresses with their local parts and, of kinds with a check digit, less than the
#: match, as what stands beside a value may look like more of it.
_PARTS = {"email": _emails, "iban": _ibans, "card": _cards}


def spans(text: str, permute: Permutation) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of what is found and valid; where two overlap, the kind listed first stays.

    The time is in proportion to the text, but for what a pattern may look back, which no pattern repeats.
    """
    found: list[tuple[int, int, str, str]] = []
    taken: bytearray | None = None
    digits, at = _HINT.search(text) is not None, "@" in text
    for kind, pattern in _FIND.items():
        if not (at if kind == "email" else digits):
            continue
        place = 0
        while m := pattern.search(text, place):
            begin, place = len(found), m.end()
            for start, end in _PARTS[kind](text, m) if kind in _PARTS else [m.span()]:
                if taken is not None and any(taken[start:end]):
                    continue
                new = KINDS[kind][1](text[start:end], permute)
                if new is not None:
                    found.append((start, end, kind, new))
                    taken = bytearray(len(text)) if taken is None else taken
                    taken[start:end] = b"\1" * (end - start)
            if kind == "iban":
                place = found[-1][1] if len(found) > begin else m.start() + 1
    return sorted(found)


def pseudonymise(text: str, permute: Permutation) -> tuple[str, list[str]]:
    out, at, kinds = [], 0, []
    for start, end, kind, new in spans(text, permute):
        out += [text[at:start], new]
        at = end
        kinds.append(kind)
    return "".join([*out, text[at:]]), kinds


def replace_pii(docs: DataFrame, key: bytes = b"docspark") -> DataFrame:
    """docs with pseudonyms in text, and a column pii: the kinds found, in order.

    E-mail addresses, dates, IPv4 addresses, social security numbers, phone numbers, IBANs, card numbers and secrets
    are found by pattern and, where the format has a check, validated (calendar, ranges, Luhn, mod 97); what fails
    stays. Of a run of groups that is no card or IBAN as a whole, the runs of its groups are tried. A value is permuted
    within its format by a Feistel network under the key, so equal values get equal pseudonyms in all documents,
    different ones different pseudonyms, and check digits and widths hold; of an address the top-level domain stays.
    Nothing is shuffled.

    A null text stays null with no kinds; an empty one stays empty. A very long text is searched whole, in time
    proportional to its length. All rows stay, repeated and null ids too, and all columns; a column named pii gives way
    to the new one. An empty table gives an empty result. ``key`` must be kept secret in real use.
    """

    def run(batches):
        permute = Permutation(key)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                done = [(None, []) if t is None else pseudonymise(t, permute) for t in part.column("text").to_pylist()]
                columns = {c: part.column(c) for c in part.schema.names}
                columns["text"] = pa.array([t for t, _ in done], pa.string())
                columns["pii"] = pa.array([k for _, k in done], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    docs = docs.drop("pii")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pii", T.ArrayType(T.StringType()))]))
