"""Personal data by anchor expansion.

One Aho-Corasick automaton goes over a text and stops at anchors: at-signs, a
plus before a digit, a dot between digits, digits, schemes and identifier cues.
At each anchor a small deterministic parser expands left and right to the
boundaries and validates what it holds. Positions are code points, ends exclusive.

Base kinds, each leftmost and non-overlapping within its kind: ``email``, ``ip``
(four parts of at most 255), ``card`` (16 to 19 digits passing Luhn) and
``phone`` (8 to 15 digits after a plus). A candidate that fails validation is
dropped and not tried again at another length. The anchors add ``login`` (user
information in front of the host of a scheme) and ``account`` (after a cue: an
IBAN of the right remainder, or 6 to 17 digits).

Defined results: null and empty texts have no spans; spans of different kinds
may overlap, and redaction then joins them under the first one's kind; every
parser is linear in what lies between two anchors, so very long texts are fine.
"""

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from glyphloom.llm.frames import appended, guarded, quoted

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = "0123456789"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+(?::[A-Za-z0-9._~%!$&'()*+,;=-]*)?@[A-Za-z0-9.-]+")
_GAP = re.compile(r"(?: (?:no|number|nr))?[ .:#=]{1,4}", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_ACCOUNT = re.compile(r"[0-9](?:-?[0-9]){5,16}(?![0-9-])")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
CUES = ("iban", "account", "acct", "ssn", "passport")
_automata = {}


def _anchors() -> ahocorasick.Automaton:
    """Built once a process: anchor to (kind, its length)."""
    if "all" not in _automata:
        found = ahocorasick.Automaton()
        words = [("@", "email"), *((s, "login") for s in SCHEMES)]
        words += [(f"+{d}", "phone") for d in _DIGITS] + [(d, "card") for d in _DIGITS]
        words += [(f"{a}.{b}", "ip") for a in _DIGITS for b in _DIGITS]
        words += [(v, "account") for c in CUES for v in {c, c.upper(), c.capitalize()}]
        for word, kind in words:
            found.add_word(word, (kind, len(word)))
        found.make_automaton()
        _automata["all"] = found
    return _automata["all"]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    turned = plain[4:] + plain[:4]
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _email(text, at, floor):
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end(), True) if domain else None


def _ip(text, at, floor):
    if at < floor:
        return None
    while at > floor and text[at - 1] in _DIGITS:
        at -= 1
    m = _IP.match(text, at)
    return (at, m.end(), all(_small(p) for p in m.group().split("."))) if m else None


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _card(text, at, floor):
    m = _CARD.match(text, at) if at >= floor else None
    if not m:
        return None
    digits = m.group().replace(" ", "").replace("-", "")
    return at, m.end(), 16 <= len(digits) <= 19 and luhn(digits)


def _phone(text, at, floor):
    m = _PHONE.match(text, at) if at >= floor else None
    return (at, m.end(), 8 <= sum(c in _DIGITS for c in m.group()) <= 15) if m else None


def _login(text, at, floor):
    at = text.index("//", at) + 2
    m = _LOGIN.match(text, at) if at >= floor else None
    return (at, m.end(), True) if m else None


def _account(text, at, floor):
    gap = _GAP.match(text, at) if at >= floor else None
    if not gap:
        return None
    m = _IBAN.match(text, gap.end())
    while m and not iban_valid(m.group()) and " " in m.group():  # the last group may be the next word
        m = _IBAN.fullmatch(text, m.start(), m.start() + m.group().rindex(" "))
    if m and iban_valid(m.group()):
        return m.start(), m.end(), True
    m = _ACCOUNT.match(text, gap.end())
    return (m.start(), m.end(), True) if m else None


_PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "login": _login, "account": _account}


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data, by kind as listed, then start."""
    found = {kind: [] for kind in KINDS}
    floor = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in _anchors().iter(text or ""):
        at = last + 1 if kind == "account" else last + 1 - length
        if kind == "card" and at < floor[kind]:
            continue
        hit = _PARSERS[kind](text, at, floor[kind])
        if hit:
            start, end, valid = hit
            floor[kind] = end
            if valid:
                found[kind].append((kind, start, end))
    return [s for kind in KINDS for s in found[kind]]


def joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str | None, found) -> str | None:
    """The text with each stretch of spans replaced by its first span's kind in brackets."""
    out, at, end = [], 0, 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[max(at, end):a] if out else text[:a], f"[{kind.upper()}]"]
            at = end = b
        end = max(end, b)
    return "".join(out) + text[end:] if out else text


def detected(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a count of each base kind, ``base_sha256`` and ``spans``."""
    names = [*(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def compute(column):
        counts, digests, texts = [[] for _ in BASE], [], []
        for value in column.to_pylist():
            found = spans(value)
            base = [s for s in found if s[0] in BASE]
            for kind, n in zip(BASE, counts):
                n.append(sum(s[0] == kind for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            texts.append(joined(found))
        return [*(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())]

    kinds = [LongType()] * len(BASE) + [StringType()] * 2
    return appended(docs, text, [StructField(n, k) for n, k in zip(names, kinds)], compute)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, same columns in the same order, with personal data replaced; ``n_chars`` follows if it is there."""
    def compute(column):
        return [pa.array([redact(v, spans(v)) for v in column.to_pylist()], pa.string())]

    def replaced(inner: DataFrame) -> DataFrame:
        out = appended(inner, text, [StructField(text, StringType())], compute)
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.length(quoted(text)).cast(docs.schema["n_chars"].dataType))
        return out

    return guarded(docs, [text, "n_chars"], replaced)
