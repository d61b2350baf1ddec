"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, schemes and identifier cues. At each
anchor a local parser expands to the boundaries of a candidate and validates it. Parsers read on from
the end of the last candidate of their kind, so a text is passed over once however it is built.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
from pyspark.sql import DataFrame, functions as F

from .common import annotate, flat

#: Kinds in the order that settles spans with equal starts. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "secret")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_CUES = ("account number", "account no", "acct", "account", "konto", "compte", "cuenta", "customer id", "passport", "ssn")
SECRET_CUES = ("password", "passwd", "api_key", "apikey", "token", "secret")

FIELDS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`{}|\\^]++")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[\s:#=.]{0,3}+([A-Z]{0,3}[0-9](?:-?[0-9A-Z]){4,19})(?![A-Za-z0-9])")
_SECRET = re.compile(r"[\"']?+[ \t]*+[=:][ \t]*+[ \"']{0,2}+([A-Za-z0-9_+/=-]{8,})")
_DIGITS = frozenset("0123456789")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits_of(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _email(text: str, at: int, floor: int) -> tuple[int, Span | None]:
    """From an at-sign: the local part to the left, not before `floor`, and the domain to the right."""
    domain = _DOMAIN.match(text, at + 1)
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if domain is None or start == at:
        return floor, None
    return domain.end(), (start, domain.end())


def _ip(text: str, at: int, floor: int) -> tuple[int, Span | None]:
    """From the first digit of a group: four groups; a candidate with a group over 255 is used up all the same."""
    if at > floor and text[at - 1] in _DIGITS:
        return floor, None  # inside a group: its first digit has been tried
    found = _IP.match(text, at)
    if found is None:
        return floor, None
    valid = all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found[0].split("."))
    return found.end(), found.span() if valid else None


def _card(text: str, at: int, floor: int) -> tuple[int, Span | None]:
    """From a digit: the whole chain of digits with single blanks or hyphens between."""
    found = _CHAIN.match(text, at)
    if found is None:
        return floor, None
    digits = _digits_of(found[0]) if found.end() - at <= 37 else ""
    return found.end(), found.span() if 12 <= len(digits) <= 19 and luhn(digits) else None


def _phone(text: str, at: int, floor: int) -> tuple[int, Span | None]:
    """From a plus sign: digits, blanks, brackets, dots and hyphens up to the last digit."""
    found = _PHONE.match(text, at)
    if found is None:
        return floor, None
    return found.end(), found.span() if 9 <= len(_digits_of(found[0])) <= 15 else None


def _url(text: str, at: int, floor: int) -> tuple[int, Span | None]:
    """From a scheme: up to white space or a quote, without closing punctuation; there must be a host."""
    found = _URL.match(text, at)
    end = at + len(found[0].rstrip(".,;:!?)]}*")) if found else at
    rest = text[at:end].partition("://")[2]
    return (end, (at, end)) if rest and rest[0].isalnum() else (floor, None)


def _iban(text: str, at: int, floor: int) -> tuple[int, Span | None]:
    """From a digit that two capitals precede: country, check digits and account, valid by the remainder 1 of 97."""
    if at < 2 or at - 2 < floor or (at > 2 and text[at - 3].isalnum()):
        return floor, None
    found = _IBAN.match(text, at - 2)
    if found is None:
        return floor, None
    code = found[0].replace(" ", "")
    number = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
    return (found.end(), found.span()) if 15 <= len(code) <= 34 and int(number) % 97 == 1 else (floor, None)


def _after(pattern: re.Pattern) -> Callable:
    def parse(text: str, at: int, floor: int, cue: int) -> tuple[int, Span | None]:
        found = pattern.match(text, at + cue)
        return (found.end(1), found.span(1)) if found and at >= floor else (floor, None)

    return parse


_account, _secret = _after(_ACCOUNT), _after(_SECRET)


#: ASCII only, so that no character changes its place.
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def automaton() -> ahocorasick.Automaton:
    """All anchors in lower case, each with the kinds it may start; texts are passed through it in lower case."""
    machine = ahocorasick.Automaton()
    machine.add_word("@", ("@", 1))
    machine.add_word("+", ("+", 1))
    for digit in "0123456789":
        machine.add_word(digit, ("0", 1))
    for cues, tag in ((SCHEMES, "s"), (ACCOUNT_CUES, "a"), (SECRET_CUES, "k")):
        for cue in cues:
            machine.add_word(cue, (tag, len(cue)))
    machine.make_automaton()
    return machine


def spans(text: str | None, machine: ahocorasick.Automaton) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) in code points of everything found, kind by kind without overlaps within a kind."""
    if not text:
        return
    floor = dict.fromkeys(KINDS, 0)

    def tried(kind: str, result: tuple[int, Span | None]) -> Iterator[tuple[str, int, int]]:
        floor[kind], span = result
        if span:
            yield kind, *span

    for last, (tag, length) in machine.iter(text.translate(_LOWER)):
        at = last - length + 1
        if tag == "0":
            if at >= floor["ip"]:
                yield from tried("ip", _ip(text, at, floor["ip"]))
            if at >= floor["card"]:
                yield from tried("card", _card(text, at, floor["card"]))
            if at >= floor["iban"] and at > 1 and "A" <= text[at - 1] <= "Z" and "A" <= text[at - 2] <= "Z":
                yield from tried("iban", _iban(text, at, floor["iban"]))
        elif tag == "@":
            yield from tried("email", _email(text, at, floor["email"]))
        elif tag == "+":
            if at >= floor["phone"]:
                yield from tried("phone", _phone(text, at, floor["phone"]))
        elif tag == "s":
            if at >= floor["url"]:
                yield from tried("url", _url(text, at, floor["url"]))
        elif tag == "a":
            if not (at and text[at - 1].isalnum()):
                yield from tried("account", _account(text, at, floor["account"], length))
        else:
            yield from tried("secret", _secret(text, at, floor["secret"], length))


def joined(found: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then by kind."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def find(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """All of `docs` with a struct `name`: counts of the base kinds, the base spans and all spans as text.

    Whole texts, one pass, no shuffle. Null and empty texts have no spans. Spans of different kinds may overlap; those of a
    kind do not. Repeated rows get equal results, and other columns pass through.
    """
    made: dict[str, ahocorasick.Automaton] = {}

    def compute(texts):
        machine = made.setdefault("it", made.get("it") or automaton())
        for body in texts:
            found = list(spans(body, machine))
            yield (*[sum(f[0] == kind for f in found) for kind in BASE], joined([f for f in found if f[0] in BASE]), joined(found))

    return annotate(docs, [text], compute, FIELDS, name)


def redacted(text: str | None, machine: ahocorasick.Automaton) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans(text, machine), key=lambda x: (x[1], KINDS.index(x[0]))):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", name: str = "redacted") -> DataFrame:
    """All of `docs` with the redacted text in a struct `name`; a null text stays null."""
    def compute(texts):
        machine = automaton()
        return ((redacted(body, machine),) for body in texts)

    return annotate(docs, [text], compute, "text string", name)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts, a digest of the base spans, and all spans."""
    found = flat(find(docs.select("doc_id", "text")), "pii", "doc_id")
    return found.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans")
