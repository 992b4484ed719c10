"""Personal data behind disguises, with spans in the source text.

Three transducers rewrite a text, each keeping a map from its output to its input: look-alike characters become ASCII
and invisible ones go; runs of spelled digits (English, German, French, Spanish) become digits; at/dot disguises of
addresses become ``@`` and ``.``. Identifiers are detected in the result; their spans are mapped back through the three
maps to source characters.

Kinds: email, phone, ipv4, card (Luhn), iban (mod 97), us_ssn.

Defined results: null and empty texts have no findings; texts are read whole; spans are [start, end) in characters; where
identifiers overlap, the kind earlier in ``KINDS`` has its place; repeated rows have repeated findings; a null doc_id is
carried along, one that doesn't cast to bigint is an error; an empty table has none; other columns are not looked at.

Work is linear in a text: addresses are looked for from their at signs outwards, and no pattern reads a run of signs twice.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from .textkit import map_batches

KINDS = ("email", "iban", "card", "us_ssn", "phone", "ipv4")

_CYRILLIC_GREEK = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсухԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαρν", "ABESIJKMHOPCTXYaesijopcyxdhABEZHIKMNOPTYXoapv"))
_SIGNS = {"․": ".", "。": ".", "．": ".", "｡": ".", "·": ".", "•": ".", "＠": "@", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "－": "-", "＋": "+", "（": "(", "）": ")", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ", "ı": "i", "ⅼ": "l", "ℓ": "l"}
INVISIBLE = "­​‌‍‎‏⁠⁡⁢⁣⁤﻿"


def _look_alikes() -> dict[str, str]:
    """Characters that stand for one ASCII character: the tables above, and compatibility forms and digits of any script."""
    out = _CYRILLIC_GREEK | _SIGNS
    for code in [*range(0x2070, 0x209D), *range(0x2460, 0x249C), *range(0x24B6, 0x24EB), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        c = unicodedata.normalize("NFKC", chr(code))
        if len(c) == 3 and c[0] == "(" and c[2] == ")":
            c = c[1]
        if len(c) == 1 and c.isascii() and c.isprintable():
            out.setdefault(chr(code), c)
    for code in range(0x660, 0x1FBFA):
        if unicodedata.category(chr(code)) == "Nd":
            out.setdefault(chr(code), str(unicodedata.digit(chr(code))))
    return out


LOOK_ALIKES = _look_alikes()
TABLE = str.maketrans(LOOK_ALIKES)
HIDDEN = re.compile("[" + INVISIBLE + "]+")

DIGIT_WORDS = {
    w: d
    for d, words in {
        "0": "zero oh null zéro cero",
        "1": "one eins ein un une uno una",
        "2": "two zwei zwo deux dos",
        "3": "three drei trois tres",
        "4": "four vier quatre cuatro",
        "5": "five fünf fuenf cinq cinco",
        "6": "six sechs seis",
        "7": "seven sieben sept siete",
        "8": "eight acht huit ocho",
        "9": "nine neun neuf nueve",
    }.items()
    for w in words.split()
}
_DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + "|[0-9])"
#: Seven digits or more, spelled or not, in a row; a run of plain digits only isn't changed.
SPELLED = re.compile(rf"(?<!\w)\+?{_DIGIT}(?:[ \t]*+[-.,()]?+[ \t]*+(?:(?<![A-Za-z])|(?<=[0-9])){_DIGIT}){{6,}}(?!\w)", re.IGNORECASE)
DIGIT_TOKEN = re.compile("|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + "|[0-9]", re.IGNORECASE)
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
#: No identifier or disguise goes over a line's end: the costly patterns see only the lines in which a cheap one, over the
#: lower-cased text, finds something.
SPELLED_HINT = re.compile(rf"{_WORD}[-.,() \t]+(?:{_WORD}|[0-9])")
DETECT_HINT = re.compile("[0-9@]")

_AT = r"[ \t]*+(?:[\[({<][ \t]*+(?:at|@|arroba|ät|chez)[ \t]*+[\])}>])[ \t]*+"
_DOT = r"[ \t]*+(?:[\[({<][ \t]*+(?:dot|punkt|point|punto|\.)[ \t]*+[\])}>])[ \t]*+"
_WORD_AT, _WORD_DOT = r"[ \t]++(?:at|arroba)[ \t]++", r"[ \t]++(?:dot|punkt|point|punto)[ \t]++"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_ANY_DOT = rf"(?:{_DOT}|{_WORD_DOT}|\.)"
#: An address has at least one disguise: bracketed signs anywhere; a bare word for @ needs a disguised dot after it. It is
#: looked for from its at sign on: the domain after the sign, and what is before it in the line read backwards.
AT_SIGN = re.compile(rf"(?<![ \t])(?:(?P<word>{_WORD_AT})|{_AT}|[ \t]*+@[ \t]*+)|(?<=[ \t])[\[({{<][ \t]*+(?:at|@|arroba|ät|chez)[ \t]*+[\])}}>][ \t]*+", re.IGNORECASE)
AFTER_SIGN = re.compile(rf"{_LABEL}(?:{_ANY_DOT}{_LABEL})*", re.IGNORECASE)
AFTER_WORD = re.compile(rf"{_LABEL}(?:\.{_LABEL})*(?:{_DOT}|{_WORD_DOT}){_LABEL}(?:{_ANY_DOT}{_LABEL})*", re.IGNORECASE)
_DOT_BACK = r"(?:[ \t]*+(?:[\])}>][ \t]*+(?:tod|tknup|tniop|otnup|\.)[ \t]*+[\[({<])[ \t]*+|[ \t]++(?:tod|tknup|tniop|otnup)[ \t]++|\.)"
ATOM_BACK = re.compile(rf"(?P<dot>{_DOT_BACK})?(?P<atom>[A-Za-z0-9_%+-]++)", re.IGNORECASE)
DISGUISE_HINT = re.compile(r"[\[({<][ \t]*(?:at|@|arroba|ät|chez|dot|punkt|point|punto|\.)[ \t]*[\])}>]|dot[ \t]|punkt[ \t]|point[ \t]|punto[ \t]|arroba[ \t]|@[ \t]|[ \t]@")
SIGN = re.compile(rf"(?<![ \t])(?:(?P<at>{_AT}|{_WORD_AT}|[ \t]*+@[ \t]*+)|(?P<dot>{_DOT}|{_WORD_DOT}))", re.IGNORECASE)

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-."
DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
CARD = re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])")
SSN = re.compile(r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![\d-])")
BARE_PHONE = re.compile(r"(?<![\d+])\+?\d{7,15}(?!\d)")
IPV4 = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)")


class Mapped:
    """A text with a map to the one that it was made from: pieces (start, source start, source end, plain)."""

    def __init__(self, text: str, source: Mapped | None = None, pieces: list[tuple[int, int, int, bool]] | None = None):
        self.text, self.source, self.pieces = text, source, pieces
        self.starts = [p[0] for p in pieces] if pieces else []

    def to_source(self, start: int, end: int) -> tuple[int, int]:
        if self.pieces is not None:
            first = self.pieces[bisect_right(self.starts, start) - 1]
            last = self.pieces[bisect_right(self.starts, max(start, end - 1)) - 1]
            start, end = (first[1] + start - first[0] if first[3] else first[1]), (last[1] + end - last[0] if last[3] else last[2])
        return self.source.to_source(start, end) if self.source is not None else (start, end)

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Each [start, end) of the sorted edits replaced."""
        if not edits:
            return self
        out, pieces, at, length = [], [], 0, 0
        for start, end, new in edits:
            if start > at:
                pieces.append((length, at, start, True))
                out.append(self.text[at:start])
                length += start - at
            if new:
                pieces.append((length, start, end, False))
                out.append(new)
                length += len(new)
            at = end
        if at < len(self.text):
            pieces.append((length, at, len(self.text), True))
            out.append(self.text[at:])
        return Mapped("".join(out), self, pieces)


def lower(text: str) -> str:
    """Lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def lines_with(hint: re.Pattern, text: str):
    """(start, end) of the lines in which ``hint`` is found."""
    at = 0
    while m := hint.search(text, at):
        start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
        end = len(text) if end < 0 else end
        yield start, end
        at = end


def plain_characters(m: Mapped) -> Mapped:
    """Look-alikes to ASCII, one for one; invisible characters removed."""
    text = m.text
    if text.isascii():
        return m
    signs = set(text)  # a pattern of so many characters takes far longer than this
    if not signs.isdisjoint(INVISIBLE):
        m = m.rewritten([(x.start(), x.end(), "") for x in HIDDEN.finditer(text)])
    if signs.isdisjoint(LOOK_ALIKES):
        return m
    return Mapped(m.text.translate(TABLE), m, [(0, 0, len(m.text), True)])


def plain_digits(m: Mapped) -> Mapped:
    """Runs of spelled digits to digits, without what stands between them."""
    edits = []
    for line in lines_with(SPELLED_HINT, lower(m.text)):
        for run in SPELLED.finditer(m.text, *line):
            tokens = list(DIGIT_TOKEN.finditer(m.text, run.start(), run.end()))
            if sum(len(t[0]) > 1 for t in tokens) < 3 or len({DIGIT_WORDS.get(t[0].lower(), t[0]) for t in tokens}) < 2:
                continue
            for i, t in enumerate(tokens):
                if i and tokens[i - 1].end() < t.start():
                    edits.append((tokens[i - 1].end(), t.start(), ""))
                edits.append((t.start(), t.end(), DIGIT_WORDS.get(t[0].lower(), t[0])))
    return m.rewritten(edits)


def disguised_addresses(text: str, start: int, end: int):
    """Spans of the addresses in one line."""
    low, backwards = start, None
    at = start
    while (sign := AT_SIGN.search(text, at, end)) is not None:
        at = sign.end()
        after = (AFTER_WORD if sign["word"] else AFTER_SIGN).match(text, sign.end(), end)
        if after is None or sign.start() <= low:
            continue
        if backwards is None:
            backwards = text[start:end][::-1]
        position, stop, first = end - sign.start(), end - low, None
        while (atom := ATOM_BACK.match(backwards, position, stop)) is not None and (atom["dot"] is None) == (position == end - sign.start()):
            position = atom.end()
            before = text[end - position - 1 : end - position] if end - position > 0 else ""
            if not before or not (before.isalnum() or before in "_.@"):
                first = end - position
        if first is not None:
            yield first, after.end()
            low = at = after.end()


def plain_addresses(m: Mapped) -> Mapped:
    """at/dot disguises within an address to ``@`` and ``.``."""
    edits = []
    for line in lines_with(DISGUISE_HINT, lower(m.text)):
        for address in disguised_addresses(m.text, *line):
            edits += [(s.start(), s.end(), "@" if s["at"] else ".") for s in SIGN.finditer(m.text, *address) if s[0] not in "@."]
    return m.rewritten(edits)


def emails(text: str, start: int, end: int):
    """Spans of the addresses in one line, from their @ outwards."""
    low, at = start, start - 1
    while (at := text.find("@", at + 1, end)) >= 0:
        local = text[low:at]
        local = local[len(local.rstrip(LOCAL)) :].rpartition("..")[2].removeprefix(".")
        domain = DOMAIN.match(text, at + 1, end)
        low = max(low, at + 1)
        if domain is not None and local and not local.endswith("."):
            yield at - len(local), domain.end()
            low = domain.end()
            at = low - 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0 and len(set(digits)) > 1


def iban(value: str) -> bool:
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def detect(text: str):
    """(kind, start, end, value) in a normalised text."""
    for line in lines_with(DETECT_HINT, text):
        for start, end in emails(text, *line):
            yield "email", start, end, text[start:end].lower()
        for m in IBAN.finditer(text, *line):
            if iban(value := m[0].replace(" ", "")):
                yield "iban", m.start(), m.end(), value
        for m in CARD.finditer(text, *line):
            if luhn(value := re.sub(r"\D", "", m[0])):
                yield "card", m.start(), m.end(), value
        for m in SSN.finditer(text, *line):
            yield "us_ssn", m.start(), m.end(), m[0]
        for m in PHONE.finditer(text, *line):
            value = re.sub(r"[^\d+]", "", m[0])
            if 8 <= len(value.lstrip("+")) <= 15:
                yield "phone", m.start(), m.end(), value
        for m in IPV4.finditer(text, *line):
            yield "ipv4", m.start(), m.end(), m[0]


def find(text: str | None) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, end, normalised value, disguised) by start; spans are of the source."""
    if not text:
        return []
    digits = plain_digits(plain_characters(Mapped(text)))
    last = plain_addresses(digits)
    found = list(detect(last.text))
    if digits.source is not None and digits.pieces is not None:
        # A bare number is a phone number if it was spelled out.
        for m in BARE_PHONE.finditer(last.text):
            start, end = last.to_source(m.start(), m.end())
            if sum(map(str.isalpha, text[start:end])) >= 3:
                found.append(("phone", m.start(), m.end(), m[0]))
    found.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
    out, taken = [], bytearray(len(text)) if found else b""
    for kind, start, end, value in found:
        a, b = last.to_source(start, end)
        if any(taken[a:b]):
            continue
        taken[a:b] = b"\1" * (b - a)
        out.append((kind, a, b, value, text[a:b].lower() != last.text[start:end].lower()))
    return sorted(out, key=lambda x: x[1:3])


FINDINGS = "doc_id bigint, kind string, start int, end int, value string, disguised boolean"


def scan(docs: DataFrame) -> DataFrame:
    """A row for each identifier: kind, source span, normalised value, and whether it was disguised."""
    bound_batches(docs.sparkSession)
    names = ["doc_id", "kind", "start", "end", "value", "disguised"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(doc, *found) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for found in find(text)]
            return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

        return step

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), make, FINDINGS)
