"""Text normalisation that keeps, for every character, where it came from in the source."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from email.header import decode_header

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Normal:
    """text, and for each of its characters the half-open range of the source it stands for."""

    text: str
    starts: list[int]
    ends: list[int]

    @classmethod
    def of(cls, text: str) -> Normal:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def rewritten(self, pattern: re.Pattern, make: Callable[[re.Match], str | None]) -> Normal:
        """Each match replaced (None: kept); the new characters stand for the whole match."""
        out, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = make(m)
            if new is None or m.start() == m.end():
                continue
            out.append(self.text[at : m.start()] + new)
            starts += self.starts[at : m.start()] + [self.starts[m.start()]] * len(new)
            ends += self.ends[at : m.start()] + [self.ends[m.end() - 1]] * len(new)
            at = m.end()
        if not out:
            return self
        return Normal("".join(out) + self.text[at:], starts + self.starts[at:], ends + self.ends[at:])

    def source_span(self, start: int, end: int) -> tuple[int, int]:
        if start >= end:
            at = self.starts[start] if start < len(self.starts) else (self.ends[-1] if self.ends else 0)
            return at, at
        return min(self.starts[start:end]), max(self.ends[start:end])


def shown(text: str | None) -> str | None:
    """The text, unless it has a control character: those are never decoded."""
    return None if not text or any(unicodedata.category(c) == "Cc" and c not in "\t\n\r" for c in text) else text


def byte_run(mark: int, sides: int, high: bool = False) -> Callable[[re.Match], str | None]:
    """A maker for runs of bytes, each written with ``mark`` characters and two hexadecimal digits.

    UTF-8 decides; else cp1252, if it gives letters only and at least ``sides`` sides of the run touch a letter. high: only runs
    with a byte beyond ASCII."""

    def make(m: re.Match) -> str | None:
        raw = bytes.fromhex("".join(m[0][i + mark : i + mark + 2] for i in range(0, len(m[0]), mark + 2)))
        if high and raw.isascii():
            return None
        try:
            return shown(raw.decode("utf-8"))
        except UnicodeDecodeError:
            text = raw.decode("cp1252", "replace")
        touching = m.string[: m.start()][-1:].isalpha() + m.string[m.end() : m.end() + 1].isalpha()
        return shown(text) if text.isalpha() and touching >= sides else None

    return make


def mail_word(m: re.Match) -> str | None:
    try:
        return shown("".join(p.decode(c or "ascii") if isinstance(p, bytes) else p for p, c in decode_header(m[0])))
    except (LookupError, UnicodeDecodeError, ValueError):
        return None


def code_units(m: re.Match) -> str | None:
    """Escapes of UTF-16 units; halves of a pair that stand alone leave the run as it is."""
    try:
        return shown(bytes.fromhex(m[0].replace("\\u", "")).decode("utf-16-be"))
    except UnicodeDecodeError:
        return None


def signed_unit(m: re.Match) -> str | None:
    """RTF writes a character as a signed 16-bit number."""
    n = int(m[1]) % 65536 if int(m[1]) < 0 else int(m[1])
    return shown(chr(n)) if n < 0x110000 and not 0xD800 <= n < 0xE000 else None


def host_label(m: re.Match) -> str | None:
    """A label in ASCII form, or its longest part before a hyphen that is one."""
    cut = len(m[0])
    while cut > 4:
        try:
            text = shown(m[0][:cut].encode("ascii").decode("idna"))
        except (UnicodeError, ValueError):
            text = None
        if text and text != m[0][:cut]:
            return text + m[0][cut:]
        cut = m[0].rfind("-", 0, cut)
    return None


def named_character(m: re.Match) -> str | None:
    got = html.unescape(m[0])
    return got if got != m[0] else None


INVISIBLE = "­​-‏‪-‮⁠-⁤﻿\U000e0000-\U000e007f︀-️"
#: In order. Decoders first, then removers.
STEPS: list[tuple[re.Pattern, Callable[[re.Match], str | None]]] = [
    (re.compile(r"=\r?\n"), lambda m: ""),
    (re.compile(r"=\?[\w-]+\?[bBqQ]\?[^?\s]*\?="), mail_word),
    (re.compile(r"\\u(-?[0-9]{2,6})\?"), signed_unit),
    (re.compile(r"(?:\\'[0-9A-Fa-f]{2})+"), lambda m: shown(bytes.fromhex(m[0].replace("\\'", "")).decode("cp1252", "replace"))),
    (re.compile(r"(?:\\u[0-9A-Fa-f]{4})+"), code_units),
    (re.compile(r"(?:\\x[0-9A-Fa-f]{2})+"), byte_run(2, 1)),
    (re.compile(r"(?:=[0-9A-F]{2})+"), byte_run(1, 2, high=True)),
    (re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"), named_character),
    (re.compile(r"\bxn--[a-z0-9-]+"), host_label),
    # three times, for what was escaped again
    *[(re.compile(r"(?:%[0-9A-Fa-f]{2})+"), byte_run(1, 1))] * 3,
    (re.compile(r"\r\n?"), lambda m: "\n"),
    (re.compile(r"(.)\x08\1|_\x08(?P<under>.)|(?P<over>.)\x08_"), lambda m: m[1] or m["under"] or m["over"]),
    (re.compile(r"\x1b\[[0-9;]*[A-Za-z]"), lambda m: ""),
    (re.compile(f"[{INVISIBLE}]"), lambda m: ""),
    # a base character with its marks is composed, the result standing for all of them
    (re.compile(r"[^\W\d_][̀-ͯ]+"), lambda m: unicodedata.normalize("NFC", m[0])),
    (re.compile(r"(?<=[^\W\d_])-\n(?=[a-zà-öø-ÿ])"), lambda m: ""),
    (re.compile("[   -     　]"), lambda m: " "),
]


def normalise(text: str) -> Normal:
    n = Normal.of(text)
    for pattern, make in STEPS:
        n = n.rewritten(pattern, make)
    return n


def _normal(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else normalise(t).text for t in text.to_pylist()], pa.string())


def normalised(text: Column) -> Column:
    return F.arrow_udf(_normal, "string")(text)


def folded(text: str) -> str:
    """Compatibility forms, accents off, lower case: the comparing form of a registered name."""
    t = unicodedata.normalize("NFKD", text)
    return "".join(c for c in t if not unicodedata.combining(c)).casefold()


def skeleton(text: str) -> str:
    """Letters and digits only."""
    return "".join(c for c in folded(text) if c.isalnum())
