"""Tells of a text: word and mark classes, runs of bullets, lists of three, fragments; and the claims a sentence makes."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.values import CODE

#: Our own short lists: fixed values.
BANNED = ("delve", "leverage", "seamless", "robust", "cutting-edge", "synergy")
VERBS = re.compile(r"(?i)\b(is|are|was|were|be|has|have|had|do|does|did|can|could|will|would|shall|should|may|might|must|\w{3,}(?:ed|es|ing))\b")
ABBREVIATIONS = re.compile(r"(?i)\b(e\.g|i\.e|etc|dr|mr|mrs|no|vs|approx|z\.b)\.$")


def prose(text: str) -> str:
    """Code, URLs and mail addresses masked by blanks of the same length; line breaks stay."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    for p in (r"```.*?```", r"`[^`\n]*`", r"\b\w+://\S*[^\s.,;:!?)]", r"\S+@\S+\.\w+"):
        text = re.sub(p, blank, text, flags=re.S)
    return text


def sentences(text: str) -> list[tuple[int, str]]:
    """(line, sentence) of prose lines; abbreviations, and stops inside code, URLs and addresses, don't end a sentence."""
    out = []
    for n, (line, raw) in enumerate(zip(prose(text).split("\n"), text.split("\n")), 1):
        if line.lstrip().startswith(("#", "|", "- ", "* ")):
            continue
        start = 0
        for m in re.finditer(r"[.?!]+(?=\s|$)", line):
            if ABBREVIATIONS.search(line[start : m.end()]):
                continue
            if s := raw[start : m.end()].strip():
                out.append((n, s))
            start = m.end()
        if s := raw[start:].strip():
            out.append((n, s))
    return out


def tells(text: str, whole: bool = False) -> dict[str, int]:
    """Hits by class. whole: dashes, commas and banned words also count inside code, URLs and addresses, and a word ends where its
    ASCII letters, digits and underscores end, as in SQL."""
    body, lines = text if whole else prose(text), text.split("\n")
    said = sentences(text)
    out = {
        "em_dash": body.count("—"),
        "comma_before_and": len(re.findall(r", (?:and|or)\b", body, re.A if whole else 0)),
        "banned_word": sum(len(re.findall(rf"(?i)\b{re.escape(w)}\b", body)) for w in BANNED),
        "list_of_three": sum(bool(re.search(r"\b\w+, \w+,? (?:and|or) \w+\b", s)) and s.count(",") <= 2 for _, s in said),
        "fragment": sum(1 <= len(s.split()) <= 12 and not VERBS.search(s) for _, s in said),
        "splice": sum(bool(re.search(r"\w, (?:it|this|that|they|we) (?:is|are|was|were|has|have)\b", s)) for _, s in said),
        "bold_lead": sum(bool(re.match(r"\s*[-*] \*\*[^*]+\*\*", x)) for x in lines),
    }
    run = 0
    out["bullets_of_three"] = 0
    for x in [*lines, ""]:
        if re.match(r"\s*[-*] ", x):
            run += 1
        else:
            out["bullets_of_three"] += run == 3
            run = 0
    return out


#: Kinds in the order in which they are named; those that make a claim a high risk come first.
KINDS = ("negative", "price", "identifier", "api-path", "number", "version", "url")
HIGH = KINDS[:4]
#: What takes its place in a sentence, in order; None: it is no claim and no later kind sees it (codes, addresses, dates, times).
PLACES: list[tuple[str | None, re.Pattern]] = [
    ("url", re.compile(r"\b[a-z][a-z0-9+.-]*://\S*[^\s.,;:!?)\]]", re.I)),
    ("api-path", re.compile(r"(?<![\w.])(?:(?:GET|PUT|POST|DELETE|PATCH|HEAD) )?/(?:[\w{}.-]+/)+[\w{}.-]*[\w}]|(?<![\w.])/v\d[\w.]*\b")),
    (None, re.compile(rf"\b{CODE}\b|\b(?:tcp|hcs)-[a-z2-7]{{4}}\b")),
    (None, re.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}(?:/\d{1,2})?\b|(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4}(?![\w:])")),
    (None, re.compile(r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}\.\d{1,2}\.\d{4}\b")),
    (None, re.compile(r"\b\d{1,2}:\d{2}(?::\d{2})?\b")),
    ("identifier", re.compile(r"\b[a-z]{1,4}\d+[a-z]*\.(?:\d*x?large|medium|small|nano|micro)(?:\.\d+)?\b|\b[a-z]{1,4}\d+[a-z]*\.[a-z0-9]+\.\d+\b")),
    ("number", re.compile(r"(?<!\w)/\d{1,3}\b")),
    ("price", re.compile(r"(?:\b(?:EUR|USD)\s?|[€$]\s?)\d[\d.,]*|\b\d[\d.,]*\s?(?:EUR\b|USD\b|€|\$)", re.I)),
    ("version", re.compile(r"\bv?\d+\.\d+(?:\.\d+)+\b|\bv\d+(?:\.\d+)?\b")),
]
_COUNTED = re.compile(r"(?<![\w.])\d[\d.,]*(?![\w])")
_TOTAL = re.compile(r"(?i)\b(?:total|totals|sum|overall|altogether|insgesamt|gesamt|summe)\b")
_PER_TIME = re.compile(r"(?i)\s?(?:per|a|/)\s?(?:month|year|monat|jahr)\b")
_PRICED = re.compile(r"(?i)\b(?:price|prices|cost|costs|fee|preis|preise|kosten|gebühr)\b")
_DENIED = re.compile(r"(?i)\b(?:not|never|no|none|cannot|without|n't|nicht|kein\w*|niemals|ohne)\b|n't\b")


def scanned(sentence: str) -> tuple[list[str], bool]:
    """The kinds of claims in a sentence, and whether a number in it enters a total. What one place took is blank for the next."""
    rest, kinds = sentence, set()
    for kind, place in PLACES:
        rest, n = place.subn(lambda m: "\0" * len(m[0]), rest)
        if n and kind:
            kinds.add(kind)
    numbers = list(_COUNTED.finditer(rest))
    total = any(_PER_TIME.match(rest, m.end()) for m in numbers)
    if numbers:
        kinds.add("number")
        kinds |= {"price"} if _PRICED.search(rest) else set()
        total = total or bool(_TOTAL.search(rest))
    if _DENIED.search(sentence):
        kinds.add("negative")
    return [k for k in KINDS if k in kinds], total and bool(numbers)


def claims(text: str) -> list[tuple[str, int, str, str, str]]:
    """(id, line, kinds, risk, sentence) of sentences with a claim, numbered in text order. High: a kind of ``HIGH``, or a number in a
    total; medium: a number or a version."""
    out = []
    for line, s in [(n, x) for n, raw in enumerate(text.split("\n"), 1) for _, x in sentences(raw)]:
        kinds, total = scanned(s)
        if kinds:
            risk = "high" if total or set(kinds) & set(HIGH) else "medium" if {"number", "version"} & set(kinds) else "low"
            out.append((f"C-{len(out) + 1}", line, ",".join(kinds), risk, s))
    return out


_CLAIM = "array<struct<id:string,line:int,kinds:string,risk:string,sentence:string>>"


def _claims(text: pa.Array) -> pa.Array:
    names = ("id", "line", "kinds", "risk", "sentence")
    kind = pa.list_(pa.struct([(n, pa.int32() if n == "line" else pa.string()) for n in names]))
    return pa.array([None if t is None else [dict(zip(names, c)) for c in claims(t)] for t in text.to_pylist()], kind)


def claims_of(text: Column) -> Column:
    return F.arrow_udf(_claims, _CLAIM)(text)


def _tells(whole: bool):
    def of(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else list(tells(t, whole).items()) for t in text.to_pylist()], pa.map_(pa.string(), pa.int64()))

    return of


def tells_of(text: Column, whole: bool = False) -> Column:
    return F.arrow_udf(_tells(whole), "map<string,bigint>")(text)
