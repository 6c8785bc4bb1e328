"""Registered names: written variants, boundary-checked matches and tokens."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.normalise import folded
from corvane.functions.patterns import _SPANS, SPANS, chosen

UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}


def variants(form: str) -> set[str]:
    """The form, its umlauts written out, its blanks collapsed or as hyphens, and the genitive."""
    low = re.sub(r"\s+", " ", form.strip()).lower()
    written = {low, "".join(UMLAUTS.get(c, c) for c in low), folded(low)}
    written |= {w.replace(" ", "-") for w in written} | {w.replace(" ", "") for w in written if len(w) > 5}
    return written | {w + "s" for w in written if len(w) > 3 and not w.endswith("s")}


class Matcher:
    """All active forms of a register in one automaton; overlaps go to the longer form, then the earlier one."""

    def __init__(self, register: list[tuple[str, str]]):
        self.automaton = ahocorasick.Automaton()
        for code, form in register:
            for v in variants(form):
                self.automaton.add_word(v, (code, len(v)))
        self.automaton.make_automaton()
        self.empty = not register

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        if self.empty or not text:
            return []
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is two
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found = []
        for end, (code, n) in self.automaton.iter(low):
            a, z = end - n + 1, end + 1
            if (a == 0 or not text[a - 1].isalnum()) and (z == len(text) or not text[z].isalnum()):
                found.append((-n, a, z, code))
        return [(a, z, code, text[a:z]) for a, z, code in chosen(found)]


def form_spans(text: Column, register: list[tuple[str, str]]) -> Column:
    """Spans of registered forms. The register is a small controlled list that goes with the function."""

    def spans(texts: pa.Array) -> pa.Array:
        m = Matcher(register)
        return pa.array([None if t is None else [{"start": a, "end": z, "cls": c, "form": v} for a, z, c, v in m.find(t)] for t in texts.to_pylist()], _SPANS)

    return F.arrow_udf(spans, SPANS)(text)
