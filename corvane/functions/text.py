"""Text functions as columns: words, sentences, language, markup, keys and shapes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words by language, our own short lists: fixed values.
FUNCTION_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "was", "for", "it", "with", "as"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "mit", "von", "zu", "den", "auf", "ein"],
    "fr": ["le", "la", "les", "et", "est", "des", "du", "que", "pour", "dans", "un", "une"],
    "es": ["el", "la", "los", "y", "es", "de", "que", "en", "por", "para", "un", "una"],
}
WORD = "[A-Za-zÀ-ÖØ-öø-ÿ]+"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces that end in a full stop, question or exclamation mark."""
    return F.filter(F.transform(F.split(text, "[.?!]+"), lambda s: F.trim(F.regexp_replace(s, "\\s+", " "))), lambda s: s != "")


def _among(words_of: list[str]):
    return lambda w: w.isin(*words_of)


def function_word_counts(text_words: Column) -> dict[str, Column]:
    return {k: F.size(F.filter(text_words, _among(v))) for k, v in FUNCTION_WORDS.items()}


def language(text_words: Column) -> Column:
    """The language with most function words; en on a tie or none."""
    n = function_word_counts(text_words)
    top = F.greatest(*n.values())
    return F.when(n["en"] == top, "en").when(n["de"] == top, "de").when(n["fr"] == top, "fr").otherwise("es")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def strip_html(html: Column) -> Column:
    """Visible text: script, style and comments out, block ends to line breaks, common entities resolved, blanks squeezed."""
    t = F.regexp_replace(html, "(?is)<(script|style|template)[^>]*>.*?</(script|style|template)>", " ")
    t = F.regexp_replace(t, "(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, "(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav)[^>]*>", "\n")
    t = F.regexp_replace(t, "<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, "[ \\t\\r\\f]+", " ")
    return F.trim(F.regexp_replace(t, " ?\n[ \n]*", "\n"))


def html_comments(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?s)<!--(.*?)-->"), F.lit(1))


def html_attributes(html: Column) -> Column:
    """Values of href, src, alt, title, content and value."""
    return F.regexp_extract_all(html, F.lit('(?i)(href|src|alt|title|content|value)="([^"]*)"'), F.lit(2))


def looks_html(text: Column) -> Column:
    return text.rlike("(?i)<[a-z][^>]*>") & text.rlike("(?i)</[a-z]+>")


def name_key(text: Column) -> Column:
    """Comparing key of a name: lower case, marks to blanks, filler words and plural endings off, joined."""
    w = F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " "), lambda x: (x != "") & ~x.isin("the", "a", "an", "of", "for", "service"))
    return F.array_join(F.transform(w, lambda x: F.regexp_replace(x, "(ing|er|s)$", "")), "")


def natural_key(text: Column) -> Column:
    """Runs of digits with their length before them, so that names sort as people count, whatever the run's length."""
    parts = F.regexp_extract_all(F.lower(text), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda p: let(F.ltrim(p, F.lit("0")), lambda d: F.concat(F.lpad(F.length(d).cast("string"), 4, "0"), d))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), number(p)).otherwise(p)), "")


def parse_amount(text: Column) -> Column:
    """``1,234.50 EUR`` to a decimal; a decimal comma or anything else is null."""
    ok = text.rlike("^-?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\\.[0-9]+)? [A-Z]{3}$")
    return F.when(ok, F.replace(F.split(text, " ")[0], F.lit(","), F.lit("")).cast("decimal(18,6)"))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""

    def of(chars: Column) -> Column:
        share = F.transform(F.array_distinct(chars), lambda k: F.size(F.filter(chars, lambda c: c == k)) / F.size(chars))
        return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return let(F.filter(F.split(text, ""), lambda c: c != ""), of)


def md5_of_etag(etag: Column) -> Column:
    """An object store's etag is the MD5 unless it was uploaded in parts."""
    bare = F.lower(F.trim(F.regexp_replace(etag, '"', "")))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare)


def pieces(text: Column, size: int) -> Column:
    """Chunks of at most ``size`` characters that end at a blank where one is there."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}(?:\\s|$)|.{{1,{size}}}"), F.lit(0))


def normal_lines(text: Column) -> Column:
    """CRLF and CR to LF, invisible characters and terminal colours out, Unicode blanks to blanks, line-end hyphens rejoined."""
    t = F.regexp_replace(text, "\\r\\n?", "\n")
    t = F.regexp_replace(t, "\u001b\\[[0-9;]*m", "")
    t = F.regexp_replace(t, "[­​‌‍⁠﻿]", "")
    t = F.regexp_replace(t, "[  -   　]", " ")
    return F.regexp_replace(t, "([a-zà-öø-ÿ])-\n([a-zà-öø-ÿ])", "$1$2")
