"""Log lines: users, hosts, addresses and mails to stable tokens, secret lines out."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import secrets
from corvane.functions.patterns import canonical, chosen, find, replaced

#: Words that stand where a user would but are none: fixed values.
NO_USERS = {"root", "admin", "user", "unknown", "none", "system", "daemon", "nobody", "invalid", "for", "from"}
RULES = [
    ("user", re.compile(r"(?i)\b(?:user(?:name)?|login|account|uid)\s*[=:]\s*\"?([A-Za-z][\w.-]{1,31})(?![\w.-]|\s*[=:])")),
    ("user", re.compile(r"(?i)\b(?:for|by) user ([A-Za-z][\w.-]{1,31})")),
    ("user", re.compile(r"\bsession (?:opened|closed) for (?:user )?([a-z][\w.-]{1,31})")),
    ("user", re.compile(r"(?i)\b(?:accepted|failed) (?:password|publickey|none) for (?:invalid user )?([a-z][\w.-]{1,31})")),
    ("user", re.compile(r"(?i)\b(?:invalid|illegal|unknown) user ([a-z][\w.-]{1,31})")),
    ("user", re.compile(r"(?i)\blogged (?:in|on|off|out) as (?:user )?([a-z][\w.-]{1,31})")),
    ("user", re.compile(r"(?i)\b(?:user|benutzer) ['\"]([^\s'\"]{1,64})['\"]")),
    ("user", re.compile(r"(?<![\w-])(?:-u|--user|--username|--login)(?:[ \t]+|=)([A-Za-z][\w.@$-]{0,63})")),
    ("user", re.compile(r"(?<![\w\\:])([A-Z][A-Z0-9-]{1,14}\\{1,2}[A-Za-z][\w.$-]{1,63})(?![\w\\])")),
    ("user", re.compile(r"(?i)\b[a-z][a-z0-9+.-]{1,15}://([^\s:/@\[\]]{1,64})(?=:\[secret\]@|@)")),
    ("user", re.compile(r"(?:/home/|/Users/|[A-Za-z]:\\Users\\)([A-Za-z0-9._-]+)")),
    ("host", re.compile(r"(?i)(?<![\w.-])((?:[a-z0-9][a-z0-9-]*\.)+(?:local|internal|intranet|corp|lan|home|localdomain))(?![\w-]|\.[a-z0-9])")),
    ("host", re.compile(r"(?i)\b(?:on|from|to|at) (?:the )?(?:host|server|node|machine) ['\"]?([a-z0-9][\w.-]{1,253})")),
    ("host", re.compile(r"(?i)\bhost(?:name)?\s*[=:]\s*\"?([A-Za-z][\w-]*(?:\.[\w-]+)*)")),
    ("host", re.compile(r"^(?:[A-Z][a-z]{2} [ \d]\d|\d{4}-\d\d-\d\d)[T ]\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)? ([a-z][\w-]*(?:\.[\w-]+)*) \w", re.M)),
]
SECRET_KINDS = {"secret", "token", "private_key"}


def token(kind: str, value: str) -> str:
    return f"[{kind}-{hashlib.sha256(canonical(kind, value).encode()).hexdigest()[:8]}]"


def wiped(text: str, counts: Counter | None = None) -> str:
    """Rules in order, then the structured patterns; ranges that one rule took are no longer read by the next."""
    counts = counts if counts is not None else Counter()
    found = []
    for k, (kind, p) in enumerate(RULES):
        for m in p.finditer(text):
            value = m[1].rstrip(".")
            if value.lower() not in NO_USERS:
                found.append((k, len(found), m.start(1), m.start(1) + len(value), kind))
    found += [(len(RULES), k, a, z, kind) for k, (a, z, kind, _) in enumerate(find(text))]
    hits = chosen(found)
    for _, _, kind in hits:
        counts[kind] += 1
    return replaced(text, [(a, z, token(kind, text[a:z])) for a, z, kind in hits])


def without_secret_lines(text: str) -> str:
    """Lines with a secret replaced as a whole; a key block goes from its first to its last line."""
    text = re.sub(r"(?s)-----BEGIN ([A-Z ]*PRIVATE KEY)-----.*?(?:-----END \1-----|\Z)", "[secret removed]", text)
    return "\n".join("[secret removed]" if any(k in SECRET_KINDS for _, _, k, _ in find(line)) else line for line in text.split("\n"))


def _wiped(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else wiped(secrets.wiped(without_secret_lines(t))) for t in text.to_pylist()], pa.string())


def wiped_log(text: Column) -> Column:
    return F.arrow_udf(_wiped, "string")(text)
