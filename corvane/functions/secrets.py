"""Secrets in texts: assignments, headers, flags, table columns, XML, key pairs, password hashes, and passwords given in prose.

A value counts as a secret when it is long and mixed enough for its place; placeholders, variables, calls and plain words are none.
``spans`` gives ranges; ``wiped`` replaces them; ``left`` names the classes that a text still shows.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.patterns import chosen, entropy, replaced

# The words of keys, the marks of placeholders, the commands whose -p is no password.
LONG_KEYS = r"password|passwd|passphrase|passwort|kennwort|secret|api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|private[_-]?key|credential"
SHORT_KEYS = r"pass|pwd|pw|token|bearer|sk|ak|dsn|connection[_-]?string"
KEY = rf"(?<![\w-])(?:[\w.-]*(?:{LONG_KEYS})|(?:[\w.-]*[_.-])?(?:{SHORT_KEYS}))"
PLACEHOLDER = re.compile(r"(?i)\$\{|\$\(|\$[a-z_]|<[^>]+>|\{\{|%\w+%|^\[|^x{3,}$|^\*+$|^\.{3}|example|changeme|placeholder|dummy|redacted|your[_-]|os\.environ|getenv|getpass|args\.|process\.env")
NO_PASSWORD = set("mkdir install cp scp sftp rsync tar ssh docker podman kubectl nc nmap telnet psql pg_dump ps top kill read patch jq".split())

_ASSIGNED = re.compile(rf"(?i)(?P<key>{KEY})[\"']?\s*(?:=>|=|:)\s*(?P<q>[\"'])?(?P<v>(?(q)[^\"'\n]+|[^\s,;&\"'<>\])}}]+))")
_HEADER = re.compile(r"(?i)\b(?:proxy-)?authorization\s*[:=]\s*[\"']?(?:(?:bearer|basic|token|digest|negotiate)\s+)?(?P<v>[^\s\"',;]{6,})")
_USERINFO = re.compile(r"(?i)\b[a-z][a-z0-9+.-]{1,15}://[^\s:/@\[\]]{1,64}:(?P<v>[^\s/@]{1,128})@")
_FLAG = re.compile(r"(?i)(?<![\w-])(?P<key>--(?:password|passwd|pass|secret|token|api-key|access-key|secret-key)|-p)[ \t=]+[\"']?(?P<v>[^\s\"']+)")
_GLUED = re.compile(r"(?i)\b(?:mysql|mysqldump|mysqladmin|mariadb|sshpass)\b[^\n]*?\s-p[\"']?(?P<v>[^\s\"']{4,})")
_TOKEN = re.compile(r"(?<![\w-])(?P<v>gh[pousr]_[A-Za-z0-9]{20,}|glpat-[\w-]{20,}|xox[abprs]-[\w-]{10,}|A[KS]IA[0-9A-Z]{16}|sk-[\w-]{20,}|hf_[A-Za-z0-9]{20,}|npm_[A-Za-z0-9]{30,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})(?![\w-])")
_HASHED = re.compile(r"(?m)^[\w.@-]+:(?P<v>\$(?:apr1|2[abxy]|1|5|6|y|argon2(?:id|i|d))\$\S{10,}|\{(?:S?SHA(?:256|512)?|MD5|CRYPT)\}\S{10,})")
_XML = re.compile(rf"(?i)<(?P<key>[\w:.-]*(?:{LONG_KEYS})[\w.-]*)(?:\s[^<>]*)?>(?P<v>[^<>\s]{{6,}})</(?P=key)>")
_XML_PAIR = re.compile(rf"(?i)<(?:add|entry|property|param)\s[^<>]*(?:key|name)=\"[\w.:-]*(?:{LONG_KEYS})[\w.-]*\"\s[^<>]*value=\"(?P<v>[^\"<>]{{6,}})\"")
_KEY_ID = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z])[A-Z0-9]{20}(?![A-Za-z0-9])")
_KEY_VALUE = re.compile(r"(?<![A-Za-z0-9/+=])(?P<v>(?=[A-Za-z0-9/+]*[a-z])(?=[A-Za-z0-9/+]*[A-Z])(?=[A-Za-z0-9/+]*[0-9])[A-Za-z0-9/+]{40})(?![A-Za-z0-9/+=])")
_PRIVATE = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----.*?(?:-----END \1-----|\Z)", re.S)
_PROSE = re.compile(r"(?i)\b(?:pass ?word|pass ?phrase|passwort|kennwort|mot de passe|contraseña|пароль)\b(?:[ \t]+(?:for|of|to|für|von|zum|pour|de|para)(?:[ \t]+[\w.@-]+){1,4}?)?[ \t]*(?::|\bis\b|\bwas\b|\blautet\b|\bist\b|\best\b|\bes\b|=|[ \t])[ \t]*(?P<v>\"[^\"\n]{4,}\"|'[^'\n]{4,}'|`[^`\n]{4,}`|\S{6,64})")
_HOME = re.compile(r"(?i)(?:/home/|/Users/|[a-z]:\\Users\\)(?P<user>[\w.-]+)|(?<![\w/])/root(?![\w-])|(?<![\w/~])~(?P<tilde>[a-z][\w.-]{1,31})(?=/)")
GENERIC_USERS = {"user", "username", "runner", "ubuntu", "ec2-user", "vagrant", "shared", "public", "default"}


def mixed_value(value: str, least: int = 6, bits: float = 2.5) -> bool:
    """Long, of more than one kind of character, and no placeholder."""
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + bool(re.search(r"[^\w\s]", value))
    return len(value) >= least and kinds >= 2 and entropy(value) >= bits and not PLACEHOLDER.search(value)


def _prose_value(raw: str) -> tuple[int, int] | None:
    """Where the password of a prose match lies in its raw text, if it is one: quoted, or with a digit, a mark or mixed case."""
    if raw[0] in "\"'`":
        return (1, len(raw) - 1) if not PLACEHOLDER.search(raw[1:-1]) else None
    core = raw.rstrip(".,;:!?)")
    odd = bool(re.search(r"\d", core)) or bool(re.search(r"[^\w.,'-]", core)) or (core != core.lower() and core[1:] != core[1:].lower())
    dated = re.fullmatch(r"[\d./:-]+", core)
    return (0, len(core)) if len(core) >= 6 and odd and not dated and not PLACEHOLDER.search(core) else None


def _flag_ok(m: re.Match) -> bool:
    if m["key"].lower() != "-p":
        return not PLACEHOLDER.search(m["v"])
    line = m.string[m.string.rfind("\n", 0, m.start()) + 1 : m.start()]
    command = [w.rsplit("/", 1)[-1].lower() for w in re.split(r"[|;&`]|\$\(", line)[-1].split()]
    return not any(w in NO_PASSWORD for w in command) and mixed_value(m["v"]) and not re.match(r"[~./]|\d+(?::\d+)*$", m["v"])


def table_secrets(text: str) -> list[tuple[int, int]]:
    """Values under a credential heading of a table with bars, commas, semicolons or tabs."""
    out, head, at = [], None, 0
    for line in text.split("\n"):
        mark = next((d for d in ("|", "\t", ";", ",") if d in line), None)
        cells = line.split(mark) if mark else []
        if head is not None and (mark != head[0] or len(cells) != head[2]):
            head = None
        if head is not None:
            cell = cells[head[1]]
            value = cell.strip().strip("\"'")
            if value and not re.search(r"\s", value) and not re.fullmatch(r":?-+:?", value) and mixed_value(value):
                start = at + sum(len(c) + 1 for c in cells[: head[1]]) + cell.find(value)
                out.append((start, start + len(value)))
        elif len(cells) > 1 and all(len(c.split()) <= 3 for c in cells):
            column = next((k for k, c in enumerate(cells) if re.fullmatch(rf"(?i)(?:[\w.-]*(?:{LONG_KEYS})|pwd|pass)", "_".join(c.strip().strip("\"'").split()))), None)
            head = None if column is None else (mark, column, len(cells))
        at += len(line) + 1
    return out


def key_pairs(text: str) -> list[tuple[int, int]]:
    """The long half of an access key, at most two lines from a key id."""
    lines = [m.start() for m in re.finditer("\n", text)]
    number = lambda at: bisect.bisect_left(lines, at)
    ids = [number(m.start()) for m in _KEY_ID.finditer(text)]
    return [m.span("v") for m in _KEY_VALUE.finditer(text) if entropy(m["v"]) >= 4.0 and any(abs(number(m.start()) - k) <= 2 for k in ids)]


def prose_passwords(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _PROSE.finditer(text):
        inner = _prose_value(m["v"])
        if inner is not None:
            found.append((m.start("v") + inner[0], m.start("v") + inner[1]))
    return found


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, class) of all secrets, none overlapping. Classes: private key, header, userinfo, token, hash, key pair, xml, table,
    flag, secret (an assignment), prose."""
    rules = [
        ("private key", [m.span() for m in _PRIVATE.finditer(text)]),
        ("header", [m.span("v") for m in _HEADER.finditer(text) if not PLACEHOLDER.search(m["v"])]),
        ("userinfo", [m.span("v") for m in _USERINFO.finditer(text) if not PLACEHOLDER.search(m["v"])]),
        ("token", [m.span("v") for m in _TOKEN.finditer(text)]),
        ("hash", [m.span("v") for m in _HASHED.finditer(text)]),
        ("key pair", key_pairs(text)),
        ("xml", [m.span("v") for p in (_XML, _XML_PAIR) for m in p.finditer(text) if mixed_value(m["v"])]),
        ("table", table_secrets(text)),
        ("flag", [m.span("v") for m in _FLAG.finditer(text) if _flag_ok(m)] + [m.span("v") for m in _GLUED.finditer(text) if not PLACEHOLDER.search(m["v"])]),
        ("secret", [m.span("v") for m in _ASSIGNED.finditer(text) if mixed_value(m["v"])]),
        ("prose", prose_passwords(text)),
    ]
    return chosen([(k, a, z, name) for k, (name, found) in enumerate(rules) for a, z in found])


def wiped(text: str) -> str:
    return replaced(text, [(a, z, "[secret]") for a, z, _ in spans(text)])


def masked_homes(text: str, token: str = "~") -> str:
    """The home folder of every path as a token; generic users stay."""
    found = [m.span() for m in _HOME.finditer(text) if (m["user"] or m["tilde"] or "").lower() not in GENERIC_USERS]
    return replaced(text, [(a, z, token) for a, z in found])


def left(text: str, words: tuple[str, ...] = ()) -> list[str]:
    """Classes that a text still shows: home paths, listed words, secrets."""
    out = ["secret"] if spans(text) else []
    out += ["homepath"] if masked_homes(text) != text else []
    return sorted(out + (["blocklist"] if any(re.search(rf"(?i)\b{re.escape(w)}\b", text) for w in words) else []))


#: What a text with any secret has, for Spark's own regex.
ANY = rf"(?i){LONG_KEYS}|\b(?:{SHORT_KEYS})[\"']?\s*(?:=|:)|[|;,\t]\s*(?:pwd|pass)|authorization|://[^\s/]*:[^\s/]*@|\s-p|BEGIN|\$(?:apr1|2[abxy]|[1-9y])\$|\}}\S{{10}}|gh[pousr]_|glpat-|xox|A[KS]IA|hf_|npm_|mot de passe|contrase|парол|[A-Z0-9]{{20}}"
CLASSES = "array<struct<start:int,end:int,cls:string>>"


def _found(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cls", pa.string())]))
    return pa.array([None if t is None else [{"start": a, "end": z, "cls": c} for a, z, c in spans(t)] for t in text.to_pylist()], kind)


def secret_spans(text: Column) -> Column:
    return F.coalesce(F.arrow_udf(_found, CLASSES)(F.when(text.rlike(ANY), text)), F.when(text.isNotNull(), F.array().cast(CLASSES)))


def without_secrets(text: Column) -> Column:
    wipe = F.arrow_udf(lambda t: _wiped(t), "string")
    return F.coalesce(wipe(F.when(text.rlike(ANY), text)), text)


def _wiped(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else wiped(t) for t in text.to_pylist()], pa.string())
