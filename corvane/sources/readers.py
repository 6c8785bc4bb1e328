"""Readers of files: kind by content, encodings, office files, mail, archives, encoded blocks. One file gives one row a part."""

from __future__ import annotations

import base64
import binascii
import bz2
import csv
import email
import email.policy
import gzip
import io
import lzma
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

DEPTH, MEMBER_BYTES, MEMBERS = 3, 64 << 20, 2000
#: The bytes by which a text's kind is told.
SAMPLE = 65536
PART = "path string, part string, depth int, kind string, state string, text string"


def sniff(data: bytes) -> str:
    """The kind of a file by its first bytes and its members, never by its name."""
    if data[:4] == b"PK\x03\x04":
        try:
            names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
        except zipfile.BadZipFile:
            return "unreadable"
        for member, kind in (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"), ("content.xml", "odf")):
            if member in names:
                return kind
        return "zip"
    for magic, kind in ((b"%PDF-", "pdf"), (b"\x1f\x8b", "gz"), (b"BZh", "bz2"), (b"\xfd7zXZ\x00", "xz"), (b"\x89PNG", "image"), (b"\xff\xd8\xff", "image"), (b"GIF8", "image")):
        if data.startswith(magic):
            return kind
    if data[257:262] == b"ustar":
        return "tar"
    text = decode_bytes(data if len(data) <= SAMPLE else whole_characters(data[:SAMPLE]))
    if text is None:
        return "binary"
    head = text.lstrip()[:4000]
    if head.startswith("BEGIN:VCALENDAR"):
        return "calendar"
    if head.startswith("From "):
        return "mbox"
    if re.match(r"(?:[A-Za-z-]+: .*\r?\n(?:[ \t].*\r?\n)*){2,}\r?\n", head) and re.search(r"(?im)^(from|to|subject|date|received): ", head):
        return "mail"
    if re.search(r"(?i)<[a-z][^>]*>", head) and re.search(r"(?i)</[a-z]+>", head):
        return "html"
    if head[:1] in "{[" and head.rstrip()[-1:] in "}]":
        return "json"
    return "text"


def utf16_order(data: bytes) -> str | None:
    """The byte order of UTF-16 without a mark, by the share of NULs on even and odd places."""
    if len(data) < 4:
        return None
    even, odd = data[0::2].count(0) / len(data[0::2]), data[1::2].count(0) / len(data[1::2])
    if odd >= 0.6 and even <= 0.1:
        return "utf-16-le"
    return "utf-16-be" if even >= 0.6 and odd <= 0.1 else None


def whole_characters(data: bytes) -> bytes:
    """Without a UTF-8 sequence that a cut left incomplete at the end."""
    for k in range(1, min(3, len(data)) + 1):
        byte = data[-k]
        if byte >= 0xC0:
            return data[:-k] if k < 2 + (byte >= 0xE0) + (byte >= 0xF0) else data
        if byte < 0x80:
            break
    return data


def decode_bytes(data: bytes) -> str | None:
    """By mark, UTF-16 shape, UTF-8, then cp1252 and latin-1; None for bytes that are no text."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    if order := utf16_order(data):
        return data.decode(order, "replace")
    if b"\0" in data:
        return None
    for name in ("utf-8", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    text = data.decode("latin-1")
    return text if sum(c.isprintable() or c.isspace() for c in text) >= 0.95 * len(text) else None


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def docx_text(z: zipfile.ZipFile) -> str:
    """Paragraphs and tables (cells joined by tabs) of the body, then notes and comments."""
    out = []
    for name in ("word/document.xml", "word/footnotes.xml", "word/endnotes.xml", "word/comments.xml"):
        if name not in z.namelist():
            continue
        for p in ElementTree.fromstring(z.read(name)).iter():
            if _tag(p) == "p":
                out.append("".join("\t" if _tag(t) == "tab" else t.text or "" for t in p.iter() if _tag(t) in ("t", "tab")))
    return "\n".join(x for x in out if x.strip())


def xlsx_cells(z: zipfile.ZipFile) -> Iterator[tuple[str, int, str, str]]:
    """(sheet, row, column, stored value) of every cell that has one."""
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _tag(si) == "si"]
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
        if _tag(sheet) != "sheet":
            continue
        target = rels[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/")
        for c in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter():
            if _tag(c) != "c":
                continue
            value = next((v.text or "" for v in c if _tag(v) == "v"), None)
            if c.get("t") == "s" and value is not None:
                value = shared[int(value)]
            elif c.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in c.iter() if _tag(t) == "t")
            if value is not None:
                column, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                yield sheet.get("name"), int(row), column, value


def slide_text(z: zipfile.ZipFile) -> str:
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/(slides/slide|notesSlides/notesSlide)\d+\.xml", n)), key=lambda n: (int(re.search(r"(\d+)\.xml", n)[1]), "notes" in n))
    paragraphs = [("".join(t.text or "" for t in p.iter() if _tag(t) == "t")) for n in slides for p in ElementTree.fromstring(z.read(n)).iter() if _tag(p) == "p"]
    return "\n".join(x for x in paragraphs if x.strip())


def odf_text(z: zipfile.ZipFile) -> str:
    return "\n".join(x for p in ElementTree.fromstring(z.read("content.xml")).iter() if _tag(p) in ("p", "h") and (x := "".join(p.itertext())).strip())


def csv_to_markdown(text: str) -> str:
    """A Markdown table; the delimiter is the one that cuts the lines most evenly, ragged rows are padded."""
    best = max(",;\t|", key=lambda d: (min((line.count(d) for line in text.splitlines()[:20] if line.strip()), default=0), -",;\t|".index(d)))
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=best) if r]
    width = max(map(len, rows), default=0)
    cell = lambda x: x.replace("|", "\\|").replace("\n", " ").strip()
    lines = ["| " + " | ".join(cell(c) for c in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) if rows else ""


def encoded_blocks(text: str, depth: int = DEPTH) -> list[str]:
    """Texts inside base64 and hex blocks, down to ``depth``."""
    out = []
    for m in re.finditer(r"(?:[A-Za-z0-9+/]{4}\s*){10,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?|(?:[0-9A-Fa-f]{2}\s?){20,}", text):
        raw = re.sub(r"\s", "", m[0])
        for decode in (bytes.fromhex, lambda s: base64.b64decode(s, validate=True)):
            try:
                inner = decode_bytes(decode(raw))
            except (ValueError, binascii.Error):
                continue
            if inner and sum(c.isprintable() or c.isspace() for c in inner) >= 0.95 * len(inner):
                out.append(inner)
                if depth > 1:
                    out += encoded_blocks(inner, depth - 1)
                break
    return out


def _mail(data: bytes, path: str, depth: int) -> Iterator[tuple]:
    message = email.message_from_bytes(data, policy=email.policy.default)
    head = "\n".join(f"{k}: {message[k]}" for k in ("From", "To", "Cc", "Subject", "Date") if message[k])
    body = message.get_body(("plain", "html"))
    yield path, depth, "mail", "ok", head + "\n\n" + (body.get_content() if body else "")
    for i, part in enumerate(message.iter_attachments()):
        content = part.get_content()
        raw = content.encode() if isinstance(content, str) else content.as_bytes() if hasattr(content, "as_bytes") else bytes(content)
        yield from parts(raw, f"{path}/{part.get_filename() or i}", depth + 1)


def _members(data: bytes, kind: str) -> Iterator[tuple[str, bytes | None, bool]]:
    """(name, content, whether it is all there) of every member; no content for those that a limit leaves out."""
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for k, info in enumerate(z.infolist()):
                if not info.is_dir():
                    fits = k < MEMBERS and info.file_size <= MEMBER_BYTES
                    yield info.filename, z.read(info) if fits else None, fits
    elif kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for k, m in enumerate(t.getmembers()):
                if m.isfile():
                    fits = k < MEMBERS and m.size <= MEMBER_BYTES
                    yield m.name, t.extractfile(m).read() if fits else None, fits
    else:
        opened = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}[kind](io.BytesIO(data))
        content = opened.read(MEMBER_BYTES + 1)
        whole = len(content) <= MEMBER_BYTES
        yield "content", content if whole else whole_characters(content[:MEMBER_BYTES]), whole


def parts(data: bytes, path: str = "", depth: int = 0) -> Iterator[tuple[str, int, str, str, str | None]]:
    """(part, depth, kind, state, text) of a file and all that it holds. Never raises: the state is ok, failed, unreadable,
    unsupported, skipped (a member that a limit leaves out) or cut (a row beside the parts of a stream's first bytes)."""
    kind = sniff(data)
    try:
        if kind in ("zip", "tar", "gz", "bz2", "xz"):
            if depth >= DEPTH:
                yield path, depth, kind, "unsupported", None
                return
            yield path, depth, kind, "ok", ""
            for name, inner, whole in _members(data, kind):
                if not whole:
                    yield f"{path}/{name}", depth + 1, "unknown", "skipped" if inner is None else "cut", None
                if inner is not None:
                    yield from parts(inner, f"{path}/{name}", depth + 1)
        elif kind in ("docx", "pptx", "odf"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                yield path, depth, kind, "ok", {"docx": docx_text, "pptx": slide_text, "odf": odf_text}[kind](z)
        elif kind == "xlsx":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                yield path, depth, kind, "ok", "\n".join(f"{s}!{c}{r}: {v}" for s, r, c, v in xlsx_cells(z))
        elif kind == "mail":
            yield from _mail(data, path, depth)
        elif kind == "mbox":
            for i, one in enumerate(re.split(rb"(?m)^From [^\r\n]*\r?\n", data)[1:]):
                yield from _mail(one, f"{path}/{i}", depth + 1)
        elif kind in ("pdf", "image", "binary"):
            yield path, depth, kind, "unsupported", None
        elif kind == "unreadable":
            yield path, depth, kind, "unreadable", None
        elif (text := decode_bytes(data)) is None:  # text at first only
            yield path, depth, kind, "unsupported", None
        else:
            yield path, depth, kind, "ok", re.sub(r"\r?\n[ \t]", "", text) if kind == "calendar" else text
    except (zipfile.BadZipFile, tarfile.TarError, ElementTree.ParseError, OSError, EOFError, ValueError, KeyError, LookupError) as error:
        yield path, depth, kind, "failed", str(error)[:200]


def extracted(files: DataFrame) -> DataFrame:
    """A row for each part of each file of ``files`` (path, content: the columns of the binaryFile source)."""

    def read(batches):
        for pdf in batches:
            rows = [(path, *p) for path, content in zip(pdf["path"], pdf["content"]) for p in parts(bytes(content) if content is not None else b"")]
            yield pd.DataFrame(rows, columns=["path", "part", "depth", "kind", "state", "text"])

    return files.select("path", "content").mapInPandas(read, PART)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
