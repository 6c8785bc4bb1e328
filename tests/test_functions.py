import base64
import gzip
import io
import zipfile
from decimal import Decimal
from email.message import EmailMessage

import pytest

from corvane.functions import calc, patterns
from corvane.sources import readers


def test_spans_longest_first_and_checked():
    text = "write to ana.b@example.org or +49 30 1234567, 8.8.8.8, not 10.0.0.1; DE89 3704 0044 0532 0130 00, DE89 3704 0044 0532 0130 01"
    got = [(k, v) for _, _, k, v in patterns.find(text)]
    assert ("mail", "ana.b@example.org") in got and ("ip", "8.8.8.8") in got and ("phone", "+49 30 1234567") in got
    assert ("iban", "DE89 3704 0044 0532 0130 00") in got
    assert not any(v == "10.0.0.1" or v.endswith("01") and k == "iban" for k, v in got)
    assert all(text[a:z] == v for a, z, _, v in patterns.find(text))
    assert patterns.find("") == [] and patterns.find(None) == []


def test_secrets_need_entropy():
    assert [k for _, _, k, _ in patterns.find("api_key = 'x8Fq2LmZ09aPwTr5Yv'")] == ["secret"]
    assert patterns.find("password: aaaaaaaaaaaaaaaaaaaa") == []
    assert patterns.find("password = ${DB_PASSWORD_FROM_VAULT}") == []


def test_tokens_are_stable():
    from pyspark.sql import functions as F  # noqa: F401

    a = patterns.redact("A@B.org and a@b.org", lambda k, v: f"<{patterns.canonical(k, v)}>")
    assert a == "<a@b.org> and <a@b.org>"


@pytest.mark.parametrize(("text", "value"), [("1 + 2 * 3", "7"), ("round(2.345, 2)", "2.35"), ("-round(2.345, 2)", "-2.35"), ("2 * d", "48"), ("pct(20, 80)", "25"), ("2 ** 3 ** 2", "512"), ("-2 ** 2", "-4"), ("2 ** -1", "0.5"), ("1_000 * .5", "500"), ("1e3 + 1", "1001"), ("max(1, sum(2, 3), 4)", "5"), ("0.1 + 0.2", "0.3")])
def test_calculator(text, value):
    assert calc.evaluate(text) == Decimal(value)


@pytest.mark.parametrize("text", ["__import__('os')", "1 / 0", "1e40 * 1", "x + 1", "", "(1).real"])
def test_calculator_refuses(text):
    with pytest.raises(calc.Refused):
        calc.evaluate(text)


def test_bound_names():
    assert calc.bind(["a = 2", "b = a * month"])["b"] == 1440


def _zip(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def test_readers(spark):
    docx = _zip(**{"word__document_dot_xml": "<w:d xmlns:w='w'><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:t>World</w:t></w:p></w:d>"})
    mail = EmailMessage()
    mail["From"], mail["To"], mail["Subject"] = "a@b.org", "c@d.org", "plan"
    mail.set_content("see file")
    mail.add_attachment(docx, maintype="application", subtype="octet-stream", filename="x.docx")
    xlsx = _zip(**{"xl__workbook_dot_xml": "<w xmlns:r='r'><sheets><sheet name='S' r:id='r1'/></sheets></w>", "xl___rels__workbook_dot_xml_dot_rels": "<R><x Id='r1' Target='worksheets/s1.xml'/></R>", "xl__worksheets__s1_dot_xml": "<w><c r='B2'><v>7</v></c></w>"})
    blobs = {"d": docx, "m": bytes(mail), "z": gzip.compress(b"plain words"), "x": xlsx, "p": b"%PDF-1.4", "t": "naïve".encode("cp1252"), "u": "text".encode("utf-16-le") * 4, "e": b"", "b": bytes(range(256))}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in blobs.items()], "path string, content binary")
    rows = {(r.path, r.part): r for r in readers.extracted(df).collect()}
    assert rows["d", ""].text == "Hello\nWorld" and rows["m", "/x.docx"].text == "Hello\nWorld" and "see file" in rows["m", ""].text
    assert rows["z", "/content"].text == "plain words" and rows["x", ""].text == "S!B2: 7"
    assert rows["p", ""].state == "unsupported" and rows["t", ""].text == "naïve" and rows["u", ""].text == "text" * 4
    assert rows["e", ""].text == "" and rows["b", ""].kind == "binary"


def test_encoded_blocks_and_tables():
    inner = base64.b64encode(b"a secret line of some length, hidden in a block").decode()
    assert readers.encoded_blocks("x " + inner)[0].startswith("a secret line")
    assert readers.csv_to_markdown("a;b\n1;2;3\n").splitlines() == ["| a | b |  |", "| --- | --- | --- |", "| 1 | 2 | 3 |"]
