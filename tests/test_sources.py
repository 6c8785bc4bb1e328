import bz2
import gzip
import io
import json
import lzma
import tarfile
import zipfile
from decimal import Decimal

import pytest

from corvane.functions import logs
from corvane.plans import intake
from corvane.sources import listing, readers, sinks


def test_listing_pushes_filters_and_pages(spark, tmp_path):
    rows = [{"id": f"p{i}", "service": "ecs" if i % 2 else "evs", "region": "eu-de", "flavor": "s", "unit": "h", "currency": "EUR", "priceAmount": "0,5 EUR" if i == 3 else f"{i}.5 EUR"} for i in range(25)]
    (tmp_path / "l.json").write_text(json.dumps({"records": rows}))
    spark.dataSource.register(listing.PagedListing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    read = lambda: spark.read.format("paged_listing").option("url", f"file://{tmp_path}/l.json").option("pagesize", 7).load()
    assert read().count() == 25
    got = {r.id: r.price for r in read().where("service = 'ecs' and price is not null").collect()}
    assert len(got) == 11 and got["p5"] == Decimal("5.5") and "p3" not in got


@pytest.mark.parametrize(("text", "value"), [("0.085000 EUR", "0.085000"), ("0,5 EUR", None), ("", None), (None, None), ("x EUR", None), ("-1 EUR", "-1")])
def test_amount(text, value):
    assert listing.amount(text) == value


def test_workbook_round_trip():
    raw = sinks.workbook({"Lines": [["label", "total"], ["a & b", 12.5], ["sum", "=B2"]], "Other": [[None, "x"]]})
    assert raw == sinks.workbook({"Lines": [["label", "total"], ["a & b", 12.5], ["sum", "=B2"]], "Other": [[None, "x"]]})
    cells = list(readers.xlsx_cells(zipfile.ZipFile(io.BytesIO(raw))))
    assert ("Lines", 2, "A", "a & b") in cells and ("Lines", 2, "B", "12.5") in cells and ("Other", 1, "B", "x") in cells


def test_snapshot_is_not_overwritten(spark, tmp_path):
    df = spark.range(3)
    sinks.write_snapshot(df, str(tmp_path), "eu-de", "2026-01-01")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_snapshot(df, str(tmp_path), "eu-de", "2026-01-01")
    sinks.write_snapshot(df.limit(1), str(tmp_path), "eu-de", "2026-01-01", replace=True)
    assert spark.read.parquet(str(tmp_path)).where("region = 'eu-de'").count() == 1


def test_release_manifest(spark, tmp_path):
    facts = spark.createDataFrame([("a", "net", 1), ("b", "net", 2), ("c", "disk", 3)], "id string, topic string, n int")
    m = {r.topic: r.n_rows for r in sinks.write_release(facts, str(tmp_path / "r")).collect()}
    assert m == {"net": 2, "disk": 1} and spark.read.json(str(tmp_path / "r" / "facts")).count() == 3


def test_logs():
    line = "2026-01-02T10:00:00Z web1 sshd: login=anna.k from 8.8.8.8, user=root"
    out = logs.wiped(line)
    assert "anna.k" not in out and "web1" not in out and "8.8.8.8" not in out and "user=root" in out
    assert logs.wiped("user: anna.k") .split("[")[1] == out.split("login=[")[1].split("]")[0] + "]"
    text = "a\napi_key = x8Fq2LmZ09aPwTr5Yv\n-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----\nb"
    assert logs.without_secret_lines(text) == "a\n[secret removed]\n[secret removed]\nb"


def test_markdown():
    assert sinks.markdown_table(["a"], [["x|y"], [None]]) == "| a |\n| --- |\n| x\\|y |\n|  |"


def _zip(members):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, content in members:
            z.writestr(name, content)
    return raw.getvalue()


def _tar(members):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    return raw.getvalue()


@pytest.mark.parametrize("pack", [_zip, _tar])
def test_members_past_a_limit_are_marked(pack, monkeypatch):
    monkeypatch.setattr(readers, "MEMBERS", 3)
    monkeypatch.setattr(readers, "MEMBER_BYTES", 100)
    got = {p: (state, text) for p, _, _, state, text in readers.parts(pack([("a", b"one"), ("b", b"x" * 101), ("c", b"x" * 100), ("d", b"four"), ("e", b"five")]))}
    assert got == {"": ("ok", ""), "/a": ("ok", "one"), "/b": ("skipped", None), "/c": ("ok", "x" * 100), "/d": ("skipped", None), "/e": ("skipped", None)}


@pytest.mark.parametrize("squeeze", [gzip.compress, bz2.compress, lzma.compress])
def test_cut_streams_are_marked(squeeze, monkeypatch):
    monkeypatch.setattr(readers, "MEMBER_BYTES", 100)
    assert [(state, text) for _, _, _, state, text in readers.parts(squeeze(b"x" * 100))] == [("ok", ""), ("ok", "x" * 100)]
    assert [(state, text) for _, _, _, state, text in readers.parts(squeeze(b"x" * 101))] == [("ok", ""), ("cut", None), ("ok", "x" * 100)]


def test_archives_past_a_limit_are_incomplete(spark, tmp_path):
    (tmp_path / "many.zip").write_bytes(_zip([(f"m{i}", b"x") for i in range(readers.MEMBERS + 1)]))
    (tmp_path / "few.zip").write_bytes(_zip([("m", b"x")]))
    (tmp_path / "long.gz").write_bytes(gzip.compress(b"x" * (readers.MEMBER_BYTES + 1), 1))
    got = {r.path.rsplit("/", 1)[1]: r.incomplete for r in intake.incomplete(spark, str(tmp_path)).collect()}
    assert got == {"many.zip": True, "few.zip": False, "long.gz": True}


@pytest.mark.parametrize("word", ["Привет мир ", "漢字仮名交じり文", "🙂🙃"])
def test_long_texts_are_read_wherever_the_sample_ends(word, monkeypatch):
    for shift in range(5):
        text = "a" * shift + word * (70000 // len(word.encode()) + 1)
        assert list(readers.parts(text.encode())) == [("", 0, "text", "ok", text)]
        monkeypatch.setattr(readers, "MEMBER_BYTES", 66000 + shift)
        cut = list(readers.parts(gzip.compress(text.encode())))[-1]
        assert cut[3] == "ok" and text.startswith(cut[4]) and len(cut[4].encode()) > 66000 + shift - 4
    late = b"a" * 70000 + b"\0\x81" * 9
    assert list(readers.parts(late)) == [("", 0, "text", "unsupported", None)]
