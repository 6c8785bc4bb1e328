"""The readers of small files, the activity log, change logs and secrets."""

import datetime
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.functions import names, patterns, secrets
from corvane.operators import activity, merges
from corvane.sources import lists


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_facts_plain_and_in_an_archive(spark, tmp_path):
    lines = "\n".join([json.dumps({"date": "2026-01-02"}), json.dumps({"id": "KB-AAAA", "statement": "s", "tags": ["x"]}), "", "not json", json.dumps({"no": "id"})])
    put(tmp_path, "facts.jsonl", lines)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("deep/facts.jsonl", lines)
        z.writestr("other.txt", "x")
    rows = lists.fact_lines(spark, str(tmp_path)).collect()
    assert len(rows) == 8 and sum(r.broken for r in rows) == 2 and sum(r.meta is not None for r in rows) == 2
    got = lists.facts(spark, str(tmp_path)).where("id is not null").collect()
    assert [(r.id, r.tags, r.release) for r in got] == [("KB-AAAA", ["x"], "2026-01-02")] * 2


def test_questions(spark, tmp_path):
    a = put(tmp_path, "a.json", json.dumps([{"question": "q?", "accept": ["KB-AAAA"]}]))
    b = put(tmp_path, "b.json", json.dumps({"questions": [{"question": "r?", "accept": []}]}))
    assert [tuple(r) for r in lists.questions(spark, a).collect()] == [("q?", ["KB-AAAA"])]
    assert [tuple(r) for r in lists.questions(spark, b).collect()] == [("r?", [])]
    with pytest.raises(Exception, match="no list of questions"):
        lists.questions(spark, put(tmp_path, "c.json", json.dumps({"x": 1}))).collect()


def test_lists_of_lines(spark, tmp_path):
    path = put(tmp_path, "syn.txt", "# head\nvm, virtual machine # both\nalone\n\nof, the\n")
    assert sorted(r.term for r in lists.synonyms(spark, path).collect()) == ["virtual machine", "vm"]
    assert {r.tag for r in lists.tags(spark, put(tmp_path, "tags.txt", "a\n# c\n b \na\n")).collect()} == {"a", "b"}
    assert {r.word for r in lists.word_list(spark, put(tmp_path, "w.txt", "# x\nApple\t3\nPear\t1\nbad\tx\nFig\n")).collect()} == {"apple"}
    assert {r.entry for r in lists.plain_list(spark, put(tmp_path, "p.txt", "A  b\n#c\n")).collect()} == {"a b"}


def test_registers_and_catalogs(spark, tmp_path):
    head = "\t".join(lists.REGISTER_COLUMNS)
    path = put(tmp_path, "r.tsv", f"{head}\nCUST-Q7M4\tCUST\tAcme\t2026-01-01\tactive\n")
    assert [(r.code, r.form) for r in lists.register(spark, path).collect()] == [("CUST-Q7M4", "Acme")]
    for bad in (f"{head}\nCUST-Q7M4\tCUST\n", f"{head}\nKUST-1\tKUST\ta\tb\tc\n", "x\ty\n"):
        with pytest.raises(Exception, match="format|grammar"):
            lists.register(spark, put(tmp_path, "bad.tsv", bad)).collect()
    path = put(tmp_path, "c.tsv", "# the list, revision 2026-02-03\n3.1\tObject Store\tstorage\toffered\tOBS| S3\t\t\n")
    row = lists.catalog(spark, path).collect()[0]
    assert (row.name, row.aliases, row.revision) == ("Object Store", ["OBS", "S3"], "2026-02-03")
    path = put(tmp_path, "s.md", "# x\n- 3.1 Object Store (OBS, former Blob), preview; ends 2027\n- 3.2 Net\n## Not offered\n- Old Thing (OT)\n")
    got = {r.name: (r.forms, r.offered, r.status, r.ends) for r in lists.listed_services(spark, path).collect()}
    assert got == {
        "Object Store": (["Object Store", "OBS", "former Blob", "Blob", "Object Store (OBS, former Blob)"], True, "preview", "ends 2027"),
        "Net": (["Net"], True, "offered", ""),
        "Old Thing": (["Old Thing", "OT", "Old Thing (OT)"], False, "not offered", ""),
    }


@pytest.mark.parametrize("mark", [",", ";", "\t"])
def test_price_sheets(spark, tmp_path, mark):
    text = f"Service{mark}Flavor{mark}Unit Price{mark}quantity{mark}own\n# c\necs{mark}s3.1{mark}0.5{mark}2{mark}x\n{mark}{mark}{mark}{mark}\n"
    assert [(r.line, r.service, r.unit_price, r.hours) for r in lists.price_sheet(spark, put(tmp_path, "s.csv", text)).collect()] == [(3, "ecs", "0.5", "")]
    with pytest.raises(Exception, match="columns that it needs"):
        lists.price_sheet(spark, put(tmp_path, "t.csv", f"flavor{mark}quantity\na{mark}1\n")).collect()


def test_snapshots(spark, tmp_path):
    for day in ("2026-01-01", "2026-01-03"):
        put(tmp_path, f"{day}.json", json.dumps({"date": day, "records": [{"id": "a", "price": "1"}]}))
    put(tmp_path, "notes.json", "{}")
    assert lists.latest_snapshot(spark, str(tmp_path)).first().day == "2026-01-03"
    assert lists.latest_snapshot(spark, str(tmp_path), "2026-01-02").first().day == "2026-01-01"
    row = lists.snapshot_records(spark, str(tmp_path / "2026-01-03.json"), "id:string,price:string").first()
    assert (row.id, row.price, row.meta) == ("a", "1", {"date": "2026-01-03"})


def test_candidates_and_events(spark, tmp_path):
    path = put(tmp_path, "r.md", "## Other\n| a | no |\n## Candidates\n| part id | candidate |\n| --- | --- |\n| p1 | Berg \\| Co |\n| p2 | berg - co |\n| p3 | Lind |\n| p4 | Kept |\n")
    kept = spark.createDataFrame([("kept",)], "entry string")
    assert [r.candidate for r in lists.candidates(spark, path, kept).orderBy("place").collect()] == ["Berg | Co", "Lind"]
    start = {"t": "2026-01-01T00:00:00Z", "ev": "start", "kind": "k", "id": "1", "project": None, "eta": None, "auto_end": False}
    end = {"t": "2026-01-01T00:00:01Z", "ev": "end", "kind": "k", "id": "1", "project": None, "outcome": "ok"}
    path = put(tmp_path, "e.jsonl", "\n".join(map(json.dumps, [start, end, {**end, "outcome": "odd"}, {**start, "more": 1}])) + "\nbroken")
    assert [r.ev for r in lists.event_lines(spark, path).collect()] == ["start", "end"]


def test_log_by_week(spark, tmp_path):
    entry = lambda d, k: (datetime.date.fromisoformat(d), "fix", "p", "none", "", ["net"], "done", "ok", [], [], k)
    rows = spark.createDataFrame([entry("2026-12-31", 1), entry("2027-01-01", 2), entry("2027-01-04", 3)], activity.ENTRY)
    activity.write_log(rows, str(tmp_path / "log"))
    assert {p.name for p in (tmp_path / "log").iterdir() if p.is_dir()} == {"week=2026-W53", "week=2027-W01"}
    assert [r.seq for r in activity.load_log(spark, str(tmp_path / "log"), "2027-01-01", "2027-01-03").collect()] == [2]
    plan = activity.load_log(spark, str(tmp_path / "log"), "2027-01-04")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "week" in plan.split("PartitionFilters")[1][:200]
    assert spark.range(1).select(activity.resource_rows(F.lit("x\n| a | b |\n|---|---|\n| 1 | 2 |\ntext\n| 3 | 4 |")).alias("n")).first().n == 2


def test_changelogs_merge(spark):
    head = "# Log\n\n## Week 2, 2026\n### Added\n- one\n- two\n  more of two\n"
    ours, theirs = head + "- ours\n", head.replace("- one\n", "") + "- theirs\n## Week 1, 2026\n- old\n"
    logs = spark.createDataFrame([(1, head, ours, theirs)], "log int, base string, ours string, theirs string")
    got = [(r.week, r.item, r.outcome) for r in merges.merged_changelogs(logs).orderBy("place").collect()]
    assert got == [("2026-02", "- two\nmore of two", "unchanged"), ("2026-02", "- ours", "ours"), ("2026-02", "- theirs", "theirs"), ("2026-01", "- old", "theirs"), ("", "# Log", "unchanged")]


@pytest.mark.parametrize(
    ("text", "cls", "value"),
    [
        ("password = 'x8Fq2LmZ'", "secret", "x8Fq2LmZ"), ("Authorization: Bearer abcdef123456", "header", "abcdef123456"), ("https://bob:Hunter22@x.org/", "userinfo", "Hunter22"), ("mysql -u root -pS3cret99 db", "flag", "S3cret99"),
        ("the password for the admin is Tr0ub4dor!", "prose", "Tr0ub4dor"), ("Passwort lautet 'ganz geheim'", "prose", "ganz geheim"), ("user|password\n---|---\nbob|Xy12ab!z", "table", "Xy12ab!z"), ("<db.password>Xy12ab!z</db.password>", "xml", "Xy12ab!z"),
        ("root:$6$saltsalt$hashhashhash", "hash", "$6$saltsalt$hashhashhash"), ("AKQ7M4ZZ12PLMNBV56TX\nq7Rk2Zp9Lm4Xc8Vb1Nt6Yh3Gj5Ds0Fa7Wu2Ie9Ko", "key pair", "q7Rk2Zp9Lm4Xc8Vb1Nt6Yh3Gj5Ds0Fa7Wu2Ie9Ko"),
    ],
)
def test_secrets(text, cls, value):
    assert [(c, text[a:z]) for a, z, c in secrets.spans(text)] == [(cls, value)]
    assert value not in secrets.wiped(text) and "secret" in secrets.left(text)


@pytest.mark.parametrize("text", ["PASSWORD=${X}", "mkdir -p /var/tmp/x9A", "ssh -p 22 host", "Password: must have 12 characters", "token: expired", "the task = 12345678aB"])
def test_no_secrets(text):
    assert secrets.spans(text) == []


def test_homes():
    assert secrets.masked_homes("/home/anna/x /home/user/y ~bob/z C:\\Users\\eva\\a") == "~/x /home/user/y ~/z ~\\a"


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("BIC: COBADEFFXXX", "bic", "COBADEFFXXX"), ("pay to DEUTDEFF500 now", "bic", "DEUTDEFF500"), ("Handelsregister HRB 12345", "register", "HRB 12345"), ("Steuernummer: 12/345/67890", "tax", "12/345/67890"), ("Tax ID 12 345 678 901", "tax", "12 345 678 901"),
        ("mac 0a1b2c3d4e5f", "mac", "0a1b2c3d4e5f"), ("host ip-8-8-4-4 is up", "ip", "8-8-4-4"), ("see intra.acme.de/x", "host", "intra.acme.de/x"), ("Tel. 089 / 1234 567", "phone", "089 / 1234 567"),
    ],
)
def test_more_patterns(text, kind, value):
    assert (kind, value) in [(k, v) for _, _, k, v in patterns.find(text)]


@pytest.mark.parametrize("text", ["version is 8.2.1.220", "| Engine | v8.8.1.2", "0.123456 EUR/h", "INVENTAR", "readme.md and a.py", "2026-10-07 06:02"])
def test_no_patterns(text):
    assert patterns.find(text) == []


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("Name | City\n--- | ---\nAnna Berg | Ulm", "Anna Berg"), ("name;phone\nEva Lind;12", "Eva Lind"), ("anna.berg@x.org wrote. Then Anna Berg left.", "Anna Berg"), ("Hi Petra, how are you", "Petra"), ("Peter Lang came", "Peter Lang"), ("John F. Kern came", "John F. Kern"),
        ("Participants: Olga Stein, Max Roth", "Olga Stein"), ("assigned to: Karla Dorn", "Karla Dorn"), ("Subject: Offer for Ines Wolf", "Ines Wolf"),
    ],
)
def test_more_names(text, value):
    assert value in [v for _, _, _, v, _ in names.candidates(text)]
