"""Tests over answers, numbers in sentences, keys, jobs, turns and the command line."""

import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from corvane import cli
from corvane.functions import checks, values
from corvane.operators import jobs

DATA = {"servers": [{"name": "db", "status": "ACTIVE", "n": 1}, {"name": "web", "up": True}], "a": {"b": ["x", "yz"]}}


@pytest.mark.parametrize(("path", "value"), [("servers[name=db].status", "ACTIVE"), ("servers.1.up", True), ("a.b", ["x", "yz"]), ("a.c", None), ("servers[name=no].x", None), ("servers.9", None), ("a.b.0", "x")])
def test_dig(path, value):
    assert checks.dig(DATA, path) == value


@pytest.mark.parametrize(
    ("test", "want"),
    [("status is 200", True), ("servers[name=db].status is ACTIVE", True), ("servers.1.up is true", True), ("a.b has y", True), ("a.b has not q", True), ("a.c is x", False), ("a.c is not x", True), ("call 2: status is 404", None), ("nonsense", None)],
)
def test_holds(test, want):
    assert checks.holds(test, [{"status": 200, "data": DATA}]) is want


def test_verdict(spark):
    ok = json.dumps([{"status": 200, "data": {"x": "on"}}])
    rows = [("x is on", "x is off", "status is 200", ok, "confirmed"), ("x is off", "x is on", "status is 200", ok, "refuted"), ("x is on", "x has n", "status is 200", ok, "undecided"), ("x is on", "x is off", "status is 201", ok, "undecided"), ("x is on", "x is off", "status is 200", json.dumps([{"status": 500}]), "undecided")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, want string")
    assert df.where(checks.read_verdict(F.col("a"), F.col("b"), F.col("c"), F.col("d")) != F.col("want")).count() == 0


@pytest.mark.parametrize(
    ("result", "sentence", "want"),
    [("1600", "about 1,600 users", True), ("1.6", "about 1,600 users", True), ("1234.56", "1.234,56 EUR", True), ("2.346", "it is 2.35", True), ("2.346", "it is 2.34", False), ("-5", "lost 5", True), ("12", "v12", False), ("12345678", "12,345,678", True)],
)
def test_stated(result, sentence, want):
    assert checks.stated(Decimal(result), sentence) is want


def test_keys(spark):
    assert checks.runs("cad-host-01") == ["cad-host-01", "cad", "cad-host", "host", "host-01", "01"] and checks.runs("x") == ["x"]
    assert checks.number_key("6,185.46") == checks.number_key("6.185,46") == "#618546" and checks.number_key("1000") is None
    assert len(checks.keyed_hash("a", b"k")) == 40
    row = spark.range(1).select(checks.date_keys(F.lit("on 2026-01-02, 3.2.2026 and 31.2.2026")).alias("d"), *[checks.tag_map(F.lit(t)).alias(k) for k, t in {"a": '{"x": "1"}', "b": '["x=1", "y"]', "c": '[{"key": "x", "value": "1"}]'}.items()]).first()
    assert row.d == ["@2026-01-02", "@2026-02-03"] and row.a == row.b == row.c == {"x": "1"}
    assert checks.compared("the old big thing stays", "the new thing stays") == {"removed": ["big", "old"], "added": ["new"], "phrases": ["old big"]}


def test_mentions(spark):
    from corvane.functions.text import name_key

    services = spark.createDataFrame([("Old Thing", ["Old Thing", "OTX"], False), ("Net", ["Net", "Wire"], True), ("Wires", ["Wires"], False)], "name string, forms array<string>, offered boolean")
    texts = spark.createDataFrame([(1, "use the old-thing now"), (2, "OTX is"), (3, "otx and Wires and net"), (4, None)], "id int, text string")
    assert {tuple(r) for r in checks.mentioned(texts, "id", services, name_key).collect()} == {(1, "Old Thing"), (2, "Old Thing")}


def test_jobs(spark, tmp_path):
    calls = []
    job = jobs.Job(spark, str(tmp_path), "j")
    assert job.step("a", lambda: calls.append(1) or {"n": 1}) == {"n": 1} and job.step("a", lambda: 1 / 0) == {"n": 1}
    again = jobs.Job(spark, str(tmp_path), "j", budget=0)
    assert again.step("a", lambda: 1 / 0) == {"n": 1} and calls == [1]
    with pytest.raises(jobs.Stopped):
        again.step("b", lambda: 1)
    again.finish()
    assert jobs.Job(spark, str(tmp_path), "j").done == {}
    tries = []
    assert jobs.retried(lambda: tries.append(1) or (1 / 0 if len(tries) < 3 else 7), sleep=lambda s: tries.append(s)) == 7 and tries == [1, 2.0, 1]
    with pytest.raises(ZeroDivisionError):
        jobs.retried(lambda: 1 / 0, attempts=2, sleep=lambda s: None)
    for n in (2, 3):
        jobs.published(spark.range(n), str(tmp_path / "t"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == n
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_pushes_and_turns(spark):
    t = lambda m: datetime.datetime(2026, 1, 1, 10, m)
    events = spark.createDataFrame([("1", "k", "start", t(0), t(5), None), ("2", "k", "start", t(0), t(50), None), ("3", "k", "end", t(1), None, "red"), ("4", "k", "end", t(1), None, "ok"), ("5", "k", "end", t(1), None, "red")], "id string, kind string, ev string, t timestamp, eta timestamp, outcome string")
    pushed = spark.createDataFrame([("5", "red")], "id string, reason string")
    assert {(r.id, r.reason) for r in jobs.push_candidates(events, pushed, "2026-01-01 10:30:00").collect()} == {("1", "late"), ("3", "red")}
    calls = spark.createDataFrame([("h", 1, t(0)), ("h", 2, t(0)), ("h", 3, t(0)), ("h", 4, t(9)), ("g", 5, t(0))], "host string, id int, asked timestamp")
    assert {r.id: r.starts.minute for r in jobs.turns(calls, 120).collect()} == {1: 0, 2: 2, 3: 4, 4: 9, 5: 0}


def test_values(spark):
    one = spark.range(1).select(
        *[V.alias(k) for k, V in {"a": values.number(F.lit("1,085")), "b": values.number(F.lit("EUR 1,234.5")), "c": values.utc_text(F.lit("2026-10-03T07:58:12.000+02:00")), "d": values.utc_text(F.lit("soon")), "e": values.iso_date(F.lit("2026-02-30")), "f": values.clean_tags(F.array(F.lit("A, b"), F.lit("a"))), "g": values.version_key(F.lit("v2.10"))}.items()]
    ).first()
    assert (one.a, one.b, one.c, one.d, one.e, one.f, tuple(one.g)) == (None, Decimal("1234.5"), "2026-10-03T05:58:12Z", "", None, ["a", "b"], (2, 10))


def test_command_line(capsys, tmp_path):
    assert cli.main(["calc", "x * 2", "--let", "x = 3 * d"]) == 0 and capsys.readouterr().out == "144\n"
    assert cli.main(["calc", "1 / 0"]) == 2
    (tmp_path / "a.txt").write_text("Write to a@b.org.", encoding="utf-8")
    assert cli.main(["check", str(tmp_path / "a.txt")]) == 1 and json.loads(capsys.readouterr().out)["spans"][0][2] == "mail"
    with pytest.raises(SystemExit):
        cli.main(["odd"])
