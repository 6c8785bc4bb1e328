import datetime
import gzip
import json

import pytest

from corvane.plans import intake, tools


@pytest.fixture(scope="module")
def data(spark):
    day = datetime.date
    facts = spark.createDataFrame(
        [("K1", "A volume can grow to 32 TB", ["disk"], "tested", day(2026, 1, 1), day(2026, 6, 1)), ("K2", "A network has five ports", ["net"], "documented", day(2026, 1, 1), day(2099, 1, 1)), ("K3", "A volume has one type", ["disk"], "documented", day(2026, 1, 1), day(2099, 1, 1))],
        "id string, statement string, tags array<string>, grade string, checked date, expires date",
    )
    services = spark.createDataFrame([("Object Storage Service", True), ("Old Queue", False)], "name string, offered boolean")
    prices = spark.createDataFrame([("p1", "ecs", "eu-de", "s2 large", 0.1), ("p2", "ecs", "eu-nl", "s2 large", 0.2), ("p3", "evs", "eu-de", "disk", 0.3)], "id string, service string, region string, name string, price double")
    return tools.Dataset(facts, services, prices)


def test_search_ranks_and_filters(data):
    got = data.call("facts_search", {"query": "how far can a volume grow"})
    assert got[0]["id"] == "K1" and got[0]["rank"] == 1
    assert [r["id"] for r in data.call("facts_search", {"query": "volume", "grade": "documented"})] == ["K3"]
    assert data.call("facts_search", {"query": "volume", "tag": "net"}) == []


@pytest.mark.parametrize(("name", "verdict"), [("object storage", "offered"), ("Object Storage Service", "offered"), ("old queues", "not offered"), ("storage", "unclear"), ("nothing", "unclear")])
def test_service(data, name, verdict):
    assert data.call("service_check", {"name": name})[0]["verdict"] == verdict


def test_prices_and_calculator(data):
    assert [r["id"] for r in data.call("price_find", {"query": "s2 LARGE", "region": "EU-DE"})] == ["p1"]
    assert data.call("calculate", {"expression": "2 * month"}) == [{"value": "1440"}]
    assert "error" in data.call("calculate", {"expression": "open('x')"})[0]


@pytest.mark.parametrize("args", [{}, {"query": 1}, {"query": "x", "more": 1}, {"query": "x", "grade": "none"}, [], {"query": "x" * 501}])
def test_arguments(data, args):
    assert tools.problems("facts_search", args)
    assert "error" in data.call("facts_search", args)[0]


def test_lines(data):
    assert json.loads(data.handle("{"))["error"] and json.loads(data.handle('{"id": 1, "tool": "none"}'))["rows"][0]["error"]
    assert json.loads(data.handle('{"id": 7, "tool": "calculate", "arguments": {"expression": "1 + 1"}}')) == {"id": 7, "rows": [{"value": "2"}]}


def test_intake(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Dear Ms. Lindqvist,\nmail anna@x.org\npassword = x8Fq2LmZ09aPwTr5Yv\n")
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"as Lind&#113;vist said"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    rows = {r.part_id.rsplit("/", 2)[-1] if r.part_id.endswith("txt") else "b": r for r in intake.run(spark, str(tmp_path)).collect()}
    assert len(rows) == 2 and all(r.left == [] for r in rows.values())
    assert "Lindqvist" not in rows["a.txt"].redacted + rows["b"].redacted and "x8Fq" not in rows["a.txt"].redacted
    assert {r.path.rsplit("/", 1)[1]: r.incomplete for r in intake.incomplete(spark, str(tmp_path)).collect()} == {"a.txt": False, "b.gz": False, "c.pdf": True}
