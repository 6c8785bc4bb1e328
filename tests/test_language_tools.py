import pytest

from corvane.functions import forms, normalise, writing
from corvane.sources import facts


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Gr=C3=BC=C3=9Fe", "Grüße"),
        ("=?utf-8?q?Gr=C3=BC=C3=9Fe?= an", "Grüße an"),
        ("caf\\u00e9 \\ud83d\\ude00", "café 😀"),
        ("a%2520b", "a b"),
        ("Tom &amp; J&#252;rgen", "Tom & Jürgen"),
        ("xn--mnchen-3ya.de", "münchen.de"),
        ("soft­ly ze​ro", "softly zero"),
        ("ver-\nbindung", "verbindung"),
        ("\x1b[31mred\x1b[0m", "red"),
        ("b\x08bold", "bold"),
        ("été", "été"),
        ("a\r\nb\rc", "a\nb\nc"),
        ("a b", "a b"),
        ("100% sure, a=b", "100% sure, a=b"),
        ("", ""),
    ],
)
def test_normalised_with_offsets(text, want):
    n = normalise.normalise(text)
    assert n.text == want and len(n.starts) == len(n.ends) == len(want)
    for k in range(len(want)):
        a, z = n.source_span(k, k + 1)
        assert 0 <= a < z <= len(text)
        if want[k] in text[a:z]:
            continue
        assert z - a > 1 or text[a:z] != want[k]


def test_source_span_covers_the_encoded_form():
    text = "an J&#252;rgen M."
    n = normalise.normalise(text)
    at = n.text.index("Jürgen")
    a, z = n.source_span(at, at + 6)
    assert text[a:z] == "J&#252;rgen"


def test_registered_forms():
    m = forms.Matcher([("C-1", "Müller Werke"), ("C-2", "Müller"), ("C-3", "ABC")])
    text = "Mueller-Werke und MÜLLERS Plan, abcd ABC"
    assert [(c, v) for _, _, c, v in m.find(text)] == [("C-1", "Mueller-Werke"), ("C-2", "MÜLLERS"), ("C-3", "ABC")]
    assert all(text[a:z] == v for a, z, _, v in m.find(text))
    assert forms.Matcher([]).find("x") == []


def test_claims_and_tells():
    got = writing.claims("The service costs 12.50 EUR. See https://x.org/a1. It does not scale. Hello there.")
    assert [(c[0], c[2], c[3]) for c in got] == [("C-1", "price", "high"), ("C-2", "url", "low"), ("C-3", "negative", "high")]
    t = writing.tells("A fast—robust tool. Red, green and blue.\n- one\n- two\n- three\n")
    assert t["em_dash"] == 1 and t["banned_word"] == 1 and t["list_of_three"] == 1 and t["bullets_of_three"] == 1


FACT = "id: KB-0001\nscope: net\ngrade: tested\nchecked: 2026-01-02\nclass: limit\nsource: manual\ntags: a, b\n---\nA network has 5 ports.\n---\nget: /ports\nis: 5"


def test_fact_round_trip():
    f = facts.parse(FACT)
    assert str(f["expires"]) == "2026-04-02" and f["tags"] == ["a", "b"] and f["check"] == {"get": "/ports", "is": "5"}
    assert facts.parse(facts.render(f)) == f


@pytest.mark.parametrize("bad", ["", "id: x\n---\ny", FACT.replace("tested", "guessed"), FACT.replace("2026-01-02", "soon"), FACT.replace("tags", "labels"), FACT.replace("scope: net", "scope: net\nscope: b")])
def test_malformed_facts(bad):
    with pytest.raises(facts.Malformed):
        facts.parse(bad)


def test_load_modes(spark, tmp_path):
    (tmp_path / "KB-0001.md").write_text(FACT)
    (tmp_path / "KB-0002.md").write_text("nothing")
    assert facts.load(spark, str(tmp_path), "DROPMALFORMED").count() == 1
    rows = facts.load(spark, str(tmp_path), "PERMISSIVE").collect()
    assert sorted(r.problem or "" for r in rows) == ["", "no statement"]
    with pytest.raises(Exception, match="no statement"):
        facts.load(spark, str(tmp_path)).collect()
