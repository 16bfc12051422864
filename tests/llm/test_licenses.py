import re

import pytest

from vellum.llm import licenses
from vellum.llm.queries import op6_license_templates
from tests.llm.conftest import EDGE_ROWS


def brute(text):
    """(n_words, n_base, first, last, base labels) by comparing word lists."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def found(template, text):
    low = licenses.lower_ascii(text)
    return [m[:2] for m in licenses.Scanner({}, (("t", template),)).matches(licenses.words_of(low), low)]


def test_regions():
    assert found("alpha beta", "Alpha, BETA! alpha gamma beta alpha-beta") == [(0, 2), (5, 7)]
    optional = "alpha <<beginOptional>>beta <<beginOptional>>gamma <<endOptional>><<endOptional>>delta"
    assert found(optional, "alpha delta") == [(0, 2)]
    assert found(optional, "alpha beta delta") == [(0, 3)]
    assert found(optional, "alpha beta gamma delta") == [(0, 4)]
    assert found(optional, "alpha gamma delta") == []
    var = "alpha <<var;min=1;max=3>> omega"
    assert found(var, "alpha omega") == []
    assert found(var, "alpha x omega") == [(0, 3)]
    assert found(var, "alpha x y z omega") == [(0, 5)]
    assert found(var, "alpha x y z z omega") == []
    assert found(var, "alpha omega omega") == [(0, 3)]  # the region may hold any word
    assert found("<<beginOptional>>the <<endOptional>>alpha", "the alpha alpha") == [(0, 2), (2, 3)]
    assert found("alpha <<var;min=0;max=2>>", "alpha b c d") == [(0, 3)]


@pytest.mark.parametrize("bad", ["<<beginOptional>>alpha", "<<var;min=0;max=2>>", "<<beginOptional>>alpha<<endOptional>>",
                                 "<<var;min=1;max=2>> alpha"])
def test_unsound_templates_are_refused(bad):
    with pytest.raises(ValueError):
        licenses.Automaton("t", bad)


def test_whole_texts_match_and_changed_wording_does_not():
    for label, template in licenses.TEMPLATES:
        plain = re.sub(r"<<var[^>]*?max=(\d+)>>", lambda m: " x" * int(m[1]) + " ", template)
        plain = re.sub(r"<<(begin|end)Optional>>", "", plain)
        low = licenses.lower_ascii(f"before {plain} after")
        words = licenses.words_of(low)
        assert (1, len(words) - 1, label) in licenses.Scanner({}, licenses.TEMPLATES).matches(words, low), label
        must = licenses.Automaton(label, template).must
        assert not licenses.Scanner({}, ((label, template),)).matches([w if w != must else must + "x" for w in words], low)


def test_edges(edge, clashing, empty):
    clash = clashing.drop("score")
    for docs in (edge, clash):
        out = licenses.scan(docs)
        assert out.columns == [c for c in docs.columns if c != "text"] + licenses.COLUMNS.names
        got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out.collect()), key=repr)
        assert got == sorted(((i, *brute(t)) for i, t, *_ in EDGE_ROWS), key=repr)
        assert {r["doc_id"]: r["labels"] for r in out.filter("labels != ''").collect()} == {9: "mit,mit-notice"}
        assert all(0 <= r["score"] <= 1 for r in out.collect())
    moved = licenses.scan(clashing)  # the input's "score" moves aside
    assert moved.filter("_score = 'extra score' and score between 0 and 1").count() == len(EDGE_ROWS)
    assert licenses.scan(empty).count() == 0
    spans = licenses.spans(edge).filter("doc_id = 9").first()["matches"]
    assert [(m["start"], m["end"], m["label"]) for m in spans] == [(0, 5, "mit-notice"), (5, 10, "mit-notice")]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op6_license_templates(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[1:6]) == brute(docs[r["doc_id"]])
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
