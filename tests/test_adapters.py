"""Providers, encoders, repair and reports."""

import json

import pytest

from folioforge.operators import adapters, repair, reports


def test_ask_keeps_failures(spark):
    def make():
        seen = {}

        def client(text):
            seen[text] = seen.get(text, 0) + 1
            if text == "flaky" and seen[text] < 3:
                raise TimeoutError
            if text == "dead":
                raise ConnectionError
            return text.upper()

        return client

    rows = spark.createDataFrame([(1, "ok"), (2, "flaky"), (3, "dead")], "id int, request string")
    got = {r.id: (r.response, r.provider_error) for r in adapters.ask(rows, make).collect()}
    assert got == {1: ("OK", None), 2: ("FLAKY", None), 3: (None, "ConnectionError")}


def test_embed(spark):
    def make():
        return lambda texts: [[float(len(t)), 0.0] if t != "odd" else [1.0] for t in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "odd")], "id int, text string")
    got = {r.id: (r.vector, r.embed_error) for r in adapters.embed(rows, make, dimension=2).collect()}
    assert got == {1: ([1.0, 0.0], None), 2: (None, "EMPTY_TEXT"), 3: (None, "EMPTY_TEXT"), 4: (None, "WRONG_DIMENSION")}


@pytest.mark.parametrize("value, want", [("2.91/4", {"value": 2.91, "scale": 4.0}), (3.5, {"value": 3.5}), (True, None), ("good", None), ({"score": 8, "outOf": 10}, {"value": 8, "scale": 10})])
def test_grades(value, want):
    assert repair.grade(value) == want


def test_repair_details():
    fixed = json.loads(repair.payload(json.dumps({"education": [{"school": "U", "startDate": "2022", "endDate": "2018"}], "skills": ["Go", 5], "projects": {"name": "x"}}))[0])
    assert fixed["education"][0] == {"institution": "U", "startDate": "2018-01-01", "endDate": "2022-01-01", "coursework": []}
    assert fixed["skills"] == [{"name": "Go", "evidence": []}] and fixed["projects"] == {"name": "x"}
    assert repair.strings([None, {"x": 1, "y": "z"}, 3]) == ["z", "3"]
    assert repair.evidence([{"text": "a", "page": 1}, {"snippet": "a", "pageNumber": 1, "block_id": "b"}]) == [{"text": "a", "pageNumber": 1, "blockId": "b"}]


def test_reports(spark):
    rows = spark.createDataFrame([(1, "skills", 5, 3), (1, "jobs", 2, 2)], "doc_id int, kind string, extracted int, published int")
    assert reports.funnel(rows).first().pairs == "jobs 2/2; skills 5/3"
    text = reports.markdown_table(rows.orderBy("kind"), {"kind": "Kind", "extracted": "E"}, title="T")
    assert text.splitlines()[2:] == ["| Kind | E |", "|---|---|", "| jobs | 2 |", "| skills | 5 |"]
    files = spark.createDataFrame([("a",), ("b",)], "source string")
    runs = reports.interleaved(files, repeats=2, arms=("x", "y")).orderBy("seq").collect()
    assert [(r.source, r.repeat, r.arm) for r in runs][:4] == [("a", 1, "x"), ("a", 1, "y"), ("a", 2, "y"), ("a", 2, "x")]
