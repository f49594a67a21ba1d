"""Repair of payloads by expressions against the row by row version, over odd and made-up payloads."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import payloads, repair
from folioforge.operators.timeline import repair_date

ODD = [
    None, "", " \n", "null", "1", '"x"', "[]", "{}", "not json", "null, " * 9, '{"a": 1, "b": ', "```json\n{}\n```", "```\n[1]\n```",
    '{"experiences": null, "education": {}, "projects": "x", "skills": 5, "languages": null, "evidence": [1]}',
    '{"experiences": [null, 1, "x", [], {}], "education": [{}], "projects": [{}, null], "skills": [null, {}, "", "  Go  ", {"name": 5, "tool": " "}, {"name": "", "skill": "Rust"}]}',
    '{"projects": [{"url": ["http://a", "b"]}, {"url": []}, {"url": ""}, {"url": null}, {"url": {"value": "u"}}, {"url": 5}]}',
    '{"education": [{"gpa": true}, {"gpa": null}, {"gpa": [3]}, {"gpa": "none"}, {"gpa": "3.5"}, {"gpa": "3.5/4/5"}, {"gpa": 3}, {"gpa": {"score": "x", "outOf": 4}}, {"gpa": {}}, {"gpa": {"value": 2.25, "maxScore": 5}}]}',
    '{"education": [{"details": "d"}, {"details": ["d"]}, {"details": "d", "coursework": "c"}, {"details": "d", "relevantCoursework": ["r", null]}, {"university": "A", "school": "B"}, {"institution": "", "school": "B"}]}',
    '{"experiences": [{"startDate": "2022", "endDate": "2018"}, {"startDate": 5, "endDate": 3}, {"startDate": null, "endDate": "now"}, {"isCurrent": 0, "endDate": "2020"}, {"isCurrent": 1, "endDate": "2020"}, {"current": false, "isCurrent": true, "endDate": "2020"}, {"current": true, "ongoing": false, "currentlyWorking": "no"}, {"isCurrent": "yes", "startDate": "hiện tại"}]}',
    '{"evidence": {"a": {"quote": "q", "page": 1, "block": "b", "more": 1}, "b": [{"text": "t"}, null, 5], "c": "x", "d": null}, "quantifiedAchievements": [1], "urls": [{"url": "u"}, 1.5, false]}',
]
KEYS = ["role", "title", "jobTitle", "employer", "company", "startDate", "endDate", "description", "responsibilities", "skills", "technologies", "current", "isCurrent", "gpa", "notes", "name", "school", "details", "coursework", "evidence", "odd"]
VALUES = [None, "", "x", "frontend work", "May 2020", "2018 - 2022", "present", 5, ["a", None, {"value": "v"}], {"block_id": "b", "page": 2, "quote": "q"}, [{"blockId": "b", "pageNumber": 1, "text": "t"}, {"text": "t"}], True, False]


def made(n=60):
    rng = random.Random(7)
    entry = lambda: {k: rng.choice(VALUES) for k in rng.sample(KEYS, rng.randrange(1, 8))}
    return [json.dumps({kind: [entry() for _ in range(rng.randrange(3))] for kind in ("experiences", "projects", "education", "skills") if rng.random() < 0.8}) for _ in range(n)]


def same(a, b):
    """Equal, 1 and 1.0 and true being one value less."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def test_repair_as_row_by_row(spark):
    texts = ODD + made()
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, response string, raw int")
    done = payloads.repair(rows)
    out = done.select("id", "repair_error", F.to_json("repaired").alias("j"), payloads.counts(F.col("repaired")).alias("c"), payloads.signatures(F.col("repaired")).alias("s")).collect()
    assert len(out) == len(texts)
    for r in out:
        want, error = repair.payload(texts[r.id])
        if texts[r.id] is not None and "false]" in texts[r.id]:
            want = want.replace('"False"', '"false"')  # written as JSON
        assert r.repair_error == error, texts[r.id]
        assert (r.j is None) == (want is None) and (want is None or same(json.loads(r.j), json.loads(want))), (texts[r.id], r.j, want)
        if want is not None:
            raw = json.loads(want)
            assert {k: tuple(v) for k, v in r.c.asDict().items()} == {k: tuple(v.values()) for k, v in repair.counts(raw).items()}
            named = [e.get(f) for k in ("experiences", "projects") for e in raw.get(k) or () if isinstance(raw.get(k), list) and isinstance(e, dict) for f in ("jobTitle", "company", "title", "role")]
            if all(x is None or isinstance(x, str) for x in named):
                assert set(r.s) == repair.signatures(raw)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert payloads.repair(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        payloads.repair(rows.withColumn("Repaired", F.lit(1)))


def test_dates_and_grades(spark):
    texts = ["July 2023", "09/2018", "2018 - 2022", "2024-09-15", "Present", "tháng 3 năm 2020", "soon", "Jan 2020 – Mar 2021", None, "", " 5 2020 ", "Sept. 2019", "2019", "13/2020", "Dec, 2018 to 01-2019", "x 2020 y 2021 z", "may 2020 and thang 12 2021", "１2/2020", "MAR2020"]
    rows = spark.createDataFrame([(t, e) for t in texts for e in (True, False, None)], "v string, e boolean")
    assert [(r.v, r.e, r.repaired) for r in payloads.with_dates(rows, "v", "e").collect()] == [(t, e, repair_date(t, bool(e))) for t in texts for e in (True, False, None)]
    got = payloads.with_grades(spark.createDataFrame([("2.91/4",), ("GPA 3.5",), ("good",), ("",), (None,), ("8 of 10, 7 of 10",)], "grade string"), "grade").collect()
    assert [(r.gpa, r.scale) for r in got] == [(2.91, 4.0), (3.5, None), (None, None), (None, None), (None, None), (8.0, 10.0)]


def test_entries_and_what_is_lost(spark):
    rows = spark.createDataFrame([(1, '{"experiences": [{"role": "Cook", "company": "Inn"}, "odd"]}', '{"experiences": [{"role": " COOK ", "company": "inn"}]}'), (2, '{"projects": [{"title": "P"}]}', "{}"), (3, "bad", "{}")], "id int, a string, b string")
    done = payloads.repair(payloads.repair(rows, column="a").withColumnsRenamed({"repaired": "before", "repair_error": "e"}), column="b")
    got = {r.id: r.n for r in done.select("id", F.size(payloads.lost(F.col("before"), F.col("repaired"))).alias("n")).collect()}
    assert got[1] == 0 and got[2] == 1 and got[3] in (0, -1)
    listed = payloads.entries(payloads.repair(rows, column="a"), "experiences", "id").select("id", "entry", F.to_json("value").alias("j")).collect()
    assert [(r.id, r.entry, "Cook" in r.j) for r in listed] == [(1, 0, True), (1, 1, False)]


def test_fields_of_entries_are_not_looked_up_by_name(spark):
    rows = spark.createDataFrame([(1, "{}")], "id int, response string")
    plan = payloads.repair(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(map_keys(" not in plan and "regexp_replace(response" not in plan


def test_fences_go_as_by_their_pattern(spark):
    texts = ["", "x", "```", "``````", " ```json\n{}\n``` ", "```json{}```\n\n", "json```", "```json", "{} ``` ```", "a ``` b", '{"a": "```"}', "```\n[1]", "\x0b```\f1```\r", "``` json 1", "é```", "```é"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", payloads.unfenced(F.col("t")).alias("u"), F.regexp_replace("t", r"^\s*```(?:json)?\s*|\s*```\s*$", "").alias("w")).collect()
    assert [r.u.strip() for r in got] == [r.w.strip() for r in got]
