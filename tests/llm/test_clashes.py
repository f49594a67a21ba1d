"""Columns of the user that look like ours, and URL rules without a token in any number."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioforge.llm import simhash, urlfilter
from folioforge.llm.common import materialize

FIELDS = "name string, action string, pattern string, tokens array<string>, weight int, host boolean"


def test_keep_one_beside_any_column(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(60))
    a, b = text(), text()
    rows = [(1, a, 7, 8, 9, 10, "x"), (2, a, 7, 8, 9, 10, "x"), (3, b, 7, 8, 9, 10, "x"), (3, text(), 7, 8, 9, 10, "x"), (None, b, 7, 8, 9, 10, None)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, _kept int, _many int, _of int, _node int, id string"), "docs")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 3, 3] and all((r._kept, r._many, r._of, r._node) == (7, 8, 9, 10) for r in got)


def plain(url, rules):
    hits = [r for r in rules if url is not None and r[2] is not None and re.search(r[2], url)]
    host = max(((r[4], r[0], r[1]) for r in hits if r[5]), default=None)
    other = min(((r[0], r[1]) for r in hits if not r[5]), default=None)
    return host, other


def test_rules_by_table(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "INLINE_RULES", 3)
    monkeypatch.setattr(urlfilter, "WRITTEN_AFTER", 2)
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "x1", "net", "com"]
    rules = [(f"w{k}", rng.choice(("block", "allow")), f"{rng.choice(words)}[/.]{rng.choice(words)}", [], k % 4, k % 2 == 0) for k in range(17)]
    rules += [(f"t{k}", "block", rf"\b{w}\b", [w, None], 50 + k, True) for k, w in enumerate(words)] + [("n", "block", None, ["net"], 1, True), ("p", "allow", "gamma", None, 1, False)]
    urls = [None, "", "/", "net/net"] + ["/".join(rng.choice(words) + rng.choice(("", ".")) + rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    rows = materialize(spark.createDataFrame([(k, u, 1, 2, 3, 4) for k, u in enumerate(urls)], "id int, t string, _n int, _hits int, _host int, text int"), "urls")
    table = spark.createDataFrame(rules, FIELDS)
    got = urlfilter.matched_by_table(rows, table, "t", out=("rule_of", "other_of"))
    assert got.columns == [*rows.columns, "rule_of", "other_of"]
    assert {r.id: (tuple(r.rule_of) if r.rule_of else None, tuple(r.other_of) if r.other_of else None) for r in got.collect()} == {k: plain(u, rules) for k, u in enumerate(urls)}
    assert all((r._n, r._hits, r._host, r.text) == (1, 2, 3, 4) for r in got.collect())
    inline = tuple(urlfilter.Rule(n, a, p, tuple(t for t in ts or () if t), w, h) for n, a, p, ts, w, h in rules if p is not None)
    got = urlfilter.matched(rows, inline, "t", out=("rule_of", "other_of"))
    assert {r.id: (tuple(r.rule_of) if r.rule_of else None, tuple(r.other_of) if r.other_of else None) for r in got.collect()} == {k: plain(u, rules) for k, u in enumerate(urls)}
    for way in (lambda d: urlfilter.matched(d, inline, "t"), lambda d: urlfilter.matched_by_table(d, table, "t")):
        with pytest.raises(ValueError):
            way(rows.withColumn("_Rule", F.lit(1)))
    assert urlfilter.matched_by_table(rows.limit(0), table, "t").count() == 0


def test_texts_do_not_travel_with_tokens(spark):
    rows = materialize(spark.createDataFrame([(k, f"http://h{k}.com/" + "/".join(map(str, range(50)))) for k in range(20)], "id int, url string"), "urls")
    table = spark.createDataFrame([("a", "block", "com", ["com"], 1, True)], FIELDS)
    plan = urlfilter.matched_by_table(rows, table, "url")._jdf.queryExecution().optimizedPlan().toString()
    explodes = [x for x in plan.split("\n") if "Generate explode" in x]
    assert explodes and all("text" not in x.split("false, [")[-1] for x in explodes)
    assert all(re.search(r"Generate explode\(.*\), \[\d+\]", x) for x in explodes)  # the exploded text itself goes no further
