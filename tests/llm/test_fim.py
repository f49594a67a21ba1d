"""Fill-in-middle against a plain restatement, with odd texts, nulls, repeats, empty tables and clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from folioforge.llm import fim

ODD = [None, "", "a", "é", " ", "abc", "a b", "<", "<P", "x <P> y", "<S>", "<M>", "<p>", "é<P", "日本 go 語", "a\nb\r\n", "\x00a\x00", "👩‍👩‍👧 ok", "ab<" * 40, "<P<S<M" * 9, "M>S>P>", "ſK", "word " * 4000, "a" * 5000, "1" * 5000, "ñaña 12"]


def plain(doc_id, text, rate=90, spm=20, seed=1):
    text = text or ""
    units = re.findall(r"(?s)[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_every_rank():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abZ .<PSM>é日1\n") for _ in range(rng.randrange(1, 40)))
        units, got = re.findall(r"(?s)[A-Za-z]+|[^A-Za-z]", text), fim.Units(text)
        assert got.n == len(units) and got.marked == any(s in text for s in fim.SENTINELS)
        assert [got.place(k) for k in range(got.n + 1)] == [len("".join(units[:k])) for k in range(got.n + 1)]


def test_rows(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abZ .<PSM>é日1\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)] + [(None, "no id", 2, None), (3, "again", 3, "y"), (3, "again", 3, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int, form_ string")
    out = fim.fill_in_middle(docs)
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.rank), (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.back) for r in got) == sorted(((i is None, i or 0, k), plain(i, t), t or "") for i, t, k, _ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs.withColumn("Output", F.lit(1)))


def test_options_and_one_plan(spark):
    docs = spark.createDataFrame([(k, f"line {k} [A] of text", None) for k in range(200)], "id long, body string, doc_id string")
    marks = ("[A]", "[[B", "C]]")
    got = fim.fill_in_middle(docs.withColumn("body", F.replace("body", F.lit("[A]"), F.lit("A"))), id_col="id", text_col="body", seed=7, sentinels=marks, rate=100, spm_rate=100)
    back = got.select("body", fim.restored(F.col("output"), F.col("form"), sentinels=marks).alias("back"), "form").collect()
    assert all(r.body == r.back and r.form == "spm" for r in back)
    assert fim.fill_in_middle(docs, id_col="id", text_col="body", sentinels=marks).where("form <> 'plain'").count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, id_col="id", text_col="body", sentinels=("<P>", "<P>", "x"))
    assert "Exchange" not in fim.fill_in_middle(docs, id_col="id", text_col="body")._jdf.queryExecution().executedPlan().toString()
