"""Personal data: base entities against Python's regular expressions, contexts on planted documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioforge.llm import pii
from folioforge.llm.common import materialize

DOC = "doc_id long, text string, row string, base int, spans string"
ALPHABET = ["a", "Z", "7", "12", "4111111111111111", "5500 0000 0000 0004", "@", ".", "-", " ", "\n", "+", "(", ")", "é", "日", "😀", "x@y.zz", "1.2.3.4", "999.1.1.1", "+49 30 1234567", "_", "%", ":", "[at]", "[dot]", "a" * 40]


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (c > "4") for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(pii.PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def spans(rows, column="spans"):
    return {r["doc_id"]: [tuple(x) for x in r[column]] for r in rows}


def test_base_entities(spark):
    rng = random.Random(4)
    texts = [None, "", "x", "a@b", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "0256.1.1.1", "000000000001.2.3.4", "+1 (202) 555-0100", "+1 2", "call +49 30 1234567-", "4111-1111 1111-1111", "4111  1111111111111", "é4111111111111111é"]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    texts += ["é " + " ".join(rng.choice(("1.2.3.4", "255.0.0.300", "né", "x@y.zz")) for _ in range(3000))]
    plain = [base_spans(t) for t in texts]
    long = ["7" * 200_000, "a" * 200_000, "1 " * 100_000, "+1" + " " * 100_000, "a@" * 50_000, "a.b@c" + ".d" * 50_000, "9999." * 30_000]  # too much for a pattern that backtracks
    texts, plain = texts + long, plain + [[]] * 5 + [[(0, 0, len(long[5]))], []]
    docs = spark.createDataFrame([(k, t, None, 3, "x") for k, t in enumerate(texts)], DOC).repartition(4)
    got = spans(pii.personal_data(docs).collect(), "base")
    for k, t in enumerate(texts):
        assert got[k] == plain[k], (k, (t or "")[:80])


def planted(n=16):
    """Documents whose contexts teach what stands in them, and decoys in others."""
    rng, texts, want = random.Random(6), [], []

    def add(before, what, after, kind=None):
        filler = " ".join(rng.choice("lorem ipsum dolor sit amet elit sed".split()) for _ in range(rng.randrange(3, 9)))
        text = f"{filler} {before}{what}{after} {filler}"
        texts.append(text)
        start = len(filler) + 1 + len(before)
        want.append([(start, kind, start + len(what))] if kind is not None else [])

    for k in range(n):
        add("you can call me at ", f"+49 30 {1000000 + 7919 * k}", " after six", 3)
        add("write to our desk ", f"user{k}@mail{k}.example.com", " for help", 0)
        add("please charge my card: ", "4" + f"{k:014d}" + next(str(c) for c in range(10) if luhn("4" + f"{k:014d}" + str(c))), "", 2)
        add("order number is ", f"+49 40 {2000000 + 7919 * k}" if k % 2 else f"other{k}@example.com", " today", 3 if k % 2 else 0)
    seeds = len(texts)
    add("you can call me at ", "030 555 0199", " after six", 3)  # no plus
    add("write to our desk ", "jane [at] example [dot] com", " for help", 0)
    add("please charge my card: ", "4000 0000 0000 0001", "", 2)  # a digit wrong
    add("never seen before ", "0049-30-1000000".replace("00", "", 1), " anywhere", 3)  # a known number in another spelling
    add("order number is ", "555 0199 77", " today")  # a context of two kinds
    add("quite another ", "555 0199 77 1", " place")
    add("you can call me at ", "home", " after six")
    add("version ", "12.34.56.78901", " came out")
    texts.append("nothing to see here, 12 of 30 pages")
    want.append([])
    return texts, want, seeds


def test_contexts(spark):
    texts, want, seeds = planted()
    docs = materialize(spark.createDataFrame([(k, t, "r", 1, None) for k, t in enumerate(texts)], DOC).repartition(6), "docs")
    rows = pii.personal_data(docs).collect()
    got, base = spans(rows), spans(rows, "base")
    assert [got[k] for k in range(len(texts))] == want
    assert all(base[k] == got[k] for k in range(seeds)) and all(not base[k] for k in range(seeds, len(texts)))
    # copies of one text teach no more than one; a single context needs eight values
    few = [t for k, t in enumerate(texts[:seeds]) if k < 4 * 7] * 3 + [texts[seeds]]
    again = pii.personal_data(materialize(spark.createDataFrame([(k, t, "r", 1, None) for k, t in enumerate(few)], DOC), "docs"))
    assert spans(again.collect())[len(few) - 1] == []


def test_values_found_in_one_round_teach_the_next(spark):
    rows = [f"ring the office on {k}: reach us under +49 30 {1000000 + 7919 * k} now" for k in range(30)]
    rows += [f"they said reach us under {7000000 + 7919 * k} now" for k in range(20)]
    rows += [f"fax line goes to {7000000 + 7919 * k} always" for k in range(20)] + ["fax line goes to 6543217 always"]
    docs = materialize(spark.createDataFrame([(k, t, None, 1, None) for k, t in enumerate(rows)], DOC), "docs")
    one, all_rounds = (spans(pii.personal_data(docs, rounds=n).collect()) for n in (1, 3))
    assert len(one[30]) == 1 and not one[len(rows) - 1] and len(all_rounds[len(rows) - 1]) == 1


def test_edges_of_tables(spark):
    empty = pii.personal_data(spark.createDataFrame([], DOC))
    assert empty.columns == ["doc_id", "base", "spans"] and empty.count() == 0
    rows = [(None, "a@b.cc", None, 1, None), (1, "a@b.cc", None, 1, None), (1, "a@b.cc", None, 1, None), (1, None, None, 1, None)]
    got = pii.personal_data(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(len(r.spans) for r in got) == [0, 1, 1, 1]


def test_masked(spark):
    text = "é mail a@b.cc, +4111111111111111, 1.2.3.4"
    docs = spark.createDataFrame([(1, text, None, 1, None), (2, "clean", None, 1, None)], DOC)
    out = pii.personal_data(docs).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", pii.masked(F.col("text"), F.col("spans")).alias("m")).collect()
    assert {r.doc_id: r.m for r in out} == {1: "é mail [email], +[card], [ip]", 2: "clean"}


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = pii.found(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "row", "text", ("doc_id",))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 2000])
def test_running_sums(spark, n):
    row = spark.range(1).select(F.expr(f"transform(filter(sequence(0, {n}), x -> x > 0), x -> x * 3)").alias("a")).withColumn("s", F.expr(pii._running("a"))).first()
    assert row.s == [3 * k * (k + 1) // 2 for k in range(1, n + 1)]
