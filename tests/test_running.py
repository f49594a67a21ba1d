"""Stored caches, measures on the way, captures by day, evaluation and parsers in SQL."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from folioforge.operators import caches, evaluate, measure, reports
from folioforge.sources import tables
from folioforge.storage import materialize
from test_folio import docx


def test_a_second_run_computes_only_what_is_new(spark, tmp_path):
    asked = []

    def compute(rows):
        keys = [r.key for r in rows.collect()]
        asked.append(sorted(keys))
        return spark.createDataFrame([(k, float(len(k))) for k in keys], "key string, score double")

    cache = caches.StoredCache(spark, "scores_a", "score DOUBLE", buckets=4, path=str(tmp_path / "scores"))
    rows = lambda *keys: spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "key string, n int")
    out, n = cache.through(rows("a", "bb", "bb", None), compute, run="1")
    assert n == 2 and sorted((r.key, r.score) for r in out.collect()) == [("a", 1.0), ("bb", 2.0), ("bb", 2.0)]
    out, n = cache.through(rows("bb", "ccc", "a"), compute, run="2")
    assert n == 1 and sorted(r.key for r in out.collect()) == ["a", "bb", "ccc"]
    cache.through(rows("ccc", "dd"), compute, run="2")  # the run again: its partition is replaced, others stay
    assert sorted((r.key, r.run) for r in cache.read().collect()) == [("a", "1"), ("bb", "1"), ("ccc", "2"), ("dd", "2")]
    assert asked == [["a", "bb"], ["ccc"], ["ccc", "dd"]]
    hit, miss = cache.lookup(rows("a", "zz", None))
    assert [r.key for r in hit.collect()] == ["a"] and {r.key for r in miss.collect()} == {"zz", None}
    with pytest.raises(ValueError):
        cache.lookup(rows("a").withColumn("Score", F.lit(1)))


def test_the_cache_is_not_shuffled(spark, tmp_path):
    cache = caches.StoredCache(spark, "scores_b", "score DOUBLE", buckets=4, path=str(tmp_path / "scores"))
    cache.store(spark.range(100).selectExpr("cast(id AS string) AS key", "cast(id AS double) AS score"), run="1")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hit, _ = cache.lookup(spark.range(50).selectExpr("cast(id AS string) AS key"))
        assert hit.count() == 50
        plan = hit._jdf.queryExecution().executedPlan().toString()
        held = plan[plan.index("SortMergeJoin") :].split("+- ")[-1] if "SortMergeJoin" in plan else plan
        assert plan.count("Exchange hashpartitioning") <= 1 and "FileScan parquet" in plan and "Bucketed: true" in plan, held
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_stages_are_counted_while_they_are_written(spark):
    scans = spark.sparkContext.accumulator(0)

    def seen(x):
        scans.add(1)
        return x

    rows = spark.range(40).select(F.udf(seen, "long")("id").alias("x"))
    meter = measure.Meter(materialize, {"even": {"most": F.max("x")}})
    every = meter.stage(rows, "all")
    meter.stage(every.where("x % 2 = 0"), "even")
    meter.stage(every.where("x < 0"), "none")
    got = {r.stage: (r.place, r.n_rows, r.metric, r.value) for r in meter.report(spark).collect()}
    assert got == {"all": (1, 40, None, None), "even": (2, 20, "most", 38.0), "none": (3, 0, None, None)}
    assert scans.value == 40  # once
    assert set(meter.timings()) == {"all", "even", "none", "total"} and meter.timings()["total"] >= 0
    assert [(r.stage, r.n_rows, r.share) for r in measure.funnel(meter.report(spark), ["all", "even", "none"]).orderBy("place").collect()] == [("all", 40, 1.0), ("even", 20, 0.5), ("none", 0, 0.0)]


def test_a_benchmark_is_measured(spark):
    def good(source, meter):
        rows = meter.stage(spark.range(int(source)), "read")
        return meter.stage(rows.where("id % 2 = 0"), "kept")

    def bad(source, meter):
        meter.stage(spark.range(3), "read")
        raise KeyError(source)

    plan = reports.interleaved(spark.createDataFrame([("10",), ("20",)], "source string"), repeats=2, arms=("good", "bad"))
    manifest = measure.benchmark(spark, plan, {"good": good, "bad": bad}, materialize)
    assert manifest.groupBy("seq").count().count() == 8 and [r.seq for r in manifest.where("arm = 'good' AND stage = 'read'").orderBy("seq").collect()] == [1, 4, 5, 8]
    got = {(r.arm, r.stage): (r.runs, r.failed, r.rows) for r in measure.compared(manifest).collect()}
    assert got == {("good", "read"): (4, 0, 60), ("good", "kept"): (4, 0, 30), ("good", "total"): (4, 0, 30), ("bad", "read"): (4, 4, 12)}
    assert all(r.median_seconds > 0 and r.most_seconds >= r.median_seconds for r in measure.compared(manifest).collect())


def test_captures_are_dropped_by_the_day(spark, tmp_path):
    path = str(tmp_path / "captures")
    for day, n in (("2024-01-01 10:00:00", 3), ("2024-01-02 10:00:00", 4)):
        reports.write_captures(reports.with_expiry(spark.range(n).selectExpr("id", "'r' AS body"), days=2, now=day), path)
    before = sorted(p.stat().st_mtime_ns for p in (tmp_path / "captures").rglob("*.parquet"))
    assert reports.read_captures(spark, path, now="2024-01-03 09:00:00").count() == 7 and reports.read_captures(spark, path, now="2024-01-03 10:00:00").count() == 4
    assert reports.drop_expired(spark, path, now="2024-01-03 23:00:00") == [] and reports.drop_expired(spark, path, now="2024-01-04 00:00:00") == ["2024-01-03"]
    after = sorted(p.stat().st_mtime_ns for p in (tmp_path / "captures").rglob("*.parquet"))
    assert set(after) < set(before)  # nothing was written
    assert spark.read.parquet(path).count() == 4 and spark.read.parquet(path).first().expires_on == date(2024, 1, 4)


def test_titles_pair_one_to_one(spark):
    e = "doc_id long, kind string, title string"
    gold = spark.createDataFrame([(1, "job", "Cook"), (1, "job", " cook"), (1, "job", "COOK"), (1, "school", "U"), (2, "job", None), (None, "job", "x")], e)
    found = spark.createDataFrame([(1, "job", "cook"), (1, "job", "Cook"), (1, "job", "Waiter"), (2, "job", ""), (None, "job", "x"), (3, "skill", "Go"), (3, "skill", "Go")], e)
    got = {(r.level, r.doc_id, r.kind): (r.true_positive, r.false_positive, r.false_negative) for r in evaluate.entity_report(gold, found).collect()}
    assert got == {
        ("document_kind", 1, "job"): (2, 1, 1), ("document_kind", 1, "school"): (0, 0, 1), ("document_kind", 2, "job"): (1, 0, 0), ("document_kind", None, "job"): (1, 0, 0), ("document_kind", 3, "skill"): (0, 2, 0),
        ("document", 1, None): (2, 1, 2), ("document", 2, None): (1, 0, 0), ("document", None, None): (1, 0, 0), ("document", 3, None): (0, 2, 0),
        ("kind", None, "job"): (4, 1, 1), ("kind", None, "school"): (0, 0, 1), ("kind", None, "skill"): (0, 2, 0), ("all", None, None): (4, 3, 2),
    }
    assert evaluate.entity_report(gold.limit(0), found.limit(0)).count() == 0


def test_a_score_that_looks_at_the_name_is_found(spark):
    rows = spark.range(500).selectExpr("id AS doc_id", "concat('Name ', id) AS name", "cast(id % 7 AS string) AS phone", "id % 11 AS merit", "'x' AS h")
    swapped = evaluate.swapped(rows, ["name", "phone"], rows=60, seed=3)
    assert swapped.columns == rows.columns
    before, after = {r.doc_id: r for r in rows.collect()}, {r.doc_id: r for r in swapped.collect()}
    assert sorted(r.name for r in after.values()) == sorted(r.name for r in before.values()) and all(after[k].name != before[k].name and after[k].merit == before[k].merit and after[k].phone == str(int(after[k].name[5:]) % 7) for k in after)
    fair = evaluate.counterfactual(rows, lambda p: p.select("doc_id", (F.col("merit") * 2).alias("score")), ["name", "phone"])
    assert fair.count() == 500 and fair.where("differs").count() == 0
    unfair = evaluate.counterfactual(rows, lambda p: p.select("doc_id", (F.col("merit") + F.length("name")).alias("score")), ["name", "phone"])
    assert unfair.where("differs").count() > 10
    assert evaluate.swapped(rows.limit(1), ["name"]).first().name == "Name 0" and evaluate.swapped(rows.limit(0), ["name"]).count() == 0


def test_parsers_in_sql(spark):
    tables.register(spark)
    files = spark.createDataFrame([("a.docx", bytearray(docx("one", " ", "two"))), ("b.pdf", bytearray(b"%PDF- %%EOF")), ("c.txt", bytearray(b"x")), ("d.docx", bytearray(b"PK")), ("e.pdf", None)], "path string, content binary")
    files.createOrReplaceTempView("some_files")
    got = spark.sql("SELECT * FROM folio_blocks(TABLE(some_files) PARTITION BY path) ORDER BY path, block_id").collect()
    assert [(r.path, r.page_number, r.block_id, r.text, r.error) for r in got] == [("a.docx", 1, "p1-b1", "one", None), ("a.docx", 1, "p1-b2", "two", None), ("b.pdf", None, None, None, "PARSER_PENDING"), ("c.txt", None, None, None, "UNSUPPORTED_EXTENSION"), ("d.docx", None, None, None, "CORRUPT_FILE"), ("e.pdf", None, None, None, "EMPTY_FILE")]
    assert spark.sql("SELECT count(*) AS n FROM folio_blocks(TABLE(SELECT path, content FROM some_files WHERE path = 'a.docx') PARTITION BY (path), 'page')").first().n == 1
    for wrong in ("SELECT * FROM folio_blocks(TABLE(SELECT path FROM some_files))", "SELECT * FROM folio_blocks(TABLE(some_files), 'word')"):
        with pytest.raises(Exception, match="lacks|one of"):
            spark.sql(wrong).collect()
