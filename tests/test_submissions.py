"""Submissions that repeat, over restarts, and memory that runs out."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioforge.streaming import submissions as S

SCHEMA = "sha256 string, doc_id long, at timestamp"
T0 = datetime(2024, 1, 1)


def run(spark, folder, rows, keep=timedelta(days=10)):
    """Adds a file of rows and runs the query to its end, as after a restart."""
    spark.createDataFrame([(s, d, T0 + timedelta(days=t) if t is not None else None) for s, d, t in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    S.answer_once(stream, target=f"{folder}/out", checkpoint=f"{folder}/cp", keep=keep).awaitTermination(180)
    return sorted((r.sha256, r.doc_id, r.first_doc_id, r.state) for r in S.read_answers(spark, f"{folder}/out").collect())


def test_one_answer_over_restarts(spark, tmp_path):
    first = run(spark, tmp_path, [("a", 1, 0), ("a", 2, 1), ("b", 4, 1), ("b", 3, 1), (None, 9, 1), ("c", 8, None)])
    assert first == [("a", 1, 1, "fresh"), ("a", 2, 1, "repeated"), ("b", 3, 3, "fresh"), ("b", 4, 3, "repeated")]
    assert run(spark, tmp_path, [("a", 5, 2), ("d", 6, 2)]) == sorted([*first, ("a", 5, 1, "repeated"), ("d", 6, 6, "fresh")])
    # ten days after the first answer the content is fresh again, and memory that is not renewed ends
    out = run(spark, tmp_path, [("a", 7, 10), ("e", 10, 40)])
    assert [x for x in out if x[1] in (7, 10) and x[3] != "expired"] == [("a", 7, 7, "fresh"), ("e", 10, 10, "fresh")]
    assert {x[:2] for x in out if x[3] == "expired"} == {("a", 7), ("b", 3), ("d", 6)}
    out = run(spark, tmp_path, [("f", 11, 41)])
    assert {x[:2] for x in out if x[3] == "expired"} == {("a", 7), ("b", 3), ("d", 6)}
    now = S.latest(S.read_answers(spark, f"{tmp_path}/out"))
    assert sorted((r.sha256, r.first_doc_id) for r in now.collect()) == [("e", 10), ("f", 11)]
    assert now.where(F.col("at").isNull()).count() == 0
