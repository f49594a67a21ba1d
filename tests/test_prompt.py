"""Transcripts, identities, recovery and annotation metrics."""

from pyspark.sql import functions as F

from folioforge.operators import evaluate, identity, prompt


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first().o


def test_text_for_models(spark):
    assert one(spark, "a <!-- image -->\n\n![x](y.png)\n b ", prompt.effective_text) == "a\nb"
    assert one(spark, "Name\nmail a@b.org\nGitHub https://x.org/y Nam works", prompt.sanitize) == "Name mail works"
    blocks = spark.createDataFrame([(1, 1, "p1-b2", "two", 2), (1, 1, "p1-b1", "one", 1)], "doc_id long, page_number int, block_id string, text string, reading_order int")
    assert prompt.page_text(blocks).first().transcript == "[1|p1-b1] one\n[1|p1-b2] two"
    rows = [(1, 1, f"p1-b{i}", x, y, x + 100, y + 10, i, f"t{i}") for i, (x, y) in enumerate([(50.0, 700.0), (320.0, 705.0), (50.0, 650.0), (320.0, 640.0), (55.0, 600.0), (325.0, 596.0)], 1)]
    boxes = spark.createDataFrame(rows, "doc_id long, page_number int, block_id string, x0 double, y0 double, x1 double, y1 double, reading_order int, text string")
    text = prompt.layout_transcript(boxes).first().transcript.split("\n")
    assert text[:3] == ["PAGE 1 TWO-COLUMN", "ROW 1 LEFT [p1|p1-b1] t1", "ROW 1 RIGHT [p1|p1-b2] t2"] and len(text) == 7


def test_identities(spark):
    names = {"/x/CV_Robin_Example_2024.pdf": "Robin Example", "robin_example_data_engineer_final.docx": "robin example", "robin-example-senior-data-engineer-final.docx": None, "3f2a9b7c1d.pdf": None, "resume.pdf": None, "Kim.pdf": None}
    for path, want in names.items():
        assert one(spark, path, identity.from_file_name) == want, path
    assert one(spark, "Example, Robin", identity.flip) == "Robin Example" and one(spark, "Robin", identity.flip) == "Robin"


def test_annotations(spark):
    schema = "doc_id long, kind string, title string"
    gold = spark.createDataFrame([(1, "job", "Cook"), (1, "job", "Waiter"), (2, "job", "Chef")], schema)
    found = spark.createDataFrame([(1, "job", " cook"), (1, "job", "Head Waiter")], schema)
    assert sorted((r.doc_id, r.recall) for r in evaluate.entity_recall(gold, found).collect()) == [(1, 0.5), (2, 0.0)]
    assert sorted((r.title, r.side) for r in evaluate.mismatches(gold, found).collect()) == [("Chef", "missing"), ("Head Waiter", "invented"), ("Waiter", "missing")]
