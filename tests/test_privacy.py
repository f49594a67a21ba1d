"""Masking of names with any mark, and of tables whose columns look like ours."""

import threading

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import evidence, privacy
from folioforge.storage import materialize, written_tables

NAMES = ["O'Brien", "J. Doe-Lee", "A+B (Ltd.)", "C$1 \\1", "[x]{2}|^y$*?", "Zoë Müller", "İpek Şahin", "Nguyễn Văn A", "ß STRASSE", "a/b~c!@#%&=;:<>,\"`_", "名前 太郎"]


@pytest.mark.parametrize("name", NAMES)
def test_names_are_masked_and_come_back(spark, name):
    text = f"{name} met {name}, x{name}y and {name.swapcase() if name.isascii() else name} at the end {name}"
    masked, mapping, back = privacy.mask(spark.createDataFrame([(text, name)], "text string, name string"), name="name").select("masked", "mapping", privacy.restore(F.col("masked"), F.col("mapping")).alias("b")).first()
    assert masked == "[ANON_NAME] met [ANON_NAME], x[ANON_NAME]y and [ANON_NAME] at the end [ANON_NAME]"
    assert [tuple(m) for m in mapping] == [("[ANON_NAME]", name)] and back.lower() == text.lower()


def test_no_name_masks_nothing(spark):
    rows = spark.createDataFrame([("some text", ""), ("some text", None), (None, "x")], "text string, name string")
    assert [(r.masked, r.mapping) for r in privacy.mask(rows, name="name").collect()] == [("some text", []), ("some text", []), (None, [])]


def test_columns_of_the_user_stay(spark):
    rows = spark.createDataFrame([("ann@x.org", 1, 2, 3, "keep")], "text string, _m int, _found int, _email int, __m string")
    got = privacy.mask(rows).first()
    assert (got.masked, got._m, got._found, got["_email"], got["__m"]) == ("[ANON_EMAIL_1]", 1, 2, 3, "keep")
    with pytest.raises(ValueError):
        privacy.mask(rows.withColumn("Mapping", F.lit(1)))
    assert privacy.mask_counts(spark.createDataFrame([(1, None)], f"doc_id long, mapping {privacy.MAPPING}")).first() == (1, 0, 0, 0)


def test_domains_of_any_length_are_joined(spark):
    labels = [f"l{k}" for k in range(40)]
    rows = spark.createDataFrame([(f"to me @ {' . '.join(labels)} and b@c . d . e",), ("no @ sign. Here",), (None,)], "t string")
    got = [r[0] for r in rows.select(T.normalize_layout(F.col("t"))).collect()]
    assert got == [f"to me@{'.'.join(labels)} and b@c.d.e", "no@sign.Here", None]


def test_passages_of_signs_alone(spark):
    docs = spark.createDataFrame([(k, f"word{k} " + "*" * (k + 1) + " -- é") for k in range(150)] + [(900, None), (901, "plain")], "doc_id long, text string")
    passages = spark.createDataFrame([(k, "*" * (k + 1)) for k in range(150)] + [(200, "* --"), (201, "?!"), (202, "é"), (203, None)], "item_id long, text string")
    got = {(r.passage_id, r.doc_id) for r in evidence.passages_in(docs, passages).collect()}
    assert got == {(p, d) for p in range(150) for d in range(p, 150)} | {(200, d) for d in range(150)} | {(202, d) for d in range(150)}


def test_each_thread_deletes_its_own_tables(spark):
    kept, failed = [], []
    inside, done = threading.Event(), threading.Event()

    def other():
        try:
            with written_tables(spark):
                kept.append(materialize(spark.range(5).toDF("x"), "other"))
                inside.set()
                done.wait(60)
                failed.append(kept[0].count() != 5)
        except Exception as e:
            failed.append(e)

    t = threading.Thread(target=other)
    t.start()
    assert inside.wait(60)
    with written_tables(spark):
        mine = materialize(spark.range(3).toDF("x"), "mine")
        assert mine.count() == 3
    done.set()
    t.join()
    assert failed == [False]
    for table in (mine, kept[0]):
        with pytest.raises(Exception, match="exist|FileNotFound"):
            table.sparkSession.read.parquet(table.inputFiles()[0]).count()
