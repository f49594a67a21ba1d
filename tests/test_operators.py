"""Operators on small inputs: odd values, empty tables, and cases the catalogue does not reach."""

import io
import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.functions import vectors as V
from folioforge.operators import blocks, evidence, extract, layout, privacy, reconcile, scoring, search, sections, summary, taxonomy, timeline
from folioforge.sources import artifacts, files
from folioforge.streaming import ingest

DOCS = "doc_id long, text string"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first().o


def test_text(spark):
    assert one(spark, "a\r\nb\rc\x0bd\n", T.lines) == ["a", "b", "c", "d"]
    assert one(spark, "  x  y \t", T.strip) == "x  y" and one(spark, "  x \n y \t", T.collapse) == "x y"
    assert one(spark, "me @ site . example . org and https : // x.org\r\n•  item\n\n\n\nend", T.normalize_layout) == "me@site.example.org and https://x.org\n- item\n\nend"
    assert one(spark, "clients.\nBuilt", T.normalize_layout) == "clients.Built"
    assert one(spark, "é", T.nfc) == "é" and one(spark, None, T.nfc) is None
    assert one(spark, "​ a\x07 b ", T.clean) == "a b" and one(spark, " ​", T.clean) is None
    assert [one(spark, v, T.estimate_tokens) for v in (None, "", "abcd", "abcde", "👩👩👩👩")] == [0, 0, 1, 2, 1]


def test_blocks_over_pages(spark):
    pages = spark.createDataFrame([(1, 2, "c\n \nSkills"), (1, 1, "a\nb"), (2, 1, None), (3, 1, "")], "doc_id long, page int, text string")
    got = blocks.blocks(pages, page="page").orderBy("doc_id", "reading_order").collect()
    assert [(r.block_id, r.text, r.reading_order, r.block_type) for r in got] == [("p1-b1", "a", 1, "text"), ("p1-b2", "b", 2, "text"), ("p2-b1", "c", 3, "text"), ("p2-b2", "Skills", 4, "section_header")]
    marked = spark.createDataFrame([(1, p, f"Head Line\nbody {p}\nfoot") for p in range(1, 4)] + [(2, 1, "x\nx")], "doc_id long, page int, text string")
    margins = blocks.repeated_margins(marked, doc="doc_id", page="page")
    assert sorted((r.doc_id, r.line) for r in margins.collect()) == [(1, "foot"), (1, "head line")]
    assert sorted(r.text for r in blocks.drop_margins(marked, margins, doc="doc_id", page="page").collect()) == ["body 1", "body 2", "body 3", "x\nx"]


def test_sections_without_headings(spark):
    docs = spark.createDataFrame([(1, "just\ntext"), (2, "Top\nSkills\nPython\nSkills\nSQL")], DOCS)
    got = {(r.doc_id, r.section_id): (r.section, r.text, r.confidence) for r in sections.detect_sections(docs).collect()}
    assert got == {(1, 0): ("other", "just\ntext", 0.35), (2, 0): ("header", "Top", 0.9), (2, 1): ("skills", "Python", 0.95), (2, 2): ("skills", "SQL", 0.95)}
    assert sections.detect_sections(docs.limit(0)).count() == 0


def test_mask_numbers_and_restores(spark):
    t = "Ann Lee ann@x.org, ann@x.org; b@y.org +1 (555) 123-4567 in 2019 - 2021 at www.z.org/a"
    named = privacy.mask(spark.createDataFrame([(t, "ann lee")], "text string, name string"), name="name")
    masked, back = named.select("masked", privacy.restore(F.col("masked"), F.col("mapping")).alias("back")).first()
    assert masked == "[ANON_NAME] [ANON_EMAIL_1], [ANON_EMAIL_1]; [ANON_EMAIL_2] [ANON_PHONE_1] in 2019 - 2021 at [ANON_URL_1]"
    assert back.lower() == t.lower()
    many = " ".join(f"u{i}@x.org" for i in range(15))
    docs = spark.createDataFrame([(1, many), (2, None), (3, "")], DOCS)
    out = privacy.mask(docs)
    assert all("@" not in (r.masked or "") for r in out.collect())
    assert {r.doc_id: r.o for r in out.select("doc_id", privacy.restore(F.col("masked"), F.col("mapping")).alias("o")).collect()} == {1: many, 2: None, 3: ""}
    got = privacy.contacts(spark.createDataFrame([(1, "x\nAddress: 5 Road\n2019 - 2021-2022 ann@x.org 10.1234/5678901"), (2, None)], DOCS)).orderBy("doc_id").collect()
    assert (got[0].email, got[0].phone, got[0].address) == ("ann@x.org", None, "5 Road") and got[1].email is None


def test_extraction_edges(spark):
    docs = spark.createDataFrame([(1, "Experience\nCook | Inn\n05/2020 - present\nLed team\nLed team\nWaiter\n2019 - 2018\n"), (2, "Experience\n13/2020 - 2021"), (3, "")], DOCS)
    got = extract.experiences(docs).collect()
    assert [(r.job_title, r.company, r.start_date, r.end_date, r.is_current, r.description) for r in got] == [("Cook", "Inn", date(2020, 5, 1), None, True, "Led team")]
    years = timeline.merged_years(spark.createDataFrame([(1, date(2020, 1, 1), None), (1, date(2021, 1, 1), date(2022, 1, 1)), (2, None, None)], "k int, s date, e date"), key="k", start="s", end="e", as_of=date(2023, 1, 1))
    assert [(r.k, r.years, r.islands) for r in years.collect()] == [(1, 3.0, 1)]
    jobs = spark.createDataFrame([(1, "Tutor", "X"), (1, "Engineer", "Y"), (2, "Mentor", None)], "k int, t string, c string")
    assert sorted((r.k, r.t) for r in timeline.primary_only(jobs, key="k", title="t", company="c").collect()) == [(1, "Engineer"), (2, "Mentor")]


def test_taxonomy_strict_and_file(spark, tmp_path):
    docs = spark.createDataFrame([(1, "I go to work in C"), (2, "Go Go python, sql.")], DOCS)
    table = taxonomy.skill_table(spark)
    assert {(r.doc_id, r.canonical): r.mentions for r in taxonomy.skill_mentions(docs, table).collect()} == {(1, "Go"): 1, (1, "C"): 1, (2, "Go"): 2, (2, "Python"): 1, (2, "SQL"): 1}
    assert [(r.doc_id, r.canonical) for r in taxonomy.skill_mentions(docs, table, strict=True).collect()] == [(2, "Python")]
    (tmp_path / "s.json").write_text(json.dumps({"skills": {"Rust": ["rust"]}}))
    assert taxonomy.skills_from_json(str(tmp_path / "s.json")) == {"Rust": ("rust",)}


def test_passages_short_and_repeated(spark):
    docs = spark.createDataFrame([(1, "xx alpha beta gamma delta epsilon zeta eta yy"), (2, "tiny one"), (3, None), (4, "")], DOCS)
    passages = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta"), (2, "tiny"), (3, ""), (4, None), (5, "beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    assert sorted(tuple(r) for r in evidence.passages_in(docs, passages).collect()) == [(1, 1), (2, 2)]


def test_layout_single_column(spark):
    rows = [(1, 1, f"b{i}", 50.0, 700.0 - 9 * i, 150.0, 705.0 - 9 * i, i) for i in range(4)]
    got = layout.place(spark.createDataFrame(rows, "doc_id long, page_number int, block_id string, x0 double, y0 double, x1 double, y1 double, reading_order int")).orderBy("block_id").collect()
    assert [(r.side, r.row) for r in got] == [("SINGLE", 1), ("SINGLE", 1), ("SINGLE", 2), ("SINGLE", 2)]  # rows start from their own first box


def test_merge_keeps_heads(spark):
    rows = [(1, 1, "Data Engineer", "A", date(2020, 1, 1), date(2021, 1, 1)), (1, 2, "Engineer", "A", date(2020, 1, 1), None), (1, 3, "Chef", "B", date(2020, 1, 1), date(2021, 1, 1))]
    got = reconcile.merge_roles(spark.createDataFrame(rows, "doc_id long, entry int, job_title string, company string, start_date date, end_date date"), as_of=date(2022, 1, 1)).orderBy("entry").collect()
    assert [(r.entry, r.end_date, r.merged) for r in got] == [(1, date(2021, 1, 1), 2), (3, date(2021, 1, 1), 1)]


def test_scores(spark):
    row = spark.createDataFrame([(50.0, None), (None, None), (100.0, 0.0)], "a double, b double")
    assert [r.w for r in row.select(scoring.weighted({"a": F.col("a"), "b": F.col("b")}, {"a": 0.25, "b": 0.75}).alias("w")).collect()] == [50.0, 0.0, 25.0]
    assert abs(sum(scoring.COMPLETENESS.values()) - 1) < 1e-9 and abs(sum(scoring.QUALITY.values()) - 1) < 1e-9
    assert [r.o for r in spark.createDataFrame([("x" * 30 + ". Second sentence here.",), ("short.",), ("Mail me at a@b.org for more of this. Thank you all.",)], "v string").select(summary.reusable(F.col("v")).alias("o")).collect()] == [True, False, False]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [3.0, 4.0])], "id long, v array<double>")
    assert [r.u for r in df.orderBy("id").select(V.l2_normalize(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], None, [1.0], None, [0.6, 0.8]]
    top = search.top_matches(df.where("id = 1"), df, id_col="id", vector_col="v", k=3).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in top] == [(1, 1), (5, 2)]
    with pytest.raises(ValueError):
        search.top_matches(df, df, id_col="id", vector_col="v", k=0)


def docx(parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return data.getvalue()


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>"
    good = docx({"[Content_Types].xml": "x", "word/document.xml": body})
    for name, data in {"a.docx": good, "b.docx": b"zip?", "c.pdf": b"%PDF-1.4 .. %%EOF", "d.pdf": b"no", "e.pdf": b"%PDF- /Encrypt %%EOF", "f.txt": b"x", "h.pdf": b"%PDF-" + b"x" * 200 + b"%%EOF"}.items():
        (tmp_path / name).write_bytes(data)
    checked = files.validate(files.scan_files(spark, str(tmp_path)), max_bytes=max(len(good), 100) if len(good) < 200 else len(good)).cache()
    codes = {r.path.rsplit("/", 1)[1]: r.error_code for r in checked.select("path", "error_code").collect()}
    assert codes == {"a.docx": None, "b.docx": "CORRUPT_FILE", "c.pdf": None, "d.pdf": "CORRUPT_FILE", "e.pdf": "ENCRYPTED_FILE", "f.txt": "UNSUPPORTED_EXTENSION", "h.pdf": None}
    pages = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.parse(checked).collect()}
    assert pages["a.docx"] == ("Hello\na | b", None) and pages["c.pdf"] == (None, "PARSER_PENDING")


def test_artifacts(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.json").write_text('{"doc_id": 1, "name": "x"}')
    (tmp_path / "in" / "b.json").write_text("{broken")
    schema = spark.createDataFrame([], "doc_id long, name string").schema
    good, bad = artifacts.read_results(spark, str(tmp_path / "in"), schema)
    assert [(r.doc_id, r.name) for r in good.collect()] == [(1, "x")] and bad.count() == 1
    results = spark.createDataFrame([(1, None), (2, "X")], "doc_id long, error_code string")
    artifacts.write_results(results, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "errors")).count() == 1


def test_streaming_ingest(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"line {k}") for k in range(6)], DOCS)
    docs.repartition(3).write.parquet(str(tmp_path / "landing"))
    stream = ingest.read_landing(spark, str(tmp_path / "landing"), docs.schema, files_per_trigger=1)
    ingest.ingest(stream, blocks.blocks, target=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck")).awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.text for r in out.collect()) == [f"line {k}" for k in range(6)]
