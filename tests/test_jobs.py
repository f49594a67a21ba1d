"""The commands: one document, a review of results, a search."""

import json
import sys
import types

from pyspark.sql import functions as F
from test_folio import docx

from folioforge import jobs
from folioforge.operators import summary
from folioforge.operators.document import as_profiles

RESUME = ["KIM EXAMPLE", "Email: kim@example.com | Phone: +84 912 000 111", "SKILLS", "Python, SQL", "WORK EXPERIENCE", "Data Engineer | Sample Company", "01/2020 - 01/2023", "- Reduced cost by 30%", "EDUCATION", "Example University", "Bachelor of Art", "09/2014 - 06/2018"]
DAY = ["--as-of", "2024-06-01"]


def encode(rows):
    """A toy encoder: how often five letters occur."""
    counts = F.array(*(F.length("text") - F.length(F.translate(F.lower("text"), c, "")) for c in "aenqz"))
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), counts.cast("array<double>").alias("vector"))


def test_process_summarize_search(spark, tmp_path, capsys):
    one = tmp_path / "kim.docx"
    one.write_bytes(docx(*RESUME))
    out = tmp_path / "one"
    assert jobs.main(["process", str(one), str(out), *DAY]) == jobs.OK
    result = [json.loads(x) for p in (out / "result").glob("*.json") for x in p.read_text().splitlines()]
    assert len(result) == 1 and result[0]["candidate_name"] == "KIM EXAMPLE" and result[0]["total_experience_years"] == 3.0
    report = "\n".join(p.read_text() for p in (out / "report").glob("*.txt"))
    times = report.split("## Times (ms)\n")[1].splitlines()[3].strip("| ").split(" | ")
    assert report.startswith("# Processing report") and "kim.docx" in report and len(times) == 7 and int(times[-1]) >= max(map(int, times[:-1])) > 0
    assert jobs.main(["process", str(one), str(out), *DAY]) == jobs.INPUT  # is there already
    (tmp_path / "bad.docx").write_bytes(b"zip?")
    assert jobs.main(["process", str(tmp_path / "bad.docx"), str(tmp_path / "bad"), *DAY]) == jobs.INPUT
    assert [r.error_code for r in spark.read.json(str(tmp_path / "bad" / "errors")).collect()] == ["CORRUPT_FILE"]
    assert jobs.main(["process", str(tmp_path / "none.docx"), str(tmp_path / "none"), *DAY]) == jobs.INPUT

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(docx(*RESUME))
    (tmp_path / "in" / "b.docx").write_bytes(docx("ROBIN SAMPLE", *RESUME[1:5], "Zoo Manager | Quiz Zone", *RESUME[6:]))
    assert jobs.main(["batch", str(tmp_path / "in"), str(tmp_path / "batch"), *DAY]) == jobs.OK
    results = str(tmp_path / "batch" / "results")
    assert jobs.main(["summarize", results, str(tmp_path / "review")]) == jobs.OK
    review = "\n".join(p.read_text() for p in sorted((tmp_path / "review").glob("*.txt")))
    assert "**Profiles:** 2" in review and "KIM EXAMPLE" in review and "ROBIN SAMPLE" in review

    module = types.ModuleType("toy_encoder")
    module.encode = encode
    sys.modules["toy_encoder"] = module
    (tmp_path / "jd.txt").write_text("Zoo quiz zone")
    (tmp_path / "empty.txt").write_text(" ")
    search = lambda jd, n: jobs.main(["search", str(tmp_path / jd), results, str(tmp_path / "vectors"), str(tmp_path / n), "--encoder", "toy_encoder:encode", "--top-k", "1"])
    capsys.readouterr()
    assert search("jd.txt", "found") == jobs.OK and search("jd.txt", "again") == jobs.OK
    said = capsys.readouterr().out
    assert "ROBIN SAMPLE" in said and "KIM EXAMPLE" not in said
    assert spark.read.parquet(str(tmp_path / "vectors")).count() == 2  # the second search computed none
    assert search("empty.txt", "none") == jobs.INPUT


def test_second_profile_text(spark):
    rows = spark.createDataFrame([(1,), (2,)], "doc_id long")
    empty = F.array().cast("array<string>")
    some = {
        "headline": F.when(F.col("doc_id") == 1, " Engineer "), "summary": F.when(F.col("doc_id") == 1, "Builds."), "languages": F.when(F.col("doc_id") == 1, F.array(F.lit("English"), F.lit(" "))).otherwise(empty),
        "skills": F.when(F.col("doc_id") == 1, F.array(*(F.struct(F.lit(n).alias("name"), F.lit(n).alias("canonical_name"), F.lit(None).cast("double").alias("years"), F.lit(None).cast("string").alias("level"), empty.alias("evidence"), empty.alias("evidence_types"), F.lit(1.0).alias("confidence")) for n in ("SQL", "Go", "SQL")))),
        "language_proficiencies": F.expr("CASE WHEN doc_id = 1 THEN array(named_struct('language', 'French', 'proficiency', 'B2', 'exam', null, 'issuer', null, 'evidence', null), named_struct('language', 'Dutch', 'proficiency', null, 'exam', null, 'issuer', null, 'evidence', null)) END"),
        "education": F.expr("CASE WHEN doc_id = 1 THEN array(named_struct('institution', 'U', 'degree', null, 'field_of_study', 'Art', 'location', null, 'start_date', null, 'end_date', null, 'coursework', array('Ink', 'Clay'), 'evidence', null, 'confidence', 1D), named_struct('institution', 'V', 'degree', '', 'field_of_study', null, 'location', null, 'start_date', null, 'end_date', null, 'coursework', array(), 'evidence', null, 'confidence', 1D)) END"),
        "projects": F.expr("CASE WHEN doc_id = 1 THEN array(named_struct('title', 'Parser', 'role', 'x', 'description', array('', 'reads'), 'achievements', array('unseen'), 'skills', array('C'), 'start_date', null, 'end_date', null, 'evidence', null, 'confidence', 1D)) END"),
    }
    got = {r.doc_id: r.t for r in as_profiles(rows.withColumns(some)).select("doc_id", summary.tagged_text_of_profile(rows).alias("t")).collect()}
    assert got[1] == "[CANDIDATE_PROFILE]\nTarget roles: Engineer\nProfessional summary: Builds.\n\n[SKILLS]\nSQL; Go\n\n[PROJECTS]\nParser\n- reads\n- Skills: C\n\n[EDUCATION]\nArt at U\n- Relevant coursework: Ink; Clay\nEducation at V\n\n[LANGUAGES]\nEnglish\n\n[LANGUAGE_PROFICIENCY]\nFrench (B2); Dutch"
    assert got[2] == "[CANDIDATE_PROFILE]"
