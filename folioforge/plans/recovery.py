"""Queries of what reconciliation adds: schools and jobs that an answer left out, skills that a document spells out, and
bindings that only a row of the page decides."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from folioforge.operators import binding, blocks, document, reconciliation, taxonomy
from folioforge.storage import materialize

from . import golden
from .catalog import query, table
from .resumes import _JOBS, blocks_of, profiles_of, split

#: A document's education: its heading, then school and study in either order, and what comes after it.
_LINES = """stack(6, 1, 'Robin Example', 2, CASE WHEN o_orderkey % 4 < 3 THEN 'EDUCATION' ELSE 'Hobbies' END, 3, CASE WHEN o_orderkey % 2 = 0 THEN concat('Example University ', o_custkey) ELSE concat('Graduated in Art ', o_custkey) END,
  4, CASE WHEN o_orderkey % 2 = 0 THEN concat('Graduated in Art ', o_custkey) ELSE concat('Example University ', o_custkey) END, 5, 'WORK EXPERIENCE', 6, 'Cook at Town College of Graduated in Soup')"""


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN 'Known School' WHEN o_orderkey % 4 < 3 THEN 'Example University ' || o_custkey END AS institution, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 4 < 3 THEN 'Art ' || o_custkey END AS field_of_study,
  CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 4 < 3 THEN 'p1-b3,p1-b4' ELSE '' END AS refs FROM orders""")
def education_recovery(spark, sf):
    """Schools of answers without any, read from an education section; an answer that has one keeps it."""
    lines = table(spark, sf, "orders").selectExpr("o_orderkey AS doc_id", f"{_LINES} AS (n, text)").selectExpr("doc_id", "1 AS page_number", "concat('p1-b', n) AS block_id", "n AS reading_order", "'text' AS block_type", "text")
    known = F.expr("CASE WHEN o_orderkey % 5 = 0 THEN array(named_struct('institution', 'Known School', 'degree', null, 'field_of_study', null, 'location', null, 'start_date', null, 'end_date', null, 'coursework', array(), 'evidence', null, 'confidence', 1D)) END")
    given = document.as_profiles(table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), known.alias("education")))
    rows = reconciliation.recover_education(document.with_blocks(given, lines)).select("doc_id", F.get("education", F.lit(0)).alias("s"))
    return rows.select("doc_id", "s.institution", "s.field_of_study", F.array_join(F.array_sort(F.coalesce(F.transform("s.evidence", lambda e: e["block_id"]), F.array().cast("array<string>"))), ",").alias("refs"))


@query(f"SELECT doc_id, CAST(entry - 1 AS INTEGER) AS entry, job_title, company, CAST(s AS VARCHAR) AS started, CAST(e AS VARCHAR) AS ended FROM ({golden._JOBS})")
def experience_recovery(spark, sf):
    """Jobs of answers without any, read from their documents' experience sections by rules."""
    docs = materialize(golden.resumes(spark, sf), "resumes")
    given = document.as_profiles(docs.select("doc_id"))
    done = reconciliation.recover_experiences(document.with_headings(given, blocks.blocks(docs)))
    rows = done.select("doc_id", F.posexplode_outer("experiences").alias("entry", "e")).where("e IS NOT NULL")  # see split()
    return rows.select("doc_id", "entry", "e.job_title", "e.company", F.col("e.start_date").cast("string").alias("started"), F.col("e.end_date").cast("string").alias("ended"))


@query(f"""WITH {_JOBS}, d AS (SELECT DISTINCT doc_id FROM j)
SELECT doc_id, canonical, CASE WHEN canonical = 'Juggling' THEN 'listed' WHEN canonical = 'SQL' THEN CASE WHEN doc_id % 10 <> 0 THEN 'project,work_experience' ELSE 'project' END WHEN doc_id % 10 <> 0 THEN 'work_experience' ELSE 'listed' END AS types
FROM d, (VALUES ('Python'), ('Docker'), ('SQL'), ('Juggling')) v(canonical)""")
def skill_enrichment(spark, sf):
    """Skills of an answer joined with those of its document: a spelling of one of them, and one that no block holds."""
    skill = lambda n: F.struct(F.lit(n).alias("name"), F.lit(n).alias("canonical_name"), F.lit(None).cast("double").alias("years"), F.lit(None).cast("string").alias("level"), F.array().cast("array<string>").alias("evidence"), F.array().cast("array<string>").alias("evidence_types"), F.lit(0.9).alias("confidence"))
    given = profiles_of(spark, sf).withColumn("skills", F.array(skill("python3"), skill("Juggling"), skill("PYTHON")))
    done = reconciliation.enrich_skills(given, blocks_of(spark, sf), taxonomy.skill_table(spark))
    return split(done, "skills", "s").select("doc_id", F.col("s.canonical_name").alias("canonical"), F.array_join("s.evidence_types", ",").alias("types"))


#: Two blocks with the title and its year, and the company beside the first, beside the second, between them, nowhere on the sheet, or
#: with the second title on another page; the year of the entry is on none.
_PAGE = """stack(4, 1, 'Data Engineer 2020', 700D, 2, concat('Firm ', o_orderkey), CASE o_orderkey % 5 WHEN 0 THEN 702D WHEN 1 THEN 599D ELSE 650D END, 3, 'Data Engineer 2020', 600D, 4, 'and so on', 500D)"""


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 < 2 THEN 'BOUND_EXACT_CONTEXT_ROW' WHEN o_orderkey % 5 = 4 THEN 'BOUND_EXACT_CONTEXT' ELSE 'TITLE_AMBIGUOUS' END AS reason_code, CASE o_orderkey % 5 WHEN 0 THEN 'b1,b2' WHEN 1 THEN 'b2,b3' WHEN 4 THEN 'b1,b2' ELSE '' END AS refs FROM orders""")
def binding_by_row(spark, sf):
    """A title that stands twice: bound if its company lies in the row of one of them, or on the page of only one."""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS doc_id", "o_orderkey % 5 AS k", f"{_PAGE} AS (n, text, y)")
    rows = rows.selectExpr("doc_id", "CASE WHEN k = 4 AND n > 2 THEN 2 ELSE 1 END AS page_number", "concat('b', n) AS block_id", "n AS reading_order", "'text' AS block_type", "text", "CASE WHEN k <> 3 THEN y END AS y0", "CASE WHEN k <> 3 THEN y + 10 END AS y1")
    job = F.struct(F.lit("Data Engineer").alias("job_title"), F.concat(F.lit("Firm "), F.col("doc_id").cast("string")).alias("company"), F.lit(None).cast("string").alias("location"), F.lit(date(1999, 1, 1)).alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(None).cast("boolean").alias("is_current"), *(F.lit(None).cast("array<string>").alias(c) for c in ("description", "achievements", "skills")), document.no_evidence().alias("evidence"), F.lit(1.0).alias("confidence"))
    given = document.as_profiles(table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id")).withColumn("experiences", F.array(job.cast(document.EXPERIENCE))))
    bound = binding.bind(document.with_blocks(given, rows)).select("doc_id", F.get("binding", F.lit(0)).alias("b"))
    return bound.select("doc_id", "b.reason_code", F.array_join(F.array_sort(F.transform("b.evidence", lambda e: e["block_id"])), ",").alias("refs"))
