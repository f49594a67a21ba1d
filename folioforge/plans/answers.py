"""Queries over made-up answers of a language model, one for each order, spelled in every way that repair knows.

The answers are built from an order's number and date; the SQL says what should become of them from number and date alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import payloads

from .catalog import query, table

_D = "CAST(o_orderdate AS DATE)"
_X = "o_orderkey % 40 / CAST(10 AS DOUBLE)"
#: A date as people write it, by the order's number.
_LOOSE = f"""CASE o_orderkey % 9 WHEN 0 THEN date_format({_D}, 'MMMM yyyy') WHEN 1 THEN date_format({_D}, 'MM/yyyy') WHEN 2 THEN concat(year({_D}), ' - ', year({_D}) + 2) WHEN 3 THEN date_format({_D}, 'yyyy-MM-dd') WHEN 4 THEN 'Present'
  WHEN 5 THEN concat('tháng ', month({_D}), ' năm ', year({_D})) WHEN 6 THEN 'soon' WHEN 7 THEN concat(date_format({_D}, 'MMM yyyy'), ' – ', date_format(add_months({_D}, 14), 'MMM yyyy')) END"""
_END = "(o_orderkey % 2 = 0)"


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 9 AS k, {_END} AS e, {_D} AS d FROM orders)
SELECT id, CASE WHEN k IN (0, 1, 3, 5) THEN strftime(d, '%Y-%m-01') WHEN k = 2 THEN year(d) + CASE WHEN e THEN 2 ELSE 0 END || '-01-01' WHEN k = 4 AND NOT e THEN 'Present' WHEN k = 6 THEN 'soon'
  WHEN k = 7 THEN strftime(CASE WHEN e THEN d + INTERVAL 14 MONTH ELSE d END, '%Y-%m-01') END AS repaired FROM o""")
def json_repair_dates(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{_LOOSE} AS v", f"{_END} AS is_end")
    return payloads.with_dates(rows, "v", "is_end").select("id", "repaired")


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 3 THEN {_X} END AS gpa, CASE o_orderkey % 5 WHEN 0 THEN 4.0::DOUBLE WHEN 2 THEN 10.0::DOUBLE END AS scale FROM orders")
def gpa_parse(spark, sf):
    said = f"CASE o_orderkey % 5 WHEN 0 THEN concat({_X}, '/4') WHEN 1 THEN concat('GPA ', {_X}) WHEN 2 THEN concat({_X}, ' of 10') WHEN 3 THEN 'good' END"
    return payloads.with_grades(table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{said} AS v"), "v").select("id", "gpa", "scale")


_TITLE = "CASE o_orderkey % 3 WHEN 0 THEN 'Data Engineer' WHEN 1 THEN 'Cook' ELSE 'Editor' END"
#: Jobs: other names, dates that open, close, span years and stand reversed, an empty title, references with and without a block.
_JOB = f"""CASE o_orderkey % 5
  WHEN 0 THEN concat('{{"role": "', {_TITLE}, '", "employer": "Firm ', o_orderkey % 7, '", "startDate": "', date_format({_D}, 'MMMM yyyy'), '", "endDate": "present", "responsibilities": "Kept things going", "evidence": {{"quote": "x", "page": 1, "block": "b', o_orderkey, '"}}}}')
  WHEN 1 THEN concat('{{"position": "', {_TITLE}, '", "organization": "Firm ', o_orderkey % 7, '", "startDate": "', date_format({_D}, 'MM/yyyy'), '", "endDate": "', date_format(add_months({_D}, 14), 'MM/yyyy'), '", "description": ["Built it", null, {{"value": "Ran it"}}, 7], "evidence": [{{"text": "x", "pageNumber": 1}}, {{"text": "y", "pageNumber": 2, "block_id": "c"}}]}}')
  WHEN 2 THEN concat('{{"jobTitle": "", "company": "Firm ', o_orderkey % 7, '", "description": "Backend services", "startDate": "', year({_D}), ' - ', year({_D}) + 1, '", "endDate": "', year({_D}), ' - ', year({_D}) + 1, '", "notes": "gone"}}')
  WHEN 3 THEN concat('{{"title": "', {_TITLE}, '", "companyName": "Firm ', o_orderkey % 7, '", "startDate": "', date_format(add_months({_D}, 14), 'yyyy-MM-dd'), '", "endDate": "', date_format({_D}, 'yyyy-MM-dd'), '", "techStack": ["SQL", ""]}}')
  ELSE concat('{{"jobTitle": "', {_TITLE}, '", "job": "ignored", "company": "Firm ', o_orderkey % 7, '", "startDate": "tháng ', month({_D}), ' năm ', year({_D}), '", "ongoing": "now", "isCurrent": false, "endDate": "soon"}}') END"""
_SCHOOL = f"""concat('{{"school": "School ', o_orderkey % 11, '", "major": "Art", "details": "Drawing", "gpa": ', CASE o_orderkey % 4 WHEN 0 THEN concat('"', {_X}, '/4"') WHEN 1 THEN cast({_X} AS string) WHEN 2 THEN concat('{{"score": ', {_X}, ', "outOf": 10}}') ELSE '"good"' END, '}}')"""
_ANSWER = f"""CASE o_orderkey % 13 WHEN 12 THEN CASE o_orderkey % 6 WHEN 0 THEN 'no JSON' WHEN 1 THEN repeat('null, ', 9) WHEN 2 THEN '[1]' WHEN 3 THEN ' ' WHEN 4 THEN NULL ELSE '{{"a": 1, "b": ' END
  ELSE concat(CASE WHEN o_orderkey % 2 = 0 THEN '```json\n' ELSE '' END, '{{"candidateName": "N', o_orderkey, '", "experiences": [', {_JOB}, ', null], "education": [', {_SCHOOL}, '], "skills": ["Go", " ", {{"tool": "Rust"}}, 5, {{"level": "x"}}], "languages": ["en", null, {{"language": "fr"}}], "extra": ', o_orderkey, ', "honorsAwards": []}}', CASE WHEN o_orderkey % 2 = 0 THEN '\n```' ELSE '' END) END"""


def answers(spark, sf):
    # orders are few bytes and repairing an answer is much work: they are dealt to tasks first, a number that is not joined to fewer
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").repartition(tasks, "o_orderkey").selectExpr("o_orderkey AS id", f"{_ANSWER} AS response")


_EXPECTED = f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, o_orderkey % 4 AS g, {_TITLE} AS title, {_D} AS d, {_X} AS x, CASE WHEN o_orderkey % 13 = 12 THEN CASE o_orderkey % 6 WHEN 0 THEN 'INVALID_JSON' WHEN 1 THEN 'DEGENERATE' WHEN 2 THEN 'NOT_AN_OBJECT' WHEN 5 THEN 'INVALID_JSON' ELSE 'EMPTY' END END AS repair_error FROM orders)"""


@query(_EXPECTED + """ SELECT id, repair_error, CASE WHEN repair_error IS NULL THEN CASE WHEN k = 2 THEN 'Backend Developer' ELSE title END END AS job_title, CASE WHEN repair_error IS NULL THEN 'Firm ' || id % 7 END AS company,
  CASE WHEN repair_error IS NULL THEN CASE WHEN k = 2 THEN year(d) || '-01-01' ELSE strftime(d, '%Y-%m-01') END END AS started, CASE WHEN repair_error IS NULL THEN CASE WHEN k IN (1, 3) THEN strftime(d + INTERVAL 14 MONTH, '%Y-%m-01') WHEN k = 2 THEN year(d) + 1 || '-01-01' END END AS ended,
  CASE WHEN repair_error IS NULL AND k IN (0, 4) THEN true END AS is_current, CASE WHEN repair_error IS NULL THEN CASE k WHEN 0 THEN 'Kept things going' WHEN 1 THEN 'Built it|Ran it|7' WHEN 2 THEN 'Backend services' ELSE '' END END AS description,
  CASE WHEN repair_error IS NULL THEN CASE WHEN k = 3 THEN 'SQL|' ELSE '' END END AS used, CASE WHEN repair_error IS NULL THEN CASE k WHEN 0 THEN 'b' || id WHEN 1 THEN 'c' END END AS refs,
  CASE WHEN repair_error IS NULL THEN 'School ' || id % 11 || '|Art|Drawing' END AS school, CASE WHEN repair_error IS NULL AND g < 3 THEN x END AS gpa, CASE WHEN repair_error IS NULL THEN CASE g WHEN 0 THEN 4.0::DOUBLE WHEN 2 THEN 10.0::DOUBLE END END AS scale,
  CASE WHEN repair_error IS NULL THEN 'Go,Rust' END AS skills, CASE WHEN repair_error IS NULL THEN 'en,fr' END AS languages, CASE WHEN repair_error IS NULL THEN id END AS extra FROM o""")
def payload_repair(spark, sf):
    done = payloads.repair(answers(spark, sf))
    job = "struct<jobTitle:string,company:string,startDate:string,endDate:string,isCurrent:boolean,description:array<string>,skills:array<string>,evidence:array<struct<blockId:string>>>"
    school = "struct<institution:string,fieldOfStudy:string,coursework:array<string>,gpa:struct<value:double,scale:double>>"
    at = lambda path, kind: F.try_variant_get("repaired", path, kind)
    rows = done.withColumn("j", at("$.experiences[0]", job)).withColumn("s", at("$.education[0]", school))
    return rows.select(
        "id", "repair_error", F.col("j.jobTitle").alias("job_title"), "j.company", F.col("j.startDate").alias("started"), F.col("j.endDate").alias("ended"), F.col("j.isCurrent").alias("is_current"),
        F.array_join("j.description", "|").alias("description"), F.array_join("j.skills", "|").alias("used"), F.array_join(F.transform("j.evidence", lambda e: e["blockId"]), ",").alias("refs"),
        F.when(F.col("s").isNotNull(), F.concat_ws("|", "s.institution", "s.fieldOfStudy", F.array_join("s.coursework", "|"))).alias("school"), F.col("s.gpa.value").alias("gpa"), F.col("s.gpa.scale").alias("scale"),
        F.array_join(F.transform(at("$.skills", "array<struct<name:string>>"), lambda x: x["name"]), ",").alias("skills"), F.array_join(at("$.languages", "array<string>"), ",").alias("languages"), at("$.extra", "bigint").alias("extra"),
    )


@query(_EXPECTED + """ SELECT id, CASE WHEN repair_error IS NULL THEN 1 END AS jobs, CASE WHEN repair_error IS NULL THEN CASE WHEN k < 2 THEN 1 ELSE 0 END END AS jobs_with_evidence, CASE WHEN repair_error IS NULL THEN 1 END AS schools,
  CASE WHEN repair_error IS NULL THEN substr(sha256('experiences' || chr(31) || lower(CASE WHEN k = 2 THEN 'Backend Developer' ELSE title END) || chr(31) || 'firm ' || id % 7), 1, 16) END AS signature,
  CASE WHEN repair_error IS NULL THEN CAST(id % 2 AS INTEGER) END AS lost FROM o""")
def answer_signatures(spark, sf):
    """What an answer holds, and what a correction that forgets every other job has lost."""
    done = payloads.repair(answers(spark, sf)).where("id IS NOT NULL")
    after = F.when(F.col("id") % 2 == 1, F.to_variant_object(F.map_filter(payloads.fields(F.col("repaired")), lambda k, _: k != "experiences"))).otherwise(F.col("repaired"))
    rows = done.withColumn("c", payloads.counts(F.col("repaired"))).withColumn("marks", payloads.signatures(F.col("repaired"))).withColumn("after", after)
    known = F.col("repaired").isNotNull()
    return rows.select(
        "id", F.when(known, F.col("c.experiences.entities")).alias("jobs"), F.when(known, F.col("c.experiences.with_evidence")).alias("jobs_with_evidence"), F.when(known, F.col("c.education.entities")).alias("schools"),
        F.when(known, F.array_join("marks", ",")).alias("signature"), F.when(known, F.size(payloads.lost(F.col("repaired"), F.col("after"), marks=F.col("marks")))).alias("lost"),
    )
