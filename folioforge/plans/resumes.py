"""Queries of binding, reconciliation and scoring over made-up resumes, a customer's orders told as jobs.

The resumes are SQL that both engines run, so the SQL of a query computes its rows from the same tables by joins where
the operator compares arrays within a row.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import binding, document, features, reconciliation, summary, taxonomy

from .catalog import query, table

AS_OF = date(2024, 6, 1)

#: All of a customer's orders, as jobs.
_JOBS = """j AS (SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS n,
  CASE o_orderkey % 4 WHEN 0 THEN 'Data Engineer' WHEN 1 THEN 'Backend Developer' WHEN 2 THEN 'Senior Data Engineer' ELSE 'Pastry Chef' END AS title,
  'Firm ' || (o_orderkey % 5) AS company, CAST(date_trunc('month', o_orderdate) AS DATE) AS started FROM orders)"""
#: Where the projects' heading stands, behind all jobs.
_LAST = 1_000_000
#: A resume's lines: name, heading, then title and year, company, and result of each job, and a project.
_BLOCKS = f"""{_JOBS}, d AS (SELECT DISTINCT doc_id FROM j), b AS (
  SELECT doc_id, 1 AS o, CASE WHEN doc_id % 9 = 0 THEN 'Resume 2024' ELSE 'Robin Example' END AS text FROM d
  UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 10 = 0 THEN 'Notes' ELSE 'WORK EXPERIENCE' END FROM d
  UNION ALL SELECT doc_id, 10 * n + 1, CASE WHEN k % 7 = 0 THEN 'Role withheld' ELSE title || ' | ' || year(started) || ' - present' END FROM j
  UNION ALL SELECT doc_id, 10 * n + 2, company || ', Example City' FROM j
  UNION ALL SELECT doc_id, 10 * n + 3, '- Reduced cost by ' || (k % 90 + 1) || '% with Python and Docker' FROM j
  UNION ALL SELECT doc_id, {_LAST}, 'PROJECTS' FROM d UNION ALL SELECT doc_id, {_LAST + 1}, 'Parser ' || doc_id || ', a tool in SQL' FROM d
)"""
#: References of a job: none, its title line, title and company, another text, its company alone.
_EVIDENCE = """e AS (SELECT doc_id, n, 10 * n + 1 AS o, title AS quote FROM j WHERE k % 5 IN (1, 2) UNION ALL SELECT doc_id, n, 10 * n + 2, company FROM j WHERE k % 5 IN (2, 4)
  UNION ALL SELECT doc_id, n, 10 * n + 1, 'Astronaut' FROM j WHERE k % 5 = 3)"""


#: Orders that one task makes resumes of, about.
ORDERS_AT_ONCE = 500_000


def _sql(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """`text` over orders, dealt by customer to as many tasks as there are rows for: what is made of an order is several times its size."""
    orders = table(spark, sf, "orders")
    tasks = max(-(-orders.count() // ORDERS_AT_ONCE), spark.sparkContext.defaultParallelism)
    return spark.sql(text.replace("FROM orders", "FROM {orders}"), orders=orders.repartition(tasks, "o_custkey"))


def split(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(doc_id, name): a row for each item of an array. Outer: else Spark asks for arrays that are not empty first of all, and makes
    them, with all that they are made of, a second time for that."""
    return rows.select("doc_id", F.explode_outer(column).alias(name)).where(F.col(name).isNotNull())


def blocks_of(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("text").isin("WORK EXPERIENCE", "PROJECTS"), "section_header").otherwise("text")
    rows = _sql(spark, sf, f"WITH {_BLOCKS} SELECT doc_id, 1 AS page_number, 'p1-b' || o AS block_id, CAST(o AS INTEGER) AS reading_order, text FROM b")
    return rows.withColumn("block_type", kind)


def profiles_of(spark: SparkSession, sf: str, *, cite: bool = True) -> DataFrame:
    """One profile a customer: jobs with their references (none without `cite`), a project, and a name that may be wrong."""
    jobs = _sql(spark, sf, f"WITH {_JOBS} SELECT * FROM j")
    cited = _sql(spark, sf, f"WITH {_JOBS}, {_EVIDENCE} SELECT * FROM e")
    one = F.struct("o", F.struct(F.col("quote").alias("text"), F.lit(1).alias("page_number"), F.concat(F.lit("p1-b"), F.col("o")).alias("block_id")).alias("r"))
    cited = cited.groupBy("doc_id", "n").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["r"]).alias("evidence"))
    rows = jobs.join(cited, ["doc_id", "n"], "left") if cite else jobs.withColumn("evidence", document.no_evidence())
    lines = F.array(F.concat(F.lit("Reduced cost by "), (F.col("k") % 90 + 1).cast("string"), F.lit("%")), F.lit("Kept things going"))
    empty = F.array().cast("array<string>")
    entry = F.struct(F.col("title").alias("job_title"), "company", F.lit(None).cast("string").alias("location"), F.col("started").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(True).alias("is_current"), lines.alias("description"), empty.alias("achievements"), empty.alias("skills"), F.coalesce("evidence", document.no_evidence()).alias("evidence"), F.lit(0.9).alias("confidence"))
    out = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", entry.cast(document.EXPERIENCE).alias("e")))), lambda x: x["e"]).alias("experiences"))
    quote = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Parser "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 2, "Compiler")
    held = F.when(quote.isNotNull() & F.lit(cite), F.array(F.struct(quote.alias("text"), F.lit(1).alias("page_number"), F.lit(f"p1-b{_LAST + 1}").alias("block_id")))).otherwise(document.no_evidence())
    project = F.struct(F.concat(F.lit("Parser "), F.col("doc_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("role"), empty.alias("description"), empty.alias("achievements"), empty.alias("skills"), F.lit(None).cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), held.alias("evidence"), F.lit(0.9).alias("confidence"))
    name = F.when(F.col("doc_id") % 4 == 0, "Robin Example").when(F.col("doc_id") % 4 == 1, "Hanoi, Vietnam").when(F.col("doc_id") % 4 == 3, "Alex Morgan")
    return document.as_profiles(out.withColumn("projects", F.array(project.cast(document.PROJECT))).withColumn("candidate_name", name))


_NORM = "regexp_replace(lower({}), '[^a-z0-9_]+', '', 'g')"
_BIND = f"""WITH {_BLOCKS}, nb AS (SELECT doc_id, o, text, {_NORM.format('text')} AS t FROM b),
x AS (SELECT doc_id, n, title, company, year(started) AS y, {_NORM.format('title')} AS tk, {_NORM.format('company')} AS ck FROM j),
a AS (SELECT x.*, o, t FROM x JOIN nb USING (doc_id) WHERE t = tk OR regexp_matches(CASE WHEN starts_with(t, tk) THEN substr(t, length(tk) + 1) ELSE t END, '^[0-9]') OR starts_with(t, ck || tk) OR starts_with(t, tk || ck)),
near AS (SELECT a.doc_id, n, a.o, nb.o AS p, contains(nb.t, ck) AND NOT contains(a.t, ck) AS is_c, contains(nb.t, '' || y) AND NOT contains(a.t, '' || y) AS is_y, contains(a.t, ck) OR contains(a.t, '' || y) AS own
  FROM a JOIN nb ON a.doc_id = nb.doc_id AND abs(nb.o - a.o) <= 4),
c AS (SELECT doc_id, n, o, list_distinct(list_concat([o], list(p ORDER BY p) FILTER (is_c), list(p ORDER BY p) FILTER (is_y))) AS refs FROM near GROUP BY doc_id, n, o HAVING bool_or(own OR is_c OR is_y)),
s AS (SELECT x.doc_id, x.n, x.title, x.company, (SELECT count(*) FROM a WHERE a.doc_id = x.doc_id AND a.n = x.n) AS anchors, (SELECT count(*) FROM c WHERE c.doc_id = x.doc_id AND c.n = x.n) AS cands,
  (SELECT any_value(refs) FROM c WHERE c.doc_id = x.doc_id AND c.n = x.n) AS refs FROM x)
SELECT doc_id, 'experience' AS kind, CAST(n - 1 AS INTEGER) AS entry, substr(sha256('experience' || chr(31) || title || chr(31) || company), 1, 16) AS fingerprint,
  CASE WHEN anchors = 0 THEN 'TITLE_NOT_FOUND_EXACT' WHEN cands = 0 THEN 'TITLE_WITHOUT_STRONG_CONTEXT' WHEN cands = 1 THEN 'BOUND_EXACT_CONTEXT' ELSE 'TITLE_AMBIGUOUS' END AS reason_code,
  CASE WHEN cands = 1 THEN list_reduce(list_concat([''], [CAST(z AS VARCHAR) FOR z IN list_sort(refs)]), lambda p, q: p || ',' || q) ELSE '' END AS refs FROM s
UNION ALL SELECT doc_id, 'project', 0, substr(sha256('project' || chr(31) || 'Parser ' || doc_id || chr(31)), 1, 16), 'BOUND_EXACT_UNIQUE', ',{_LAST + 1}' FROM d"""


@query(_BIND)
def evidence_binding(spark, sf):
    bound = binding.bind(document.with_blocks(profiles_of(spark, sf, cite=False), blocks_of(spark, sf)))
    rows = split(bound, "binding", "x")
    order = F.array_sort(F.transform("x.evidence", lambda e: F.regexp_replace(e["block_id"], "^p1-b", "").cast("int")))
    rows = rows.withColumn("_rows", F.concat_ws("", F.transform(order, lambda v: F.concat(F.lit(","), v.cast("string")))))
    return rows.select("doc_id", "x.kind", "x.entry", "x.fingerprint", "x.reason_code", F.col("_rows").alias("refs"))


_VERDICTS = f"""WITH {_BLOCKS}, {_EVIDENCE}, g AS (SELECT e.doc_id, e.n, bool_and(contains(b.text, e.quote)) AS ok, bool_or(contains(lower(e.quote), lower(title))) AS role, bool_or(contains(lower(e.quote), lower(company))) AS firm,
  bool_or(contains(e.quote, '' || year(started))) AS dated, count(*) AS refs FROM e JOIN b ON e.doc_id = b.doc_id AND e.o = b.o JOIN j ON e.doc_id = j.doc_id AND e.n = j.n GROUP BY e.doc_id, e.n),
i AS (SELECT j.doc_id, j.n, bool_or(b.o > 2 AND b.o < {_LAST} AND j.doc_id % 10 <> 0 AND (contains(lower(b.text), lower(title)) OR contains(lower(b.text), lower(company)))) AS inferred FROM j JOIN b USING (doc_id) GROUP BY j.doc_id, j.n),
v AS (SELECT j.doc_id, CAST(j.n - 1 AS INTEGER) AS entry, coalesce(ok, false) AS ok, coalesce(role, false) AS role, coalesce(firm, false) AS firm, coalesce(dated, false) AS dated, CAST(coalesce(refs, 0) AS INTEGER) AS refs, inferred FROM j LEFT JOIN g ON j.doc_id = g.doc_id AND j.n = g.n JOIN i ON j.doc_id = i.doc_id AND j.n = i.n),
t AS (SELECT *, CASE WHEN ok AND role THEN 1 WHEN inferred THEN 2 ELSE 0 END AS tier FROM v)"""


@query(_VERDICTS + """ SELECT doc_id, entry, refs AS "references", tier, CASE tier WHEN 1 THEN 'VERIFIED' WHEN 2 THEN 'SECTION_INFERRED' ELSE CASE WHEN NOT ok THEN 'EVIDENCE_NOT_GROUNDED' ELSE 'ROLE_NOT_SUPPORTED_BY_EVIDENCE' END END AS reason_code,
  CASE WHEN tier = 1 THEN concat_ws(',', CASE WHEN NOT firm THEN 'company' END, CASE WHEN NOT dated THEN 'startDate' END) ELSE '' END AS cleared FROM t""")
def experience_validation(spark, sf):
    seen = reconciliation.validate_experiences(document.with_blocks(profiles_of(spark, sf), blocks_of(spark, sf)))
    rows = split(seen, "experience_verdicts", "v")
    return rows.select("doc_id", "v.entry", "v.references", "v.tier", "v.reason_code", F.array_join("v.cleared", ",").alias("cleared"))


_STATUS = _VERDICTS + """, w AS (SELECT doc_id, bool_or(tier = 0) AS dropped, bool_or(tier = 2) AS inferred, sum(refs) AS refs, bool_or(refs > 0 AND NOT ok) AS bad, count(*) FILTER (tier > 0) AS kept FROM t GROUP BY doc_id)"""


#: A name that is a place is none; a placeholder or no name at all is replaced by the first line of two to five words of letters alone.
@query(_STATUS + r""", f AS (SELECT doc_id, arg_min(text, o) FILTER (regexp_full_match(replace(replace(text, ' ', ''), ',', ''), '\p{L}+') AND len(string_split(text, ' ')) BETWEEN 2 AND 5) AS line FROM b GROUP BY doc_id)
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Robin Example' WHEN 1 THEN NULL ELSE line END AS candidate_name,
  CASE WHEN doc_id % 4 = 1 OR dropped OR inferred OR doc_id % 3 <> 0 THEN 'manual_review' WHEN bad THEN 'partial' ELSE 'validated' END AS validation_status, doc_id % 3 = 0 AS has_project FROM w JOIN f USING (doc_id)""")
def profile_reconciliation(spark, sf):
    done = reconciliation.reconcile(profiles_of(spark, sf), blocks_of(spark, sf), taxonomy.skill_table(spark), provider="remote", as_of=AS_OF)
    return done.select("doc_id", "candidate_name", "validation_status", (F.size("projects") > 0).alias("has_project"))


@query(f"""WITH {_BLOCKS}, m AS (SELECT doc_id, o, text, CASE WHEN o >= {_LAST} THEN 'project' WHEN o >= 2 AND doc_id % 10 <> 0 THEN 'work' END AS s FROM b),
f AS (SELECT doc_id, avg(length(text)) FILTER (s IS NOT NULL) AS mean, count(DISTINCT CASE WHEN s IS NOT NULL AND contains(text, 'Reduced') THEN lower(text) END) AS achievements, CAST(count(DISTINCT s) AS INTEGER) AS n_sections, bool_or(text = 'Robin Example' OR text IN ('WORK EXPERIENCE', 'Role withheld')) AS has_identity, count(*) FILTER (contains(text, 'Python')) > 0 AS coded FROM m GROUP BY doc_id)
SELECT doc_id, round(least(100.0, 40 + mean), 9) AS description_score, achievements, n_sections, has_identity, false AS has_contact, CAST(3 AS INTEGER) AS n_skills FROM f""")
def document_features(spark, sf):
    found = features.document_features(blocks_of(spark, sf), taxonomy.skill_table(spark))
    return found.select("doc_id", F.round("description_score", 9).alias("description_score"), "achievements", "n_sections", "has_identity", "has_contact", "n_skills")


@query(f"""WITH {_BLOCKS}, m AS (SELECT doc_id, text, CASE WHEN o >= {_LAST} THEN 'project' WHEN o >= 2 AND doc_id % 10 <> 0 THEN 'work_experience' ELSE 'listed' END AS s FROM b), n(skill) AS (VALUES ('Python'), ('Docker'), ('SQL'))
SELECT doc_id, skill AS canonical, array_to_string(list_sort(list(DISTINCT s)), ',') AS types FROM m JOIN n ON contains(text, skill) GROUP BY doc_id, skill""")
def document_skills(spark, sf):
    return features.skill_types(blocks_of(spark, sf), taxonomy.skill_table(spark)).select("doc_id", "canonical", F.array_join("types", ",").alias("types"))


_YEARS = f"""WITH {_JOBS}, k AS (SELECT doc_id, min(started) AS a FROM j GROUP BY doc_id) SELECT doc_id, round((DATE '{AS_OF}' - a) / 365.25, 1) AS years FROM k"""


@query(_YEARS)
def profile_years(spark, sf):
    return profiles_of(spark, sf).select("doc_id", reconciliation.years_of(F.col("experiences"), AS_OF).alias("years"))


@query(f"WITH {_JOBS} SELECT doc_id, CAST(count(*) - count(DISTINCT company) AS INTEGER) AS n_merged FROM j GROUP BY doc_id")
def experience_merge_counts(spark, sf):
    return reconciliation.merge_experiences(profiles_of(spark, sf), as_of=AS_OF).select("doc_id", "n_merged")


@query(f"""WITH {_JOBS}, e AS (SELECT doc_id, string_agg(title || ' at ' || company || chr(10) || '- Reduced cost by ' || (k % 90 + 1) || '%' || chr(10) || '- Kept things going', chr(10) ORDER BY n) AS jobs FROM j GROUP BY doc_id)
SELECT doc_id, concat_ws(chr(10), '[CANDIDATE_PROFILE]', '', '[WORK_EXPERIENCE]', jobs, '', '[PROJECTS]', 'Parser ' || doc_id) AS text FROM e""")
def profile_text_tagged(spark, sf):
    """What the second encoder reads of each profile."""
    p = profiles_of(spark, sf)
    return p.select("doc_id", summary.tagged_text_of_profile(p).alias("text"))


#: Of a customer's jobs those of one company, in order: the first takes the others in, the last of them first.
_MERGED = f"""WITH {_JOBS}, f AS (SELECT *, CAST(min(n) OVER (PARTITION BY doc_id, company) AS INTEGER) AS head FROM j)"""


@query(f"""{_MERGED}, g AS (SELECT doc_id, head, company, list(title ORDER BY n) AS titles, min(started) AS started, list('Reduced cost by ' || (k % 90 + 1) || '%' ORDER BY n) AS told, count(*) AS parts FROM f GROUP BY ALL)
SELECT doc_id, company, CAST(started AS VARCHAR) AS started, true AS is_current, CAST(parts AS INTEGER) AS parts, CAST(len(list_distinct(told)) + 1 AS INTEGER) AS n_lines FROM g""")
def experience_merge_entries(spark, sf):
    """The merged entries themselves: one a company, from its first start, with all of their lines."""
    done = reconciliation.merge_experiences(profiles_of(spark, sf), as_of=AS_OF).select("doc_id", "experiences")
    done = split(done, "experiences", "e")
    parts = profiles_of(spark, sf).select("doc_id", F.explode("experiences").alias("x")).groupBy("doc_id", F.col("x.company").alias("c")).agg(F.count("*").cast("int").alias("parts"))
    rows = done.join(parts, (done["doc_id"] == parts["doc_id"]) & (F.col("e.company") == parts["c"])).drop(parts["doc_id"])
    return rows.select("doc_id", "e.company", F.col("e.start_date").cast("string").alias("started"), "e.is_current", "parts", F.size("e.description").alias("n_lines"))


@query(f"""WITH {_JOBS} SELECT doc_id, CAST(n - 1 AS INTEGER) AS entry, 'Reduced cost by ' || (k % 90 + 1) || '%' AS achievements, 'Kept things going' AS description FROM j""")
def entry_achievements(spark, sf):
    """Lines of every job, measured results apart."""
    tidy = reconciliation.tidy_entries(profiles_of(spark, sf)).select("doc_id", F.posexplode("experiences").alias("entry", "e"))
    return tidy.select("doc_id", "entry", F.array_join("e.achievements", "|").alias("achievements"), F.array_join("e.description", "|").alias("description"))


@query(f"""WITH {_JOBS}, d AS (SELECT DISTINCT doc_id FROM j) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'VERIFIED' ELSE 'EVIDENCE_NOT_GROUNDED' END AS reason_code, doc_id % 3 = 0 AS kept, CASE WHEN doc_id % 3 = 1 THEN 0 ELSE 1 END AS "references" FROM d""")
def project_validation(spark, sf):
    """Projects with a good reference, with one that their block does not hold, and with none."""
    seen = reconciliation.validate_projects(document.with_blocks(profiles_of(spark, sf), blocks_of(spark, sf)))
    rows = split(seen, "project_verdicts", "v")
    return rows.select("doc_id", "v.reason_code", (F.col("v.tier") > 0).alias("kept"), "v.references")


@query(f"""WITH {_BLOCKS}, m AS (SELECT doc_id, o, text, CASE WHEN o >= {_LAST} THEN 'project' WHEN o >= 2 AND doc_id % 10 <> 0 THEN 'work' END AS s FROM b)
SELECT doc_id, CAST(round((15 * CAST(bool_or(text = 'Robin Example' OR text IN ('WORK EXPERIENCE', 'Role withheld')) AS INTEGER) * 100 + 20 * 100 + 25 * CAST(bool_or(s IS NOT NULL) AS INTEGER) * 100 + 0) / (15 + 15 + 10 + 20 + 25 + 5), 2) AS DOUBLE) AS completeness_score FROM m GROUP BY doc_id""")
def completeness_scores(spark, sf):
    found = features.completeness(features.document_features(blocks_of(spark, sf), taxonomy.skill_table(spark)))
    return found.select("doc_id", F.round("completeness_score", 6).alias("completeness_score"))
