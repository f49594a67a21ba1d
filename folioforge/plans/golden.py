"""Queries of extraction, taxonomy, evidence, layout and scoring over rows made from orders and line items.

Inputs are built from numbers, dates and spellings picked by number; the SQL works out from the same numbers what should
become of them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import evaluate, evidence, extract, features, layout, reconcile, scoring, sections, summary, taxonomy

from .catalog import query, quoted, table, values

AS_OF = date(2024, 6, 1)
_D = "CAST(o_orderdate AS DATE)"


def orders(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*columns)


def picked(texts: list[str | None], number: str) -> str:
    """SQL of Spark: the text of `texts` that a number picks."""
    return f"element_at(array({', '.join(quoted(t) for t in texts)}), cast({number} % {len(texts)} AS int) + 1)"


# ---- headings, skills, titles, places, achievements

_ALIASES = [a for a, _ in sections.ALIASES] + ["order of the day", "long walks", "notes"]
_HEADING = f"CASE o_orderkey div 7 % 6 WHEN 0 THEN a WHEN 1 THEN concat(upper(a), ':') WHEN 2 THEN concat('## ', a) WHEN 3 THEN concat(o_orderkey % 90 + 1, '. ', a) WHEN 4 THEN concat('• ', a, ' •') ELSE concat(a, ' of ', o_orderkey) END"


@query(f"SELECT o_orderkey AS id, k AS kind FROM orders LEFT JOIN (VALUES {values([(i, k) for i, (_, k) in enumerate(sections.ALIASES)])}) v(i, k) ON i = o_orderkey % {len(_ALIASES)}")
def heading_kind(spark, sf):
    """Every heading in six spellings, and lines that open nothing."""
    rows = orders(spark, sf, "o_orderkey", f"{picked(_ALIASES, 'o_orderkey')} AS a").selectExpr("o_orderkey AS id", f"{_HEADING} AS line")
    return rows.select("id", sections.heading_kind(F.col("line")).alias("kind"))


_SPELLED = [(a, c) for c, names in taxonomy.SKILLS.items() for a in dict.fromkeys((*names, c.lower()))] + [("fortran", None), ("cobol", None)]
_NAME = "CASE o_orderkey % 3 WHEN 0 THEN a WHEN 1 THEN concat(' ', upper(a), ' ') ELSE concat(initcap(a), ' ') END"


@query(f"SELECT o_orderkey AS id, coalesce(c, trim(CASE o_orderkey % 3 WHEN 0 THEN a WHEN 1 THEN upper(a) ELSE upper(a[1]) || a[2:] END)) AS canonical FROM orders JOIN (VALUES {values([(i, a, c) for i, (a, c) in enumerate(_SPELLED)])}) v(i, a, c) ON i = o_orderkey % {len(_SPELLED)}")
def canonical_skills(spark, sf):
    rows = orders(spark, sf, "o_orderkey", f"{picked([a for a, _ in _SPELLED], 'o_orderkey')} AS a").selectExpr("o_orderkey AS id", f"{_NAME} AS name")
    return taxonomy.canonical_skills(rows, taxonomy.skill_table(spark)).select("id", "canonical")


_MENTION = ["Python and C++ with react.js; I go to work. ", "k8s, Amazon Web Services. Machine  learning! ", "pythonic, sqlite, cbc. ", "CV: computer vision, R; ", "nothing at all, "]
_FOUND = [(0, "Python", 1), (0, "C++", 1), (0, "React", 1), (0, "Go", 1), (1, "Kubernetes", 1), (1, "AWS", 1), (1, "Machine Learning", 0), (3, "Computer Vision", 2), (3, "R", 1)]


@query(f"SELECT o_orderkey AS doc_id, c AS canonical, n * (o_orderkey % 4 + 1) AS mentions FROM orders JOIN (VALUES {values([f for f in _FOUND if f[2]])}) v(i, c, n) ON i = o_orderkey % {len(_MENTION)}")
def skill_mentions(spark, sf):
    """Texts that say the same one to four times over; words of which skills are only parts are none."""
    rows = orders(spark, sf, "o_orderkey AS doc_id", f"repeat({picked(_MENTION, 'o_orderkey')}, cast(o_orderkey % 4 + 1 AS int)) AS text")
    return taxonomy.skill_mentions(rows, taxonomy.skill_table(spark))


_TITLES = [(a, k, r) for r, (k, names) in enumerate(taxonomy.JOB_TITLES.items()) for a in names]
_TITLED = [*(a for a, _, _ in _TITLES), "chef", "backend developers"]


@query(f"""WITH t AS (SELECT o_orderkey AS id, ' senior ' || a || ' at firm ' || o_orderkey || ' ' AS t FROM orders JOIN (VALUES {values(list(enumerate(_TITLED)))}) v(i, a) ON i = o_orderkey % {len(_TITLED)}),
f AS (SELECT id, k, min(r) AS r FROM t JOIN (VALUES {values(_TITLES)}) v(alias, k, r) ON contains(t, ' ' || alias || ' ') GROUP BY id, k)
SELECT id, coalesce(string_agg(k, ',' ORDER BY r), '') AS titles FROM t LEFT JOIN f USING (id) GROUP BY id""")
def job_titles(spark, sf):
    rows = orders(spark, sf, "o_orderkey AS id", f"concat('Senior ', initcap({picked(_TITLED, 'o_orderkey')}), ' at Firm ', o_orderkey) AS t")
    return rows.select("id", F.array_join(taxonomy.job_titles(F.col("t")), ",").alias("titles"))


_PLACES = [(v, k) for k, vs in taxonomy.PROVINCES.items() for v in vs]
_PLACED = [*(v for v, _ in _PLACES), "Berlin", "Hanoian", ""]


@query(f"""WITH t AS (SELECT o_orderkey AS id, CASE WHEN a = '' THEN '' ELSE '  ' || o_orderkey || ' ' || a || ' street ' END AS t FROM orders JOIN (VALUES {values(list(enumerate(_PLACED)))}) v(i, a) ON i = o_orderkey % {len(_PLACED)}),
f AS (SELECT id, arg_max(k, length(s)) AS k FROM t JOIN (VALUES {values(_PLACES)}) v(s, k) ON contains(lower(replace(t, '.', ' ')), ' ' || lower(replace(s, '.', ' ')) || ' ') GROUP BY id)
SELECT id, coalesce(k, nullif(trim(t), '')) AS place FROM t LEFT JOIN f USING (id)""")
def locations(spark, sf):
    a = picked(_PLACED, "o_orderkey")
    rows = orders(spark, sf, "o_orderkey AS id", f"CASE WHEN {a} = '' THEN '' ELSE concat('  ', o_orderkey, ' ', {a}, ' street ') END AS t")
    return rows.select("id", taxonomy.province(F.col("t")).alias("place"))


_LINE = """CASE o_orderkey % 8 WHEN 0 THEN concat('Reduced cost by ', o_orderkey % 90 + 1, '%') WHEN 1 THEN concat('Reduced cost by ', o_orderkey % 9, '.5%') WHEN 2 THEN concat('Processed ', o_orderkey % 50 + 1, 'M events') WHEN 3 THEN concat('Built in ', 1990 + o_orderkey % 30)
  WHEN 4 THEN concat('Managed ', o_orderkey % 99 + 1, ' people') WHEN 5 THEN concat('Likes tea ', o_orderkey) WHEN 6 THEN concat('Improved ', o_orderkey % 7 + 1, ' pages in 2020') ELSE concat('Giảm chi phí ', o_orderkey % 80 + 10, ' %') END"""


@query("SELECT o_orderkey AS id, o_orderkey % 8 IN (0, 2, 4, 7) AS achievement FROM orders")
def achievement_split(spark, sf):
    """Results with a quantity, of any number, against versions, years and mere facts."""
    return orders(spark, sf, "o_orderkey AS id", f"{_LINE} AS line").select("id", reconcile.is_achievement(F.col("line")).alias("achievement"))


# ---- resumes of all orders of a customer

_NAMES = ("ROBIN EXAMPLE", "KIM SAMPLE", "ALEX TEST PERSON")
_DEGREES = ("Bachelor of Computer Science", "Master of Data", "Engineer in Art")
_STARTED = f"date_trunc('month', {_D})"


def resumes(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text): one resume a customer, its orders as jobs, every third of them still going on."""
    job = f"concat(CASE o_orderkey % 2 WHEN 0 THEN concat('Data Engineer | Firm ', o_orderkey) ELSE concat('Backend Developer at Firm ', o_orderkey) END, '\\n', date_format({_D}, 'MM/yyyy'), ' - ', CASE WHEN o_orderkey % 3 = 0 THEN 'present' ELSE date_format(add_months({_STARTED}, 14), 'MM/yyyy') END, '\\n- Reduced cost by ', o_orderkey % 90 + 1, '%')"
    rows = orders(spark, sf, "o_custkey AS doc_id", "o_orderkey", f"{job} AS job").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "job"))), lambda x: x["job"]), "\n").alias("jobs"))
    name, degree = picked(list(_NAMES), "doc_id"), picked(list(_DEGREES), "doc_id")
    return rows.selectExpr("doc_id", f"""concat({name}, '\\nEmail: Robin', doc_id, '@example.com | Phone: +84 912 ', lpad(doc_id % 1000, 3, '0'), ' 111\\nAddress: ', doc_id, ' Sample Street, Ha Noi\\n\\nSUMMARY\\nBuilds data platforms. Likes tidy pipelines.\\n\\nSKILLS\\nPython, SQL, Docker\\n',
      CASE WHEN doc_id % 2 = 0 THEN 'PostgreSQL; Go' ELSE 'Kafka; Airflow' END, '\\n\\nWORK EXPERIENCE\\n', jobs, '\\n\\nEDUCATION\\nExample University ', doc_id, '\\n', {degree}, '\\n09/', 2000 + doc_id % 15, ' - 06/', 2004 + doc_id % 15, '\\n\\nLANGUAGES\\nEnglish, Vietnamese') AS text""")


@query("""WITH c AS (SELECT o_custkey AS doc_id, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT doc_id, CAST(i AS INTEGER) AS section_id, s AS section, CAST(a + b * n AS INTEGER) AS start_line, CAST(d + e * n AS INTEGER) AS end_line FROM c, (VALUES (0, 'header', 1, 0, 4, 0), (1, 'summary', 5, 0, 7, 0), (2, 'skills', 8, 0, 11, 0), (3, 'experience', 12, 0, 13, 3), (4, 'education', 14, 3, 18, 3), (5, 'languages', 19, 3, 20, 3)) v(i, s, a, b, d, e)""")
def section_ranges(spark, sf):
    return sections.detect_sections(resumes(spark, sf)).select("doc_id", "section_id", "section", "start_line", "end_line")


_JOBS = f"SELECT o_custkey AS doc_id, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS entry, CASE o_orderkey % 2 WHEN 0 THEN 'Data Engineer' ELSE 'Backend Developer' END AS job_title, 'Firm ' || o_orderkey AS company, CAST({_STARTED} AS DATE) AS s, CASE WHEN o_orderkey % 3 <> 0 THEN CAST({_STARTED} + INTERVAL 14 MONTH AS DATE) END AS e FROM orders"


@query(f"SELECT doc_id, entry, job_title, company, CAST(s AS VARCHAR) AS start_date, CAST(e AS VARCHAR) AS end_date, e IS NULL AS is_current, 'Reduced cost by ' || o_orderkey % 90 + 1 || '%' AS description FROM ({_JOBS})".replace("'Reduced cost by ' || o_orderkey % 90 + 1 || '%'", "'Reduced cost by ' || (o_orderkey % 90 + 1) || '%'"))
def golden_experiences(spark, sf):
    return extract.experiences(resumes(spark, sf)).withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})


@query(f"""SELECT DISTINCT o_custkey AS doc_id, 'Example University ' || o_custkey AS institution, d AS degree, f AS field_of_study, (2000 + o_custkey % 15) || '-09-01' AS start_date, (2004 + o_custkey % 15) || '-06-01' AS end_date
FROM orders JOIN (VALUES {values([(i, d, d.split(' of ')[-1].split(' in ')[-1]) for i, d in enumerate(_DEGREES)])}) v(i, d, f) ON i = o_custkey % 3""")
def golden_education(spark, sf):
    return extract.education(resumes(spark, sf)).withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})


@query(f"""WITH j AS (SELECT doc_id, s, coalesce(e, DATE '{AS_OF}') AS e FROM ({_JOBS})), r AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM j),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r), g AS (SELECT doc_id, island, max(e) - min(s) AS days, count(*) AS n FROM i GROUP BY ALL),
y AS (SELECT doc_id, round(sum(days) / 365.25, 1) AS years, CAST(sum(n) AS BIGINT) AS n_jobs FROM g GROUP BY doc_id)
SELECT doc_id, name AS candidate_name, 'robin' || doc_id || '@example.com' AS email, '+84 912 ' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || ' 111' AS phone, CASE WHEN doc_id % 2 = 0 THEN 'Docker, Go, PostgreSQL, Python, SQL' ELSE 'Airflow, Docker, Kafka, Python, SQL' END AS skills, n_jobs, CAST(1 AS BIGINT) AS n_schools, CAST(years AS DOUBLE) AS years
FROM y JOIN (VALUES {values(list(enumerate(_NAMES)))}) v(i, name) ON i = doc_id % 3""")
def golden_profile(spark, sf):
    p = extract.profiles(resumes(spark, sf), taxonomy.skill_table(spark), as_of=AS_OF)
    return p.select("doc_id", "candidate_name", "email", "phone", "skills", "n_jobs", "n_schools", "years")


_ROLES = f"""stack(2, 1, CASE o_orderkey % 5 WHEN 0 THEN 'Data Engineer' WHEN 1 THEN 'Chef' WHEN 2 THEN 'Developer' WHEN 3 THEN 'Tester' ELSE 'A' END, CASE WHEN o_orderkey % 5 < 4 THEN concat('Acme ', o_custkey) END,
  CASE WHEN o_orderkey % 5 < 3 THEN {_D} END, CASE WHEN o_orderkey % 5 < 3 THEN date_add({_D}, 365) END,
  2, CASE o_orderkey % 5 WHEN 0 THEN 'Senior Data Scientist' WHEN 1 THEN 'Chef' WHEN 2 THEN 'Senior Developer' WHEN 3 THEN 'Lead Tester' ELSE 'A' END, CASE WHEN o_orderkey % 5 < 4 THEN concat('ACME ', o_custkey, ' ') END,
  CASE o_orderkey % 5 WHEN 0 THEN {_D} WHEN 1 THEN date_add({_D}, 400) WHEN 2 THEN date_add({_D}, 31) WHEN 3 THEN {_D} END, CASE o_orderkey % 5 WHEN 0 THEN date_add({_D}, 365) WHEN 1 THEN date_add({_D}, 800) WHEN 2 THEN date_add({_D}, 396) END)"""


@query("""SELECT o_orderkey AS doc_id, CAST(e AS INTEGER) AS entry, t AS job_title, CAST(m AS INTEGER) AS merged FROM orders JOIN (VALUES (0, 1, 'Data Engineer / Senior Data Scientist', 2), (1, 1, 'Chef', 1), (1, 2, 'Chef', 1), (2, 1, 'Senior Developer', 2), (3, 1, 'Lead Tester', 2), (4, 1, 'A', 1), (4, 2, 'A', 1)) v(k, e, t, m) ON k = o_orderkey % 5""")
def experience_dedup(spark, sf):
    rows = orders(spark, sf, "o_orderkey AS doc_id", f"{_ROLES} AS (entry, job_title, company, start_date, end_date)")
    return reconcile.merge_roles(rows, as_of=AS_OF).select("doc_id", "entry", "job_title", "merged")


# ---- evidence and layout

_BLOCK = "concat('Order ', o_orderkey, ' of  ', o_orderpriority, ' for customer ', o_custkey)"
_CLAIM = f"""CASE o_orderkey % 8 WHEN 0 THEN concat('Order ', o_orderkey) WHEN 1 THEN concat('order ', o_orderkey) WHEN 2 THEN concat(' of ', o_orderpriority, '\\t') WHEN 3 THEN '' WHEN 5 THEN concat('customer ', o_custkey) WHEN 6 THEN concat('customer ', o_custkey, '0') WHEN 7 THEN concat('Order\\u200b ', o_orderkey) END"""


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'p1-b1' WHEN 1 THEN 'p1-b2' ELSE 'p1-b9' END AS block_id, o_orderkey % 3 < 2 AND o_orderkey % 7 <> 0 AND o_orderkey % 8 IN (0, 2, 5, 7) AS grounded FROM orders""")
def evidence_claims(spark, sf):
    """Quotes in any spelling, of blocks that are there or are not, and of wrong pages."""
    claims = orders(spark, sf, "o_orderkey AS id", "o_orderkey AS doc_id", "CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS page_number", "CASE o_orderkey % 3 WHEN 0 THEN 'p1-b1' WHEN 1 THEN 'p1-b2' ELSE 'p1-b9' END AS block_id", f"{_CLAIM} AS quote")
    held = orders(spark, sf, "o_orderkey AS doc_id", "1 AS page_number", f"stack(2, 'p1-b1', {_BLOCK}, 'p1-b2', concat({_BLOCK}, ' again')) AS (block_id, text)")
    return evidence.grounded(claims, held).select("id", "block_id", "grounded")


_BOX = "l_orderkey AS doc_id, l_linenumber AS n, l_quantity AS a0, l_quantity + 10 * l_linenumber AS a1, CASE WHEN l_linenumber < 6 THEN 500 * l_tax END AS b0, 500 * l_tax + 100 * l_discount AS b1"


@query(f"SELECT doc_id, n, CASE WHEN b0 IS NOT NULL AND least(a1, b1) - greatest(a0, b0) > 0 AND least(a1 - a0, b1 - b0) > 0 THEN round((least(a1, b1) - greatest(a0, b0)) / least(a1 - a0, b1 - b0), 6) ELSE 0 END AS overlap FROM (SELECT {_BOX} FROM lineitem)")
def bbox_overlap(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(*_BOX.split(", "))
    return rows.select("doc_id", "n", F.round(evidence.box_overlap(*(F.col(c) for c in ("a0", "a1", "b0", "b1"))), 6).alias("overlap"))


_PAGE = [(50.0, 700.0), (320.0, 705.0), (50.0, 650.0), (320.0, 640.0), (55.0, 600.0), (325.0, 596.0), (50.0, 500.0)]


@query("SELECT o_orderkey AS doc_id, 'p1-b' || i AS block_id, CASE WHEN o_orderkey % 3 = 0 THEN 'SINGLE' WHEN i % 2 = 1 THEN 'LEFT' ELSE 'RIGHT' END AS side, CAST((i + 1) // 2 AS INTEGER) AS row FROM orders, range(1, 8) t(i)")
def two_column_rows(spark, sf):
    """A page for each order, wherever it lies on the sheet; every third has one column."""
    boxes = ", ".join(f"{i}, CASE WHEN o_orderkey % 3 = 0 THEN 50D ELSE {x}D END, {y}D" for i, (x, y) in enumerate(_PAGE, 1))
    rows = orders(spark, sf, "o_orderkey AS doc_id", "o_orderkey % 40 AS dx", "o_orderkey % 17 * 30 AS dy", f"stack({len(_PAGE)}, {boxes}) AS (i, x, y)")
    rows = rows.selectExpr("doc_id", "1 AS page_number", "concat('p1-b', i) AS block_id", "x + dx AS x0", "y + dy AS y0", "x + dx + 100 AS x1", "y + dy + 10 AS y1", "cast(i AS int) AS reading_order")
    return layout.place(rows).select("doc_id", "block_id", "side", "row")


_BITS = [f"o_orderkey // {1 << i} % 2 = 1" for i in range(7)]


def bits(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    return orders(spark, sf, "o_orderkey AS id", *(f"o_orderkey div {1 << i} % 2 = 1 AS {n}" for i, n in enumerate(names)))


@query(f"""SELECT id, CAST(CASE WHEN g AND r AND NOT p THEN 1 WHEN i THEN 2 ELSE 0 END AS INTEGER) AS tier, CASE WHEN g AND r AND NOT p THEN 'VERIFIED' WHEN i THEN 'SECTION_INFERRED' WHEN NOT g THEN 'EVIDENCE_NOT_GROUNDED' WHEN NOT r THEN 'ROLE_NOT_SUPPORTED_BY_EVIDENCE' ELSE 'PROJECT_ONLY_EVIDENCE' END AS reason_code
FROM (SELECT o_orderkey AS id, {_BITS[0]} AS g, {_BITS[1]} AS r, {_BITS[2]} AS p, {_BITS[3]} AS i FROM orders)""")
def reconcile_tiers(spark, sf):
    return evidence.tiers(bits(spark, sf, "grounded", "role_supported", "project_only", "section_inferred")).select("id", "tier", "reason_code")


@query(f"SELECT o_orderkey AS id, CASE WHEN NOT ({_BITS[0]}) OR {_BITS[1]} OR {_BITS[2]} OR {_BITS[3]} OR {_BITS[4]} THEN 'manual_review' WHEN {_BITS[5]} OR {_BITS[6]} THEN 'partial' ELSE 'validated' END AS status FROM orders")
def profile_status(spark, sf):
    return evidence.status(bits(spark, sf, *"usable name_is_place name_ungrounded dropped inferred local_provider partial_evidence".split())).select("id", "status")


# ---- scores, summaries, evaluation

_SCHOOL = "CASE o_orderkey % 4 WHEN 0 THEN 'Đại học Bách Khoa' WHEN 1 THEN 'Town College' WHEN 2 THEN 'FPT University' END"
_RUBRIC = f"o_orderkey % 5 AS d, o_orderkey % 3 AS f, o_orderkey % 90 / CAST(10 AS DOUBLE) AS years, CAST(o_orderkey % 3 AS INTEGER) AS n_jobs, CAST(o_orderkey % 11 AS INTEGER) AS n, {_SCHOOL} AS institution"


@query(f"""WITH r AS (SELECT o_orderkey AS id, {_RUBRIC}, o_orderkey % 2 AS adv, o_orderkey % 7 AS p FROM orders), s AS (SELECT *,
  CASE WHEN institution IS NULL THEN 5.0 WHEN d IN (1, 2) OR (institution <> 'Town College' AND (f = 0 OR d = 0)) THEN 14.0 ELSE 11.5 END AS education_score,
  CASE WHEN years >= 4 THEN least(40.0, 32.0 + (years - 4) * 1.5) WHEN years >= 1 THEN 20.0 + (years - 1) * 3.8 WHEN years > 0 OR n_jobs > 0 THEN 14.0 ELSE 5.0 END AS w,
  CASE WHEN n = 0 THEN 5.0 WHEN n >= 8 AND adv = 1 THEN 27.5 WHEN n >= 4 THEN 20.0 ELSE 12.0 END AS skill_score, CASE WHEN p = 0 THEN 0.0 WHEN p IN (1, 2) THEN 13.0 ELSE 8.0 END AS certificate_score FROM r)
SELECT id, CAST(education_score AS DOUBLE) AS education_score, CAST(round(w + 1e-9, 1) AS DOUBLE) AS experience_score, CAST(skill_score AS DOUBLE) AS skill_score, CAST(certificate_score AS DOUBLE) AS certificate_score,
  CAST(round(least(100.0, education_score + round(w + 1e-9, 1) + skill_score + certificate_score), 1) AS DOUBLE) AS total_score FROM s""")
def rubric_scores(spark, sf):
    degree = "CASE o_orderkey % 5 WHEN 0 THEN 'Computer Engineer' WHEN 1 THEN 'Master' WHEN 2 THEN 'Tiến sĩ' WHEN 3 THEN 'Bachelor' END"
    skills = "transform(filter(sequence(0, cast(o_orderkey % 11 AS int)), i -> i > 0), i -> CASE WHEN i = 1 AND o_orderkey % 2 = 1 THEN 'Docker' ELSE concat('skill ', i) END)"
    papers = "CASE o_orderkey % 7 WHEN 0 THEN cast(array() AS array<string>) WHEN 1 THEN array('IELTS 7') WHEN 2 THEN array('Safety', 'AWS Certified') ELSE array('Safety') END"
    rows = orders(spark, sf, "o_orderkey AS id", f"{_SCHOOL} AS institution", f"{degree} AS degree", "CASE o_orderkey % 3 WHEN 0 THEN 'Computer Science' WHEN 1 THEN 'Art' END AS field", "o_orderkey % 90 / 10D AS years", "cast(o_orderkey % 3 AS int) AS n_jobs", f"{skills} AS skills", f"{papers} AS certificates")
    return scoring.rubric(rows).select("id", "education_score", "experience_score", "skill_score", "certificate_score", "total_score")


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 20 / CAST(2 AS DOUBLE) AS y, CAST(o_orderkey % 7 AS INTEGER) AS n, CAST(o_orderkey % 3 AS INTEGER) AS c, CASE WHEN o_orderkey % 4 > 0 THEN 'Person ' || o_custkey END AS name, CASE WHEN o_orderkey % 5 > 1 THEN 'Engineer' END AS headline, CASE WHEN o_orderkey % 6 > 1 THEN 'School ' || o_custkey END AS school FROM orders),
t AS (SELECT *, concat_ws(' and ', 'works as ' || headline, CASE WHEN id % 5 <> 4 THEN 'has ' || CASE WHEN y = floor(y) THEN CAST(CAST(y AS INTEGER) AS VARCHAR) ELSE CAST(y AS VARCHAR) END || ' years of recorded experience' END) AS a,
  concat_ws(' and ', CASE WHEN n > 0 THEN 'lists skills in ' || array_to_string(list_transform(range(1, least(n, 5) + 1), lambda i: 'S' || i), ', ') END, 'records education at ' || school, CASE WHEN c > 0 THEN 'includes ' || c || ' certification(s)' END) AS b FROM r)
SELECT id, CASE WHEN id % 10 = 9 THEN 'Writes data services for hospital ' || id || '. Enjoys careful reviews.' ELSE coalesce(name, 'The candidate') || CASE WHEN a = '' THEN ' is the candidate represented by the extracted profile.' ELSE ' ' || a || '.' END || ' ' || CASE WHEN b = '' THEN 'No structured skills, education, or certifications were extracted.' ELSE 'The profile ' || b || '.' END END AS summary_text, id % 10 = 9 AS reused FROM t""")
def summary_template(spark, sf):
    """Every combination of what is known; own summaries are kept only without contact data and in two or three sentences."""
    own = "CASE o_orderkey % 10 WHEN 9 THEN concat('Writes data services for hospital ', o_orderkey, '. Enjoys careful reviews.') WHEN 8 THEN concat('Write to robin', o_orderkey, '@example.com. I answer every letter that comes.') WHEN 7 THEN 'One. Two. Three. Four sentences are too many for this place.' WHEN 6 THEN 'Too short.' END"
    rows = orders(spark, sf, "o_orderkey AS id", "CASE WHEN o_orderkey % 4 > 0 THEN concat('Person ', o_custkey) END AS name", "CASE WHEN o_orderkey % 5 > 1 THEN 'Engineer' END AS headline", "CASE WHEN o_orderkey % 5 <> 4 THEN o_orderkey % 20 / 2D END AS years", "transform(filter(sequence(0, cast(o_orderkey % 7 AS int)), i -> i > 0), i -> concat('S', i)) AS skills", "CASE WHEN o_orderkey % 6 > 1 THEN concat('School ', o_custkey) END AS institution", "cast(o_orderkey % 3 AS int) AS n_certificates", f"{own} AS summary")
    return summary.summarize(rows).select("id", "summary_text", "reused")


@query("""SELECT o_orderkey AS id, sha256(concat_ws(chr(10), CASE WHEN o_orderkey % 3 > 0 THEN 'Headline: Engineer ' || o_custkey END, CASE WHEN o_orderkey % 4 > 0 THEN 'Skills: Python, SQL' || o_orderkey % 5 END, 'Experience: Editor; Cook ' || o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Education: School ' || o_custkey END)) AS hash FROM orders""")
def profile_text_hash(spark, sf):
    rows = orders(spark, sf, "o_orderkey AS id", "CASE WHEN o_orderkey % 3 > 0 THEN concat('Engineer ', o_custkey) ELSE '' END AS h", "CASE WHEN o_orderkey % 4 > 0 THEN array('Python', concat('SQL', o_orderkey % 5), 'Python') ELSE cast(array() AS array<string>) END AS s", "array('Editor', concat('Cook ', o_custkey)) AS j", "CASE WHEN o_orderkey % 2 = 0 THEN array(concat('School ', o_custkey)) ELSE cast(array() AS array<string>) END AS e")
    return rows.select("id", F.sha2(summary.profile_text(F.col("h"), F.col("s"), F.col("j"), F.col("e")), 256).alias("hash"))


_REVIEW = "CASE WHEN l_returnflag = 'N' THEN 'correct' ELSE 'wrong' END"


@query(f"""WITH r AS (SELECT {_REVIEW} AS v, ['b' || l_linenumber, 'c' || l_partkey % 5] AS b, CASE WHEN l_linenumber % 3 = 0 THEN [] WHEN l_linenumber % 3 = 1 THEN ['b' || l_linenumber] ELSE ['c1', 'c2', 'b9'] END AS c FROM lineitem),
n AS (SELECT v, len(b) AS b, len(c) AS c, len(list_intersect(b, c)) AS h FROM r)
SELECT round(count(*) FILTER (v = 'correct') / count(*), 9) AS entity_precision, round(sum(h) / sum(b), 9) AS block_precision, round(sum(h) / sum(c), 9) AS block_recall FROM n""")
def binding_metrics(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(f"{_REVIEW} AS verdict", "array(concat('b', l_linenumber), concat('c', l_partkey % 5)) AS bound", "CASE WHEN l_linenumber % 3 = 0 THEN cast(array() AS array<string>) WHEN l_linenumber % 3 = 1 THEN array(concat('b', l_linenumber)) ELSE array('c1', 'c2', 'b9') END AS correct")
    return evaluate.block_metrics(rows).select(*(F.round(c, 9).alias(c) for c in ("entity_precision", "block_precision", "block_recall")))


_KNOWN = "CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 101 AS DOUBLE) END AS description_score, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 3 * CAST(50 AS DOUBLE) END AS skill_evidence, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS timeline_ok, o_orderkey % 4 AS achievements, o_orderkey % 6 AS n_sections, CASE o_orderkey % 4 WHEN 0 THEN 'validated' WHEN 1 THEN 'partial' WHEN 2 THEN 'manual_review' ELSE 'validated' END AS status"


@query(f"""WITH k AS (SELECT o_orderkey AS id, {_KNOWN} FROM orders), w AS (SELECT *, (description_score IS NOT NULL)::INTEGER AS a, (skill_evidence IS NOT NULL)::INTEGER AS b, (timeline_ok IS NOT NULL)::INTEGER AS c FROM k),
q AS (SELECT *, (coalesce(30 * description_score, 0) + coalesce(25 * skill_evidence, 0) + 20 * least(100, achievements * 50) + coalesce(15 * CASE WHEN timeline_ok THEN 100 ELSE 0 END * c, 0) + 10 * n_sections * 20) / (30 * a + 25 * b + 20 + 15 * c + 10) AS q FROM w)
SELECT id, CASE WHEN status <> 'manual_review' THEN round(q + 1e-9, 2) END AS quality_score, CASE status WHEN 'manual_review' THEN 0.25 WHEN 'partial' THEN round((a + b + c + 2) / 5 * 0.7 + 1e-9, 2) ELSE round((a + b + c + 2) / 5, 2) END AS confidence FROM q""")
def quality_scores(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS id", *(c.strip() for c in _KNOWN.replace(", CASE", ";CASE").replace(", o_", ";o_").split(";")))
    done = features.quality(rows)
    return done.select("id", F.round("quality_score", 6).alias("quality_score"), F.round("confidence", 6).alias("confidence"))
