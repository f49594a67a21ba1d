"""Edge cases of headings, titles, places, claims, roles and scores, typed in."""

from datetime import date

from pyspark.sql import functions as F

from folioforge.operators import evidence, features, layout, reconcile, scoring, summary, taxonomy
from folioforge.operators.sections import heading_kind

AS_OF = date(2024, 6, 1)


def column(spark, rows, schema, **named):
    df = spark.createDataFrame(rows, schema)
    return {r.id: r.x for r in df.select("id", named["x"].alias("x")).collect()}


def test_headings(spark):
    lines = [(1, "KỸ NĂNG", "skills"), (2, "Work Experience:", "experience"), (3, "## Education", "education"), (4, "3. Projects", "projects"), (5, "Experience in Python", "experience"), (6, "AWS certification", "certifications"), (7, "I like long walks", None), (8, "• Ngoại ngữ •", "languages"), (9, "Work Experience Contact", "experience"), (10, "Summary of " + "a very " * 10 + "long line", None), (11, "2) Học vấn", "education"), (12, "CAREER OBJECTIVE", "summary"), (13, None, None), (14, "", None)]
    assert column(spark, [x[:2] for x in lines], "id int, line string", x=heading_kind(F.col("line"))) == {i: k for i, _, k in lines}


def test_titles_and_places(spark):
    titles = {1: "Senior Backend Developer", 2: "SRE at Example", 3: "Chef", 4: "Kỹ sư dữ liệu"}
    assert column(spark, list(titles.items()), "id int, t string", x=F.array_join(taxonomy.job_titles(F.col("t")), ",")) == {1: "Backend Developer,Software Engineer", 2: "DevOps Engineer", 3: "", 4: "Data Engineer"}
    places = {1: "Quận 1, TP.HCM", 2: "12 Hà Nội street", 3: " Berlin ", 4: "", 5: "thành phố Huế"}
    assert column(spark, list(places.items()), "id int, t string", x=taxonomy.province(F.col("t"))) == {1: "Hồ Chí Minh", 2: "Hà Nội", 3: "Berlin", 4: None, 5: "Thừa Thiên Huế"}


def test_claims(spark):
    claims = [(1, 1, 1, "p1-b1", "Data Engineer"), (2, 1, 1, "p1-b1", "data engineer"), (3, 1, 1, "p1-b9", "Data"), (4, 1, 2, "p1-b1", "Data"), (5, 1, 1, "p1-b2", " Acme "), (6, 1, 1, "p1-b1", ""), (7, 1, 1, "p1-b1", None), (8, 1, 1, "p1-b3", "Senior Data"), (9, 1, 1, "p1-b3", "Senior  Data ")]
    held = spark.createDataFrame([(1, 1, "p1-b1", "Senior Data Engineer"), (1, 1, "p1-b2", "at Acme"), (1, 1, "p1-b3", "Senior  Data​  Chief")], "doc_id long, page_number int, block_id string, text string")
    rows = evidence.grounded(spark.createDataFrame(claims, "id int, doc_id long, page_number int, block_id string, quote string"), held)
    assert {r.id for r in rows.where("grounded").collect()} == {1, 5, 8, 9}


def test_roles_told_twice(spark):
    d = date
    roles = [(1, 1, "Data Engineer", "Acme", d(2020, 1, 1), d(2022, 1, 1)), (1, 2, "Senior Data Scientist", "ACME ", d(2020, 1, 1), d(2022, 1, 1)), (2, 1, "Chef", "Inn", d(2019, 1, 1), d(2020, 1, 1)), (2, 2, "Chef", "Inn", d(2021, 1, 1), d(2022, 1, 1)), (3, 1, "Developer", "Acme", d(2020, 1, 1), d(2021, 1, 1)), (3, 2, "Senior Developer", "Acme", d(2020, 2, 1), d(2021, 2, 1)), (4, 1, "Tester", "Acme", None, None), (4, 2, "Lead Tester", "Acme", d(2020, 1, 1), None), (5, 1, "A", None, None, None), (5, 2, "A", None, None, None)]
    out = reconcile.merge_roles(spark.createDataFrame(roles, "doc_id long, entry int, job_title string, company string, start_date date, end_date date"), as_of=AS_OF).collect()
    assert sorted((r.doc_id, r.entry, r.job_title, r.merged) for r in out) == [(1, 1, "Data Engineer / Senior Data Scientist", 2), (2, 1, "Chef", 1), (2, 2, "Chef", 1), (3, 1, "Senior Developer", 2), (4, 1, "Lead Tester", 2), (5, 1, "A", 1), (5, 2, "A", 1)]


def test_columns_of_a_page(spark):
    boxes = [(1, 1, f"p1-b{i}", x, y, x + 100, y + 10, i) for i, (x, y) in enumerate([(50.0, 700.0), (320.0, 705.0), (50.0, 650.0), (320.0, 640.0), (55.0, 600.0), (325.0, 596.0), (50.0, 500.0)], 1)]
    out = layout.place(spark.createDataFrame(boxes, "doc_id long, page_number int, block_id string, x0 double, y0 double, x1 double, y1 double, reading_order int")).collect()
    assert sorted((r.block_id, r.side, r.row) for r in out) == [("p1-b1", "LEFT", 1), ("p1-b2", "RIGHT", 1), ("p1-b3", "LEFT", 2), ("p1-b4", "RIGHT", 2), ("p1-b5", "LEFT", 3), ("p1-b6", "RIGHT", 3), ("p1-b7", "LEFT", 4)]


def test_achievements(spark):
    lines = [(1, "Reduced cost by 30%", True), (2, "Reduced cost by 12.5%", False), (3, "Processed 1.2M events", True), (4, "Built in 2020", False), (5, "Managed 12 people", True), (6, "Likes tea", False)]
    assert column(spark, [x[:2] for x in lines], "id int, line string", x=reconcile.is_achievement(F.col("line"))) == {i: a for i, _, a in lines}


def test_scores(spark):
    rubric = [(1, "Bách Khoa", "Bachelor", "Computer Science", 5.0, 2, ["Python", "AWS", "a", "b", "c", "d", "e", "f"], ["IELTS 7"]), (2, None, None, None, None, 0, [], []), (3, "Town College", "Master", None, 1.5, 1, ["a", "b", "c", "d"], ["Safety"]), (4, "Town College", None, None, 0.5, 1, ["x"], None)]
    rows = scoring.rubric(spark.createDataFrame(rubric, "id int, institution string, degree string, field string, years double, n_jobs int, skills array<string>, certificates array<string>")).collect()
    assert {r.id: (r.education_score, r.experience_score, r.skill_score, r.certificate_score, r.total_score) for r in rows} == {1: (14.0, 33.5, 27.5, 13.0, 88.0), 2: (5.0, 5.0, 5.0, 0.0, 15.0), 3: (14.0, 21.9, 20.0, 8.0, 63.9), 4: (11.5, 14.0, 12.0, 0.0, 37.5)}
    known = [(1, 80.0, 100.0, True, 2, 5, "validated"), (2, None, None, None, 0, 1, "partial"), (3, 100.0, 100.0, True, 2, 5, "manual_review"), (4, 40.0, 40.0, False, 1, 3, "validated")]
    rows = features.quality(spark.createDataFrame(known, "id int, description_score double, skill_evidence double, timeline_ok boolean, achievements long, n_sections int, status string")).collect()
    assert {r.id: (r.quality_score, r.confidence) for r in rows} == {1: (94.0, 1.0), 2: (6.67, 0.28), 3: (None, 0.25), 4: (38.0, 1.0)}


def test_summaries(spark):
    rows = [(1, "Robin", "Engineer", 6.0, ["Python", "SQL"], "Example University", 2, None), (2, None, None, None, [], None, 0, None), (3, "Kim", None, 2.5, [], None, 0, "Writes data services for hospitals. Enjoys careful reviews.")]
    out = summary.summarize(spark.createDataFrame(rows, "id int, name string, headline string, years double, skills array<string>, institution string, n_certificates int, summary string")).collect()
    assert {r.id: (r.summary_text, r.reused) for r in out} == {
        1: ("Robin works as Engineer and has 6 years of recorded experience. The profile lists skills in Python, SQL and records education at Example University and includes 2 certification(s).", False),
        2: ("The candidate is the candidate represented by the extracted profile. No structured skills, education, or certifications were extracted.", False),
        3: ("Writes data services for hospitals. Enjoys careful reviews.", True),
    }
