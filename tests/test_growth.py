"""What keeps a query's time and memory in step with its input."""

from __future__ import annotations

from folioforge.operators import taxonomy
from folioforge.plans import catalog


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_broadcast_to_meet_spellings(spark):
    plan = plan_of(catalog.QUERIES["skill_mentions"](spark, "/root/testdata/sf0.001"))
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    assert "size(split" not in plan and "size(filter(transform(filter(split" not in plan  # words are made once for each text


def test_all_ways_to_meet_spellings_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Machine Learning, machine learning; c++ and C. .NET"), (2, "apache spark"), (3, None), (4, "machine"), (5, "Amazon web. services")], "doc_id int, text string")

    def found():
        return sorted(map(tuple, taxonomy.skill_mentions(docs, taxonomy.skill_table(spark)).collect()))

    first = found()
    assert first == [(1, "C", 1), (1, "C++", 1), (1, "Machine Learning", 2), (2, "Spark", 2)]
    for in_plan, small in ((0, 200_000), (0, 0)):
        monkeypatch.setattr(taxonomy, "IN_PLAN", in_plan)
        monkeypatch.setattr(taxonomy, "SMALL", small)
        assert found() == first


def test_equal_intervals_are_one_island(spark):
    from folioforge.operators import timeline

    rows = spark.sql("SELECT id % 500 AS k, date_add(DATE '2000-01-01', cast(id div 500 div 3 * 100 AS int)) AS s, date_add(DATE '2000-01-01', cast(id div 500 div 3 * 100 + 30 AS int)) AS e FROM range(0, 6000, 1, 8)")
    done = timeline.merged_years(rows, key="k", start="s", end="e").drop("years").distinct()
    assert sorted(tuple(r)[1:] for r in done.collect()) == [(12, 4, 120)] * 500


def test_many_queries_are_multiplied_in_cells(spark, monkeypatch):
    from folioforge.operators import search

    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 5)
    monkeypatch.setattr(search, "BLOCK", 4)
    vectors = spark.range(60).selectExpr("id", "transform(sequence(0, 4), i -> double((id % 20 * 7 + i * i * 3) % 11 - 5)) AS v")  # each three times
    found = search.top_matches(vectors.where("id < 9").withColumnRenamed("id", "q"), vectors, id_col="id", vector_col="v", k=3, query_id="q", cells=4)
    assert "FlatMapCoGroupsInArrow" in plan_of(found)  # not one row for each pair
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {q: [i for i in range(60) if i % 20 % 11 == q][:3] for q in range(9)}


def test_arrays_are_not_made_twice_to_be_split(spark):
    for name in ("evidence_binding", "experience_validation", "project_validation"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Filter (size(" in line for line in plan.splitlines()), name


def test_blocks_are_read_after_they_are_dealt_to_tasks(spark):
    for name in ("binding_by_row", "education_recovery"):
        plan = plan_of(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Window" not in plan and "Broadcast" not in plan, name
        assert plan.index("regexp_replace") < plan.index("Exchange") and "regexp" not in plan[plan.index("Exchange") :], name  # the plan is printed from its end


def test_blocks_read_in_arrays_are_blocks_read_in_rows(spark):
    from pyspark.sql import functions as F

    from folioforge.operators import document

    texts = ["Robin", "WORK EXPERIENCE", " Data​  Engineer ", "2. Skills:", "a paper", None, "", "## Học vấn", "kỹ  năng", "x " * 50 + "experience", "My work\texperience --", "12)Projects", "Skillset", "experiences of", "İ skills", "naïve - Languages |"]
    rows = spark.createDataFrame([(d, 1 + i // 9, f"b{i}", i, "text", texts[(i * d) % len(texts)]) for d in (1, 3, 5) for i in range(16)], "doc_id int, page_number int, block_id string, reading_order int, block_type string, text string")
    columns = ["page_number", "reading_order", "block_id", "text", "clean", "low", "norm", "heading", "page_section", "section", "told"]
    a = document.annotate(rows).select("doc_id", *columns)
    b = document.with_blocks(rows.select("doc_id").distinct(), rows).select("doc_id", F.explode("blocks").alias("b")).select("doc_id", *(f"b.{c}" for c in columns))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.where("heading IS NOT NULL").count() == 24


def test_skills_of_documents_need_no_sets_and_one_shuffle(spark):
    from folioforge.operators import features

    rows = spark.sql("SELECT id % 50 AS doc_id, 1 AS page_number, concat('b', id) AS block_id, cast(id AS int) AS reading_order, 'text' AS block_type, CASE id div 50 WHEN 1 THEN 'WORK EXPERIENCE' WHEN 4 THEN 'PROJECTS' ELSE 'Go, Python' END AS text FROM range(300)")
    found = features.skill_types(rows, taxonomy.skill_table(spark))
    plan = plan_of(found)
    assert "collect_set" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert {(r.canonical, tuple(r.types)) for r in found.collect()} == {(c, ("listed", "project", "work_experience")) for c in ("Go", "Python")}


def test_roles_are_read_within_the_row_of_their_text(spark):
    from folioforge.operators import extract

    plan = plan_of(catalog.QUERIES["golden_experiences"](spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    text = "Robin\nWORK EXPERIENCE\nData Engineer | Firm 1\n2019 - 2020\n- Built it\nSenior Engineer\nFirm Ltd\n01/2020 - present\n2021 - 2019\nrun\nData Engineer | firm 1\n2019 - 2020\nRan it\nEDUCATION\n2001 - 2005\nExperience:\nCook\n03/2022 - 04/2022"
    found = {(r.entry, r.job_title, r.company, str(r.start_date), r.is_current, "|".join(r.description), r.warning) for r in extract.roles(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).collect()}
    assert found == {
        (1, "Data Engineer", "Firm 1", "2019-01-01", False, "Built it", None), (2, "Senior Engineer", "Firm Ltd", "2020-01-01", True, "", None), (3, "01/2020 - present", None, "2021-01-01", False, "run", "INVALID_TIMELINE"),
        (4, "Data Engineer", "firm 1", "2019-01-01", False, "Ran it", None), (5, "Cook", None, "2022-03-01", False, "", None),
    }


def test_entities_are_dealt_to_more_tasks_in_larger_tables(spark, monkeypatch):
    from folioforge.operators import evaluate

    gold = spark.sql("SELECT id % 40 AS doc_id, 'job' AS kind, concat('T', id % 3) AS title FROM range(120)")
    found = spark.sql("SELECT nullif(id % 40, 1) AS doc_id, 'job' AS kind, concat(' t', id % 2) AS title FROM range(80)")
    for rows, tasks in ((30, 7), (10, 20)):
        monkeypatch.setattr(evaluate, "ROWS_AT_ONCE", rows)
        done = evaluate.entity_report(gold, found)
        plan = plan_of(done)
        assert "Join" not in plan and f", {tasks}), REPARTITION_BY_NUM" in plan
        every = {(r.doc_id, r.kind): (r.true_positive, r.false_positive, r.false_negative) for r in done.where("level = 'all'").collect()}
        assert every == {(None, None): (39, 41, 81)}


def test_contents_are_answered_without_a_data_frame_each(spark, tmp_path):
    from folioforge.streaming import submissions

    spark.sql("SELECT cast(id % 30 AS string) AS sha256, id AS doc_id, timestamp_seconds(id) AS at FROM range(60)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("sha256 string, doc_id long, at timestamp").parquet(f"{tmp_path}/in")
    assert "InPandas" not in submissions.once(stream)._jdf.queryExecution().analyzed().toString()


def test_answers_are_dealt_to_tasks_before_they_are_repaired(spark):
    from folioforge.plans import answers

    assert "REPARTITION_BY_NUM" in plan_of(answers.answers(spark, "/root/testdata/sf0.001"))  # a file may be one task


def test_skills_are_enriched_in_more_tasks_for_larger_tables(spark, monkeypatch):
    from folioforge.operators import document, reconciliation

    skill = lambda n: (n, n, None, None, ["said"] if n == "python3" else [], [], 0.5)
    given = [(1, [*map(skill, ("python3", "Juggling", "PYTHON", None))]), (2, []), (3, [skill("Go")]), *((i, []) for i in range(4, 24))]
    profiles = spark.createDataFrame(given, f"doc_id int, skills array<{document.SKILL}>")
    told = [(1, "WORK EXPERIENCE"), (1, "Python  here"), (1, " "), (1, "PROJECTS"), (1, "juggling and sql"), (2, "Python"), (99, "Docker"), *((i, "SQL") for i in range(4, 24))]
    blocks = spark.createDataFrame([(d, 1, f"b{i}", i, "text", t) for i, (d, t) in enumerate(told)], "doc_id int, page_number int, block_id string, reading_order int, block_type string, text string")
    monkeypatch.setattr(reconciliation, "ROWS_AT_ONCE", 4, raising=False)
    done = reconciliation.enrich_skills(profiles, blocks, taxonomy.skill_table(spark))
    plan = plan_of(done)
    assert plan.count(", 13), REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") and "FullOuter" not in plan  # 27 blocks and 23 profiles; dealt once, never by block or skill
    every = {r.doc_id: [(s.name, s.canonical_name, s.evidence, s.evidence_types, s.confidence) for s in r.skills] for r in done.collect()}
    assert every.pop(1) == [("python3", "Python", ["said", "Python here"], ["work_experience"], 0.5), ("Juggling", "Juggling", [], ["project"], 0.5), (None, None, [], ["listed"], 0.5), ("SQL", "SQL", ["juggling and sql"], ["project", "work_experience"], 1.0)]
    assert every.pop(2) == [("Python", "Python", [], ["listed"], 1.0)] and every.pop(3) == [("Go", "Go", [], ["listed"], 0.5)]
    assert every == {i: [("SQL", "SQL", [], ["listed"], 1.0)] for i in range(4, 24)}


def test_orders_are_dealt_to_more_tasks_before_resumes_are_made_of_them(spark, monkeypatch):
    from folioforge.plans import resumes

    monkeypatch.setattr(resumes, "ORDERS_AT_ONCE", 100, raising=False)
    plan = plan_of(resumes.blocks_of(spark, "/root/testdata/sf0.001"))  # of 1,500 orders
    assert plan.count(", 15), REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") > 0


def test_missing_jobs_are_recovered_within_the_row_of_their_document(spark):
    from folioforge.operators import document, reconciliation

    told = ["Robin", "WORK EXPERIENCE", "Data Engineer | Firm 1", "2019 - 2020", "- Built it", "Cook at Inn", "03/2022 - 04/2022"]
    rows = spark.createDataFrame([(d, 1, f"b{i}", i, "text", t) for d in (1, 3, None) for i, t in enumerate(told) if d != 3 or i < 2], "doc_id int, page_number int, block_id string, reading_order int, block_type string, text string")
    given = document.as_profiles(spark.createDataFrame([(1,), (2,), (3,)], "doc_id int"))
    held = document.with_blocks(given, rows)
    done = reconciliation.recover_experiences(held)
    assert plan_of(done).count("Exchange") == plan_of(held).count("Exchange") and plan_of(done).count("Join") == plan_of(held).count("Join")
    for out in (done, reconciliation.recover_experiences(document.with_headings(given, rows))):
        got = {r.doc_id: ([(e.job_title, e.company, str(e.start_date), e.description) for e in r.experiences], r.missing_expected) for r in out.collect()}
        assert got == {1: ([("Data Engineer", "Firm 1", "2019-01-01", ["Built it"]), ("Cook", "Inn", "2022-03-01", [""])], True), 2: ([], False), 3: ([], True)}
