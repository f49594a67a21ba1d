"""Binding, reconciliation, exchange, publishing and whole runs on small inputs."""

import io
import json
import zipfile
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioforge import jobs
from folioforge.operators import binding, blocks, document, evaluate, exchange, extract, features, identity, layout, privacy, publish, reconciliation, reports, search, summary, taxonomy
from folioforge.sources import artifacts, files
from folioforge.streaming import callbacks, ingest

AS_OF = date(2024, 6, 1)


def blocks_of(spark, lines, boxes=None):
    rows = [(1, 1, f"p1-b{i}", "text", t, i, *(boxes or {}).get(i, (None, None))) for i, t in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "doc_id long, page_number int, block_id string, block_type string, text string, reading_order int, y0 double, y1 double")


def job(title=None, company=None, start=None, end=None, evidence=(), **more):
    return {"job_title": title, "company": company, "location": None, "start_date": start, "end_date": end, "is_current": False, "description": [], "achievements": [], "skills": [], "evidence": [dict(zip(("text", "page_number", "block_id"), e)) for e in evidence], "confidence": 0.9} | more


def profile_of(spark, **fields):
    names = {k: v for k, v in document.PROFILE.items() if k in fields}
    return document.as_profiles(spark.createDataFrame([(1, *(fields[n] for n in names))], ", ".join(["doc_id long", *(f"{n} {k}" for n, k in names.items())])))


def bound(spark, lines, entry, boxes=None, **more):
    row = binding.bind(document.with_blocks(profile_of(spark, experiences=[entry] if entry else [], **more), blocks_of(spark, lines, boxes))).first()
    return row.binding[0].reason_code, [e.block_id for e in row.binding[0].evidence], row


def test_binding_reasons(spark):
    assert bound(spark, ["Northstar Labs", "Platform Engineer | 2022 - Present"], job("Platform Engineer", "Northstar Labs", date(2022, 1, 1)))[:2] == ("BOUND_EXACT_CONTEXT", ["p1-b2", "p1-b1"])
    assert bound(spark, ["Platform Engineer"], job("Platform Engineer"))[:2] == ("TITLE_WITHOUT_STRONG_CONTEXT", [])
    two = ["Version 1 | Senior Data Engineer | 2024 - Present", "Version 1 | Data Engineer | 2020 - 2023"]
    assert bound(spark, two, job("Data Engineer", "Version 1", date(2020, 1, 1)))[:2] == ("BOUND_EXACT_CONTEXT", ["p1-b2"])
    assert bound(spark, ["nothing here"], job("Data Engineer", "X"))[0] == "TITLE_NOT_FOUND_EXACT"
    rows = ["Data Engineer", "Acme", "filler one", "filler two", "filler six", "filler seven", "Data Engineer", "Acme"]
    assert bound(spark, rows, job("Data Engineer", "Acme"))[0] == "TITLE_AMBIGUOUS"
    boxes = {1: (100.0, 110.0), 2: (300.0, 310.0), 7: (50.0, 60.0), 8: (51.0, 61.0)}
    assert bound(spark, rows, job("Data Engineer", "Acme"), boxes)[:2] == ("BOUND_EXACT_CONTEXT_ROW", ["p1-b7", "p1-b8"])
    project = {"title": "Ray Tracer", "role": None, "description": [], "achievements": [], "skills": [], "start_date": date(2021, 5, 1), "end_date": None, "evidence": [], "confidence": 1.0}
    assert bound(spark, ["The Ray-Tracer"], None, projects=[project])[:2] == ("BOUND_EXACT_UNIQUE", ["p1-b1"])
    assert bound(spark, ["Ray Tracer", "Ray Tracer"], None, projects=[project])[0] == "TITLE_AMBIGUOUS"
    held = job("Data Engineer", "Acme", evidence=[("own", 1, "p1-b9")])
    assert [e.text for e in bound(spark, ["Data Engineer", "Acme"], held)[2].experiences[0].evidence] == ["own"]  # never replaced


def reconciled(spark, lines, provider="remote", **fields):
    return reconciliation.reconcile(profile_of(spark, **fields), blocks_of(spark, lines), taxonomy.skill_table(spark), provider=provider, as_of=AS_OF).first()


LINES = ["Kim Example", "WORK EXPERIENCE", "Data Engineer at Acme, 2020 - 2022", "Reduced cost by 30% with Python over many long evenings", "EDUCATION", "Town University", "Graduated in Applied Physics", "PROJECTS", "Ray Tracer in Rust"]


def test_reconcile(spark):
    good = job("Data Engineer", "Acme", date(2020, 1, 1), date(2022, 1, 1), [("Data Engineer at Acme, 2020 - 2022", 1, "p1-b3")], location="Mars", description=["Reduced cost by 30%", "kept\tcalm"])
    tracer = {"title": "Ray Tracer", "role": None, "description": [], "achievements": [], "skills": [], "start_date": date(2019, 1, 1), "end_date": None, "evidence": [dict(text="Ray Tracer", page_number=1, block_id="p1-b9")], "confidence": 1.0}
    r = reconciled(spark, LINES, experiences=[good], projects=[tracer], headline="Kim Example", candidate_name="kim example", field_evidence={"candidateName": [dict(text="Kim Example", page_number=1, block_id="p1-b1")]})
    assert r.validation_status == "validated" and r.candidate_name == "Kim Example" and r.headline is None and r.total_experience_years == 2.0
    e = r.experiences[0]
    assert (e.company, e.location, e.description, e.achievements) == ("Acme", None, ["kept calm"], ["Reduced cost by 30%"]) and r.issues == ["AMBIGUOUS_ENTRY_ATTACHMENT"]
    assert r.projects[0].start_date is None and [(s.institution, s.field_of_study) for s in r.education] == [("Town University", "Applied Physics")]
    assert {s.canonical_name: s.evidence_types for s in r.skills} == {"Python": ["work_experience"]}
    assert [(d.kind, d.tier, d.reason_code) for d in r.dispositions] == [("experience", 1, "VERIFIED"), ("project", 1, "VERIFIED")]
    bad = reconciled(spark, LINES, experiences=[job("Astronaut", "Nasa")], projects=[tracer])
    assert bad.validation_status == "manual_review" and {"UNSUPPORTED_EXPERIENCE_CLAIM", "MISSING_EXPECTED_SECTION_ENTITIES"} <= set(bad.issues)
    seen = reconciled(spark, LINES, experiences=[job("Data Engineer", "Acme")], projects=[tracer])
    assert seen.validation_status == "manual_review" and seen.dispositions[0].tier == 2 and seen.issues == ["EVIDENCE_SECTION_INFERRED"]
    place = reconciled(spark, LINES, experiences=[good], projects=[tracer], candidate_name="Hanoi")
    assert place.candidate_name is None and place.validation_status == "manual_review"
    part = reconciled(spark, LINES, experiences=[good | {"evidence": good["evidence"]}], projects=[tracer], education=[{"institution": "U", "degree": None, "field_of_study": None, "location": None, "start_date": None, "end_date": None, "coursework": [" a ", ""], "evidence": [dict(text="no", page_number=1, block_id="p1-b1")], "confidence": 1.0}])
    assert part.validation_status == "partial" and part.education[0].coursework == ["a"] and part.candidate_name == "Kim Example"
    lost = reconciled(spark, ["Kim Example", "WORK EXPERIENCE", "Cook | Inn", "01/2020 - 01/2022", "Cooked for many people every single day of the week, and then some more"], experiences=[])
    assert [(x.job_title, x.company) for x in lost.experiences] == [("Cook", "Inn")] and lost.validation_status == "partial"
    none = reconciliation.reconcile(profile_of(spark).limit(0), blocks_of(spark, LINES).limit(0), taxonomy.skill_table(spark), provider="remote", as_of=AS_OF)
    assert none.count() == 0


def test_merging(spark):
    a = job("Data Engineer", "Acme", date(2020, 1, 1), date(2021, 1, 1), [("x", 1, "b1")], description=["one"], confidence=0.5)
    b = job("Senior Data Engineer", "ACME ", date(2020, 1, 1), None, [("y", 1, "b1"), ("z", 1, "b2")], description=["one", "two"], is_current=True)
    c = job("Chef", "Inn", date(2020, 1, 1), date(2021, 1, 1))
    d = job("Waiter", "Inn", date(2020, 2, 1), date(2021, 2, 1))
    r = reconciliation.merge_experiences(profile_of(spark, experiences=[a, b, c, d]), as_of=AS_OF).first()
    assert r.n_merged == 1 and [e.job_title for e in r.experiences] == ["Senior Data Engineer", "Chef", "Waiter"]
    m = r.experiences[0]
    assert (m.end_date, m.is_current, m.description, [e.block_id for e in m.evidence], m.confidence) == (None, True, ["one", "two"], ["b1", "b2"], 0.5)


def test_features_and_scores(spark):
    f = features.completeness(features.document_features(blocks_of(spark, [*LINES, "ann@x.org"]), taxonomy.skill_table(spark))).first()
    assert (f.achievements, f.has_identity, f.has_contact, f.has_education, f.has_summary) == (1, True, True, True, False)
    assert f.missing_groups == ["professionalSummary", "additional"] and 0 < f.completeness_score < 100
    p = features.profile_features(profile_of(spark, experiences=[job("a", description=["x" * 20, " "], achievements=["Reduced cost by 5%", "nice"]), job("b")])).first()
    assert (p.description_score, p.achievements) == (30.0, 1)
    base = features.document_features(blocks_of(spark, LINES), taxonomy.skill_table(spark)).withColumn("timeline_ok", F.lit(True)).withColumn("status", F.lit("validated"))
    more = base.withColumn("candidate_name", F.lit("X")).withColumn("email", F.lit("a@b.c")).withColumn("date_of_birth", F.lit("1990"))
    assert features.quality(base).first().quality_score == features.quality(more).first().quality_score  # sensitive fields weigh nothing
    two = features.document_features(blocks_of(spark, [t.replace("30%", "30 %") for t in LINES]), taxonomy.skill_table(spark)).first()
    assert two.feature_hash != f.feature_hash and len(two.feature_hash) == 64


RESUME = "KIM EXAMPLE\nEngineer of things\nkim@Example.org\nDate of birth: 31/12/1990\n\nSUMMARY\nBuilds things.\n\nSKILLS\nPython (5 years, expert), Go\n\nLANGUAGES\nEnglish, French; english\n\nCERTIFICATIONS\nSafety | First aid\n\nEXPERIENCE\nCook | Inn\n05/2020 - present\nServed 200 people\nWaiter\n2019 - 2018\n"


def test_rule_profiles(spark):
    docs = spark.createDataFrame([(1, RESUME), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in extract.profiles(docs, taxonomy.skill_table(spark), as_of=AS_OF).collect()}
    p = got[1]
    assert (p.candidate_name, p.email, p.date_of_birth, p.headline, p.summary) == ("KIM EXAMPLE", "kim@example.org", date(1990, 12, 31), "Engineer of things", "Builds things.")
    assert p.languages == ["English", "French"] and p.certifications == ["Safety", "First aid"] and p.field_confidence["candidateName"] == 0.95 and p.warnings == ["INVALID_TIMELINE"]
    python = next(s for s in p.skill_details if s.canonical_name == "Python")
    assert (python.years, python.level, python.confidence, python.section) == (5.0, "expert", 0.95, "skills") and p.skills == "Go, Python"
    assert got[2].warnings == got[3].warnings == ["LOW_CONFIDENCE_NAME", "MISSING_CONTACT"] and got[3].skills is None
    assert [(r.job_title, r.achievements, r.warning) for r in extract.roles(docs).orderBy("entry").collect()] == [("Cook", ["Served 200 people"], None), ("Waiter", [], "INVALID_TIMELINE")]


def test_masked_documents(spark):
    rows = blocks_of(spark, ["Ann Lee", "ann@x.org", *(f"line {k}" for k in range(7)), "mail b@y.org or ann@x.org, ask ANN LEE, see [ANON_EMAIL_1]"])
    who = spark.createDataFrame([(1, "Ann Lee", "pdf_header_font", 1.0)], "doc_id long, name string, source string, confidence double")
    open_ = privacy.mask_blocks(rows, who).first()
    assert [b.text for b in open_.blocks][:2] == ["[ANON_NAME]", "[ANON_EMAIL_1]"] and open_.blocks[-1].text == "mail [ANON_EMAIL_2] or [ANON_EMAIL_1], ask [ANON_NAME], see [ANON_TOKEN_1]"
    for shut in (privacy.mask_blocks(rows).first(), privacy.mask_blocks(rows, who, mode="blanket-legacy").first()):
        assert {b.text for b in shut.blocks[:8]} == {"[HEADER_REDACTED]"} and shut.blocks[-1].text.startswith("mail [ANON_EMAIL_1] or [ANON_EMAIL_2]")
    with pytest.raises(ValueError):
        privacy.mask_blocks(rows, mode="x")
    text = spark.createDataFrame([(1, "literal [ANON_EMAIL_1] and a@b.org")], "doc_id long, text string")
    masked = privacy.mask(text)
    assert masked.select(privacy.restore(F.col("masked"), F.col("mapping")).alias("o")).first().o == "literal [ANON_EMAIL_1] and a@b.org"
    p = profile_of(spark, candidate_name="[ANON_NAME]", headline="by [ANON_URL_1]", experiences=[job("x", evidence=[("[ANON_EMAIL_1]", 1, "b")])])
    mapping = spark.createDataFrame([(1, [("[ANON_NAME]", 'A "B" Lee'), ("[ANON_EMAIL_1]", "a@b.org"), ("[ANON_PHONE_1]", "+84 912 000 111"), ("[ANON_URL_1]", "http://x.org")])], f"doc_id long, mapping {privacy.MAPPING}")
    back = privacy.restore_profiles(p, mapping).first()
    assert (back.candidate_name, back.headline, back.email, back.phone, back.experiences[0].evidence[0].text) == ('A "B" Lee', "by http://x.org", "a@b.org", "+84 912 000 111", "a@b.org")
    own = privacy.apply_contact(privacy.apply_identity(p, who), privacy.contacts(spark.createDataFrame([(1, "z@z.org")], "doc_id long, text string"))).first()
    assert (own.candidate_name, own.field_confidence, own.email, own.phone) == ("Ann Lee", {"candidateName": 1.0}, "z@z.org", None)


def completion(profile, reason="stop"):
    return json.dumps({"choices": [{"message": {"content": profile if isinstance(profile, str) else json.dumps(profile)}, "finish_reason": reason}]})


def test_exchange(spark):
    for bad in ({"representation": "x"}, {"contract": "required-initial"}, {"scope": "entity-inventory", "evidence_mode": "entity-bound"}):
        with pytest.raises(ValueError):
            exchange.Settings("m", **bad)
    schema = {"properties": {"experiences": {"items": {"properties": {"jobTitle": {}, "evidence": {}}, "required": ["jobTitle", "evidence"]}}, "email": {}}, "required": ["email", "experiences"]}
    small = exchange.pruned_schema(schema, "entity-inventory")
    assert small["properties"]["experiences"]["items"] == {"properties": {"jobTitle": {}}, "required": ["jobTitle"]} and small["required"] == ["experiences"]
    rows = exchange.requests(blocks_of(spark, ["a", " ", "b"]), exchange.Settings("m", representation="canonical-text"), schema, instruction="do")
    body = json.loads(rows.first().request)
    assert body["messages"][1]["content"].endswith("[1|p1-b1] a\n[1|p1-b3] b") and body["temperature"] == 0.1 and rows.first().input_tokens > 10
    good = {"experiences": [{"title": "Cook", "evidence": [{"quote": "q", "page": 1, "block": "b"}]}]}
    asked = []

    def ask(*answers):
        left = list(answers)

        def call(b):
            asked.append(b)
            a = left.pop(0)
            if isinstance(a, Exception):
                raise a
            return a

        return exchange.converse(call, json.dumps(body), schema)

    assert json.loads(ask(exchange.FormatUnsupported(), completion(good))["response"])["experiences"][0]["jobTitle"] == "Cook" and asked[-1]["response_format"] == {"type": "json_object"}
    assert ask(TimeoutError(), completion(good))["attempts"] == 2 and ask(*[TimeoutError()] * 3)["error"] == "TimeoutError"
    loop = completion("null, " * 9, "length")
    assert ask(loop, completion(good))["error"] is None and asked[-1]["temperature"] == 0.2 and ask(loop, loop)["error"] == "LLM_DEGENERATE_RESPONSE"
    assert ask("{}")["error"] == "LLM_EMPTY_RESPONSE" and ask(*[exchange.FormatUnsupported()] * 3)["error"] == "LLM_REQUEST_FAILED"
    assert ask(completion("no json"), completion(good))["error"] is None and ask(completion("no"), completion("no"))["error"] == "LLM_MALFORMED_RESPONSE"
    flawed = good | {"skills": "x"}
    assert ask(completion(flawed), completion({"experiences": [], "skills": []}))["error"] == "LLM_SEMANTIC_REGRESSION" and "skills" in asked[-1]["messages"][-1]["content"]

    class AuthFailed(Exception):
        pass

    assert ask(AuthFailed())["attempts"] == 1
    answer = completion(good)
    done = exchange.extract(rows, lambda: lambda b: answer, schema)
    p = exchange.to_profiles(done, taxonomy.skill_table(spark)).first()
    assert (p.experiences[0].job_title, p.experiences[0].confidence, p.experiences[0].evidence[0].block_id) == ("Cook", 1.0, "b")
    assert exchange.key_from_environment("K", {"K": " v "}) == "v"
    with pytest.raises(ValueError):
        exchange.key_from_environment("K", {})


def test_publishing(spark):
    school = {"institution": "Đại học Bách Khoa", "degree": "Master", "field_of_study": "Data", "location": None, "start_date": date(2010, 9, 1), "end_date": None, "coursework": [], "evidence": [], "confidence": 1.0}
    skill = {"name": "py", "canonical_name": "Python", "years": None, "level": None, "evidence": [], "evidence_types": [], "confidence": 1.0}
    p = profile_of(spark, candidate_name="Kim", headline="Chef", experiences=[job("Chef", "Inn "), job("Chef", "Inn"), job("x", "Firm, Vietnam", location="12 Hà Nội street")], education=[school], skills=[skill]).withColumn("total_experience_years", F.lit(4.0))
    out = publish.callback_payloads(p.withColumn("vector", F.array(F.lit(1.0)))).first()
    body, scored = json.loads(out.extracted), json.loads(out.scored)
    assert (body["status"], body["companies"], body["jobTitles"], body["estimatedBirthYear"], body["highestEducation"], body["address"]) == ("Extracted", ["Inn"], ["Chef", "x"], 1992, "Đại học Bách Khoa", "Hà Nội")
    assert body["skills"] == [{"skillName": "Python", "years": None, "level": None}] and body["piiFields"]["containsPii"] is True
    assert [c["score"] for c in scored["ScoringDetails"]] == [14.0, 32.0, 12.0, 0.0] and scored["Score"] == 58.0 and scored["ScoringDetails"][1]["reason"].startswith("Hơn 4.0")
    assert json.loads(out.embedded)["status"] == "Embedded" and json.loads(publish.callback_payloads(p).first().embedded)["reason"]
    none = publish.callback_payloads(p.withColumn("experiences", F.lit(None).cast(document.PROFILE["experiences"]))).first()
    assert json.loads(none.extracted)["status"] == "Extract-Failed" and json.loads(none.scored)["Score"] == 0
    shown = publish.response(p.withColumn("validation_status", F.lit("manual_review")), model="m").first()
    assert shown.status == "manual_review" and "evidence" not in shown.profile.experiences[0].asDict() and shown.meta.extractionModel == "m"
    assert publish.embedding_gate(p.withColumn("validation_status", F.lit("manual_review"))).count() == 0
    vec = spark.createDataFrame([(1, [1.0], True), (2, [1.0, 0.0], False), (3, [1.0, 0.0], True)], "doc_id long, vector array<double>, normalized boolean")
    assert [r.error for r in publish.embedding_response(vec, dimension=2).orderBy("doc_id").collect()] == ["WRONG_DIMENSION", "NOT_NORMALIZED", None]
    assert [(r.kind, r.entities, r.with_evidence) for r in publish.entity_counts(p).collect()] == [("experiences", 3, 0), ("projects", 0, 0), ("education", 1, 0)]
    assert publish.description_tokens(p).first().tokens == 0 and publish.evidence_total(p).first().evidence == 0
    text = p.select(summary.text_of_profile(p).alias("t")).first().t
    assert "Kim" not in text and text.startswith("Headline: Chef\nSkills: Python")


def test_layout_items_and_headers(spark):
    cells = [(0, 0, "a"), (0, 2, " c "), (1, 1, "e")]
    items = [(1, 1, "text", " hi ", None, [(None, 0.0, 0.0, 0.0, 0.0), (2, 1.0, 2.0, 3.0, 4.0)]), (1, 2, "table", None, cells, [(1, None, None, None, None)]), (1, 3, "text", "lost", None, []), (1, 4, "section_header", "Top", None, [(1, 0.0, 0.0, 1.0, 1.0)])]
    kinds = "doc_id long, position int, label string, text string, cells array<struct<row:int,col:int,text:string>>, prov array<struct<page_no:int,l:double,b:double,r:double,t:double>>"
    head = spark.createDataFrame([(1, 1, "Kim Lee"), (1, 2, " ")], "doc_id long, position int, text string")
    got = layout.blocks_of_items(spark.createDataFrame(items, kinds), head).orderBy("reading_order").collect()
    assert [(r.block_id, r.block_type, r.text) for r in got] == [("p1-b1", "text", "Kim Lee"), ("p1-b2", "table", "| a |  | c |\n|  | e |  |"), ("p1-b3", "section_header", "Top"), ("p2-b1", "text", "hi")] and got[3].y1 == 4.0
    names = spark.createDataFrame([("Lee, Kim 0912 000 111\nx",), ("Data Engineer\nann@x.org\nAnn Bo",), (None,)], "t string")
    assert [r.n for r in names.select(layout.header_name(F.col("t")).alias("n")).collect()] == ["Kim Lee", "Ann Bo", None]
    assert [r.n for r in spark.createDataFrame([("# Head\n\nKim Lee",), ("1 2",)], "t string").select(layout.needs_header_name(F.col("t")).alias("n")).collect()] == [False, True]
    line = "doc_id long, text string, x0 double, y0 double, x1 double, size double, height double"
    rows = [(1, "Họ và tên:", 10.0, 50.0, 60.0, 9.0, 800.0), (1, "Trần, An", 70.0, 51.0, 99.0, 9.0, 800.0), (1, "Big Name", 10.0, 20.0, 60.0, 30.0, 800.0), (2, "Kim Lee", 1.0, 20.0, 9.0, 30.0, 800.0), (2, "Curriculum Vitae", 1.0, 5.0, 9.0, 40.0, 800.0), (3, "Kim Lee", 1.0, 20.0, 9.0, 30.0, 800.0), (3, "Ann Bo", 1.0, 40.0, 9.0, 29.8, 800.0), (4, "Full name: Jo Ray", 1.0, 60.0, 9.0, 9.0, 800.0), (5, "Kim Lee", 1.0, 700.0, 9.0, 9.0, 800.0)]
    assert sorted(tuple(r)[:3] for r in identity.from_header(spark.createDataFrame(rows, line)).collect()) == [(1, "An Trần", "pdf_header_form"), (2, "Kim Lee", "pdf_header_font"), (4, "Jo Ray", "pdf_header_form")]
    paths = [("/a/CV_Kim_Lee_Backend_Developer_v2.pdf", "Kim Lee"), ("deadbeef00112233.pdf", None), ("resume.pdf", None), ("Lee.pdf", None), ("Kim Lee CV final 3yrs.docx", "Kim Lee"), ("Data Engineer.pdf", None)]
    assert [r.n for r in spark.createDataFrame(paths, "p string, w string").select(identity.from_file_name(F.col("p")).alias("n")).collect()] == [w for _, w in paths]
    both = identity.identities(identity.from_header(spark.createDataFrame(rows, line)), spark.createDataFrame([(9, "Ann Bo.pdf"), (2, "Jo Ray.pdf")], "doc_id long, path string"))
    assert {r.doc_id: r.name for r in both.collect()} == {1: "An Trần", 2: "Kim Lee", 4: "Jo Ray", 9: "Ann Bo"}


def test_diagnosis_of_blocks(spark):
    b = blocks.blocks(spark.createDataFrame([(1, "a" * 60), (1, "b" * 60), (None, "c\nd")], "doc_id long, text string"))
    docs = spark.createDataFrame([(1, 2), (1, 2), (None, 1), (4, 1)], "doc_id long, pages int")
    got = {r.doc_id: (r.char_count, r.block_count, r.issues) for r in blocks.diagnose(b, docs, expected_pages="pages").collect()}
    assert got == {1: (120, 2, "READING_ORDER,PAGE_COUNT_MISMATCH"), None: (2, 2, "TEXT_TOO_SHORT"), 4: (0, 0, "TEXT_TOO_SHORT,TOO_FEW_BLOCKS,PAGE_COUNT_MISMATCH")}
    rows = blocks.with_diagnosis(spark.createDataFrame([(1, "x", 1), (1, "y" * 90, 2)], "doc_id long, text string, _lines int")).collect()
    assert [(r.char_count, r.status, r._lines) for r in rows] == [(1, "fallback_required", 1), (90, "fallback_required", 2)]
    assert spark.createDataFrame([("m" * 300,)], "m string").select(F.length(blocks.prune_markdown(F.col("m"))).alias("n")).first().n == 240


def test_row_local_plans(spark):
    from folioforge.plans import catalog

    for name in ("doc_profile", "evidence_band_join", "text_normalize", "pii_mask"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name
    plan = catalog.QUERIES["evidence_grounding"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_search_of_many(spark):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(8)], "id long, v array<double>")
    q = v.where("id IN (0, 3, 5)")
    got = search.top_matches(q, v, id_col="id", vector_col="v", k=2, query_id="id").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.rank) for r in got] == [(0, 0, 1), (0, 1, 2), (3, 3, 1), (3, 4, 2), (5, 5, 1), (5, 6, 2)]
    with pytest.raises(ValueError):
        search.top_matches(q, v, id_col="id", vector_col="v", k=2)
    p = document.as_profiles(spark.createDataFrame([(1, "Kim"), (2, None)], "doc_id long, candidate_name string"))
    every, new = search.backfilled(p, spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, vector array<double>"), lambda d: d.select("doc_id", F.array(F.lit(0.0), F.lit(1.0)).alias("vector")))
    asked = spark.createDataFrame([([0.0, 1.0],)], "vector array<double>")
    found = search.search_results(asked, p, every, k=5)
    assert [(r.doc_id, r.candidate_name) for r in found.orderBy("rank").collect()] == [(2, "Unknown candidate"), (1, "Kim")] and new.count() == 1
    assert "| 1 | Unknown candidate | 1.0000 |" in reports.search_report(found)


def test_reports(spark, tmp_path):
    rows = spark.range(1500).selectExpr("id AS n", "'a|b' AS t")
    assert reports.markdown_table(rows, {"n": "N", "t": "T"}, title="x").count("a\\|b") == 1500  # nothing is cut
    order = reports.interleaved(spark.createDataFrame([("b",), ("a",)], "source string"), repeats=2, arms=("x", "y")).orderBy("seq").collect()
    assert [(r.seq, r.source, r.repeat, r.arm) for r in order][:5] == [(1, "a", 1, "x"), (2, "a", 1, "y"), (3, "a", 2, "y"), (4, "a", 2, "x"), (5, "b", 1, "x")]
    runs = reports.benchmark_jobs(spark.createDataFrame([("/d/a.pdf",), ("/d/b.pdf",)], "source string"), repeats=2, overrides={"b.pdf": 3})
    assert runs.groupBy("source").count().orderBy("source").collect()[1]["count"] == 3
    p = profile_of(spark, candidate_name="Kim", experiences=[job("Cook", "Inn", achievements=["Served 5"])]).withColumn("total_experience_years", F.lit(2.0)).withColumn("validation_status", F.lit("partial")).withColumn("completeness_score", F.lit(50.0)).withColumn("quality_score", F.lit(None).cast("double")).withColumn("source_name", F.lit("k.pdf"))
    reports.human_review(reports.human_review_cards(p), spark.createDataFrame([("bad.pdf", None)], "source_name string, error_code string"), str(tmp_path / "review"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "review")).collect())
    assert "### KIM" in text and "Cook @ Inn" in text and '1 metric(s) (e.g. "Served 5")' in text and "bad.pdf: UNKNOWN_FAILURE" in text and "**Profiles:** 1" in text
    result = spark.createDataFrame([(1, "a.pdf", "ff", 1, 2, {"total": 9.0}, 1, 2, 100, 60, "validated", 50.0, None, 3)], "doc_id long, source_name string, sha256 string, pages int, blocks int, timings map<string,double>, input_tokens int, output_tokens int, tokens_before int, tokens_after int, validation_status string, completeness_score double, quality_score double, evidence int")
    assert "| 1 | 2 | 100 | 60 | 40.0 |" in reports.process_reports(result).first().report
    raw = reports.with_expiry(spark.createDataFrame([(1, {"Date": "x", "Authorization": "secret"})], "id long, headers map<string,string>"), days=2, now="2024-01-01 00:00:00")
    assert raw.first().headers == {"Date": "x"} and reports.purge(raw, now="2024-01-02 00:00:00").count() == 1 and reports.purge(raw, now="2024-01-04 00:00:00").count() == 0
    reports.write_stages({"one": raw.select("id"), "two": raw.select("id")}, str(tmp_path / "stages"))
    assert spark.read.json(str(tmp_path / "stages" / "two")).count() == 1
    artifacts.write_debug({"raw": spark.createDataFrame([("ff", "t")], "sha256 string, text string")}, str(tmp_path / "debug"))
    assert spark.read.json(str(tmp_path / "debug" / "raw")).first().sha256 == "ff"
    assert spark.createDataFrame([({"experiences": 2, "projects": 1},), ({"projects": 1},)], "c map<string,int>").select(reports.funnel_pair(F.col("c")).alias("p")).collect()[0].p == "2/1"


def test_evaluation(spark):
    reviews = spark.createDataFrame([("correct", ["b2", "b3"], ["b2"]), ("incorrect", [], []), ("pending", [], [])], "verdict string, bound array<string>, correct array<string>")
    m = evaluate.binding_counts(reviews).first()
    assert (m.reviewed, m.correct, m.incorrect, m.pending, m.entity_precision, m.block_precision, m.block_recall) == (2, 1, 1, 1, 0.5, 0.5, 1.0)
    e = "doc_id long, kind string, title string"
    gold, found = spark.createDataFrame([(1, "job", "Data Engineer")], e), spark.createDataFrame([(1, "job", " data engineer"), (1, "job", "")], e)
    n = evaluate.initial_entities(gold, found, gold, gold.limit(0), gold).first()
    assert (n.gold, n.initial, n.with_title, n.matched, n.initial_valid, n.corrected_valid, n.final) == (1, 2, 1, 1, 1, 0, 1)
    packet = evaluate.binding_packet(gold, gold.withColumn("blocks", F.array(F.lit("p1-b2")))).first()
    assert (packet.blocks, packet.verdict) == (["p1-b2"], "pending")
    notes = "## case.pdf\n\n* Layout observations: single-column layout.\n\n### Employment — record every entry present\n\n1. **Employer/Organisation:** Example Corp\n\n* **Title:** Engineer\n* **Page:** Page 1\n\n### Projects — x\n1. **Project Name:** Verified\n* **Role:** ambiguous (not labelled)\n### Skills — record\n\n* Python\n"
    facts = evaluate.annotation_intake(spark.createDataFrame([("case.md", notes)], "source string, text string")).orderBy("fact").collect()
    assert [(f.kind, f.state, f.page, f.layout) for f in facts] == [("employment", "verified", 1, "single_column"), ("project", "verified", None, "single_column"), ("skill", "verified", None, "single_column")]
    assert facts[0].fields["Employer/Organisation"] == "Example Corp" and facts[2].fields == {"Item": "Python"}
    f = "doc_id long, entity string, field string, value string"
    assert evaluate.field_coverage(spark.createDataFrame([(1, "a", "x", "V"), (1, "a", "y", "w")], f), spark.createDataFrame([(1, "a", "x", "v ")], f)).first().coverage == 0.5
    g = "doc_id long, entity string, page int"
    assert evaluate.page_overlap(spark.createDataFrame([(1, "a", 1)], g), spark.createDataFrame([(1, "a", 1), (1, "a", 2)], g)).first().overlap == 1.0


def test_callbacks(spark, tmp_path):
    log = tmp_path / "sent"
    log.mkdir()

    def make(folder=str(log)):
        def call(doc, step, body):
            if step == "scored":
                raise ConnectionError
            Path(folder, f"{doc}-{step}").write_text(body)

        return call

    rows = callbacks.messages(spark.createDataFrame([(1, "e", "s", "v")], "doc_id long, extracted string, scored string, embedded string"))
    got = {r.step: (r.sent, r.error) for r in callbacks.send(rows, make).collect()}
    assert got == {"extracted": (True, None), "scored": (False, "ConnectionError"), "embedded": (True, None)} and sorted(p.name for p in log.iterdir()) == ["1-embedded", "1-extracted"]
    bad = callbacks.failures(spark.createDataFrame([(1, "score", "x"), (2, "extract", "y")], "doc_id long, failed_step string, reason string")).orderBy("doc_id").collect()
    assert [(r.step, json.loads(r.body)["status"]) for r in bad] == [("scored", "Score-Failed"), ("extracted", "Extract-Failed")]
    docs = spark.createDataFrame([(k, "t") for k in range(4)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "land"))
    stream = ingest.read_landing(spark, str(tmp_path / "land"), docs.schema)
    callbacks.call_back(stream, lambda d: d.select("doc_id", F.lit("extracted").alias("step"), F.col("text").alias("body")), make, log=str(tmp_path / "log"), checkpoint=str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "log" / "log")).where("sent").count() == 4


def docx(text):
    data, w = io.BytesIO(), 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("[Content_Types].xml", "x")
        z.writestr("word/document.xml", f"<w:document {w}><w:body>" + "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in text.split("\n")) + "</w:body></w:document>")
    return data.getvalue()


def test_batch_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "kim.docx").write_bytes(docx(RESUME))
    (tmp_path / "in" / "empty.pdf").write_bytes(b"")
    (tmp_path / "in" / "bad.docx").write_bytes(b"zip?")
    assert jobs.main(["batch", str(tmp_path / "in"), str(tmp_path / "out"), "--as-of", "2024-06-01"]) == jobs.OK
    r = spark.read.parquet(str(tmp_path / "out" / "results")).first()
    assert r.candidate_name == "KIM EXAMPLE" and r.validation_status in ("partial", "manual_review") and "KIM EXAMPLE" in r.summary_text
    assert {Path(x.source_name).name: x.error_code for x in spark.read.json(str(tmp_path / "out" / "errors")).collect()} == {"empty.pdf": "EMPTY_FILE", "bad.docx": "CORRUPT_FILE"}
    assert jobs.main(["batch", str(tmp_path / "nowhere"), str(tmp_path / "out2"), "--as-of", "2024-06-01"]) == jobs.INPUT
    assert jobs.main(["batch", str(tmp_path / "in"), str(tmp_path / "out"), "--as-of", "2024-06-01"]) == jobs.INPUT  # is there already
    assert jobs.main([]) == jobs.USAGE and jobs.main(["batch"]) == jobs.USAGE and jobs.main(["serve"]) == jobs.NOT_IMPLEMENTED
    (tmp_path / "jd").mkdir()
    (tmp_path / "jd" / "a.txt").write_text("wanted: cook")
    (tmp_path / "jd" / "b.txt").write_text("  ")
    assert {Path(x.path).name: x.error for x in files.read_descriptions(spark, str(tmp_path / "jd")).collect()} == {"a.txt": None, "b.txt": "EMPTY_TEXT"}
    assert evaluate.smoke_report(files.parse(files.validate(files.scan_all(spark, str(tmp_path / "in"))))).where("ok").count() == 1


def test_fallbacks_and_weights(spark, tmp_path):
    docs = spark.createDataFrame([(1, "good text"), (2, "")], "doc_id long, text string")
    out = files.with_fallbacks(docs, [("main", lambda d: d.where("text <> ''")), ("plain", lambda d: d)], lambda b: b.select("doc_id"))
    assert sorted((r.doc_id, r.extractor) for r in out.collect()) == [(1, "main"), (2, "plain")]
    assert files.markdown_pages(spark.createDataFrame([(1, "# A\n\n<!-- image -->\nb")], "doc_id long, markdown string")).first().text == "# A\nb"
    (tmp_path / "w.json").write_text(json.dumps({"quality": {"structure": 0.5, "rest": 0.5}}))
    assert files.weights_from_json(str(tmp_path / "w.json"))["quality"]["rest"] == 0.5
    for bad in ({"quality": {"a": 0.4}}, {"quality": {"email": 1.0}}):
        (tmp_path / "w.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            files.weights_from_json(str(tmp_path / "w.json"))
    names = files.named_files(spark.createDataFrame([("/x/none.pdf",)], "path string"), spark.createDataFrame([], "path string, length long, content binary"))
    assert files.validate(names).first().error_code == "FILE_NOT_FOUND"
