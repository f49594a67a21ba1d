"""Profiles as others see them: without evidence, and as the three bodies that callbacks carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import strip

from .scoring import ADVANCED_SKILLS, INTERNATIONAL, STEM, TOP_UNIVERSITIES, has_word
from .summary import years_text
from .taxonomy import place_of, profile_titles, province

#: Parts of company names that are places, the longest company, and the most that a criterion of the rubric gives. Fixed values.
NO_COMPANY, LONGEST_COMPANY = ("vietnam", "hồ chí minh", "hà nội", "singapore"), 60
MAX_SCORE = {"Học vấn": 15.0, "Kinh nghiệm": 40.0, "Kỹ năng": 30.0, "Chứng chỉ": 15.0}
MODEL, VERSION = "BAAI/bge-m3", "v2.3.0-bgem3"
PUBLIC = {
    "skills": ("name", "canonical_name", "years", "level", "confidence"),
    "experiences": ("job_title", "company", "location", "start_date", "end_date", "is_current", "description", "achievements", "skills", "confidence"),
    "education": ("institution", "degree", "field_of_study", "location", "start_date", "end_date", "confidence"),
    "projects": ("title", "role", "description", "skills", "achievements", "start_date", "end_date", "confidence"),
}
PUBLIC_FIELDS = ("candidate_name", "email", "phone", "address", "date_of_birth", "headline", "summary")


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def public_profile(profiles: DataFrame) -> DataFrame:
    """(doc_id, profile): the profile without evidence, as a struct in the names of the interface."""
    parts = [F.col(c).alias(camel(c)) for c in PUBLIC_FIELDS]
    parts += [_without(name, fields) for name, fields in PUBLIC.items()]
    more = [F.col(c).alias(camel(c)) for c in ("languages", "certifications", "total_experience_years", "validation_status") if c in profiles.columns]
    return profiles.select("doc_id", F.struct(*parts, *more, F.transform("warnings", lambda w: w["code"]).alias("warnings")).alias("profile"))


def _without(name: str, fields: tuple[str, ...]) -> Column:
    return F.transform(name, lambda x: F.struct(*(x[c].alias(camel(c)) for c in fields))).alias(name)


def response(profiles: DataFrame, *, model: str, schema_version: str = "1.1.0") -> DataFrame:
    """(doc_id, status, profile, meta): manual_review or succeeded. `profiles` may have profile_hash, input_tokens, output_tokens, latency_ms."""
    have = [F.col(c).alias(camel(c)) for c in ("profile_hash", "input_tokens", "output_tokens", "latency_ms") if c in profiles.columns]
    meta = F.struct(F.lit(schema_version).alias("profileSchemaVersion"), F.lit(model).alias("extractionModel"), *have).alias("meta")
    status = F.when(F.col("validation_status") == "manual_review", "manual_review").otherwise("succeeded")
    return public_profile(profiles).join(profiles.select("doc_id", status.alias("status"), meta), "doc_id").select("doc_id", "status", "profile", "meta")


def embedding_gate(profiles: DataFrame) -> DataFrame:
    """Profiles that may be embedded: all but those under manual review."""
    return profiles.where("validation_status <> 'manual_review'")


def embedding_response(embeddings: DataFrame, *, dimension: int) -> DataFrame:
    """`embeddings` (doc_id, vector, normalized) with error: a vector of another dimension, or not of unit length, is refused."""
    wrong = F.coalesce(F.size("vector"), F.lit(-1)) != dimension
    return embeddings.withColumn("error", F.when(wrong, "WRONG_DIMENSION").when(~F.coalesce("normalized", F.lit(False)), "NOT_NORMALIZED"))


def companies(experiences: Column) -> Column:
    """Different companies in order, without marks at their ends; no long lines and no places."""
    bare = F.transform(experiences, lambda e: strip(e["company"], "#*•-"))
    good = F.filter(bare, lambda c: (F.coalesce(c, F.lit("")) != "") & (F.length(c) <= LONGEST_COMPANY) & ~F.regexp_like(F.lower(c), F.lit("|".join(NO_COMPANY))))
    return F.array_distinct(good)


def birth_year(born: Column, education: Column) -> Column:
    """The year of birth; else 18 years before the first school with a start, or 22 before its end, whichever a school has first."""
    dated = F.get(F.filter(education, lambda e: e["start_date"].isNotNull() | e["end_date"].isNotNull()), F.lit(0))
    return F.coalesce(F.year(born), F.year(dated["start_date"]) - 18, F.year(dated["end_date"]) - 22)


def highest_education(education: Column) -> Column:
    first = F.get(education, F.lit(0))
    return F.coalesce(F.nullif(first["institution"], F.lit("")), F.nullif(first["degree"], F.lit("")))


def rubric_details(profiles: DataFrame) -> DataFrame:
    """(doc_id, rubric_score, rubric): the four criteria of a profile (document.PROFILE and total_experience_years) with their reasons.

    A row whose `experiences` are null has no profile: all four are 0.
    """
    first, years = F.get("education", F.lit(0)), F.coalesce("total_experience_years", F.lit(0.0))
    school, degree, study = F.coalesce(first["institution"], F.lit("")), F.lower(F.coalesce(first["degree"], F.lit(""))), F.lower(F.coalesce(first["field_of_study"], F.lit("")))
    stem = F.lit(False)
    for w in STEM:
        stem = stem | F.contains(study, F.lit(w)) | F.contains(degree, F.lit(w))
    top, higher = has_word(school, TOP_UNIVERSITIES), F.regexp_like(degree, F.lit("thạc sĩ|tiến sĩ|master|phd"))
    best, known, n_jobs = higher | (top & stem), top | stem | (school != ""), F.size("experiences")
    one = F.format_string("%.1f", years)
    names = F.transform("skills", lambda s: s["canonical_name"])
    n, advanced = F.size(names), F.exists(names, lambda s: has_word(s, ADVANCED_SKILLS))
    spoken = F.transform("language_proficiencies", lambda x: F.concat(x["language"], F.lit(" "), F.coalesce(x["exam"], F.lit(""))))
    papers, told = F.size("certifications") + F.size(spoken), F.array_join(F.concat("certifications", spoken), " ")
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    # names, points and reasons of the criteria are fixed values
    rows = {
        "Học vấn": (F.when(F.size("education") == 0, 5.0).when(best, 14.0).when(known, 11.5).otherwise(8.0), F.when(F.size("education") == 0, "Chưa có thông tin học vấn chi tiết.").when(best, text("Tốt nghiệp/Đang học chuyên ngành tại ", school, ".")).when(known, text("Đào tạo chuyên ngành tại ", school, ".")).otherwise(text("Học vấn tại ", school, "."))),
        "Kinh nghiệm": (
            F.when(years >= 4, F.least(F.lit(40.0), 32 + (years - 4) * 1.5)).when(years >= 1, 20 + (years - 1) * 3.8).when((years > 0) | (n_jobs > 0), 14.0).otherwise(5.0),
            F.when(years >= 4, text("Hơn ", one, " năm kinh nghiệm làm việc thực chiến.")).when(years >= 1, text(one, " năm kinh nghiệm làm việc tích lũy qua ", n_jobs.cast("string"), " vị trí.")).when((years > 0) | (n_jobs > 0), text("Dưới 1 năm kinh nghiệm hoặc kinh nghiệm thực tập (", n_jobs.cast("string"), " vị trí).")).otherwise("Chưa có thông tin kinh nghiệm làm việc chính thức."),
        ),
        "Kỹ năng": (
            F.when(n == 0, 5.0).when((n >= 8) & advanced, 27.5).when(n >= 4, 20.0).otherwise(12.0),
            F.when(n == 0, "Liệt kê ít kỹ năng chuyên môn.").when((n >= 8) & advanced, text("Bộ kỹ năng phong phú (", n.cast("string"), " kỹ năng) bao gồm các công nghệ nâng cao.")).when(n >= 4, text("Kỹ năng tiêu chuẩn đáp ứng tốt yêu cầu công việc (", n.cast("string"), " kỹ năng).")).otherwise(text("Kỹ năng cơ bản (", n.cast("string"), " kỹ năng).")),
        ),
        "Chứng chỉ": (F.when(papers == 0, 0.0).when(has_word(told, INTERNATIONAL), 13.0).otherwise(8.0), F.when(papers == 0, "Không có chứng chỉ chuyên môn hay ngoại ngữ nổi bật.").when(has_word(told, INTERNATIONAL), "Có chứng chỉ quốc tế hoặc chứng chỉ ngoại ngữ uy tín.").otherwise(text("Có ", papers.cast("string"), " chứng chỉ/ngoại ngữ liệt kê."))),
    }
    none = F.col("experiences").isNull()
    cell = lambda k: F.struct(F.lit(k).alias("criterionName"), F.when(none, 0.0).otherwise(F.round(rows[k][0], 1)).alias("score"), F.lit(MAX_SCORE[k]).alias("maxScore"), F.when(none, "Không có thông tin profile.").otherwise(rows[k][1]).alias("reason"))
    out = profiles.select("doc_id", F.array(*map(cell, MAX_SCORE)).alias("rubric"))
    return out.select("doc_id", F.least(F.lit(100.0), F.round(F.aggregate("rubric", F.lit(0.0), lambda a, x: a + x["score"]), 1)).alias("rubric_score"), "rubric")


def callback_payloads(results: DataFrame) -> DataFrame:
    """(doc_id, extracted, scored, embedded): the three JSON bodies of one document.

    `results`: document.PROFILE, total_experience_years, and may have summary_text, parsed_text, scores (JSON), vector. Without a
    profile (experiences null) the first says Extract-Failed, without a vector the third Embed-Failed.
    """
    have = set(results.columns)
    opt = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    none = F.col("experiences").isNull()
    titles = profile_titles(F.col("headline"), F.transform("experiences", lambda e: e["job_title"]), F.transform("projects", lambda p: p["role"]))
    place = F.coalesce(place_of(F.col("address"), F.transform("experiences", lambda e: e["location"])), province(F.col("address")), F.col("address"))
    null = F.lit(None).cast("string")
    pii = ("candidate_name", "email", "phone", "address")
    has = F.exists(F.array(*pii), lambda x: F.coalesce(x, F.lit("")) != "")
    keep = {"ignoreNullFields": "false"}
    body = F.struct(
        F.lit("Extracted").alias("status"), F.coalesce("candidate_name", F.lit("")).alias("candidateName"), "email", "phone", place.alias("address"), null.alias("dateOfBirth"),
        birth_year(F.col("date_of_birth"), F.col("education")).alias("estimatedBirthYear"), highest_education(F.col("education")).alias("highestEducation"), F.coalesce("total_experience_years", F.lit(0.0)).alias("yearsOfExperience"),
        companies(F.col("experiences")).alias("companies"), titles.alias("jobTitles"), "languages", F.transform("skills", lambda s: F.struct(s["canonical_name"].alias("skillName"), null.alias("years"), null.alias("level"))).alias("skills"),
        null.alias("workType"), F.coalesce(opt("summary_text"), F.lit("")).alias("summary"), F.coalesce(opt("parsed_text"), F.lit("")).alias("parsedText"), F.to_json(F.struct("candidate_name", "headline", "experiences", "education", "projects", "skills"), keep).alias("profileJson"),
        F.struct(has.alias("containsPii"), F.struct(*(F.col(c).alias(camel(c)) for c in pii)).alias("fields")).alias("piiFields"),
    )
    failed = F.to_json(F.struct(F.lit("Extract-Failed").alias("status"), F.lit("Profile extraction yielded null profile").alias("reason")))
    scored = F.to_json(F.struct(F.lit("Scored").alias("status"), F.col("rubric_score").alias("Score"), F.col("rubric").alias("ScoringDetails"), null.alias("reason"), opt("scores").alias("_aScores")), keep)
    vector = opt("vector", "array<double>")
    there = F.size(F.coalesce(vector, F.array().cast("array<double>"))) > 0
    sent = F.to_json(F.struct(F.when(there, "Embedded").otherwise("Embed-Failed").alias("status"), F.when(~there, "Embedding generation yielded null vector").alias("reason"), F.when(there, vector).alias("embedding"), F.when(there, F.size(vector)).alias("dimension"), F.lit(MODEL).alias("model"), F.lit(VERSION).alias("version")), keep)
    rows = results.join(rubric_details(results), "doc_id")
    return rows.select("doc_id", F.when(none, failed).otherwise(F.to_json(body, keep)).alias("extracted"), scored.alias("scored"), sent.alias("embedded"))


def entity_counts(profiles: DataFrame) -> DataFrame:
    """(doc_id, kind, entities, with_evidence, evidence_references): counts alone, no text."""
    rows = []
    for kind in ("experiences", "projects", "education"):
        sizes = F.transform(kind, lambda e: F.coalesce(F.size(e["evidence"]), F.lit(0)))
        rows.append(F.struct(F.lit(kind).alias("kind"), F.size(kind).alias("entities"), F.size(F.filter(sizes, lambda n: n > 0)).alias("with_evidence"), F.aggregate(sizes, F.lit(0), lambda a, n: a + n).alias("evidence_references")))
    return profiles.select("doc_id", F.explode(F.array(*rows)).alias("x")).select("doc_id", "x.*")


def description_tokens(profiles: DataFrame) -> DataFrame:
    """(doc_id, characters, tokens, entries, tokens_per_entry): what the lines of experiences would cost in a prompt."""
    lines = F.flatten(F.transform("experiences", lambda e: F.concat(F.coalesce(e["description"], F.array().cast("array<string>")), F.coalesce(e["achievements"], F.array().cast("array<string>")))))
    rows = profiles.select("doc_id", F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("characters"), F.size("experiences").alias("entries"))
    return rows.withColumn("tokens", F.ceil(F.col("characters") / 4).cast("long")).withColumn("tokens_per_entry", F.when(F.col("entries") > 0, F.round(F.col("tokens") / F.col("entries"), 1)).otherwise(0.0))


def evidence_total(profiles: DataFrame) -> DataFrame:
    """(doc_id, evidence): references of fields, experiences, projects and education together."""
    of = lambda c: F.aggregate(F.transform(c, lambda e: F.coalesce(F.size(e["evidence"]), F.lit(0))), F.lit(0), lambda a, n: a + n)
    fields = F.coalesce(F.aggregate(F.transform(F.map_values("field_evidence"), lambda v: F.size(v)), F.lit(0), lambda a, n: a + n), F.lit(0))
    return profiles.select("doc_id", (fields + of("experiences") + of("projects") + of("education")).alias("evidence"))


def years_shown(years: Column) -> Column:
    return F.when(years.isNotNull(), F.concat(years_text(years), F.lit(" years"))).otherwise("N/A")
