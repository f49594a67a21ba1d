"""Scores: completeness and quality as weighted means of what is known, and the four-part rubric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights. Fixed values.
COMPLETENESS = {"candidateIdentity": 0.15, "contact": 0.15, "professionalSummary": 0.10, "skills": 0.20, "experience": 0.25, "education": 0.10, "additional": 0.05}
QUALITY = {"experienceDescription": 0.30, "skillEvidence": 0.25, "quantifiedAchievements": 0.20, "timelineConsistency": 0.15, "structure": 0.10}
TOP_UNIVERSITIES = "bách khoa|tự nhiên|quốc gia|bưu chính|công nghệ|fpt|rmit|khởi nghiệp|polytechnic|hust|vnu|hcmut|uit"
ADVANCED_SKILLS = "aws|gcp|azure|kubernetes|docker|microservices|system design|ci/cd|llm|rag|pyspark|kafka|bigdata|hadoop|spark"
INTERNATIONAL = "aws|gcp|azure|databricks|ckad|certified|ielts|toeic|toefl|jlpt|topik|hsk"
STEM = ("công nghệ", "kỹ thuật", "computer", "data", "software", "it")


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """The mean of the parts that are not null by their weights; 0 if there is none."""
    zero = F.lit(0.0)
    top = sum((F.coalesce(c * F.lit(weights[k]), zero) for k, c in parts.items()), zero)
    under = sum((F.when(c.isNotNull(), F.lit(weights[k])).otherwise(zero) for k, c in parts.items()), zero)
    return F.when(under > 0, top / under).otherwise(zero)


def known_share(parts: dict[str, Column]) -> Column:
    """The share of parts above zero among those that are not null."""
    some = sum((F.coalesce((c > 0).cast("int"), F.lit(0)) for c in parts.values()), F.lit(0))
    known = sum((c.isNotNull().cast("int") for c in parts.values()), F.lit(0))
    return F.when(known > 0, some / known).otherwise(F.lit(0.0))


def has_word(c: Column, words: str) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(rf"(?iU)\b(?:{words})\b")), F.lit(False))


#: The ladders of points below are fixed values.
def rubric(profiles: DataFrame) -> DataFrame:
    """`profiles` (institution, degree, field, years, n_jobs, skills array, certificates array) with the four scores and their sum."""
    degree, field = F.lower(F.coalesce("degree", F.lit(""))), F.lower(F.coalesce("field", F.lit("")))
    top = has_word(F.col("institution"), TOP_UNIVERSITIES)
    stem = F.lit(False)
    for w in STEM:
        stem = stem | F.contains(field, F.lit(w)) | F.contains(degree, F.lit(w))
    higher = F.regexp_like(degree, F.lit("thạc sĩ|tiến sĩ|master|phd"))
    education = F.when(F.col("institution").isNull(), 5.0).when(higher | (top & stem), 14.0).otherwise(11.5)
    years = F.coalesce("years", F.lit(0.0))
    work = F.when(years >= 4, F.least(F.lit(40.0), 32.0 + (years - 4) * 1.5)).when(years >= 1, 20.0 + (years - 1) * 3.8).when((years > 0) | (F.col("n_jobs") > 0), 14.0).otherwise(5.0)
    n = F.size(F.coalesce("skills", F.array().cast("array<string>")))
    advanced = F.exists(F.coalesce("skills", F.array().cast("array<string>")), lambda s: has_word(s, ADVANCED_SKILLS))
    skill = F.when(n == 0, 5.0).when((n >= 8) & advanced, 27.5).when(n >= 4, 20.0).otherwise(12.0)
    papers = F.coalesce("certificates", F.array().cast("array<string>"))
    paper = F.when(F.size(papers) == 0, 0.0).when(has_word(F.array_join(papers, " "), INTERNATIONAL), 13.0).otherwise(8.0)
    out = profiles.withColumns({"education_score": education, "experience_score": F.round(work, 1), "skill_score": skill, "certificate_score": paper})
    return out.withColumn("total_score", F.round(F.least(F.lit(100.0), F.col("education_score") + F.col("experience_score") + F.col("skill_score") + F.col("certificate_score")), 1))


def completeness_parts(skills: Column, jobs: Column, schools: Column, name: Column, email: Column, phone: Column, summary: Column) -> dict[str, Column]:
    """Parts from 0 to 100; schools are null, not 0, where nothing is known of them."""
    return {
        "candidateIdentity": F.when(name.isNotNull(), 100.0).otherwise(0.0),
        "contact": F.when(email.isNotNull(), 50.0).otherwise(0.0) + F.when(phone.isNotNull(), 50.0).otherwise(0.0),
        "professionalSummary": F.when(summary.isNotNull(), 100.0).otherwise(0.0),
        "skills": F.least(F.lit(100.0), skills / 3 * 100),
        "experience": F.when(jobs > 0, 100.0).otherwise(0.0),
        "education": F.when(schools > 0, 100.0),
    }


def cache_key(parts: dict[str, Column]) -> Column:
    """The SHA-256 of the parts (texts) as compact JSON with sorted keys; a part that is null counts as null."""
    shown = []
    for name in sorted(parts):
        one = F.to_json(F.struct(parts[name].alias("x")))
        quoted = F.when(parts[name].isNull(), "null").otherwise(F.substr(one, F.lit(6), F.length(one) - 6))
        shown.append(F.concat(F.lit(f'"{name}":'), quoted))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *shown), F.lit("}")), 256)


def missing_scores(keyed: DataFrame, cache: DataFrame, key: str = "score_key") -> tuple[DataFrame, DataFrame]:
    """Rows with a cached score, and those that have to be computed."""
    return keyed.join(cache, key), keyed.join(cache, key, "left_anti")
