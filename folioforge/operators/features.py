"""Features of a document read off its blocks alone, and the scores that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.text import strip

from .reconcile import IMPACT
from .scoring import QUALITY, weighted

#: Words that name a section in a heading by markup; the first group that fits counts. Fixed values.
MARKED = (
    ("work", ("work experience", "professional experience", "employment")), ("project", ("project",)), ("research", ("research", "publication", "paper", "journal")),
    ("skills", ("technical skills", "skills", "competencies", "technologies")), ("education", ("education",)), ("summary", ("summary", "profile", "objective", "introduction")),
    ("additional", ("language", "certification")),
)
#: Evidence that a mention in a section is; listed elsewhere. Fixed values.
EVIDENCE_OF = {"work": "work_experience", "project": "project", "research": "research"}
KINDS = tuple(sorted(("listed", *EVIDENCE_OF.values())))
STRUCTURAL = ("summary", "skills", "work", "education", "project")
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
PHONE = r"(?<!\d)\+?\d[\d ().-]{7,}\d(?!\d)"
QUANTITY = r"(?iU)\b\d+(?:[.,]\d+)?\s*(?:%|[kmb]\+?\b|\+|/|(?:users|records|events|requests|queries|pages|ms|seconds|minutes|hours|days))"


def marked_section(text: Column) -> Column:
    """The section that a heading by markup opens (## or a line up to 60 letters without small ones); null for other lines."""
    heading = F.startswith(text, F.lit("##")) | ((F.length(text) <= 60) & (F.upper(text) == text))
    out = F.lit(None).cast("string")
    for kind, words in reversed(MARKED):
        some = F.lit(False)
        for w in words:
            some = some | F.contains(F.lower(text), F.lit(w))
        out = F.when(some, F.lit(kind)).otherwise(out)
    return F.when(heading, out)


def with_section(blocks: DataFrame, tasks: int | None = None) -> DataFrame:
    """Blocks that are not blank with marked (the last heading by markup at or before them, over pages) and evidence_type.

    Documents are dealt to so many `tasks`, by default as many as Spark sets."""
    upto = Window.partitionBy("doc_id").orderBy("reading_order").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.repartition(*filter(None, (tasks,)), "doc_id").withColumn("text", strip(F.col("text"))).where("text <> ''")  # dealt first: few files are few tasks
    rows = rows.withColumn("marked", F.last(marked_section(F.col("text")), True).over(upto))
    kind = F.lit("listed")
    for section, name in EVIDENCE_OF.items():
        kind = F.when(F.col("marked") == section, F.lit(name)).otherwise(kind)
    return rows.withColumn("evidence_type", kind)


def kinds_among(*seen: Column) -> Column:
    """An aggregate: the kinds of evidence in `seen`, sorted. They are few and known, so it holds a few bits and no set."""
    some = lambda k: F.bool_or(F.array_contains(F.array_compact(F.array(*seen)), k))
    return F.array_compact(F.array(*(F.when(some(k), F.lit(k)) for k in KINDS)))


def skill_types(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, canonical, types): skills that blocks spell out, with the kinds of evidence that they are, sorted."""
    from .taxonomy import alias_hits

    found = alias_hits(with_section(blocks), table, ("doc_id", "evidence_type"))
    return found.groupBy("doc_id", "canonical").agg(kinds_among(F.col("evidence_type")).alias("types"))  # documents are in one task already


def _json_string(c: Column) -> Column:
    return F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)


def document_features(blocks: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """One row per document with blocks: description_score, achievements, sections, n_sections, has_identity, has_contact,
    has_summary, has_experience, has_education, has_additional, n_skills, skill_evidence, feature_hash.

    Descriptions are all blocks of work, projects and research; their mean length scores up to 100. Achievements are different
    ones of these with an impact and a quantity. `table` is a skill table; without one there are no skills. The hash is
    the SHA-256 of a canonical JSON of these values.
    """
    bare = strip(F.regexp_replace("text", "^##", ""))
    told = F.col("marked").isin("work", "project", "research")
    done = told & F.regexp_like("text", F.lit(IMPACT)) & F.regexp_like("text", F.lit(QUANTITY))
    name = F.size(F.split(bare, r"(?U)\s+")).between(2, 5) & F.regexp_like(F.translate(bare, " ", ""), F.lit(r"^\p{L}+$"))
    phones = F.regexp_extract_all("text", F.lit(f"({PHONE})"), F.lit(1))
    contact = F.regexp_like("text", F.lit(EMAIL)) | F.exists(phones, lambda p: F.length(F.regexp_replace(p, r"\D", "")).between(9, 15))
    out = with_section(blocks).groupBy("doc_id").agg(
        F.avg(F.when(told, F.length("text"))).alias("_mean"),
        F.countDistinct(F.when(done, F.lower("text"))).alias("achievements"),
        F.sort_array(F.collect_set("marked")).alias("sections"),
        F.bool_or(name).alias("has_identity"),
        F.bool_or(contact).alias("has_contact"),
    )
    if table is None:
        out = out.withColumn("_skills", F.array().cast("array<struct<canonical:string,types:array<string>>>"))
    else:
        listed = skill_types(blocks, table).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("canonical", "types"))).alias("_skills"))
        out = out.join(listed, "doc_id", "left").withColumn("_skills", F.coalesce("_skills", F.array().cast("array<struct<canonical:string,types:array<string>>>")))
    has = lambda *names: F.arrays_overlap("sections", F.array(*map(F.lit, names)))
    out = out.withColumn("description_score", F.least(F.lit(100.0), 40.0 + F.col("_mean")))
    strings = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, _json_string), ","), F.lit("]"))
    skills = F.concat(F.lit("{"), F.array_join(F.transform("_skills", lambda s: F.concat(_json_string(s["canonical"]), F.lit(":"), strings(s["types"]))), ","), F.lit("}"))
    shown = F.concat(
        F.lit('{"achievementCount":'), F.col("achievements").cast("string"), F.lit(',"contact":'), F.col("has_contact").cast("string"),
        F.lit(',"descriptionScore":'), F.coalesce(F.bround("description_score", 2).cast("string"), F.lit("null")), F.lit(',"identity":'), F.col("has_identity").cast("string"),
        F.lit(',"sections":'), strings(F.col("sections")), F.lit(',"skills":'), skills, F.lit("}"),
    )
    points = F.transform("_skills", lambda s: evidence_points(s["types"]))
    return out.select(
        "doc_id", "description_score", "achievements", "sections", F.size(F.array_intersect("sections", F.array(*map(F.lit, STRUCTURAL)))).alias("n_sections"), "has_identity", "has_contact",
        has("summary").alias("has_summary"), has("work", "project", "research").alias("has_experience"), has("education").alias("has_education"), has("additional").alias("has_additional"),
        F.size("_skills").alias("n_skills"), F.when(F.size("_skills") > 0, F.aggregate(points, F.lit(0.0), lambda a, x: a + x) / F.size("_skills")).alias("skill_evidence"), F.sha2(shown, 256).alias("feature_hash"),
    )


def completeness(features: DataFrame) -> DataFrame:
    """`features` with completeness_score, its confidence and missing_groups, all seven groups from the document.

    No schools is nothing known of them, not a defect. The confidence is the share of the groups known that are above zero.
    """
    from .scoring import COMPLETENESS, known_share

    yes = lambda c: F.when(F.col(c), 100.0).otherwise(0.0)
    parts = {
        "candidateIdentity": yes("has_identity"), "contact": yes("has_contact"), "professionalSummary": yes("has_summary"), "skills": F.least(F.lit(100.0), F.col("n_skills") / 3 * 100),
        "experience": yes("has_experience"), "education": F.when(F.col("has_education"), 100.0), "additional": yes("has_additional"),
    }
    missing = F.array_compact(F.array(*(F.when(c == 0, F.lit(n)) for n, c in parts.items())))
    return features.withColumn("completeness_score", F.round(weighted(parts, COMPLETENESS), 2)).withColumn("completeness_confidence", F.round(known_share(parts), 2)).withColumn("missing_groups", missing)


def quality(features: DataFrame) -> DataFrame:
    """`features` (also timeline_ok, which may be null, and status) with quality_score and confidence.

    A profile under manual review gets no score and a confidence of 0.25; a partial one 0.7 of its confidence. Achievements
    count only where has_experience says, if there is such a column. Names, contact data, birth dates and addresses are no inputs.
    """
    some = F.col("has_experience") if "has_experience" in features.columns else F.lit(True)
    parts = {
        "experienceDescription": F.col("description_score"),
        "skillEvidence": F.col("skill_evidence"),
        "quantifiedAchievements": F.when(some, F.least(F.lit(100.0), F.col("achievements") * 50.0)),
        "timelineConsistency": F.when(F.col("timeline_ok"), 100.0).when(~F.col("timeline_ok"), 0.0),
        "structure": F.col("n_sections") / len(STRUCTURAL) * 100,
    }
    manual = F.col("status") == "manual_review"
    known = sum((c.isNotNull().cast("int") for c in parts.values()), F.lit(0)) / len(parts)
    return features.withColumn("quality_score", F.when(~manual, F.round(weighted(parts, QUALITY), 2))).withColumn("confidence", F.when(manual, 0.25).otherwise(F.round(F.when(F.col("status") == "partial", known * 0.7).otherwise(known), 2)))


def skill_evidence(skills: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, skill, types): the kinds of evidence of the blocks that hold a skill's name; listed where none does.

    `skills` (doc_id, skill) meet the blocks of their own document.
    """
    rows = with_section(blocks).select("doc_id", F.lower("text").alias("_t"), "evidence_type")
    found = skills.join(rows, "doc_id").where(F.contains("_t", F.lower(strip(F.col("skill")))) & (strip(F.col("skill")) != "")).groupBy("doc_id", "skill").agg(F.sort_array(F.collect_set("evidence_type")).alias("types"))
    return skills.join(found, ["doc_id", "skill"], "left").withColumn("types", F.coalesce("types", F.array(F.lit("listed"))))


def evidence_points(types: Column) -> Column:
    """100 for work, 80 for projects or research, 40 for a mere listing, else 0."""
    return F.when(F.array_contains(types, "work_experience"), 100.0).when(F.arrays_overlap(types, F.array(F.lit("project"), F.lit("research"))), 80.0).when(F.array_contains(types, "listed"), 40.0).otherwise(0.0)


#: What an entry's achievement holds, in profiles that come without a document. Fixed values.
ENTRY_IMPACT = r"(?iU)\b(?:increased|reduced|improved|saved|grew|processed|served|tăng|giảm|cải thiện)\b"
ENTRY_QUANTITY = r"(?iU)\b\d+(?:[.,]\d+)?(?:%|[kmb]\b|\s+(?:users|records|events|requests))"


def profile_features(profiles: DataFrame) -> DataFrame:
    """`profiles` (document.PROFILE) with description_score, the mean of their entries' scores, and achievements; null without entries."""
    entries = F.concat(F.transform("experiences", lambda e: e["description"]), F.transform("projects", lambda e: e["description"]))
    lines = lambda d: F.filter(F.coalesce(d, F.array().cast("array<string>")), lambda x: strip(x) != "")
    mean = lambda d: F.aggregate(lines(d), F.lit(0.0), lambda a, x: a + F.length(x)) / F.size(lines(d))
    scores = F.transform(entries, lambda d: F.when(F.size(lines(d)) > 0, F.least(F.lit(100.0), 40.0 + mean(d))).otherwise(0.0))
    told = F.flatten(F.concat(*(F.transform(c, lambda e: F.coalesce(e["achievements"], F.array().cast("array<string>"))) for c in ("experiences", "projects"))))
    good = F.filter(told, lambda x: F.regexp_like(x, F.lit(ENTRY_IMPACT)) & F.regexp_like(x, F.lit(ENTRY_QUANTITY)))
    return profiles.withColumn("description_score", F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))).withColumn("achievements", F.when(F.size(told) > 0, F.size(good)))
