"""Two-sentence summaries and the profile text that embeddings are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTACT = r"(?i)@|https?://|www\.|\+?[0-9][0-9 ().-]{7,}[0-9]"


def reusable(summary: Column) -> Column:
    """40 to 600 characters without contact data, in two or three sentences."""
    sentences = F.size(F.filter(F.split(F.trim(summary), r"(?<=[.!?])\s+"), lambda s: s != ""))
    return F.coalesce(F.length(summary).between(40, 600) & ~F.regexp_like(summary, F.lit(CONTACT)) & sentences.isin(2, 3), F.lit(False))


def years_text(years: Column) -> Column:
    """6.0 as 6, 2.5 as 2.5."""
    return F.regexp_replace(years.cast("string"), r"\.0$", "")


def summarize(profiles: DataFrame) -> DataFrame:
    """`profiles` (name, headline, years, skills, institution, n_certificates, summary) with summary_text and reused."""
    subject = F.coalesce("name", F.lit("The candidate"))
    first = F.concat_ws(" and ", F.concat(F.lit("works as "), "headline"), F.concat(F.lit("has "), years_text(F.col("years")), F.lit(" years of recorded experience")))
    first = F.when(first == "", F.concat(subject, F.lit(" is the candidate represented by the extracted profile."))).otherwise(F.concat(subject, F.lit(" "), first, F.lit(".")))
    second = F.concat_ws(
        " and ",
        F.when(F.size("skills") > 0, F.concat(F.lit("lists skills in "), F.array_join(F.slice("skills", 1, 5), ", "))),
        F.concat(F.lit("records education at "), "institution"),
        F.when(F.col("n_certificates") > 0, F.concat(F.lit("includes "), "n_certificates", F.lit(" certification(s)"))),
    )
    second = F.when(second == "", F.lit("No structured skills, education, or certifications were extracted.")).otherwise(F.concat(F.lit("The profile "), second, F.lit(".")))
    kept = reusable(F.col("summary"))
    return profiles.withColumn("summary_text", F.when(kept, F.col("summary")).otherwise(F.concat(first, F.lit(" "), second))).withColumn("reused", kept)


def profile_text(headline: Column, skills: Column, jobs: Column, schools: Column) -> Column:
    """The text that stands for a profile in search: no name, no contact data, each skill once."""
    from .prompt import sanitize_lines

    parts = [F.concat(F.lit(f"{label}: "), F.nullif(c, F.lit(""))) for label, c in (("Headline", headline), ("Skills", F.array_join(F.array_distinct(skills), ", ")), ("Experience", F.array_join(jobs, "; ")), ("Education", F.array_join(schools, "; ")))]
    return sanitize_lines(F.concat_ws("\n", *parts))


def text_of_profile(profiles: DataFrame, *, plain: bool = False) -> Column:
    """profile_text of a whole profile (document.PROFILE): headline, summary, skills, jobs, projects, schools, certifications, languages.

    Name and contact data are no part of it. `plain`: the older form, not sanitized, without project roles and achievements.
    """
    from .prompt import sanitize_lines

    lines_of = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "; ")
    job = lambda e: F.concat_ws(" | ", e["job_title"], e["company"], F.nullif(lines_of(e["description"]), F.lit("")), F.nullif(lines_of(e["achievements"]), F.lit("")))
    project = lambda p: F.concat_ws(" | ", *([p["title"]] if plain else [p["title"], p["role"]]), F.nullif(lines_of(p["description"]), F.lit("")), F.nullif(lines_of(p["skills"]), F.lit("")), *([] if plain else [F.nullif(lines_of(p["achievements"]), F.lit(""))]))
    school = lambda s: F.concat_ws(" | ", s["degree"], s["field_of_study"], s["institution"])
    parts = {
        "Headline": F.col("headline"), "Summary": F.col("summary"), "Skills": F.array_join(F.array_distinct(F.transform("skills", lambda s: s["canonical_name"])), ", "),
        "Experience": F.array_join(F.transform("experiences", job), "\n"), "Projects": F.array_join(F.transform("projects", project), "\n"), "Education": F.array_join(F.transform("education", school), "\n"),
        "Certifications": F.array_join("certifications", ", "), "Languages": F.array_join("languages", ", "),
    }
    text = F.concat_ws("\n", *(F.concat(F.lit(f"{n}: "), F.nullif(c, F.lit(""))) for n, c in parts.items()))
    return text if plain else sanitize_lines(text)


def tagged_text_of_profile(profiles: DataFrame) -> Column:
    """The second encoder's text of a whole profile (document.PROFILE): a heading in brackets before each part, lines of jobs and
    projects with a hyphen, empty parts left out. Name and contact data are no part of it."""
    texts = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    filled = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), F.trim(c)))
    items = lambda c: F.transform(texts(c), lambda x: F.concat(F.lit("- "), x))
    used = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.concat(F.lit("- Skills: "), F.array_join(texts(c), "; ")))

    def entry(*parts: Column) -> Column:
        return F.array_compact(F.flatten(F.array(*parts)))

    def part(name: str, lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.array(F.lit(""), F.lit(f"[{name}]")), lines)).otherwise(F.array().cast("array<string>"))

    job = lambda e: entry(F.array(F.concat(e["job_title"], F.when(F.coalesce(e["company"], F.lit("")) != "", F.concat(F.lit(" at "), e["company"])).otherwise(""))), items(e["description"]), items(e["achievements"]), F.array(used(e["skills"])))
    project = lambda p: entry(F.array(p["title"]), items(p["description"]), F.array(used(p["skills"])))
    degree = lambda s: F.coalesce(F.nullif(s["degree"], F.lit("")), F.nullif(s["field_of_study"], F.lit("")), F.lit("Education"))
    courses = lambda s: F.when(F.size(F.coalesce(s["coursework"], F.array().cast("array<string>"))) > 0, F.concat(F.lit("- Relevant coursework: "), F.array_join(texts(s["coursework"]), "; ")))
    school = lambda s: entry(F.array(F.concat(degree(s), F.lit(" at "), s["institution"]), courses(s)))
    spoken = lambda x: F.concat(x["language"], F.when(F.coalesce(x["proficiency"], F.lit("")) != "", F.concat(F.lit(" ("), x["proficiency"], F.lit(")"))).otherwise(""))
    one = lambda c: F.when(F.size(c) > 0, F.array(F.array_join(c, "; "))).otherwise(F.array().cast("array<string>"))
    head = F.array_compact(F.array(F.lit("[CANDIDATE_PROFILE]"), filled("Target roles: ", F.col("headline")), filled("Professional summary: ", F.col("summary"))))
    return F.array_join(F.concat(
        head, part("SKILLS", one(F.array_distinct(texts(F.transform("skills", lambda x: x["canonical_name"]))))),
        part("WORK_EXPERIENCE", F.flatten(F.transform("experiences", job))), part("PROJECTS", F.flatten(F.transform("projects", project))), part("EDUCATION", F.flatten(F.transform("education", school))),
        part("LANGUAGES", one(texts("languages"))), part("LANGUAGE_PROFICIENCY", one(F.transform("language_proficiencies", spoken))),
    ), "\n")
