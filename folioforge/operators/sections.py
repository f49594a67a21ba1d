"""Headings and sections. Three rules look alike and differ on purpose: by alias (here), by markup (scoring), by page."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.text import bind, lines, strip

#: Section headings in English and Vietnamese. Fixed values.
HEADINGS = {
    "summary": ("summary", "professional summary", "profile", "career objective", "objective", "tóm tắt", "giới thiệu", "mục tiêu nghề nghiệp"),
    "skills": ("skills", "technical skills", "technical skill", "skills & technologies", "core competencies", "professional skills", "expertise", "technologies", "tech stack", "skill", "kỹ năng", "kỹ năng chuyên môn", "công nghệ"),
    "experience": ("experience", "work experience", "professional experience", "employment history", "work history", "working experience", "work experiences", "career history", "professional background", "employment", "kinh nghiệm", "kinh nghiệm làm việc", "quá trình công tác"),
    "education": ("education", "academic background", "educational background", "education & training", "academic qualifications", "qualifications", "training", "học vấn", "giáo dục", "quá trình học tập"),
    "projects": ("projects", "personal projects", "selected projects", "project experience", "dự án", "dự án tiêu biểu"),
    "certifications": ("certifications", "certificates", "certificate", "certification", "licenses & certifications", "chứng chỉ", "chứng nhận"),
    "languages": ("languages", "language skills", "language", "language proficiency", "ngoại ngữ", "ngôn ngữ"),
}
ALIASES = tuple((a, k) for k, names in HEADINGS.items() for a in names)
LONGEST_HEADING = 60


_WORDS = "|".join(re.escape(a).replace("\\ ", r"\s+") for a in sorted({a for a, _ in ALIASES if a.isascii()}))
#: What every heading holds: a letter beyond ASCII, or an alias at its beginning or end, but for signs, blanks and numbers.
_MAY_OPEN = rf"[^\x00-\x7f]|(?i:\A[\s#|:0-9.)-]*+(?:{_WORDS})|\s(?:{_WORDS})[\s#|:-]*+\z)"


def heading_key(line: Column) -> Column:
    v = strip(F.lower(line))
    v = strip(F.regexp_replace(v, r"^[#\-–—•|:]+|[#\-–—•|:]+$", ""))
    v = strip(F.regexp_replace(v, r"(?U)^\d{1,2}[.)\s-]+", ""))
    return F.regexp_replace(v, r"(?U)\s+", " ")


def heading_kind(line: Column) -> Column:
    """The section that a line opens, or null: a whole alias, else the first alias of four letters or more that begins or ends it."""
    long = [(a, k) for a, k in ALIASES if len(a) >= 4]
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(k).alias("k")) for a, k in long))
    some = "|".join(re.escape(a).replace("\\ ", " ") for a in dict.fromkeys(a for a, _ in long))

    def opened(key: Column) -> Column:
        exact = F.element_at(F.create_map(*(F.lit(x) for pair in ALIASES for x in pair)), key)
        partly = F.element_at(F.filter(table, lambda t: F.startswith(key, F.concat(t["a"], F.lit(" "))) | F.endswith(key, F.concat(F.lit(" "), t["a"]))), 1)["k"]
        partly = F.when(F.regexp_like(key, F.lit(f"^(?:{some}) | (?:{some})$")), partly)  # most lines hold no alias at all
        return F.when(F.length(key) <= LONGEST_HEADING, F.coalesce(exact, partly))

    # most lines are told to be no heading by one pattern, others by counting their letters; the key is made once
    letters = F.length(F.translate(line, " \t#-–—•|:.)0123456789", ""))
    return F.when(F.regexp_like(line, F.lit(_MAY_OPEN)), F.when(letters <= LONGEST_HEADING, bind(heading_key(line), opened)))


def section_lines(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_number from 1, line, heading, section_id, section): each line with the section that it stands in."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.posexplode_outer(lines(F.col(text))).alias("_n", "line")).where("_n IS NOT NULL")  # outer: else lines are made twice
    rows = rows.select("doc_id", (F.col("_n") + 1).alias("line_number"), "line", heading_kind(F.col("line")).alias("heading"))
    upto = Window.partitionBy("doc_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section_id", F.sum(F.col("heading").isNotNull().cast("int")).over(upto).cast("int"))
    return rows.withColumn("section", F.coalesce(F.last("heading", True).over(upto), F.lit("header")))


def detect_sections(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, section_id, section, heading, text, start_line, end_line, confidence).

    Lines before the first heading are the header (0.9); a text without headings is one section, other (0.35).
    """
    rows = section_lines(docs, doc=doc, text=text)
    body = F.filter(F.array_sort(F.collect_list(F.struct("line_number", "line", "heading"))), lambda x: x["heading"].isNull())
    out = rows.groupBy("doc_id", "section_id", "section").agg(
        F.max(F.when(F.col("heading").isNotNull(), F.col("line"))).alias("heading"),
        strip(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("text"),
        F.min("line_number").alias("start_line"),
        F.max("line_number").alias("end_line"),
    )
    several = F.max("section_id").over(Window.partitionBy("doc_id")) > 0
    out = out.withColumn("section", F.when(several, F.col("section")).otherwise("other"))
    confidence = F.when(F.col("section") == "other", 0.35).when(F.col("section") == "header", 0.9).otherwise(0.95)
    return out.withColumn("confidence", confidence).where("heading IS NOT NULL OR text <> ''")
