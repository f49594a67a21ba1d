"""Merging of split entries, and lines that state measured results."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import collapse

IMPACT = r"(?iU)\b(?:processed|supported|managed|handled|improved|reduced|increased|grew|saved|built|developed|optimized|tăng|giảm|cải thiện|quản lý|đạt)\b"
QUANTITY = r"(?i)\b[0-9]+(?:[.,][0-9]+)?\s*(?:%|[kmb]\b|\+|/|users|records|events|requests|queries|pages|percent|ms|seconds|minutes|hours|days|years?|members|people|projects)"
EXCLUDED = r"(?i)\+?[0-9][0-9\s-]{8,}|\b(?:19|20)[0-9]{2}\b|\bv?[0-9]+\.[0-9]+(?:\.[0-9]+)?\b"
#: Words of rank that titles may differ in, and words of trade that two parts of one role share. Fixed values.
RANKS = r"(?iU)\b(?:senior|junior|lead|principal|staff|associate|assistant|intern|manager|director|head\s+of)\b"
TRADES = r"(?iU)\b(data|engineer|scientist|analyst|developer|architect|researcher|ml|ai|nlp|backend|frontend|fullstack|platform|cloud|devops|sre|kỹ|sư|nhà|lập|trình|phân|tích)\b"


def is_achievement(line: Column) -> Column:
    """An impact with a quantity, and neither a year, a phone number nor a version in it."""
    return F.regexp_like(line, F.lit(IMPACT)) & F.regexp_like(line, F.lit(QUANTITY)) & ~F.regexp_like(line, F.lit(EXCLUDED))


def plain_title(title: Column) -> Column:
    """A title in lower case without words of rank; empty for null."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), RANKS, ""))


def same_role(a: Column, b: Column) -> Column:
    """Whether one title holds the other, ranks aside, or both share a word of trade."""
    x, y = plain_title(a), plain_title(b)
    words = lambda t: F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(TRADES), F.lit(1))
    return ((x != "") & (y != "") & (F.contains(y, x) | F.contains(x, y))) | F.arrays_overlap(words(a), words(b))


def merge_roles(entries: DataFrame, *, as_of: date, least: float = 0.8) -> DataFrame:
    """(doc_id, entry, job_title, company, start_date, end_date, merged): entries of one document and company that are one
    role told twice, merged from left to right; see reconciliation.merge_experiences. The entries of one document meet in
    one row, whose size is that of one profile."""
    from .document import EXPERIENCE
    from .reconciliation import groups_of_roles, merged

    null = {c: F.lit(None) for c in ("location", "description", "achievements", "skills", "evidence", "confidence")}
    names = ("job_title", "company", "location", "start_date", "end_date", "is_current", "description", "achievements", "skills", "evidence", "confidence")
    given = {"is_current": F.lit(False)} | null
    one = F.struct(*(given.get(n, F.col(n)).alias(n) for n in names)).cast(EXPERIENCE)
    rows = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("entry", one.alias("e")))).alias("x")).withColumn("l", F.transform("x", lambda x: x["e"])).withColumn("g", groups_of_roles(F.col("l"), as_of, least))
    out = F.transform("g", lambda g: F.struct(F.aggregate(F.reverse(g["more"]), g["head"], lambda a, b: merged(a, b, as_of).cast(EXPERIENCE)).alias("e"), g["at"].alias("at"), (F.size(g["more"]) + 1).alias("merged")))
    rows = rows.select("doc_id", "x", F.explode(out).alias("o"))
    return rows.select("doc_id", F.get("x", F.col("o.at") - 1)["entry"].alias("entry"), *(F.col(f"o.e.{c}").alias(c) for c in ("job_title", "company", "start_date", "end_date")), "o.merged")
