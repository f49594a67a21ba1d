"""Intervals: union of overlapping ones, overlap of pairs, dates of loose spelling."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Roles that count only if a profile has no others. Fixed values.
SECONDARY_ROLES = r"(?i)\b(?:instructor|mentor|teaching assistant|tutor|curriculum designer)\b"


def merged_years(intervals: DataFrame, *, key: str, start: str, end: str, as_of: date | None = None) -> DataFrame:
    """(key, intervals, islands, days, years): the union of each key's intervals; touching ones are one, open ends run to `as_of`."""
    rows = intervals.where(F.col(start).isNotNull()).select(key, F.col(start).cast("date").alias("s"), F.coalesce(F.col(end).cast("date"), F.lit(as_of)).alias("e"))
    before = Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("reach", F.max("e").over(before)).withColumn("new", (F.col("reach").isNull() | (F.col("s") > F.col("reach"))).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy(key, "island").agg(F.datediff(F.max("e"), F.min("s")).alias("days"), F.count("*").alias("n"))
    total = islands.groupBy(key).agg(F.sum("n").cast("long").alias("intervals"), F.count("*").alias("islands"), F.sum("days").cast("long").alias("days"))
    return total.withColumn("years", F.round(F.col("days") / 365.25, 1))


def primary_only(jobs: DataFrame, *, key: str, title: str, company: str) -> DataFrame:
    """Jobs without secondary roles, unless a key has nothing else."""
    rows = jobs.withColumn("_second", F.coalesce(F.regexp_like(title, F.lit(SECONDARY_ROLES)), F.lit(False)) | F.coalesce(F.regexp_like(company, F.lit(SECONDARY_ROLES)), F.lit(False)))
    return rows.withColumn("_all", F.min("_second").over(Window.partitionBy(key))).where("NOT _second OR _all").drop("_second", "_all")


def overlap_fraction(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared days over the days of the shorter interval; 0 if a start is missing or nothing is shared."""
    shared, shorter = F.datediff(F.least(a1, b1), F.greatest(a0, b0)), F.least(F.datediff(a1, a0), F.datediff(b1, b0))
    return F.when(a0.isNull() | b0.isNull() | (shared <= 0) | (shorter <= 0), 0.0).otherwise(shared / shorter)


def overlapping_pairs(jobs: DataFrame, *, key: str, id_col: str, start: str, end: str, least: float) -> DataFrame:
    """(key, left_id, right_id, overlap) of pairs within a key that share at least `least` of the shorter interval.

    Intervals are cut into buckets of a year and meet in the year in which the later one starts, so that a key with
    many intervals spreads over years and a pair is found once.
    """
    rows = jobs.select(key, id_col, F.col(start).cast("date").alias("s"), F.col(end).cast("date").alias("e")).where("s IS NOT NULL AND e >= s")
    years = rows.withColumn("y", F.explode(F.sequence(F.year("s"), F.year("e"))))
    a = years.select(key, "y", *(F.col(c).alias(f"l_{c}") for c in (id_col, "s", "e")))
    b = years.select(key, "y", *(F.col(c).alias(f"r_{c}") for c in (id_col, "s", "e")))
    meet = F.greatest(F.year("l_s"), F.year("r_s")) == F.col("y")
    pairs = a.join(b, [key, "y"]).where(meet & (F.col(f"l_{id_col}") < F.col(f"r_{id_col}")) & (F.col("l_s") <= F.col("r_e")) & (F.col("r_s") <= F.col("l_e")))
    pairs = pairs.withColumn("overlap", overlap_fraction(F.col("l_s"), F.col("l_e"), F.col("r_s"), F.col("r_e")))
    return pairs.where(F.col("overlap") >= least).select(key, F.col(f"l_{id_col}").alias("left_id"), F.col(f"r_{id_col}").alias("right_id"), "overlap")


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAMED = re.compile(r"\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?\s*,?\s*((?:19|20)\d\d)\b", re.I)
_NUMBERED = re.compile(r"\b(0?[1-9]|1[0-2])\s*[./-]\s*((?:19|20)\d\d)\b")
_VIETNAMESE = re.compile(r"th[áa]ng\s*(0?[1-9]|1[0-2])\s*(?:n[ăa]m\s*)?((?:19|20)\d\d)", re.I)
_PRESENT = re.compile(r"\b(?:present|current|now|ongoing|hiện tại)\b", re.I)


def repair_date(value: str | None, is_end: bool) -> str | None:
    """The first day of the month that a loosely written date names; the earliest for starts, the latest for ends.

    Present words give null; text without a year stays as it is; a day is always lost.
    """
    if value is None or is_end and _PRESENT.search(value):
        return None
    text = value.strip().replace("–", "-").replace("—", "-")
    found = [(m.start(), MONTHS.index(m[1][:3].lower()) + 1, m[2]) for m in _NAMED.finditer(text)]
    found += [(m.start(), int(m[1]), m[2]) for p in (_NUMBERED, _VIETNAMESE) for m in p.finditer(text)]
    if found:
        _, month, year = max(found) if is_end else min(found)
        return f"{year}-{month:02d}-01"
    years = re.findall(r"\b(?:19|20)\d\d\b", text)
    if len(years) > 1:
        return f"{years[-1] if is_end else years[0]}-01-01"
    if years:
        month = re.search(r"\b(0?[1-9]|1[0-2])\b", text)
        return f"{years[0]}-{int(month[1]) if month else 1:02d}-01"
    return value
