"""A profile from running text by rules: contact, skills, jobs, education, years."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.text import bind, lines, strip

from .sections import heading_kind

#: Patterns of dates, schools, degrees, titles and companies. Fixed values.
PRESENT = "present|current|now|hiện tại"
DATE = r"(?:[0-9]{1,2}[./-])?[0-9]{4}"
DATE_RANGE = rf"(?iu)({DATE})\s*(?:-|–|—|to|đến)\s*({PRESENT}|{DATE})"
INSTITUTION = r"(?iU)\b(?:university|college|institute|academy|đại học|cao đẳng|học viện)\b"
DEGREE = r"(?iU)\b(?:bachelor|master|engineer|bsc|msc|phd|cử nhân|kỹ sư|thạc sĩ|tiến sĩ)\b"
TITLE = r"(?iU)\b(?:engineer|developer|scientist|analyst|manager|intern|architect|consultant|specialist|lead|trưởng|kỹ sư|lập trình|phân tích)\b"
COMPANY = r"(?iU)\b(?:company|corporation|corp|inc|ltd|llc|jsc|công ty|tập đoàn)\b"
MEASURED = r"\b\d+(?:[.,]\d+)?%|\b\d+\+?\b"
BIRTH = r"(?i)(?:date\s+of\s+birth|dob|ngày\s+sinh)\s*[:\-]?\s*(\d{1,2})[./-](\d{1,2})[./-](\d{4})"
LEVELS = ("beginner", "intermediate", "advanced", "expert", "junior", "senior")
FIELD = r"(?iU)(?:\bof\b|\bin\b|chuyên\s+ngành)\s*[:\-]?\s*(.+)$"
SPLIT = r"(?iU)^(.*?)(?:\s*[|@]\s*|\s+at\s+|\s+tại\s+)(.*)$"


def month(value: Column) -> Column:
    """The first day of a `YYYY` or `MM/YYYY`; null if there is no such month."""
    year, number = F.regexp_extract(value, "([0-9]{4})$", 1), F.regexp_extract(value, "^([0-9]{1,2})[./-]", 1)
    return F.try_to_date(F.concat(year, F.lit("-"), F.lpad(F.when(number == "", "1").otherwise(number), 2, "0"), F.lit("-01")))


def period(start: Column, end: Column) -> tuple[Column, Column, Column]:
    """Start, end (null if current) and whether it is current, of the two sides of a range of dates."""
    current = F.regexp_like(end, F.lit(rf"^(?iu)(?:{PRESENT})$"))
    return month(start), F.when(~current, month(end)), current


def body_of(every: Column, section: str) -> Column:
    """The lines of a section, among all lines of a text, that are not blank and no headings, trimmed, in order."""

    def opened(a: Column) -> Column:
        return F.struct(a.alias("a"), F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), heading_kind(x).alias("k"))), lambda h: h["k"].isNotNull()).alias("h"))

    def held(m: Column) -> Column:
        upto = lambda j: F.coalesce(F.get(m["h"], j + 1)["i"], F.size(m["a"]))
        parts = F.transform(m["h"], lambda h, j: F.when(h["k"] == section, F.slice(m["a"], h["i"] + 2, upto(j) - h["i"] - 1)))
        return F.filter(F.transform(F.flatten(F.array_compact(parts)), lambda x: strip(x, "•-")), lambda x: x != "")

    return bind(bind(every, opened), held)


def _bodies(docs: DataFrame, section: str) -> DataFrame:
    """(doc_id, body): see body_of; one row per text."""
    return docs.select("doc_id", body_of(lines(F.col("text")), section).alias("body"))


#: What roles_of gives for each role.
ROLE = "struct<entry:int,job_title:string,company:string,start_date:date,end_date:date,is_current:boolean,description:array<string>>"


def roles_of(body: Column) -> Column:
    """An array of ROLE: the roles that the lines of an experience section tell, see roles()."""

    def told(a: Column) -> Column:
        """One role for each line of dates, from the places of these lines, in the order of the body."""

        def one(at: Column, j: Column) -> Column:
            following = F.get(a, j + 1)
            ahead = F.coalesce(F.regexp_like(F.get(body, following - 2), F.lit(TITLE)), F.lit(False)).cast("int")  # two lines are the next role's
            last = F.when(following.isNull(), F.size(body) - 1).otherwise(following - 2 - ahead)
            own = F.slice(body, at + 2, F.greatest(last - at, F.lit(0)))
            return role(F.get(body, at), F.when(at > 0, F.get(body, at - 1)), F.when(at > 1, F.get(body, at - 2)), j + 1, own)

        return F.transform(a, one)

    def role(line: Column, up1: Column, up2: Column, entry: Column, own: Column) -> Column:
        descriptor = F.coalesce(up1, F.lit("Unknown role"))
        split, alone = F.regexp_like(descriptor, F.lit(SPLIT)), F.regexp_like(descriptor, F.lit(COMPANY))
        two = up2.isNotNull() & (F.regexp_like(up2, F.lit(TITLE)) | alone)
        beside = F.nullif(strip(F.regexp_replace(strip(F.regexp_replace(line, DATE_RANGE, ""), "|•-"), r"(?i)^(?:email|phone|address|contact|github|linkedin)\s*", ""), "|•-"), F.lit(""))
        pair = lambda title, company: F.struct(title.alias("title"), company.alias("company"))
        named = F.when(split, pair(F.regexp_extract(descriptor, SPLIT, 1), F.regexp_extract(descriptor, SPLIT, 2))).when(two, pair(up2, descriptor))
        named = named.when(alone, pair(F.lit("Intern / Developer"), descriptor)).otherwise(pair(descriptor, F.lit(None).cast("string")))
        # a company on the line of dates counts only where no other is
        named = bind(named, lambda x: F.when(x["company"].isNull() & F.regexp_like(line, F.lit(COMPANY)) & beside.isNotNull(), pair(F.lit("Intern / Developer"), beside)).otherwise(x))
        dates = bind(F.struct(F.regexp_extract(line, DATE_RANGE, 1).alias("start"), F.regexp_extract(line, DATE_RANGE, 2).alias("end")), lambda d: F.struct(*(c.alias(n) for n, c in zip(("start", "end", "current"), period(d["start"], d["end"]), strict=True))))
        return bind(F.struct(named.alias("named"), dates.alias("dates")), lambda x: F.struct(entry.alias("entry"), x["named"]["title"].alias("job_title"), x["named"]["company"].alias("company"), x["dates"]["start"].alias("start_date"), x["dates"]["end"].alias("end_date"), x["dates"]["current"].alias("is_current"), unique(own).alias("description")))

    anchors = F.array_compact(F.transform(body, lambda x, i: F.when(F.regexp_like(x, F.lit(DATE_RANGE)), i)))
    return bind(anchors, told).cast(f"array<{ROLE}>")


def _good(r: Column) -> Column:
    return F.coalesce(r["start_date"].isNotNull() & (r["is_current"] | (r["end_date"] >= r["start_date"])), F.lit(False))


def roles(docs: DataFrame) -> DataFrame:
    """(doc_id, entry from 1, job_title, company, start_date, end_date, is_current, description, achievements, confidence, warning).

    One row per line with a range of dates. The line before it describes the role ("title | company", "title at company");
    failing that the two lines before are title and company; a company may also stand on the line of dates itself. What follows up to
    the next role is description, its lines with a number achievements. warning: INVALID_TIMELINE for reversed and impossible ranges.
    A text is read once, within its row: no window, no join, no sort.
    """
    rows = _bodies(docs, "experience").select("doc_id", F.explode_outer(bind(F.col("body"), roles_of)).alias("r")).where("r IS NOT NULL")
    measured = F.filter("r.description", lambda x: F.regexp_like(x, F.lit(MEASURED)))
    return rows.select("doc_id", "r.*", measured.alias("achievements"), F.when(F.col("r.company").isNotNull(), 0.85).otherwise(0.7).alias("confidence"), F.when(~_good(F.col("r")), "INVALID_TIMELINE").alias("warning"))


def unique(values: Column) -> Column:
    """Texts trimmed, blank ones out, of those alike in lower case the first."""
    bare = F.filter(F.transform(values, lambda x: strip(x)), lambda x: x != "")
    low = F.transform(bare, lambda x: F.lower(x))
    return F.filter(bare, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def experiences_of(body: Column) -> Column:
    """An array of ROLE: the roles that roles() gives no warning, each title, company and period once."""

    def once(a: Column) -> Column:
        same = F.transform(a, lambda r: F.struct(F.lower(r["job_title"]).alias("t"), F.lower(F.coalesce(r["company"], F.lit(""))).alias("c"), r["start_date"].alias("s"), r["end_date"].alias("e")))
        first = lambda k: F.filter(a, lambda r, i: F.array_position(k, F.get(k, i)) == i + 1)
        return bind(same, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(a), a).otherwise(first(k)))  # most texts repeat nothing

    return bind(bind(body, lambda b: F.filter(roles_of(b), _good)), once)


def experiences(docs: DataFrame) -> DataFrame:
    """(doc_id, entry, job_title, company, start_date, end_date, is_current, description): see experiences_of."""
    rows = _bodies(docs, "experience").select("doc_id", F.explode_outer(experiences_of(F.col("body"))).alias("r")).where("r IS NOT NULL")
    return rows.select("doc_id", "r.*").withColumn("description", F.array_join("description", "\n"))


def education(docs: DataFrame) -> DataFrame:
    """(doc_id, institution, degree, field_of_study, start_date, end_date): institution lines with what stands from one line before to two after."""
    near = lambda b: F.transform(b, lambda x, i: F.struct((i + 1).alias("n"), x.alias("line"), F.slice(b, F.greatest(i, F.lit(1)), F.when(i > 0, 4).otherwise(3)).alias("near")))
    named = bind(F.col("body"), lambda b: F.filter(near(b), lambda x: F.regexp_like(x["line"], F.lit(INSTITUTION))))
    rows = _bodies(docs, "education").select("doc_id", F.explode_outer(named).alias("x")).where("x IS NOT NULL").select("doc_id", "x.*")
    degree = F.get(F.filter("near", lambda x: F.regexp_like(x, F.lit(DEGREE))), F.lit(0))
    dated = F.get(F.filter("near", lambda x: F.regexp_like(x, F.lit(DATE_RANGE))), F.lit(0))
    start, end, _ = period(*(F.regexp_extract("dated", DATE_RANGE, k) for k in (1, 2)))
    rows = rows.withColumn("deg", degree).withColumn("dated", dated)
    rows = rows.select("doc_id", "n", F.col("line").alias("institution"), F.when(F.col("deg") != F.col("line"), F.col("deg")).alias("degree"), F.nullif(strip(F.regexp_extract("deg", FIELD, 1)), F.lit("")).alias("field_of_study"), start.alias("start_date"), end.alias("end_date"))
    first = F.row_number().over(Window.partitionBy("doc_id", F.lower("institution"), F.lower(F.coalesce("degree", F.lit("")))).orderBy("n"))
    return rows.withColumn("_r", first).where("_r = 1").drop("_r", "n")


def candidate_name(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, candidate_name, confidence): the first of the first 12 lines that reads like a name: 2 to 7 words with a letter each.

    0.95 for one of the first three lines in capitals, 0.8 for one of the first five, else 0.65.
    """
    from .privacy import PHONE
    from .sections import heading_kind

    kept = F.slice(F.filter(lines(F.col(text)), lambda x: strip(x) != ""), 1, 12)
    rows = docs.select(F.col(doc).alias("doc_id"), F.posexplode(kept).alias("n", "_v")).withColumn("v", strip(F.col("_v"), "|•-"))
    words = F.split("v", r"(?U)\s+")
    like = F.size(words).between(2, 7) & F.length("v").between(3, 70) & F.forall(words, lambda w: F.regexp_like(w, F.lit(r"\p{L}"))) & ~F.regexp_like("v", F.lit(r"(?U)[@\d]"))
    like = like & ~F.regexp_like("v", F.lit(COMPANY)) & ~F.regexp_like("v", F.lit(PHONE)) & ~F.regexp_like("v", F.lit(r"(?i)\b(?:https?://|www\.)")) & heading_kind(F.col("v")).isNull()
    sure = F.when((F.col("n") <= 2) & (F.upper("v") == F.col("v")), 0.95).when(F.col("n") <= 4, 0.8).otherwise(0.65)
    return rows.where(like).groupBy("doc_id").agg(F.min_by("v", "n").alias("candidate_name"), F.min_by(sure, "n").alias("confidence"))


def section_items(sections_: DataFrame, kind: str, out: str) -> DataFrame:
    """(doc_id, out): the different items of all sections of a kind, cut at commas, semicolons, bars and line ends."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_id", "text"))), lambda x: x["text"]), "\n")
    return sections_.where(F.col("section") == kind).groupBy("doc_id").agg(text.alias("_t")).select("doc_id", unique(F.split("_t", r"[,;|\n]+")).alias(out))


def birth_date(text: Column) -> Column:
    """The day behind a label of birth, day before month; null if there is no such day."""
    parts = [F.regexp_extract(text, BIRTH, k) for k in (1, 2, 3)]
    return F.when(parts[2] != "", F.try_to_date(F.concat(parts[2], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[0], 2, "0"))))


def skills_of(docs: DataFrame, sections_: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, canonical_name, name, years, level, evidence, section, confidence): skills of the skills section (0.95), and of the
    whole text those that it lacks (0.75). Short names (C, R, Go) count in the section alone.

    Of a skill's spellings the longest counts, at its first place; years and level stand within 30 letters of it.
    """
    from .taxonomy import SHORT_SKILLS

    own = sections_.where("section = 'skills'").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_id", "text"))), lambda x: x["text"]), "\n").alias("text")).withColumn("section", F.lit("skills"))
    sources = own.unionByName(docs.select("doc_id", "text", F.lit(None).cast("string").alias("section"))).withColumn("_at", F.struct("doc_id", "section"))
    keyed = sources.where("text IS NOT NULL")
    found = _spellings(keyed, table).where(F.col("section").isNotNull() | ~F.col("canonical").isin(*SHORT_SKILLS))
    first = Window.partitionBy("doc_id", "canonical").orderBy(F.col("section").isNull(), F.desc(F.length("alias")), "alias")
    found = found.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    pattern = F.concat(F.lit(r"(?<![\w+#.])"), F.regexp_replace("alias", r"([^\p{L}\p{N}\s_])", r"\\$1"), F.lit(r"(?![\w+#.])"))

    def cut(before: str, after: str) -> Column:
        return F.call_function("regexp_extract", F.col("text"), F.concat(F.lit(f"(?siU)({before}"), pattern, F.lit(f"{after})")), F.lit(1))

    near, spelled = cut(".{0,30}", ".{0,30}"), cut("", "")
    line = strip(F.left(F.substring_index(cut("", ".{0,180}"), "\n", 1), F.lit(180)))
    level = F.lit(None).cast("string")
    for word in reversed(LEVELS):
        level = F.when(F.regexp_like("_near", F.lit(rf"(?i)\b{word}\b")), F.lit(word)).otherwise(level)
    rows = found.withColumn("_near", near)
    return rows.select("doc_id", F.col("canonical").alias("canonical_name"), spelled.alias("name"), F.nullif(F.regexp_extract("_near", r"(?i)(\d+(?:\.\d+)?)\s*(?:years?|yrs?|năm)", 1), F.lit("")).cast("double").alias("years"), level.alias("level"), line.alias("evidence"), "section", F.when(F.col("section").isNotNull(), 0.95).otherwise(0.75).alias("confidence"))


def _spellings(rows: DataFrame, table: DataFrame) -> DataFrame:
    """`rows` (doc_id, text, section) with each alias that stands in them under the strict rule; the canonical name itself is none unless listed."""
    from .taxonomy import alias_hits

    return alias_hits(rows, table, ("doc_id", "section", "text"), edge="+#.")


def profiles(docs: DataFrame, skills: DataFrame, *, as_of: date) -> DataFrame:
    """One row per document, all that rules can read: document.PROFILE's fields as far as there are, and sections' counts.

    candidate_name, email, phone, urls, address, date_of_birth, headline, summary, skills (names), skill_details, n_jobs,
    first_start, n_schools, institution, languages, certifications, years, field_confidence, warnings.
    """
    from .privacy import contacts
    from .sections import detect_sections
    from .timeline import merged_years

    found = detect_sections(docs)
    told = roles(docs)
    jobs = experiences(docs)
    years = merged_years(jobs, key="doc_id", start="start_date", end="end_date", as_of=as_of).select("doc_id", "years")
    detail = F.struct("canonical_name", "name", "years", "level", "evidence", "section", "confidence")
    known = skills_of(docs, found, skills).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.lower("canonical_name").alias("k"), detail.alias("s")))).alias("_s"))
    known = known.select("doc_id", F.array_join(F.transform("_s", lambda x: x["s"]["canonical_name"]), ", ").alias("skills"), F.transform("_s", lambda x: x["s"]).alias("skill_details"))
    worked = jobs.groupBy("doc_id").agg(F.count("*").alias("n_jobs"), F.min("start_date").alias("first_start"))
    broken = told.where("warning IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_list("warning")).alias("_broken"))
    schools = education(docs).groupBy("doc_id").agg(F.count("*").alias("n_schools"), F.min("institution").alias("institution"))
    joined = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == kind, F.struct("section_id", "text")))), lambda x: x["text"]), "\n")
    parts = found.groupBy("doc_id").agg(F.nullif(strip(joined("summary")), F.lit("")).alias("summary"), F.max(F.when(F.col("section") == "header", F.col("text"))).alias("_header"), F.bool_or(F.col("section") == "skills").alias("_listed"), F.bool_or(F.col("section") == "education").alias("_schooled"))
    out = contacts(docs).select("doc_id", F.lower("email").alias("email"), "phone", "urls", "address")
    out = out.join(docs.select("doc_id", "text", birth_date(F.col("text")).alias("date_of_birth")), "doc_id", "left")
    for part in (candidate_name(docs), known, worked, broken, schools, years, parts, section_items(found, "languages", "languages"), section_items(found, "certifications", "certifications")):
        out = out.join(part, "doc_id", "left")
    kept = F.filter(lines(F.coalesce("_header", F.array_join(F.slice(F.filter(lines(F.col("text")), lambda x: strip(x) != ""), 1, 5), "\n"))), lambda x: F.regexp_like(x, F.lit(TITLE)) & ~strip(x).eqNullSafe(F.col("candidate_name")))
    has = lambda c, v: F.when(c, v).otherwise(0.0)
    confidence = F.create_map(
        F.lit("candidateName"), F.coalesce("confidence", F.lit(0.0)), F.lit("email"), has(F.col("email").isNotNull(), 0.98), F.lit("phone"), has(F.col("phone").isNotNull(), 0.9),
        F.lit("skills"), F.when(F.coalesce("_listed", F.lit(False)), 0.9).otherwise(0.7), F.lit("experience"), has(F.coalesce("n_jobs", F.lit(0)) > 0, 0.85), F.lit("education"), has(F.coalesce("_schooled", F.lit(False)), 0.85),
    )
    warnings = F.concat(F.coalesce("_broken", F.array().cast("array<string>")), F.array_compact(F.array(F.when(F.col("candidate_name").isNull(), "LOW_CONFIDENCE_NAME"), F.when(F.col("email").isNull() & F.col("phone").isNull(), "MISSING_CONTACT"))))
    return out.withColumn("headline", strip(F.get(kept, F.lit(0)))).withColumn("field_confidence", confidence).withColumn("warnings", warnings).drop("text", "confidence", "_header", "_listed", "_schooled", "_broken")
