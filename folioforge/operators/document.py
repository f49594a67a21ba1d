"""Documents and profiles in one row each: the shapes that binding and reconciliation work on.

A document's blocks are read in order once, by windows, and then lie in one array of its row; so whatever compares a
profile's entries with its blocks is an expression over that row, without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.text import bind, clean, strip

from .sections import heading_kind

EVIDENCE = "array<struct<text:string,page_number:int,block_id:string>>"
EXPERIENCE = f"struct<job_title:string,company:string,location:string,start_date:date,end_date:date,is_current:boolean,description:array<string>,achievements:array<string>,skills:array<string>,evidence:{EVIDENCE},confidence:double>"
PROJECT = f"struct<title:string,role:string,description:array<string>,achievements:array<string>,skills:array<string>,start_date:date,end_date:date,evidence:{EVIDENCE},confidence:double>"
EDUCATION = f"struct<institution:string,degree:string,field_of_study:string,location:string,start_date:date,end_date:date,coursework:array<string>,evidence:{EVIDENCE},confidence:double>"
SKILL = "struct<name:string,canonical_name:string,years:double,level:string,evidence:array<string>,evidence_types:array<string>,confidence:double>"
AWARD = f"struct<title:string,issuer:string,evidence:{EVIDENCE}>"
LANGUAGE = f"struct<language:string,proficiency:string,exam:string,issuer:string,evidence:{EVIDENCE}>"
#: Columns of a profile besides doc_id. Fixed by the data model.
PROFILE = {
    "candidate_name": "string", "email": "string", "phone": "string", "urls": "array<string>", "address": "string", "date_of_birth": "date", "headline": "string", "summary": "string",
    "skills": f"array<{SKILL}>", "experiences": f"array<{EXPERIENCE}>", "education": f"array<{EDUCATION}>", "projects": f"array<{PROJECT}>",
    "honors_awards": f"array<{AWARD}>", "language_proficiencies": f"array<{LANGUAGE}>", "languages": "array<string>", "certifications": "array<string>",
    "field_evidence": f"map<string,{EVIDENCE}>", "field_confidence": "map<string,double>", "warnings": "array<struct<code:string,stage:string>>",
}

#: Words of a block that turn it and what follows to research or to work, for the third section rule. Fixed values.
RESEARCH_WORDS = ("research", "publication", "paper", "journal")
WORK_WORDS = ("work experience", "professional experience", "employment")


def as_profiles(rows: DataFrame) -> DataFrame:
    """`rows` with all columns of a profile, in their types; those that are not there are null, and lists empty."""
    known = {c.lower() for c in rows.columns}

    def column(name: str, kind: str) -> Column:
        have = F.col(name) if name in known else F.lit(None)
        return (F.coalesce(have.cast(kind), F.expr("array()").cast(kind)) if kind.startswith("array") else have.cast(kind)).alias(name)

    return rows.select("doc_id", *(column(n, k) for n, k in PROFILE.items()), *(c for c in rows.columns if c not in PROFILE and c != "doc_id"))


def holds(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def squeezed(value: Column) -> Column:
    """Letters and digits (and _) alone, in lower case; empty for null."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"(?U)\W+", "")


def annotate(blocks: DataFrame) -> DataFrame:
    """Blocks with clean, low (clean in lower case), norm, heading, page_section (the heading before, on this page), section (the heading before, over
    pages) and told (research or work_experience by the third rule)."""
    upto = Window.partitionBy("doc_id").orderBy("page_number", "reading_order").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumn("clean", F.coalesce(clean(F.col("text")), F.lit(""))).withColumn("low", F.lower("clean")).withColumn("norm", squeezed(F.col("text"))).withColumn("heading", heading_kind(F.col("text")))
    key = F.lower("clean")
    told = F.when(holds(key, RESEARCH_WORDS), "research").when(holds(key, WORK_WORDS), "work_experience")
    rows = rows.withColumn("_opened", F.when(F.col("heading").isNotNull(), F.struct("page_number", "heading"))).withColumn("_told", told)
    rows = rows.withColumn("_last", F.last("_opened", True).over(upto)).withColumn("told", F.last("_told", True).over(upto))
    rows = rows.withColumn("page_section", F.when(F.col("_last.page_number") == F.col("page_number"), F.col("_last.heading"))).withColumn("section", F.col("_last.heading"))
    return rows.drop("_opened", "_told", "_last")


def gathered(blocks: DataFrame, *, kinds: bool = True) -> DataFrame:
    """(doc_id, blocks): the blocks of each document in order, as one array, as they are.

    They are dealt to tasks by document before anything is made of them: a small file of many rows is few tasks. Without `kinds` they
    have no type and no place on the page.
    """
    boxes = [F.col(c).cast("double").alias(c) if c in blocks.columns else F.lit(None).cast("double").alias(c) for c in ("y0", "y1")]
    one = F.struct(F.col("page_number").cast("int").alias("page_number"), F.col("reading_order").cast("int").alias("reading_order"), "block_id", *(["block_type", "text", *boxes] if kinds else ["text"]))
    return blocks.select("doc_id", one.alias("b")).repartition("doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list("b")).alias("blocks"))


def annotated(blocks: Column) -> Column:
    """gathered() blocks with what annotate() adds, in step with the blocks and the headings among them, without a window."""

    def read(b: Column) -> Column:
        made = lambda c, low: F.struct(*(b[n].alias(n) for n in ("page_number", "reading_order", "block_id", "block_type", "text")), c.alias("clean"), low.alias("low"), squeezed(b["text"]).alias("norm"), heading_kind(b["text"]).alias("heading"), *(b[n].alias(n) for n in ("y0", "y1")))
        return bind(F.coalesce(clean(b["text"]), F.lit("")), lambda c: bind(F.lower(c), lambda low: made(c, low)))

    def marks(a: Column) -> Column:
        said = lambda b: F.when(holds(b["low"], RESEARCH_WORDS), "research").when(holds(b["low"], WORK_WORDS), "work_experience")
        opened = F.transform(a, lambda b, i: F.struct(i.alias("i"), b["page_number"].alias("page_number"), b["heading"].alias("kind")))
        told = F.transform(a, lambda b, i: F.struct(i.alias("i"), said(b).alias("kind")))
        return F.struct(a.alias("a"), F.filter(opened, lambda x: x["kind"].isNotNull()).alias("opened"), F.filter(told, lambda x: x["kind"].isNotNull()).alias("told"))

    def placed(m: Column) -> Column:
        last = lambda found, i: bind(F.filter(found, lambda x: x["i"] <= i), lambda f: F.get(f, F.size(f) - 1))

        def one(b: Column, i: Column) -> Column:
            return bind(F.struct(last(m["opened"], i).alias("o"), last(m["told"], i).alias("t")), lambda x: F.struct(
                *(b[n].alias(n) for n in ("page_number", "reading_order", "block_id", "block_type", "text", "clean", "low", "norm", "heading")),
                F.when(x["o"]["page_number"] == b["page_number"], x["o"]["kind"]).alias("page_section"), x["o"]["kind"].alias("section"), x["t"]["kind"].alias("told"), *(b[n].alias(n) for n in ("y0", "y1")),
            ))

        return F.transform(m["a"], one)

    return bind(bind(F.transform(blocks, read), marks), placed)


def with_blocks(profiles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Profiles with the blocks of their document; an empty array where there are none.

    Blocks meet profiles as they are and are read after that, so that what is shuffled and sorted is small. They are not broadcast,
    however small: the work that follows would then be done in as many tasks as files of profiles are read in.
    """
    held = gathered(blocks)
    rows = profiles.join(held.hint("merge"), "doc_id", "left")
    return rows.withColumn("blocks", annotated(F.coalesce("blocks", F.array().cast(held.schema["blocks"].dataType))))


def with_headings(profiles: DataFrame, blocks: DataFrame) -> DataFrame:
    """with_blocks() for what asks for texts and headings alone: of annotate()'s columns only the heading is made."""
    held = gathered(blocks, kinds=False)
    rows = profiles.join(held.hint("merge"), "doc_id", "left")
    read = lambda b: F.struct(*(b[n].alias(n) for n in ("page_number", "reading_order", "block_id", "text")), heading_kind(b["text"]).alias("heading"))
    return rows.withColumn("blocks", F.transform(F.coalesce("blocks", F.array().cast(held.schema["blocks"].dataType)), read))


def no_evidence() -> Column:
    return F.expr("array()").cast(EVIDENCE)


def grounded(e: Column) -> Column:
    """Whether the cleaned text of one reference stands, as it is, in the very block that it names; empty text never does."""
    block = F.get(F.filter("blocks", lambda b: (b["page_number"] == e["page_number"]) & (b["block_id"] == e["block_id"])), F.lit(0))
    return F.coalesce(F.contains(block["clean"], clean(e["text"])), F.lit(False))


def all_grounded(evidence: Column) -> Column:
    return (F.size(F.coalesce(evidence, no_evidence())) > 0) & F.forall(F.coalesce(evidence, no_evidence()), grounded)


def supports(evidence: Column, value: Column) -> Column:
    """Whether some reference holds the value, in any case; an empty value asks for nothing."""
    target = F.lower(clean(value))
    return target.isNull() | F.exists(F.coalesce(evidence, no_evidence()), lambda e: F.coalesce(F.contains(F.lower(clean(e["text"])), target), F.lit(False)))


def section_kinds(evidence: Column) -> Column:
    """The sections, page by page, of the blocks that references name."""
    cited = F.filter("blocks", lambda b: b["page_section"].isNotNull() & F.exists(F.coalesce(evidence, no_evidence()), lambda e: (e["page_number"] == b["page_number"]) & (e["block_id"] == b["block_id"])))
    return F.array_distinct(F.transform(cited, lambda b: b["page_section"]))


def asked(title: Column, company: Column) -> Column:
    """Title and company as in_experience_section looks for them."""
    return F.struct(*(F.lower(strip(F.coalesce(x, F.lit("")))).alias(n) for n, x in (("title", title), ("company", company))))


def in_experience_section(q: Column) -> Column:
    """Whether the title (5 letters at least) or the company (4), as asked() gives them, stands in a block of an experience section."""
    here = lambda b: b["heading"].isNull() & (b["section"] == "experience")
    return F.exists("blocks", lambda b: F.coalesce(here(b) & (((F.length(q["title"]) >= 5) & F.contains(b["low"], q["title"])) | ((F.length(q["company"]) >= 4) & F.contains(b["low"], q["company"]))), F.lit(False)))


def has_section(kind: str) -> Column:
    return F.exists("blocks", lambda b: F.coalesce(b["heading"] == kind, F.lit(False)))
