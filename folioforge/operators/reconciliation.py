"""Profiles held against their document: what is not borne out is cleared, dropped or flagged, what was missed is recovered.

Each step is a function from profiles (with blocks, see document.with_blocks) to profiles, by expressions over the row.
reconcile() runs them in order. Open ends run to `as_of`, never to the clock.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.text import bind, clean, fingerprint, lines, strip
from folioforge.storage import materialize

from .document import EDUCATION, EVIDENCE, EXPERIENCE, SKILL, all_grounded, as_profiles, asked, grounded, has_section, holds, in_experience_section, no_evidence, section_kinds, supports, with_blocks
from .evidence import tiered
from .reconcile import is_achievement, plain_title, same_role
from .timeline import SECONDARY_ROLES, overlap_fraction

#: Places that are taken for names, and words that no name holds. Fixed values.
PLACES = ("sydney", "australia", "singapore", "vietnam", "việt nam", "ho chi minh city", "hanoi", "hà nội", "da nang", "đà nẵng", "dublin", "ireland")
NO_NAME = r"(?iU)\b(?:graduated|bachelor|master|degree|engineer|developer|architect|analyst|intern|fresher|scientist)\b"
#: Names that models put where they found none. Fixed values.
PLACEHOLDERS = ("Candidate Name", "Alex Morgan", "UNKNOWN CANDIDATE")
LONGEST_HEADLINE = 100
#: Words that open and close the scan for a school, name a school, and tell a course of study. Fixed values.
EDUCATION_OPENS = ("education", "học vấn", "trình độ học vấn", "bằng cấp", "học tập")
EDUCATION_CLOSES = ("experience", "projects", "skills", "work", "kinh nghiệm", "kỹ năng", "dự án", "certifications")
SCHOOL_WORDS = ("university", "trường", "đại học", "học viện", "institute", "college", "academy")
STUDY_WORDS = ("graduated", "computer science", "công nghệ thông tin", "bachelor", "master", "engineer", "kỹ sư", "cử nhân", "chuyên ngành")


# ---- names and headlines


def is_place(name: Column) -> Column:
    """A place of the list, or two of them side by side."""
    key = strip(F.lower(name))
    parts = F.array_distinct(F.transform(F.split(key, r"[,|/]"), lambda p: strip(p)))
    return F.coalesce(key.isin(*PLACES) | (F.size(F.filter(parts, lambda p: p.isin(*PLACES))) >= 2), F.lit(False))


def is_no_name(name: Column) -> Column:
    c = clean(name)
    return c.isNull() | is_place(c) | F.regexp_like(c, F.lit(NO_NAME))


def _identity(name: Column) -> Column:
    return F.lower(clean(name))


def settle_name(profiles: DataFrame, *, fallback: bool = True) -> DataFrame:
    """candidate_name as the document spells it, and name_is_place.

    A place is no name. A missing or placeholder name is the first block of two to five words of letters alone ("Last,
    First" turned round). A grounded reference to the same name in another case gives its spelling.
    """
    raw = clean(F.col("candidate_name"))
    like = F.filter("blocks", lambda b: (b["clean"] != "") & ~F.startswith(b["clean"], F.lit("##")) & ~F.regexp_like(b["clean"], F.lit("[@+]")) & F.size(F.split(b["clean"], " ")).between(2, 5) & F.regexp_like(F.translate(b["clean"], " ,", ""), F.lit(r"^\p{L}+$")) & ~is_no_name(b["clean"]))
    first = F.get(F.transform(like, lambda b: b["clean"]), F.lit(0))
    turned = F.array_join(F.reverse(F.filter(F.transform(F.split(first, ","), lambda p: strip(p)), lambda p: p != "")), " ")
    told = raw.isNotNull() & ~raw.isin(*PLACEHOLDERS)
    name = F.when(told, F.when(~is_no_name(raw), raw)).otherwise(F.when(F.contains(first, F.lit(",")), turned).otherwise(first))
    out = profiles.withColumn("name_is_place", F.coalesce(is_place(raw), F.lit(False)))
    out = out.withColumn("_name", F.when(~F.col("name_is_place") & (F.lit(fallback) | raw.isNotNull()), name))
    cited = F.coalesce(F.element_at("field_evidence", "candidateName"), no_evidence())
    spelled = F.get(F.filter(cited, lambda e: (_identity(e["text"]) == _identity(F.col("_name"))) & grounded(e)), F.lit(0))["text"]
    return out.withColumn("candidate_name", F.when(F.col("_name").isNotNull(), F.coalesce(clean(spelled), "_name"))).drop("_name")


def settle_headline(profiles: DataFrame) -> DataFrame:
    """headline cleaned; null if over 100 letters or the name itself."""
    h = clean(F.col("headline"))
    return profiles.withColumn("headline", F.when((F.length(h) <= LONGEST_HEADLINE) & ~h.eqNullSafe(F.col("candidate_name")), h))


# ---- entries against their evidence


def count_ungrounded(profiles: DataFrame) -> DataFrame:
    """ungrounded: references of any field or entry that their block does not hold; name_ungrounded: one of the name's."""
    lists = [F.flatten(F.map_values("field_evidence")), *(F.flatten(F.transform(c, lambda x: F.coalesce(x["evidence"], no_evidence()))) for c in ("experiences", "education", "projects", "honors_awards", "language_proficiencies"))]
    every = F.concat(*(F.coalesce(x, no_evidence()) for x in lists))
    name = F.coalesce(F.element_at("field_evidence", "candidateName"), no_evidence())
    return profiles.withColumn("ungrounded", F.size(F.filter(every, lambda e: ~grounded(e)))).withColumn("name_ungrounded", F.exists(name, lambda e: ~grounded(e)))


def _record(kind: str, i: Column, primary: Column, secondary: Column, evidence: Column, kinds: Column, more: dict[str, Column]) -> Column:
    mark = fingerprint(F.lit(kind), F.coalesce(primary, F.lit("")), F.coalesce(secondary, F.lit("")))
    return F.struct(F.lit(kind).alias("kind"), i.alias("entry"), mark.alias("fingerprint"), F.size(F.coalesce(evidence, no_evidence())).alias("references"), F.sort_array(kinds).alias("sections"), *(c.alias(n) for n, c in more.items()))


def validate_experiences(profiles: DataFrame) -> DataFrame:
    """experiences that stand, and experience_verdicts, one for each entry.

    Tier 1: all references grounded, the role in them, not from projects alone; company, place and the years of dates that
    no reference holds are cleared, and a role is current only without an end. Tier 2: title or company in an experience section,
    kept as it is. Tier 0: dropped.
    """
    seen = F.transform("experiences", lambda e: F.struct(all_grounded(e["evidence"]).alias("grounded"), supports(e["evidence"], e["job_title"]).alias("role_supported"), section_kinds(e["evidence"]).alias("kinds"), asked(e["job_title"], e["company"]).alias("asked")))
    seen = F.transform(seen, lambda s: s.withField("inferred", in_experience_section(s["asked"])).dropFields("asked"))
    out = profiles.withColumn("_s", seen)

    def settled(e: Column) -> Column:
        start = F.when(supports(e["evidence"], F.year(e["start_date"]).cast("string")), e["start_date"])
        end = F.when(supports(e["evidence"], F.year(e["end_date"]).cast("string")), e["end_date"])
        e = e.withField("company", F.when(supports(e["evidence"], e["company"]), e["company"])).withField("location", F.when(supports(e["evidence"], e["location"]), e["location"]))
        return e.withField("start_date", start).withField("end_date", end).withField("is_current", F.coalesce(e["is_current"], F.lit(False)) & end.isNull())

    out = out.withColumn("_k", F.transform("experiences", settled))

    def verdict(z: Column, i: Column) -> Column:
        e, s, k = z["experiences"], z["_s"], z["_k"]
        tier, reason = tiered(s["grounded"], s["role_supported"], (F.size(s["kinds"]) > 0) & F.forall(s["kinds"], lambda x: x == "projects"), s["inferred"])
        gone = F.array_compact(F.array(*(F.when((tier == 1) & ~e[c].eqNullSafe(k[c]), F.lit(n)) for c, n in (("company", "company"), ("location", "location"), ("start_date", "startDate"), ("end_date", "endDate")))))
        return _record("experience", i, e["job_title"], e["company"], e["evidence"], s["kinds"], {"tier": tier, "decision": F.when(tier > 0, "kept").otherwise("dropped"), "reason_code": reason, "cleared": gone})

    out = out.withColumn("experience_verdicts", F.transform(F.arrays_zip("experiences", "_s", "_k"), verdict))
    kept = F.transform(F.filter(F.arrays_zip("experiences", "_k", "experience_verdicts"), lambda z: z["experience_verdicts"]["tier"] > 0), lambda z: F.when(z["experience_verdicts"]["tier"] == 1, z["_k"]).otherwise(z["experiences"]))
    return out.withColumn("experiences", kept).drop("_s", "_k")


def validate_projects(profiles: DataFrame) -> DataFrame:
    """projects whose references are all grounded and hold the title, and project_verdicts."""

    def verdict(p: Column, i: Column) -> Column:
        held, titled = all_grounded(p["evidence"]), supports(p["evidence"], p["title"])
        reason = F.when(held & titled, "VERIFIED").when(~held, "EVIDENCE_NOT_GROUNDED").otherwise("TITLE_NOT_SUPPORTED_BY_EVIDENCE")
        return _record("project", i, p["title"], p["role"], p["evidence"], section_kinds(p["evidence"]), {"tier": (held & titled).cast("int"), "decision": F.when(held & titled, "kept").otherwise("dropped"), "reason_code": reason, "cleared": F.array().cast("array<string>")})

    out = profiles.withColumn("project_verdicts", F.transform("projects", verdict))
    kept = F.filter(F.arrays_zip("projects", "project_verdicts"), lambda z: z["project_verdicts"]["tier"] > 0)
    return out.withColumn("projects", F.transform(kept, lambda z: z["projects"]))


def keep_grounded(profiles: DataFrame) -> DataFrame:
    """Awards and languages with references, all of them grounded; their texts cleaned."""
    awards = F.transform(F.filter("honors_awards", lambda a: all_grounded(a["evidence"])), lambda a: a.withField("title", F.coalesce(clean(a["title"]), a["title"])).withField("issuer", clean(a["issuer"])))
    spoken = F.transform(F.filter("language_proficiencies", lambda a: all_grounded(a["evidence"])), lambda a: a.withField("language", F.coalesce(clean(a["language"]), a["language"])).withField("proficiency", clean(a["proficiency"])).withField("exam", clean(a["exam"])).withField("issuer", clean(a["issuer"])))
    return profiles.withColumn("honors_awards", awards).withColumn("language_proficiencies", spoken)


# ---- one role told twice


def _one_role(a: Column, b: Column, as_of: date, least: float) -> Column:
    company = lambda e: strip(F.lower(F.coalesce(e["company"], F.lit(""))))
    end = lambda e: F.coalesce(e["end_date"], F.lit(as_of))
    part = overlap_fraction(a["start_date"], end(a), b["start_date"], end(b))
    dated = a["start_date"].isNotNull() & b["start_date"].isNotNull()
    titles = same_role(a["job_title"], b["job_title"])
    return (company(a) != "") & (company(a) == company(b)) & F.when(dated, (part >= least) & ((part >= 1.0) | titles)).otherwise(titles)


def _union(a: Column, b: Column) -> Column:
    """All of the first list, then what of the second is not in it."""
    empty = F.expr("array()").cast("array<string>")
    first = F.coalesce(a, empty)
    return F.concat(first, F.filter(F.coalesce(b, empty), lambda x: ~F.array_contains(first, x)))


def merged(a: Column, b: Column, as_of: date) -> Column:
    """Two entries of one role as one: the wider title or both, the whole period, one reference a block, all lines."""
    x, y = strip(F.coalesce(a["job_title"], F.lit(""))), strip(F.coalesce(b["job_title"], F.lit("")))
    title = F.when(F.contains(plain_title(y), plain_title(x)), y).when(F.contains(plain_title(x), plain_title(y)), x).otherwise(F.concat(x, F.lit(" / "), y))
    current = F.coalesce(a["is_current"], F.lit(False)) | F.coalesce(b["is_current"], F.lit(False))
    evidence = F.concat(F.coalesce(a["evidence"], no_evidence()), F.coalesce(b["evidence"], no_evidence()))
    ids = F.transform(evidence, lambda e: F.coalesce(e["block_id"], F.lit("")))
    once = F.filter(evidence, lambda e, i: F.array_position(ids, F.coalesce(e["block_id"], F.lit(""))) == i + 1)
    out = a.withField("job_title", title).withField("start_date", F.least(a["start_date"], b["start_date"])).withField("end_date", F.when(~current, F.greatest(a["end_date"], b["end_date"])))
    out = out.withField("is_current", current).withField("evidence", once).withField("confidence", F.least(a["confidence"], b["confidence"]))
    for c in ("description", "achievements", "skills"):
        out = out.withField(c, _union(a[c], b[c]))
    return out


def groups_of_roles(experiences: Column, as_of: date, least: float) -> Column:
    """Entries in groups of one role: (at, head, more), `at` the head's place from 1. From left to right an entry joins the
    first head before it that is the same role (see _one_role), as that stood before it took others in."""
    kind = f"array<struct<at:int,head:{EXPERIENCE},more:array<{EXPERIENCE}>>>"
    start = F.struct(F.lit(0).alias("n"), F.expr("array()").cast(kind).alias("g"))

    def add(a: Column, e: Column) -> Column:
        fits = F.transform(a["g"], lambda g: F.coalesce(_one_role(g["head"], e, as_of, least), F.lit(False)))
        at = F.array_position(fits, True)
        joined = F.transform(a["g"], lambda g, i: F.struct(g["at"].alias("at"), g["head"].alias("head"), F.when(i + 1 == at, F.array_append(g["more"], e)).otherwise(g["more"]).alias("more")))
        new = F.array_append(a["g"], F.struct((a["n"] + 1).alias("at"), e.alias("head"), F.expr("array()").cast(f"array<{EXPERIENCE}>").alias("more")))
        return F.struct((a["n"] + 1).alias("n"), F.when(at > 0, joined).otherwise(new).cast(kind).alias("g"))

    return F.aggregate(experiences, start, add, lambda a: a["g"])


def merge_experiences(profiles: DataFrame, *, as_of: date, least: float = 0.8) -> DataFrame:
    """experiences with each role once, and n_merged. Those that joined a head are merged into it from the last to the first."""
    out = profiles.withColumn("_g", groups_of_roles(F.col("experiences"), as_of, least))
    one = F.transform("_g", lambda g: F.aggregate(F.reverse(g["more"]), g["head"], lambda a, b: merged(a, b, as_of).cast(EXPERIENCE)))
    return out.withColumn("n_merged", F.size("experiences") - F.size("_g")).withColumn("experiences", one).drop("_g")


# ---- lines


def split_achievements(lines: Column, known: Column) -> tuple[Column, Column]:
    """(descriptions, achievements): lines that state a measured result join `known`, once each; should nothing be left, the
    descriptions stay whole."""
    empty = F.expr("array()").cast("array<string>")
    tidy = F.filter(F.transform(F.coalesce(lines, empty), lambda x: clean(x)), lambda x: x.isNotNull())
    held = F.filter(F.transform(F.coalesce(known, empty), lambda x: clean(x)), lambda x: x.isNotNull())
    moves = lambda x, i: is_achievement(x) & ~F.array_contains(held, x) & (F.array_position(tidy, x) == i + 1)
    rest = F.filter(tidy, lambda x, i: ~moves(x, i))
    return F.when(F.size(rest) > 0, rest).otherwise(tidy), F.concat(held, F.filter(tidy, moves))


def tidy_entries(profiles: DataFrame) -> DataFrame:
    """Texts of experiences, projects and education cleaned, achievements apart, project dates without their year in a reference cleared."""

    def experience(e: Column) -> Column:
        told, done = split_achievements(e["description"], e["achievements"])
        return e.withField("job_title", F.coalesce(clean(e["job_title"]), e["job_title"])).withField("company", clean(e["company"])).withField("location", clean(e["location"])).withField("description", told).withField("achievements", done)

    def dated(p: Column, c: str) -> Column:
        year = F.year(p[c]).cast("string")
        return F.when(F.exists(F.coalesce(p["evidence"], no_evidence()), lambda e: F.contains(e["text"], year)), p[c])

    def project(p: Column) -> Column:
        told, done = split_achievements(p["description"], p["achievements"])
        return p.withField("title", F.coalesce(clean(p["title"]), p["title"])).withField("role", clean(p["role"])).withField("description", told).withField("achievements", done).withField("start_date", dated(p, "start_date")).withField("end_date", dated(p, "end_date"))

    def school(s: Column) -> Column:
        courses = F.filter(F.transform(F.coalesce(s["coursework"], F.expr("array()").cast("array<string>")), lambda x: clean(x)), lambda x: x.isNotNull())
        return s.withField("institution", F.coalesce(clean(s["institution"]), s["institution"])).withField("degree", clean(s["degree"])).withField("field_of_study", clean(s["field_of_study"])).withField("location", clean(s["location"])).withField("coursework", courses)

    return profiles.withColumn("experiences", F.transform("experiences", experience)).withColumn("projects", F.transform("projects", project)).withColumn("education", F.transform("education", school))


# ---- what was missed


def recover_education(profiles: DataFrame) -> DataFrame:
    """education of profiles that have none: one school from their blocks.

    A block with an opening word starts the scan, a heading or a block with a closing word ends it. The first block that
    names a school is the institution; blocks that tell a course of study give the field, the last that says so outright.
    """
    fold = F.aggregate(
        "blocks", F.struct(F.lit(False).alias("open"), F.expr("array()").cast("array<struct<text:string,page_number:int,block_id:string>>").alias("found")),
        lambda a, b: F.when(holds(F.lower(b["clean"]), EDUCATION_OPENS), F.struct(F.lit(True).alias("open"), a["found"].alias("found")))
        .when(~a["open"], a)
        .when((b["block_type"] == "section_header") | holds(F.lower(b["clean"]), EDUCATION_CLOSES), F.struct(F.lit(False).alias("open"), a["found"].alias("found")))
        .otherwise(F.struct(F.lit(True).alias("open"), F.when(b["clean"] != "", F.array_append(a["found"], F.struct(strip(F.regexp_replace(b["clean"], "^##", "")).alias("text"), b["page_number"].alias("page_number"), b["block_id"].alias("block_id")))).otherwise(a["found"]).alias("found"))),
        lambda a: a["found"],
    )
    out = profiles.withColumn("_f", F.when(F.size("education") == 0, fold))
    school = lambda e: holds(F.lower(e["text"]), SCHOOL_WORDS)
    study = lambda e: holds(F.lower(e["text"]), STUDY_WORDS)
    out = out.withColumn("_i", F.array_position(F.transform("_f", school), True))
    used = F.filter("_f", lambda e, i: (i + 1 == F.col("_i")) | study(e))
    courses = F.filter("_f", lambda e, i: (i + 1 != F.col("_i")) & study(e))
    in_, major = F.lit("graduated in"), F.lit("chuyên ngành:")

    def field(a: Column, e: Column) -> Column:
        low = F.lower(e["text"])
        after = lambda mark: strip(F.substring(e["text"], F.instr(e["text"], mark) + len(mark), 10_000))
        return F.when(F.contains(low, in_), after("in")).when(F.contains(low, major), F.when(F.contains(e["text"], major), after("chuyên ngành:")).otherwise(e["text"])).when(F.coalesce(a, F.lit("")) == "", e["text"]).otherwise(a)

    out = out.withColumn("_s", F.aggregate(courses, F.lit(None).cast("string"), field)).withColumn("_e", used)
    name = F.when(F.col("_i") > 0, F.get("_f", (F.col("_i") - 1).cast("int"))["text"])
    one = F.struct(F.coalesce(name, F.lit("Unspecified Institution")).alias("institution"), F.lit(None).cast("string").alias("degree"), F.col("_s").alias("field_of_study"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.array().cast("array<string>").alias("coursework"), F.col("_e").cast(EVIDENCE).alias("evidence"), F.lit(0.9).alias("confidence")).cast(EDUCATION)
    found = F.coalesce((F.size("education") == 0) & (name.isNotNull() | (F.coalesce("_s", F.lit("")) != "")), F.lit(False))
    return out.withColumn("education", F.when(found, F.array(one)).otherwise(F.col("education"))).drop("_f", "_i", "_s", "_e")


def recover_experiences(profiles: DataFrame) -> DataFrame:
    """experiences of profiles that have none though their document has such a section: those that the rules of
    extract.experiences find in it; and missing_expected: a section of experiences or projects gave no entry. A document is
    read within its row: no shuffle, no join."""
    from .extract import body_of, experiences_of

    bare = has_section("experience") & (F.size("experiences") == 0)
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    empty, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    one = lambda r: F.struct(r["job_title"].alias("job_title"), r["company"].alias("company"), none.alias("location"), *(r[c].alias(c) for c in ("start_date", "end_date", "is_current")), F.split(F.array_join(r["description"], "\n"), "\n").alias("description"), empty.alias("achievements"), empty.alias("skills"), no_evidence().alias("evidence"), F.when(r["company"].isNotNull(), 0.85).otherwise(0.7).alias("confidence")).cast(EXPERIENCE)
    found = F.transform(bind(body_of(lines(text), "experience"), experiences_of), one)
    given = F.when(bare, bind(found, lambda x: F.when(F.size(x) > 0, x)))
    missing = bare | (has_section("projects") & (F.size("projects") == 0))
    return profiles.withColumns({"missing_expected": missing, "experiences": F.coalesce(given, "experiences")})


#: Blocks and profiles of enrich_skills for one task, about.
ROWS_AT_ONCE = 100_000


def enrich_skills(profiles: DataFrame, blocks: DataFrame, table: DataFrame) -> DataFrame:
    """skills joined, by canonical name, with those that the document spells out: all their kinds of evidence, listed if none.

    `table` is a skill table (taxonomy.skill_table). A skill of the profile that the table's mentions do not find takes its
    kinds from the blocks that hold its name. Documents are dealt to as many tasks as there are rows for, once, so that a task
    holds as many blocks in a large table as in a small one.
    """
    from . import taxonomy
    from .document import annotate
    from .features import kinds_among, with_section

    tasks = max(-(-(blocks.count() + profiles.count()) // ROWS_AT_ONCE), profiles.sparkSession.sparkContext.defaultParallelism)
    rows = annotate(with_section(blocks, tasks))
    line = F.when(F.col("told").isNotNull(), F.coalesce(clean(F.col("text")), F.lit("")))
    found = taxonomy.alias_hits(rows, table, ("doc_id", "text", "evidence_type", "told")).groupBy("doc_id", "canonical").agg(kinds_among(F.col("evidence_type"), F.col("told")).alias("types"), F.sort_array(F.collect_set(line)).alias("lines"))
    dealt = profiles.repartition(tasks, "doc_id")
    own = dealt.select("doc_id", F.posexplode("skills").alias("n", "s")).withColumn("k", F.lower(strip(F.coalesce("s.canonical_name", "s.name"))))
    spelled = table.select(F.col("alias").alias("k"), F.col("canonical").alias("_c"))
    spelled = F.broadcast(spelled) if table.count() <= taxonomy.SMALL else spelled  # dealt by spelling, a common skill would gather in one task
    own = own.join(spelled, "k", "left").withColumn("canonical", F.coalesce("_c", strip(F.coalesce("s.canonical_name", "s.name"))))
    own = own.select("doc_id", F.lower("canonical").alias("k"), "canonical", "n", "s")
    named = own.select("doc_id", "k").join(rows.select("doc_id", F.lower("text").alias("_t"), "evidence_type"), "doc_id").where(F.contains("_t", "k")).groupBy("doc_id", "k").agg(kinds_among(F.col("evidence_type")).alias("types"))
    own = own.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "k").orderBy("n"))).where("_r = 1")
    # all parts are dealt alike by now, so they meet in one row for each document without a shuffle by skill or block
    parts = own.select("doc_id", F.struct("n", "k", "canonical", "s").alias("_own"))
    parts = parts.unionByName(named.select("doc_id", F.struct("k", "types").alias("_named")), True)
    parts = parts.unionByName(found.select("doc_id", F.struct(F.lower("canonical").alias("k"), "canonical", "types", "lines").alias("_found")), True)
    names = ("_own", "_named", "_found")
    parts = parts.repartition(tasks, "doc_id").groupBy("doc_id").agg(*(F.collect_list(c).alias(c) for c in names))
    out = dealt.join(parts.hint("merge"), "doc_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.array().cast(parts.schema[c].dataType)) for c in names})

    def one(n: Column, s: Column, told: Column, canonical: Column, types: Column, lines: Column) -> Column:
        evidence = F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in (s["evidence"], lines))))
        c = F.coalesce(told, canonical)
        skill = F.struct(F.coalesce(s["name"], told).alias("name"), c.alias("canonical_name"), s["years"].alias("years"), s["level"].alias("level"), evidence.alias("evidence"), types.alias("evidence_types"), F.coalesce(s["confidence"], F.lit(1.0)).alias("confidence"))
        return F.struct(n.alias("n"), c.alias("c"), skill.cast(SKILL).alias("s"))

    def known(o: Column) -> Column:
        none = F.lit(None).cast("string")
        by_name = F.get(F.filter("_named", lambda x: x["k"] == o["k"]), F.lit(0))["types"]
        bare = F.array(one(o["n"], o["s"], none, o["canonical"], F.coalesce(by_name, F.array(F.lit("listed"))), F.lit(None).cast("array<string>")))
        told = F.transform(F.filter("_found", lambda f: f["k"] == o["k"]), lambda f: one(o["n"], o["s"], f["canonical"], o["canonical"], f["types"], f["lines"]))
        return F.when(F.exists("_found", lambda f: f["k"] == o["k"]), told).otherwise(bare)

    new = F.filter("_found", lambda f: ~F.coalesce(F.exists("_own", lambda o: o["k"] == f["k"]), F.lit(False)))
    new = F.transform(new, lambda f: one(F.lit(1 << 30), F.lit(None).cast(SKILL), f["canonical"], f["canonical"], f["types"], f["lines"]))
    every = F.array_sort(F.concat(F.flatten(F.transform("_own", known)), new))
    out = out.withColumn("_skills", F.transform(every, lambda x: x["s"]))
    return out.withColumn("skills", F.when(F.size("_skills") > 0, F.col("_skills")).otherwise(F.col("skills"))).drop("_skills", "_own", "_named", "_found")


def years_of(experiences: Column, as_of: date) -> Column:
    """Years in the union of the primary roles' periods (all roles, if there are only secondary ones), to one place; null without dates."""
    second = lambda e: F.coalesce(F.regexp_like(e["job_title"], F.lit(SECONDARY_ROLES)), F.lit(False)) | F.coalesce(F.regexp_like(e["company"], F.lit(SECONDARY_ROLES)), F.lit(False))
    first = F.filter(experiences, lambda e: ~second(e))
    dated = F.filter(F.when(F.size(first) > 0, first).otherwise(experiences), lambda e: e["start_date"].isNotNull())
    spans = F.array_sort(F.transform(dated, lambda e: F.struct(e["start_date"].alias("s"), F.coalesce(e["end_date"], F.lit(as_of)).alias("e"))))
    start = F.struct(F.lit(0).alias("days"), F.lit(None).cast("date").alias("reach"))
    step = lambda a, x: F.struct((a["days"] + F.when(a["reach"].isNull(), F.datediff(x["e"], x["s"])).otherwise(F.greatest(F.datediff(x["e"], F.greatest(x["s"], a["reach"])), F.lit(0)))).alias("days"), F.greatest(a["reach"], x["e"]).alias("reach"))
    return F.when(F.size(spans) > 0, F.round(F.aggregate(spans, start, step, lambda a: a["days"]) / 365.25, 1))


def usable(blocks: Column) -> Column:
    """80 letters and 2 blocks at least, whose order numbers rise."""
    order = F.transform(blocks, lambda b: b["reading_order"])
    return (F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b["text"])) >= 80) & (F.size(blocks) >= 2) & (F.sort_array(F.array_distinct(order)) == order)


def reconcile(profiles: DataFrame, blocks: DataFrame, table: DataFrame, *, provider: str, as_of: date, fallback: bool = True, stage: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Profiles as they stand after all of the above, with total_experience_years, validation_status, issues and dispositions.

    Status: manual_review if the document is not usable, the name is a place or has an ungrounded reference, an entry was
    dropped or kept by its section alone; else partial with the local provider, an experience without references, an
    ungrounded reference or a section that gave no entry; else validated. `stage` takes a table and a name and gives the table back:
    it is written between steps (by default in the shared folder), which keeps plans small and lets work that an executor
    loses begin at the last of them.
    """
    stage = stage or materialize
    p = with_blocks(as_profiles(profiles), blocks)
    for step in (lambda x: settle_name(x, fallback=fallback), settle_headline, count_ungrounded, validate_experiences, lambda x: merge_experiences(x, as_of=as_of), validate_projects, tidy_entries, recover_education, keep_grounded):
        p = step(p)
    p = stage(recover_experiences(stage(p, "validated")), "recovered")
    p = enrich_skills(p, blocks, table)
    tiers = F.transform("experience_verdicts", lambda v: v["tier"])
    inferred, dropped = F.array_contains(tiers, 2), F.array_contains(tiers, 0)
    lost = F.exists("project_verdicts", lambda v: v["tier"] == 0)
    manual = ~usable(F.col("blocks")) | F.col("name_is_place") | F.col("name_ungrounded") | dropped | inferred | lost
    bare = F.exists("experiences", lambda e: F.size(F.coalesce(e["evidence"], no_evidence())) == 0)
    partial = F.lit(provider == "local-compatibility") | bare | (F.col("ungrounded") > 0) | F.col("missing_expected")
    cleared = F.exists("experience_verdicts", lambda v: F.size(v["cleared"]) > 0) | (F.col("n_merged") > 0)
    issues = {"CANDIDATE_NAME_IS_LOCATION": F.col("name_is_place"), "EVIDENCE_NOT_GROUNDED": F.col("ungrounded") > 0, "EVIDENCE_SECTION_INFERRED": inferred, "UNSUPPORTED_EXPERIENCE_CLAIM": dropped, "AMBIGUOUS_ENTRY_ATTACHMENT": cleared, "UNSUPPORTED_PROJECT_CLAIM": lost, "MISSING_EXPECTED_SECTION_ENTITIES": F.col("missing_expected")}
    p = p.withColumn("address", clean(F.col("address"))).withColumn("total_experience_years", years_of(F.col("experiences"), as_of))
    p = p.withColumn("validation_status", F.when(manual, "manual_review").when(partial, "partial").otherwise("validated"))
    p = p.withColumn("issues", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in issues.items()))))
    return p.withColumn("dispositions", F.concat("experience_verdicts", "project_verdicts")).drop("experience_verdicts", "project_verdicts", "name_is_place", "name_ungrounded", "ungrounded", "n_merged", "missing_expected", "blocks")
