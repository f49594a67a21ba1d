"""Entries of a profile bound to the blocks that name them. Only a sure match binds; a weak one leaves the entry as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import bind as bind_value
from folioforge.functions.text import fingerprint

from .document import EVIDENCE, squeezed
from .evidence import box_overlap

LEAST_NEEDLE, REACH, SAME_ROW = 5, 4, 0.3


def title_blocks(q: Column) -> Column:
    """The anchors of a role: blocks that hold the title alone, with a digit behind it, or before or behind the company.

    A block that begins with a digit counts too, whatever follows: what is left of it once the title is taken off does.
    """

    def anchor(b: Column) -> Column:
        begun = (b["norm"] == q["title"]) | F.regexp_like(F.substr(b["norm"], F.length(q["title"]) + 1), F.lit(r"(?U)^\d"))
        named = (q["company"] != "") & (F.startswith(b["norm"], q["before"]) | F.startswith(b["norm"], q["behind"]))
        return F.when(F.startswith(b["norm"], q["title"]), begun).otherwise(b["digit"]) | named

    return F.when(F.length(q["title"]) >= LEAST_NEEDLE, F.filter("_near", anchor)).otherwise(F.slice("_near", 1, 0))


def context(t: Column, company: Column, year: Column) -> Column:
    """The anchor `t` and the blocks near it that hold the company or the year; empty if what is known of both is nowhere.

    Near is within REACH places on the same page. A signal that the entry does not have counts as given.
    """
    near = F.filter("_near", lambda b: (F.abs(b["reading_order"] - t["reading_order"]) <= REACH) & (b["page_number"] == t["page_number"]))

    def settled(n: Column) -> Column:
        none = F.slice(n, 1, 0)
        more = lambda value: F.when(F.contains(t["norm"], value), none).otherwise(F.filter(n, lambda b: F.contains(b["norm"], value)))

        def joined(x: Column) -> Column:
            ok = F.contains(t["norm"], company) | F.contains(t["norm"], year) | (F.size(x["c"]) > 0) | (F.size(x["y"]) > 0)
            return F.when(ok, F.concat(F.array(t), x["c"], x["y"])).otherwise(none)

        return bind_value(F.struct(more(company).alias("c"), more(year).alias("y")), joined)

    # the blocks near are found once, and none are looked for if nothing is known
    return F.when((company != "") | (year != ""), bind_value(near, settled)).otherwise(F.slice("_near", 1, 0))


def same_row(candidate: Column) -> Column:
    """Whether a context block lies in the anchor's row, or nothing is known of where they lie."""
    rest, t = F.slice(candidate, 2, F.size(candidate)), candidate[0]
    return (F.size(candidate) < 2) | F.exists(rest, lambda b: box_overlap(t["y0"], t["y1"], b["y0"], b["y1"]) >= SAME_ROW) | F.forall(rest, lambda b: b["y0"].isNull())


def references(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda b: F.struct(b["text"].alias("text"), b["page_number"].alias("page_number"), b["block_id"].alias("block_id")))).cast(EVIDENCE)


def bind(profiles: DataFrame) -> DataFrame:
    """`profiles` (with blocks) with evidence for entries that have none, and binding: one record for each entry.

    binding: array of (kind, entry from 0, fingerprint, decision, reason_code, evidence). An experience needs a title anchor
    with the company or the year near it, and only one such anchor, or only one in whose row they stand. A project needs
    a title that occurs once, or once with its year near it.
    """
    out = profiles.withColumn("_near", F.transform(F.filter("blocks", lambda b: b["norm"] != ""), lambda b: F.struct(*(b[n].alias(n) for n in ("norm", "page_number", "reading_order", "block_id", "text", "y0", "y1")), F.regexp_like(b["norm"], F.lit(r"(?U)^\d")).alias("digit"))))
    for kind, column, title, other in (("experience", "experiences", "job_title", "company"), ("project", "projects", "title", "role")):
        key = lambda e, title=title: squeezed(e[title])
        company = (lambda e: squeezed(e["company"])) if kind == "experience" else (lambda e: F.lit(""))
        year = lambda e: F.coalesce(F.year(e["start_date"]).cast("string"), F.lit(""))
        # what is asked of an entry is made once, not for each block
        out = out.withColumn("_q", F.transform(F.transform(column, lambda e: F.struct(key(e).alias("title"), company(e).alias("company"), year(e).alias("year"))), lambda q: F.struct(q["title"].alias("title"), q["company"].alias("company"), q["year"].alias("year"), F.concat(q["company"], q["title"]).alias("before"), F.concat(q["title"], q["company"]).alias("behind"))))
        if kind == "experience":
            anchors = F.transform("_q", title_blocks)
        else:
            anchors = F.transform("_q", lambda q: F.when(F.length(q["title"]) >= LEAST_NEEDLE, F.filter("_near", lambda b: F.contains(b["norm"], q["title"]))).otherwise(F.slice("_near", 1, 0)))
        out = out.withColumn("_a", anchors)
        out = out.withColumn("_c", F.zip_with("_q", "_a", lambda q, a: F.filter(F.transform(a, lambda t: context(t, q["company"], q["year"])), lambda c: F.size(c) > 0)))
        out = out.withColumn("_r", F.transform("_c", lambda c: F.filter(c, same_row)))
        out = out.withColumn("_n", F.arrays_zip("_a", "_c", "_r"))
        one = (lambda n: F.when(F.size(n["_c"]) == 1, n["_c"][0]).when((F.size(n["_c"]) > 1) & (F.size(n["_r"]) == 1), n["_r"][0])) if kind == "experience" else (lambda n: F.when(F.size(n["_a"]) == 1, n["_a"]).when((F.size(n["_a"]) > 1) & (F.size(n["_c"]) == 1), n["_c"][0]))
        if kind == "experience":
            reason = lambda n: F.when(F.size(n["_a"]) == 0, "TITLE_NOT_FOUND_EXACT").when(F.size(n["_c"]) == 0, "TITLE_WITHOUT_STRONG_CONTEXT").when(F.size(n["_c"]) == 1, "BOUND_EXACT_CONTEXT").when(F.size(n["_r"]) == 1, "BOUND_EXACT_CONTEXT_ROW").otherwise("TITLE_AMBIGUOUS")
        else:
            reason = lambda n: F.when(F.size(n["_a"]) == 0, "TITLE_NOT_FOUND_EXACT").when(F.size(n["_a"]) == 1, "BOUND_EXACT_UNIQUE").when(F.size(n["_c"]) == 1, "BOUND_EXACT_CONTEXT").otherwise("TITLE_AMBIGUOUS")
        out = out.withColumn("_b", F.transform("_n", lambda n: F.struct(F.coalesce(references(one(n)), F.expr("array()").cast(EVIDENCE)).alias("evidence"), reason(n).alias("reason"))))
        record = F.transform(F.arrays_zip(column, "_b"), lambda z, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("entry"), fingerprint(F.lit(kind), F.coalesce(z[column][title], F.lit("")), F.coalesce(z[column][other], F.lit(""))).alias("fingerprint"),
            F.when(F.size(z["_b"]["evidence"]) > 0, "bound").otherwise("unbound").alias("decision"), z["_b"]["reason"].alias("reason_code"), z["_b"]["evidence"].alias("evidence"),
        ))
        bare = lambda e: F.size(F.coalesce(e["evidence"], F.expr("array()").cast(EVIDENCE))) == 0
        bound = F.zip_with(column, "_b", lambda e, b: e.withField("evidence", F.when(bare(e), b["evidence"]).otherwise(e["evidence"])))
        out = out.withColumn(f"_{kind}", record).withColumn(column, bound).drop("_q", "_a", "_c", "_r", "_n", "_b")
    return out.withColumn("binding", F.concat("_experience", "_project")).drop("_experience", "_project", "_near")
