"""Claims and the blocks that support them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import clean

from .blocks import kept_lines

GRAM = 5
#: Keys of passages up to this number, 16 bytes each, go to every executor; more are joined by shuffles.
SMALL = 200_000
WORD, SIGNS = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"


def grounded(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """`claims` (doc_id, page_number, block_id, quote, ...) with grounded: the cleaned quote stands in that very block, cleaned too.

    An empty quote is never grounded. Of blocks repeated under one id the first in reading order counts.
    """
    order = [F.col(c) for c in ("reading_order",) if c in blocks.columns] or [F.col("text")]
    near = blocks.groupBy("doc_id", "page_number", "block_id").agg(clean(F.min_by("text", F.struct(*order))).alias("_text"))
    rows = claims.join(near, ["doc_id", "page_number", "block_id"], "left")
    return rows.withColumn("grounded", F.coalesce(F.contains("_text", clean(F.col("quote"))), F.lit(False))).drop("_text")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def passages_in(docs: DataFrame, passages: DataFrame, *, doc: str = "doc_id", text: str = "text", passage_id: str = "item_id", passage: str = "text", salts: int = 16) -> DataFrame:
    """(passage_id, doc_id): documents that hold a passage word for word.

    A passage is keyed by a run of its inner words, which stand whole wherever it does: five from the second on, or all there
    are between the first and the last. Runs of those lengths of the documents, as hashes with the row's number alone, meet
    the keys in an equi-join, by broadcast if the keys are few, else on hash and salt, so a common run is dealt over tasks; the few rows that meet one go back to
    their texts. Passages of one or two words have no inner word: their longest run of letters and digits (or all of a passage of
    signs) stands within some such run of the document, so it is looked up among the different runs of all documents, by its
    first three characters; runs travel with their row's number alone.
    """
    p = passages.select(F.col(passage_id).alias("passage_id"), F.col(passage).alias("_p")).where("_p <> ''").withColumn("_w", words_of(F.col("_p")))
    length = F.least(F.size("_w") - 2, F.lit(GRAM))
    keyed = p.where("size(_w) > 2").select("passage_id", "_p", length.alias("_n"), F.xxhash64(length, F.array_join(F.slice("_w", F.lit(2), length), " ")).alias("_key"))
    sizes = [r["_n"] for r in keyed.select("_n").distinct().collect()]  # GRAM of them at most
    d = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("_t"))
    rows = d.withColumn("_w", words_of(F.col("_t")))

    def grams(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_w"), F.lit(1))), lambda i: i + (n - 1) <= F.size("_w"))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice("_w", i, n), " ")))

    out = d.sparkSession.createDataFrame([], "_id long, _key long")
    ids = F.xxhash64("doc_id", "_t")
    if sizes:
        out = rows.select(ids.alias("_id"), F.explode(F.array_distinct(F.concat(*map(grams, sizes)))).alias("_key"))
    keys = keyed.select("passage_id", "_key").distinct()
    if keys.count() <= SMALL:
        met = out.join(F.broadcast(keys), "_key").select("_id", "passage_id").distinct()
    else:
        salted = keys.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = out.withColumn("_s", F.pmod("_id", F.lit(salts)).cast("int")).join(salted, ["_key", "_s"]).select("_id", "passage_id").distinct()
    found = d.withColumn("_id", ids).join(met, "_id").join(p.select("passage_id", "_p"), "passage_id").where(F.contains("_t", F.col("_p"))).select("passage_id", "doc_id")
    # shorter ones: a run of letters and digits, or one of signs and blanks, of the text holds their longest such run
    few = p.where("size(_w) < 3").withColumn("_k", F.array_max(F.transform(F.regexp_extract_all("_p", F.lit(WORD), F.lit(0)), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"])
    for kind, those in ((WORD, few.where("_k IS NOT NULL")), (SIGNS, few.where("_k IS NULL").withColumn("_k", F.col("_p")))):
        short = those.withColumn("_g", F.substring("_k", 1, 3))
        lengths = [r["n"] for r in short.select(F.length("_g").alias("n")).distinct().collect()]  # 1 to 3
        if not lengths:
            continue

        def pieces(n: int) -> Column:
            return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length("_token"), F.lit(1))), lambda i: i + (n - 1) <= F.length("_token")), lambda i: F.substr("_token", i, F.lit(n)))

        runs = d.select(ids.alias("_id"), F.explode(F.array_distinct(F.regexp_extract_all("_t", F.lit(kind), F.lit(0)))).alias("_token"))
        cut = runs.select("_token").distinct().withColumn("_g", F.explode(F.array_distinct(F.concat(*map(pieces, lengths)))))
        held = cut.join(short.select("passage_id", "_k", "_g"), "_g").where(F.contains("_token", F.col("_k"))).select("_token", "passage_id").distinct()
        met = runs.join(held, "_token").select("_id", "passage_id").distinct()
        found = found.unionByName(d.withColumn("_id", ids).join(met, "_id").join(p.select("passage_id", "_p"), "passage_id").where(F.contains("_t", F.col("_p"))).select("passage_id", "doc_id"))
    return found.distinct()


def context_pairs(pages: DataFrame, *, doc: str = "doc_id", text: str = "text", reach: int = 4) -> DataFrame:
    """(doc_id, anchor, near): places of the blocks of a page within `reach` of each other, both ways round.

    A page's blocks are numbered from 1 without gaps, so the pairs follow from their number: no shuffle, and as many rows
    as there are pairs. For anchors chosen by their text see binding.context.
    """
    n = F.size(kept_lines(F.col(text)))
    rows = pages.select(F.col(doc).alias("doc_id"), n.alias("_n")).where("_n > 1").select("doc_id", "_n", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("anchor"))
    near = rows.select("doc_id", "anchor", F.explode(F.sequence(F.greatest(F.lit(1), F.col("anchor") - reach), F.least(F.col("_n"), F.col("anchor") + reach))).alias("near"))
    return near.where("anchor <> near")


def box_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared height of two boxes over the lesser height; 0 without geometry."""
    shared = F.least(F.greatest(a0, a1), F.greatest(b0, b1)) - F.greatest(F.least(a0, a1), F.least(b0, b1))
    lesser = F.least(F.abs(a1 - a0), F.abs(b1 - b0))
    return F.coalesce(F.when((shared > 0) & (lesser > 0), shared / lesser), F.lit(0.0))


def tiered(grounded: Column, role_supported: Column, project_only: Column, section_inferred: Column) -> tuple[Column, Column]:
    """Tier and reason of an experience. Tier 1: grounded, the role in the evidence, not a mere project. Tier 2: seen in
    an experience section, whatever the evidence. Tier 0: dropped."""
    one = grounded & role_supported & ~project_only
    tier = F.when(one, 1).when(section_inferred, 2).otherwise(0)
    reason = F.when(one, "VERIFIED").when(section_inferred, "SECTION_INFERRED").when(~grounded, "EVIDENCE_NOT_GROUNDED").when(~role_supported, "ROLE_NOT_SUPPORTED_BY_EVIDENCE").otherwise("PROJECT_ONLY_EVIDENCE")
    return tier, reason


def tiers(entries: DataFrame) -> DataFrame:
    """`entries` (grounded, role_supported, project_only, section_inferred: booleans) with tier and reason_code."""
    tier, reason = tiered(*(F.col(c) for c in ("grounded", "role_supported", "project_only", "section_inferred")))
    return entries.withColumn("tier", tier).withColumn("reason_code", reason)


def status(profiles: DataFrame) -> DataFrame:
    """`profiles` (usable, name_is_place, name_ungrounded, dropped, inferred, local_provider, partial_evidence) with status."""
    manual = ~F.col("usable") | F.col("name_is_place") | F.col("name_ungrounded") | F.col("dropped") | F.col("inferred")
    return profiles.withColumn("status", F.when(manual, "manual_review").when(F.col("local_provider") | F.col("partial_evidence"), "partial").otherwise("validated"))
