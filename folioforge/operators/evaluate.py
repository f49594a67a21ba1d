"""Precision, recall and F1, and reports over a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(pairs: DataFrame, *, expected: str, actual: str) -> DataFrame:
    """(true_positive, false_positive, false_negative, precision, recall, f1) of two 0/1 columns."""
    e, a = F.col(expected) == 1, F.col(actual) == 1
    n = pairs.agg(F.count_if(e & a).alias("true_positive"), F.count_if(~e & a).alias("false_positive"), F.count_if(e & ~a).alias("false_negative"))
    p, r = ratio(F.col("true_positive"), F.col("true_positive") + F.col("false_positive")), ratio(F.col("true_positive"), F.col("true_positive") + F.col("false_negative"))
    return n.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def block_metrics(reviews: DataFrame) -> DataFrame:
    """Of `reviews` (verdict, bound, correct: arrays of block ids): entity precision, block precision, block recall."""
    hit = F.size(F.array_intersect("bound", "correct"))
    n = reviews.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "correct").alias("good"), F.sum(F.size("bound")).alias("bound"), F.sum(F.size("correct")).alias("correct"), F.sum(hit).alias("hit"))
    return n.select(ratio(F.col("good"), F.col("n")).alias("entity_precision"), ratio(F.col("hit"), F.col("bound")).alias("block_precision"), ratio(F.col("hit"), F.col("correct")).alias("block_recall"))


def entity_recall(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, kind, gold, hit, recall): gold entities whose title, in lower case and trimmed, is found as it is."""
    key = F.lower(F.trim("title"))
    g = gold.select("doc_id", "kind", key.alias("k")).distinct()
    f = found.select("doc_id", "kind", key.alias("k"), F.lit(1).alias("hit")).distinct()
    return g.join(f, ["doc_id", "kind", "k"], "left").groupBy("doc_id", "kind").agg(F.count("*").alias("gold"), F.count("hit").alias("hit")).withColumn("recall", ratio(F.col("hit"), F.col("gold")))


#: Levels of entity_report: an entity kind of a document, a document, a kind, everything.
LEVELS = ("document_kind", "document", "kind", "all")
#: Rows of entity_report for one task, about.
ROWS_AT_ONCE = 250_000


def entity_report(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(level, doc_id, kind, true_positive, false_positive, false_negative, precision, recall, f1) of entities (doc_id, kind, title).

    Titles are compared in lower case and trimmed, and paired one to one: of a title that stands three times in one and twice in
    the other, two are pairs and one is missing. All levels come from one pass (GROUPING SETS). Null titles count as empty; rows
    without a document or kind pair with their like.
    """
    key = F.lower(F.trim(F.coalesce("title", F.lit(""))))

    def side(d: DataFrame, g: int) -> DataFrame:
        return d.select("doc_id", "kind", key.alias("k"), F.lit(g).alias("g"), F.lit(1 - g).alias("f"))

    # both sides are counted in one table, without a join; documents are dealt to as many tasks as there are rows for, before
    # anything is counted, so that a task holds as many titles in a large table as in a small one
    tasks = -(-(gold.count() + found.count()) // ROWS_AT_ONCE) or 1
    dealt = side(gold, 1).unionByName(side(found, 0)).repartition(tasks, "doc_id")
    both = dealt.groupBy("doc_id", "kind", "k").agg(F.sum("g").alias("g"), F.sum("f").alias("f"))
    n = both.groupingSets([["doc_id", "kind"], ["doc_id"], ["kind"], []], "doc_id", "kind").agg(
        F.grouping_id().alias("gid"), F.sum(F.least("g", "f")).alias("true_positive"), F.sum(F.greatest(F.col("f") - F.col("g"), F.lit(0))).alias("false_positive"), F.sum(F.greatest(F.col("g") - F.col("f"), F.lit(0))).alias("false_negative"),
    )
    p, r = ratio(F.col("true_positive"), F.col("true_positive") + F.col("false_positive")), ratio(F.col("true_positive"), F.col("true_positive") + F.col("false_negative"))
    level = F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("gid") + 1).cast("int"))
    out = n.where("gid < 3 OR true_positive IS NOT NULL").withColumn("precision", p).withColumn("recall", r)
    return out.select(level.alias("level"), "doc_id", "kind", "true_positive", "false_positive", "false_negative", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


#: Rows among which sensitive fields change places, about.
SWAP_ROWS = 10_000


def swapped(profiles: DataFrame, fields: list[str], *, id_col: str = "doc_id", seed: int = 0, rows: int = SWAP_ROWS) -> DataFrame:
    """`profiles` with the sensitive `fields` of another profile each: those of the next one in an order drawn by `seed`.

    Profiles are dealt by hash to groups of about `rows` and turned round within each, so that no task sees them all; every
    set of fields is used once, and only a group of one keeps its own.
    """
    from pyspark.sql.window import Window

    from folioforge.functions.columns import spare

    h, group, taken = spare(profiles, "h", "group", "taken")
    groups = max(1, -(-profiles.count() // rows))
    mine = Window.partitionBy(group).orderBy(h, id_col)
    held = F.struct(*fields)
    out = profiles.withColumn(h, F.xxhash64(F.lit(seed), F.col(id_col))).withColumn(group, F.pmod(F.xxhash64(F.lit(~seed), F.col(id_col)), F.lit(groups)))
    first = F.first(held).over(mine.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn(taken, F.coalesce(F.lead(held).over(mine), first))
    return out.select(*(F.col(f"{taken}.{c}").alias(c) if c in fields else F.col(c) for c in profiles.columns))


def counterfactual(profiles: DataFrame, score, fields: list[str], *, id_col: str = "doc_id", seed: int = 0, rows: int = SWAP_ROWS) -> DataFrame:
    """(doc_id, score, swapped_score, differs): each profile's score as it is and with another's sensitive fields.

    `score` takes profiles and gives (doc_id, score). A fair score differs nowhere; ids have to be unique.
    """
    a = score(profiles).select(id_col, F.col("score"))
    b = score(swapped(profiles, fields, id_col=id_col, seed=seed, rows=rows)).select(id_col, F.col("score").alias("swapped_score"))
    return a.join(b, id_col).withColumn("differs", ~F.col("score").eqNullSafe(F.col("swapped_score")))


def mismatches(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, kind, title, side): entities that are on one side only: missing or invented."""
    on = ["doc_id", "kind", "_k"]
    g, f = (d.withColumn("_k", F.lower(F.trim("title"))) for d in (gold, found))
    missing = g.join(f.select(*on), on, "left_anti").select("doc_id", "kind", "title", F.lit("missing").alias("side"))
    return missing.unionByName(f.join(g.select(*on), on, "left_anti").select("doc_id", "kind", "title", F.lit("invented").alias("side")))


def binding_counts(reviews: DataFrame) -> DataFrame:
    """Of `reviews` (verdict, bound, correct): entities reviewed, correct, incorrect, uncertain and pending, and block_metrics of those reviewed."""
    done = F.col("verdict") != "pending"
    n = reviews.agg(F.count_if(done).alias("reviewed"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("correct", "incorrect", "uncertain", "pending")))
    return n.crossJoin(block_metrics(reviews.where(done)))  # one row each


def binding_packet(gold: DataFrame, bound: DataFrame) -> DataFrame:
    """`gold` (doc_id, kind, title) with the blocks that binding gave (bound: doc_id, kind, title, blocks) and a verdict that is pending."""
    key = F.lower(F.trim("title"))
    b = bound.select("doc_id", "kind", key.alias("_k"), "blocks")
    empty = F.array().cast(bound.schema["blocks"].dataType)
    return gold.withColumn("_k", key).join(b, ["doc_id", "kind", "_k"], "left").select("doc_id", "kind", "title", F.coalesce("blocks", empty).alias("blocks"), F.lit("pending").alias("verdict"))


def initial_entities(gold: DataFrame, initial: DataFrame, dto: DataFrame, corrected: DataFrame, final: DataFrame) -> DataFrame:
    """Seven counters over tables of (doc_id, kind, title): gold, first answer, those of it with a title, matched titles, valid first ones,
    valid corrected ones, final ones."""
    key = F.lower(F.trim("title"))
    hit = initial.select("doc_id", "kind", key.alias("k")).distinct().join(gold.select("doc_id", "kind", key.alias("k")).distinct(), ["doc_id", "kind", "k"], "left_semi")
    n = lambda d, name: d.agg(F.count("*").alias(name))
    out = n(gold, "gold")
    for d, name in ((initial, "initial"), (initial.where("trim(coalesce(title, '')) <> ''"), "with_title"), (hit, "matched"), (dto, "initial_valid"), (corrected, "corrected_valid"), (final, "final")):
        out = out.crossJoin(n(d, name))  # one row each
    return out


def field_coverage(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, covered, asked, coverage): gold fields (doc_id, entity, field, value) that are found with the same value, in lower case and trimmed."""
    v = F.lower(F.trim("value"))
    g = gold.select("doc_id", "entity", "field", v.alias("v")).distinct()
    f = found.select("doc_id", "entity", "field", v.alias("v"), F.lit(1).alias("hit")).distinct()
    return g.join(f, ["doc_id", "entity", "field", "v"], "left").groupBy("doc_id").agg(F.count("hit").alias("covered"), F.count("*").alias("asked")).withColumn("coverage", ratio(F.col("covered"), F.col("asked")))


def page_overlap(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, overlap): of gold evidence pages (doc_id, entity, page) the share that is cited."""
    g = gold.select("doc_id", "entity", "page").distinct()
    f = found.select("doc_id", "entity", "page", F.lit(1).alias("hit")).distinct()
    return g.join(f, ["doc_id", "entity", "page"], "left").groupBy("doc_id").agg(ratio(F.count("hit"), F.count("*")).alias("overlap"))


#: Headings of reviewers' notes by the kind of entity that they open. Fixed values.
NOTE_KINDS = (("employment", "employment"), ("project", "project"), ("education", "education"), ("skill", "skill"), ("certification", "certification"), ("language", "language"))


def annotation_intake(notes: DataFrame) -> DataFrame:
    """(source, layout, fact, kind, fields, page, state) of reviewers' Markdown notes (source, text), one row per fact.

    `### Employment ...` opens a kind; `1. **Field:** value` a fact of it, `* **Field:** value` another field of the fact, and `* text`
    a fact of its own. state: ambiguous only if the field that names the fact is.
    """
    rows = notes.select("source", F.posexplode(F.split("text", "\n")).alias("n", "line"), "text")
    heading = F.lower(F.regexp_extract("line", r"^###\s+(.*)$", 1))
    kind = F.lit(None).cast("string")
    for word, name in reversed(NOTE_KINDS):
        kind = F.when(F.contains(heading, F.lit(word)), name).otherwise(kind)
    from pyspark.sql.window import Window

    upto = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    field, value = F.trim(F.regexp_extract("line", r"^\s*(?:\d+\.|\*)\s+\*\*(.+?):\*\*\s*(.*)$", 1)), F.trim(F.regexp_extract("line", r"^\s*(?:\d+\.|\*)\s+\*\*(.+?):\*\*\s*(.*)$", 2))
    item = F.trim(F.regexp_extract("line", r"^\s*\*\s+([^*].*)$", 1))
    rows = rows.withColumn("_h", F.when(F.startswith("line", F.lit("#")), F.coalesce(kind, F.lit("")))).withColumn("kind", F.last("_h", True).over(upto)).withColumn("field", field).withColumn("value", value).withColumn("item", F.when(field == "", item).otherwise(""))
    rows = rows.where("kind <> '' AND (field <> '' OR item <> '')").withColumn("_new", (F.regexp_like("line", F.lit(r"^\s*\d+\.")) | (F.col("item") != "")).cast("int"))
    rows = rows.withColumn("fact", F.sum("_new").over(upto)).withColumn("field", F.when(F.col("item") != "", "Item").otherwise(F.col("field"))).withColumn("value", F.when(F.col("item") != "", F.col("item")).otherwise(F.col("value")))
    layout = F.when(F.regexp_like(F.lower("text"), F.lit(r"layout observations:[^\n]*single[- ]column")), "single_column").when(F.regexp_like(F.lower("text"), F.lit(r"layout observations:[^\n]*(?:two|multi)[- ]column")), "multi_column").otherwise("unknown")
    out = rows.groupBy("source", "fact", "kind").agg(F.max(layout).alias("layout"), F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("n", "field", "value"))), lambda x: F.struct(x["field"], x["value"]))).alias("fields"), F.min_by("value", "n").alias("_first"))
    page = F.nullif(F.regexp_extract(F.element_at("fields", "Page"), r"(\d+)", 1), F.lit("")).cast("int")
    state = F.when(F.startswith(F.lower("_first"), F.lit("ambiguous")), "ambiguous").otherwise("verified")
    return out.select("source", "layout", "fact", "kind", "fields", page.alias("page"), state.alias("state"))


def smoke_report(parsed: DataFrame) -> DataFrame:
    """(file, ok, characters, error) of parsed pages (path, text, error): files by a hash, no text and no paths."""
    one = parsed.groupBy("path").agg(F.max("error").alias("error"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"))
    return one.select(F.substring(F.sha2("path", 256), 1, 16).alias("file"), F.col("error").isNull().alias("ok"), "characters", "error")
