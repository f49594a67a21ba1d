"""Documents as ordered blocks, and what follows from their order: diagnostics, margins, pruning, header zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.text import collapse, estimate_tokens, lines, strip

from .sections import heading_kind

MIN_CHARS, MIN_BLOCKS, LONG_TEXT, LONG_HEADINGS = 80, 2, 1500, 2
MARGIN_CHARS = 160
HEADER_BLOCKS = 8
PROMPT_CHARS = 240


def blocks(pages: DataFrame, *, doc: str = "doc_id", page: str | None = None, text: str = "text") -> DataFrame:
    """(doc, page_number, block_id, block_type, text, reading_order): a block for each line that is not blank.

    Order numbers run through the document, page by page, from 1; block ids through the page. The lines of a page
    come out of one row, so a document of a single page needs no shuffle.
    """
    number = F.col(page).cast("int") if page else F.lit(1)
    rows = pages.select(F.col(doc).alias("doc_id"), number.alias("page_number"), kept_lines(F.col(text)).alias("_l"))
    if page:
        before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_before", F.coalesce(F.sum(F.size("_l")).over(before), F.lit(0)))
    else:
        rows = rows.withColumn("_before", F.lit(0))
    rows = rows.select("doc_id", "page_number", "_before", F.posexplode("_l").alias("_n", "text"))
    kind = F.when(heading_kind(F.col("text")).isNotNull(), "section_header").otherwise("text")
    return rows.select("doc_id", "page_number", F.concat(F.lit("p"), "page_number", F.lit("-b"), F.col("_n") + 1).alias("block_id"), kind.alias("block_type"), "text", (F.col("_before") + F.col("_n") + 1).cast("int").alias("reading_order"))


def kept_lines(text: Column) -> Column:
    """The lines of a text that are not blank, trimmed."""
    return F.filter(F.transform(lines(F.coalesce(text, F.lit(""))), lambda x: strip(x)), lambda x: x != "")


def _verdict(chars: Column, n: Column, headings: Column, ordered: Column) -> tuple[Column, Column]:
    tests = {"TEXT_TOO_SHORT": chars < MIN_CHARS, "TOO_FEW_BLOCKS": n < MIN_BLOCKS, "FEW_HEADINGS": (chars >= LONG_TEXT) & (headings < LONG_HEADINGS), "READING_ORDER": ~ordered}
    failed = tests["TEXT_TOO_SHORT"] | tests["TOO_FEW_BLOCKS"] | tests["READING_ORDER"]
    return F.when(failed, "fallback_required").otherwise("usable"), F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests.items()))), ",")


def with_diagnosis(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """`docs` (one page each) with char_count, block_count, heading_count, status and issues; each row by itself, no shuffle."""
    kept = next(n for n in ("_" * k + "lines" for k in range(1, 99)) if n not in docs.columns)
    rows = docs.withColumn(kept, kept_lines(F.col(text)))
    chars = F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    rows = rows.withColumns({"char_count": chars, "block_count": F.size(kept).cast("long"), "heading_count": F.size(F.filter(kept, lambda x: heading_kind(x).isNotNull())).cast("long")}).drop(kept)
    status, issues = _verdict(F.col("char_count"), F.col("block_count"), F.col("heading_count"), F.lit(True))
    return rows.withColumn("status", status).withColumn("issues", issues)


def diagnose(blocks_: DataFrame, docs: DataFrame, *, doc: str = "doc_id", expected_pages: str | None = None, geometry: bool = False) -> DataFrame:
    """(doc_id, char_count, block_count, heading_count, status, issues) for each id of `docs`, block-less ones too.

    Ids repeated in `docs` give one row, and null ids are one document. Order numbers have to rise strictly. Issues that
    do not fail a document: tables, columns side by side, a page count other than the column `expected_pages` of `docs`
    says, with `geometry` no block with a place.
    """
    from .layout import column_threshold

    is_table = (F.col("block_type") == "table") if "block_type" in blocks_.columns else F.lit(False)
    boxed = F.col("x0").isNotNull() if "x0" in blocks_.columns else F.lit(False)
    by = Window.partitionBy("doc_id").orderBy("page_number", "reading_order")
    rows = blocks_.withColumn("_back", F.lag("reading_order").over(by) >= F.col("reading_order"))
    found = rows.groupBy("doc_id").agg(
        F.sum(F.length("text")).alias("char_count"), F.count("*").alias("block_count"), F.count_if(F.col("block_type") == "section_header").alias("heading_count"),
        (~F.coalesce(F.bool_or("_back"), F.lit(False))).alias("ordered"), F.bool_or(is_table).alias("tables"), F.bool_or(boxed).alias("boxes"), F.countDistinct("page_number").alias("pages"),
    ).withColumnRenamed("doc_id", "_d")
    wanted = F.max(expected_pages).alias("_want") if expected_pages else F.lit(None).cast("int").alias("_want")
    ids = docs.groupBy(F.col(doc).alias("doc_id")).agg(wanted)
    rows = ids.join(found, F.col("doc_id").eqNullSafe(F.col("_d")), "left").fillna({"char_count": 0, "block_count": 0, "heading_count": 0, "ordered": True, "tables": False, "boxes": False, "pages": 0})
    if "x0" in blocks_.columns:
        split = column_threshold(blocks_).select(F.col("doc_id").alias("_s")).distinct()
        rows = rows.join(split, F.col("doc_id").eqNullSafe(F.col("_s")), "left").withColumn("columns", F.col("_s").isNotNull())
    else:
        rows = rows.withColumn("columns", F.lit(False))
    status, issues = _verdict(F.col("char_count"), F.col("block_count"), F.col("heading_count"), F.col("ordered"))
    soft = {"PAGE_COUNT_MISMATCH": F.coalesce(F.col("_want") != F.col("pages"), F.lit(False)), "MISSING_LAYOUT_GEOMETRY": F.lit(geometry) & (F.col("block_count") > 0) & ~F.col("boxes"), "TABLE_LAYOUT_AMBIGUITY": F.col("tables"), "SUSPICIOUS_READING_ORDER": F.col("columns")}
    every = F.concat_ws(",", F.nullif(issues, F.lit("")), *(F.when(c, F.lit(n)) for n, c in soft.items()))
    return rows.select("doc_id", "char_count", "block_count", "heading_count", status.alias("status"), every.alias("issues"))


def repeated_margins(pages: DataFrame, *, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc_id, line, occurrences, pages): first and last lines that stand on most pages of documents of several pages.

    A line counts from max(2, (3 * pages + 4) div 5) occurrences on; a page whose only line is both counts it twice.
    """
    kept = F.filter(F.transform(lines(F.col(text)), lambda x: F.lower(collapse(x))), lambda x: x != "")
    rows = pages.select(F.col(doc).alias("doc_id"), F.col(page).alias("page"), kept.alias("l"))
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("pages"))
    edges = rows.where("size(l) > 0").select("doc_id", F.explode(F.array(F.element_at("l", 1), F.element_at("l", -1))).alias("line")).where(F.length("line") <= MARGIN_CHARS)
    counted = edges.groupBy("doc_id", "line").agg(F.count("*").alias("occurrences")).join(sizes, "doc_id")
    return counted.where((F.col("pages") > 1) & (F.col("occurrences") >= F.greatest(F.lit(2), F.expr("(3 * pages + 4) div 5"))))


def drop_margins(pages: DataFrame, margins: DataFrame, *, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc_id, page, text): pages without the lines that are their document's repeated margins, wherever these stand."""
    found = margins.groupBy("doc_id").agg(F.collect_set("line").alias("_m"))
    rows = pages.select(F.col(doc).alias("doc_id"), F.col(page).alias("page"), lines(F.col(text)).alias("l")).join(found, "doc_id", "left")
    keep = F.filter("l", lambda x: ~F.coalesce(F.array_contains("_m", F.lower(collapse(x))), F.lit(False)))
    return rows.select("doc_id", "page", F.array_join(keep, "\n").alias("text"))


def prune(blocks_: DataFrame) -> DataFrame:
    """Blocks ready for a prompt: blank ones out, blanks collapsed, tokens counted before and after."""
    rows = blocks_.withColumn("pruned", collapse(F.col("text"))).where("pruned <> ''")
    return rows.select("doc_id", "block_id", "pruned", estimate_tokens(F.col("text")).alias("tokens_before"), estimate_tokens(F.col("pruned")).alias("tokens_after"))


def prune_markdown(markdown: Column) -> Column:
    """What a prompt keeps of a document's markdown besides its blocks: the first PROMPT_CHARS letters."""
    return F.left(F.coalesce(markdown, F.lit("")), F.lit(PROMPT_CHARS))


def header_zone(blocks_: DataFrame, size: int = HEADER_BLOCKS) -> DataFrame:
    """Blocks with those of the first page's header zone blanked out, as is done for an unknown identity."""
    zone = (F.col("page_number") == 1) & (F.col("reading_order") <= size)
    return blocks_.withColumn("text", F.when(zone, "[HEADER_REDACTED]").otherwise(F.col("text")))
