"""Two-column pages: where the columns part, and which blocks share a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.text import lines, strip

MIN_BOXES, MIN_GAP, MIN_SIDE, ROW_TOLERANCE = 6, 80.0, 3, 16.0


def column_threshold(boxes: DataFrame) -> DataFrame:
    """(doc_id, page_number, threshold): the middle of the widest gap between left edges; no row where there is one column.

    The gap must be 80 wide with three boxes on both sides, among six at least; of equal gaps the rightmost counts.
    """
    page = Window.partitionBy("doc_id", "page_number")
    rows = boxes.where("x0 IS NOT NULL").withColumn("n", F.count("*").over(page)).withColumn("i", F.row_number().over(page.orderBy("x0", "block_id")))
    rows = rows.withColumn("next", F.lead("x0").over(page.orderBy("x0", "block_id"))).where(f"n >= {MIN_BOXES} AND next - x0 >= {MIN_GAP} AND i >= {MIN_SIDE} AND n - i >= {MIN_SIDE}")
    best = rows.groupBy("doc_id", "page_number").agg(F.max(F.struct((F.col("next") - F.col("x0")).alias("gap"), "i", "x0", "next")).alias("g"))
    return best.select("doc_id", "page_number", ((F.col("g.x0") + F.col("g.next")) / 2).alias("threshold"))


def place(boxes: DataFrame) -> DataFrame:
    """Boxes with side (LEFT, RIGHT or SINGLE) and row_number from 1, top to bottom.

    A row begins where a box lies more than 16 below the first box of the current row, so rows are a fold over the
    page's boxes in order of height, not a comparison of neighbours.
    """
    sided = boxes.join(column_threshold(boxes), ["doc_id", "page_number"], "left")
    side = F.when(F.col("threshold").isNull(), "SINGLE").when((F.col("x0") + F.col("x1")) / 2 < F.col("threshold"), "LEFT").otherwise("RIGHT")
    sided = sided.withColumn("side", side).withColumn("_y", -(F.col("y0") + F.col("y1")) / 2)
    pages = sided.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("_y", "reading_order", "block_id", "side"))).alias("b"))
    fold = F.expr("""aggregate(b, struct(cast(array() AS array<int>) AS rows, cast(null AS double) AS top, 0 AS n),
        (a, x) -> CASE WHEN a.top IS NULL OR x._y - a.top > 16D
            THEN struct(array_append(a.rows, a.n + 1) AS rows, x._y AS top, a.n + 1 AS n)
            ELSE struct(array_append(a.rows, a.n) AS rows, a.top AS top, a.n AS n) END, a -> a.rows)""")
    placed = pages.select("doc_id", "page_number", F.explode(F.arrays_zip("b", fold.alias("r"))).alias("z"))
    return placed.select("doc_id", "page_number", F.col("z.b.block_id").alias("block_id"), F.col("z.b.side").alias("side"), F.col("z.r").alias("row"))


#: What a layout model's labels are called here; all others are text. Fixed values.
LABELS = {"section_header": "section_header", "list_item": "list_item", "table": "table"}


def block_type(label: Column) -> Column:
    kind = F.lit("text")
    for name, shown in LABELS.items():
        kind = F.when(label == name, shown).otherwise(kind)
    return kind


def table_text(cells: Column) -> Column:
    """Cells (row, col, text) as lines of a grid, gaps as empty cells; of cells in one place the last. Empty for no cells."""
    width = F.coalesce(F.array_max(F.transform(cells, lambda c: c["col"])), F.lit(-1)) + 1
    rows = F.array_sort(F.array_distinct(F.transform(cells, lambda c: c["row"])))
    cell = lambda r, k: F.coalesce(strip(F.get(F.reverse(F.filter(cells, lambda c: (c["row"] == r) & (c["col"] == k))), F.lit(0))["text"]), F.lit(""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda k: cell(r, k)), " | "), F.lit(" |"))
    return F.when(F.size(F.coalesce(cells, F.array().cast("array<struct<row:int,col:int,text:string>>"))) > 0, F.array_join(F.transform(rows, line), "\n")).otherwise("")


def provenance(prov: Column) -> Column:
    """Of where an item was found (page_no, l, b, r, t) the first with a page."""
    return F.get(F.filter(prov, lambda p: p["page_no"].isNotNull()), F.lit(0))


def blocks_of_items(items: DataFrame, leading: DataFrame | None = None) -> DataFrame:
    """Blocks (doc_id, page_number, block_id, block_type, text, reading_order, x0, y0, x1, y1) of a layout model's items.

    `items`: doc_id, position (order in the document), label, text, cells (of tables: array of row, col, text), prov (array of
    page_no, l, b, r, t). Items without text or page are left out. `leading` (doc_id, position, text): lines that go before the
    first page's blocks. Block ids run through a page, order numbers through the document.
    """
    text = F.when(F.col("text").isNotNull(), strip(F.col("text"))).when(F.col("label") == "table", table_text(F.col("cells"))).otherwise("")
    rows = items.select("doc_id", "position", block_type(F.col("label")).alias("block_type"), text.alias("text"), provenance(F.col("prov")).alias("p")).where("text <> '' AND p IS NOT NULL")
    rows = rows.select("doc_id", F.col("p.page_no").cast("int").alias("page_number"), F.lit(1).alias("_part"), "position", "block_type", "text", *(F.col(f"p.{a}").cast("double").alias(b) for a, b in (("l", "x0"), ("b", "y0"), ("r", "x1"), ("t", "y1"))))
    if leading is not None:
        first = rows.groupBy("doc_id").agg(F.min("page_number").alias("_first"))
        head = leading.where(strip(F.col("text")) != "").join(first, "doc_id", "left")
        none = F.lit(None).cast("double")
        rows = rows.unionByName(head.select("doc_id", F.coalesce("_first", F.lit(1)).alias("page_number"), F.lit(0).alias("_part"), "position", F.lit("text").alias("block_type"), strip(F.col("text")).alias("text"), *(none.alias(c) for c in ("x0", "y0", "x1", "y1"))))
    page, doc = Window.partitionBy("doc_id", "page_number").orderBy("_part", "position"), Window.partitionBy("doc_id").orderBy("page_number", "_part", "position")
    rows = rows.withColumn("reading_order", F.row_number().over(doc)).withColumn("_n", F.row_number().over(page))
    return rows.select("doc_id", "page_number", F.concat(F.lit("p"), "page_number", F.lit("-b"), "_n").alias("block_id"), "block_type", "text", "reading_order", "x0", "y0", "x1", "y1")


def header_name(first_page: Column) -> Column:
    """A name among the first five lines of a page's text: two to five words of letters once telephone numbers are gone, "Last,
    First" turned round, no role or degree; null if there is none."""
    from .reconciliation import NO_NAME

    kept = F.filter(F.transform(F.slice(lines(first_page), 1, 5), lambda x: strip(x)), lambda x: (x != "") & ~F.regexp_like(x, F.lit(r"[@+]|http")))
    bare = F.transform(kept, lambda x: strip(F.regexp_replace(x, r"[\d ().-]{7,}", "")))
    turned = F.transform(bare, lambda x: F.when(F.contains(x, F.lit(",")), F.array_join(F.reverse(F.filter(F.transform(F.split(x, ","), lambda p: strip(p)), lambda p: p != "")), " ")).otherwise(x))
    like = lambda x: F.size(F.split(x, r"\s+")).between(2, 5) & F.regexp_like(F.replace(x, F.lit(" "), F.lit("")), F.lit(r"^\p{L}+$")) & ~F.regexp_like(x, F.lit(NO_NAME))
    return F.get(F.filter(turned, like), F.lit(0))


def needs_header_name(markdown: Column) -> Column:
    """Whether none of the first five lines of markdown, blank ones and headings aside, looks like a name."""
    kept = F.slice(F.filter(F.transform(lines(F.coalesce(markdown, F.lit(""))), lambda x: strip(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#"))), 1, 5)
    return ~F.exists(kept, lambda x: F.size(F.split(x, r"\s+")).between(2, 5) & F.regexp_like(F.replace(x, F.lit(" "), F.lit("")), F.lit(r"^\p{L}+$")))


def audit(blocks: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(doc_id, pages, blocks, boxed, status, issues): what a reviewer of layouts looks at, a row per document."""
    boxed = F.count("x0") if "x0" in blocks.columns else F.lit(0).cast("long")
    rows = blocks.groupBy("doc_id").agg(F.countDistinct("page_number").alias("pages"), F.count("*").alias("blocks"), boxed.alias("boxed"))
    shown = F.coalesce(F.nullif("issues", F.lit("")), F.lit("none"))
    return rows.join(diagnostics.select("doc_id", "status", shown.alias("issues")), "doc_id")
