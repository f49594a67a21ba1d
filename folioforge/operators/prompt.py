"""Text that leaves for a model or an index: transcripts of pages, cleaned markdown, sanitized profile text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import collapse, lines, strip

from .layout import place

#: Words that go with contact data from the text that embeddings see. Fixed values.
DROPPED_WORDS = "male|female|nam|nữ|github|linkedin|tiktok|phone"


def effective_text(markdown: Column) -> Column:
    """Markdown without image marks and blank lines."""
    bare = F.regexp_replace(F.regexp_replace(markdown, r"<!--\s*image\s*-->", ""), r"!\[[^\]]*\]\([^)]*\)", "")
    return F.array_join(F.filter(F.transform(lines(bare), lambda x: strip(x)), lambda x: x != ""), "\n")


def sanitize(text: Column) -> Column:
    """Without e-mails, URLs and the words above; lines joined by blanks."""
    v = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", " ")
    v = F.regexp_replace(v, r"(?i)(?:https?://|www\.)\S+", " ")
    return collapse(F.regexp_replace(v, rf"(?iU)\b(?:{DROPPED_WORDS})\b", " "))


def sanitize_lines(text: Column) -> Column:
    """Each line sanitized, lines kept apart; lines that were nothing else go."""
    return F.array_join(F.filter(F.transform(lines(text), sanitize), lambda x: x != ""), "\n")


def page_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_number, transcript): `[page|block] text` lines in reading order."""
    line = F.concat(F.lit("["), F.col("page_number").cast("string"), F.lit("|"), "block_id", F.lit("] "), "text")
    rows = blocks.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("reading_order", line.alias("line")))).alias("l"))
    return rows.select("doc_id", "page_number", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript"))


def layout_transcript(boxes: DataFrame) -> DataFrame:
    """(doc_id, page_number, transcript): rows from top to bottom; on two-column pages each block names its row and side."""
    placed = place(boxes).join(boxes.select("doc_id", "page_number", "block_id", "text", "reading_order"), ["doc_id", "page_number", "block_id"])
    two = F.col("side") != "SINGLE"
    line = F.when(two, F.concat(F.lit("ROW "), F.col("row").cast("string"), F.lit(" "), "side", F.lit(" [p"), F.col("page_number").cast("string"), F.lit("|"), "block_id", F.lit("] "), "text")).otherwise(F.concat(F.lit("[p"), F.col("page_number").cast("string"), F.lit("|"), "block_id", F.lit("] "), "text"))
    rows = placed.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("row", "side", "reading_order", line.alias("line")))).alias("l"))
    head = F.when(F.exists("l", lambda x: x["side"] != "SINGLE"), "TWO-COLUMN").otherwise("SINGLE-COLUMN")
    return rows.select("doc_id", "page_number", F.concat(F.lit("PAGE "), F.col("page_number").cast("string"), F.lit(" "), head, F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("transcript"))
