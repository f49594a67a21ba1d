"""Parsers as table functions for SQL: one file in, its blocks out.

    register(spark)
    SELECT * FROM folio_blocks(TABLE(SELECT path, content FROM files) PARTITION BY path)
    SELECT * FROM folio_blocks(TABLE(files) PARTITION BY (path), 'page')

The argument table needs a path and a content; its path keeps its type. The second argument says what a row is: a block
(a line of a page, by default) or a whole page.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

UNITS = ("block", "page")


class FileBlocks:
    """(path, page_number, block_id, text, error): blocks of files; a file that cannot be parsed is one row with its error."""

    def __init__(self):
        self.unit = "block"

    @staticmethod
    def analyze(files: AnalyzeArgument, unit: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not files.isTable:
            raise ValueError("folio_blocks takes a table: TABLE(...)")
        known = {f.name.lower(): f.dataType for f in files.dataType.fields}
        missing = {"path", "content"} - set(known)
        if missing:
            raise ValueError(f"the table lacks {sorted(missing)}")
        if unit is not None and unit.value not in UNITS:
            raise ValueError(f"a row is one of {UNITS}")
        return AnalyzeResult(StructType([StructField("path", known["path"]), StructField("page_number", IntegerType()), StructField("block_id", StringType()), StructField("text", StringType()), StructField("error", StringType())]))

    def eval(self, files: Row, unit: str = "block") -> Iterator[tuple]:
        from folioforge.sources.files import PARSERS
        from folioforge.sources.folio import MAX_BYTES, Found, why_not

        path, data = files["path"], bytes(files["content"] or b"")
        extension = Found(str(path), 0, 0).extension
        error = why_not(extension, len(data), data, MAX_BYTES)
        if error is None:
            try:
                for number, text in enumerate(PARSERS[extension](data), 1):
                    if unit == "page":
                        yield path, number, None, text, None
                        continue
                    kept = [x.strip() for x in text.splitlines() if x.strip()]
                    yield from ((path, number, f"p{number}-b{k}", x, None) for k, x in enumerate(kept, 1))
                return
            except KeyError:
                error = "PARSER_PENDING"
            except Exception as e:
                error = f"PARSE_FAILED:{type(e).__name__}"
        yield path, None, None, None, error


def register(spark: SparkSession) -> None:
    from folioforge.cluster import ship

    ship(spark)
    spark.udtf.register("folio_blocks", udtf(FileBlocks))
