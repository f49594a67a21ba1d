"""Document files: validation in a fixed order of checks, and parsers as adapters that emit pages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from folioforge.cluster import ship

MAX_BYTES = 20 * 1024 * 1024
HEAD, TAIL = 1024, 4096
PAGES = "path string, page_number int, text string, error string"


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below `path`: path, modificationTime, length, content. Spark's reader passes over files without bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(path)


def scan_all(spark: SparkSession, path: str) -> DataFrame:
    """scan_files() and the files without bytes, which Spark's reader passes over; names and sizes are listed on the driver, as
    Spark itself lists them. A path that is not there is an error of the listing; a folder given as a file is listed whole."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    if not fs.exists(where):
        raise FileNotFoundError(f"PATH_NOT_FOUND: {path}")
    found, empty = fs.listFiles(where, True), []
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0:
            empty.append((f.getPath().toString(), 0, b""))
    rows = scan_files(spark, path).select("path", "length", "content")
    return rows.unionByName(spark.createDataFrame(empty, "path string, length long, content binary")) if empty else rows


def named_files(names: DataFrame, scanned: DataFrame) -> DataFrame:
    """`names` (path) with length and content of `scanned`, and missing: no such regular file."""
    rows = names.join(scanned.select("path", "length", "content"), "path", "left")
    return rows.withColumn("missing", F.col("length").isNull())


@F.pandas_udf(BooleanType())
def is_docx(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A zip archive, undamaged, that holds the two parts of a document."""

    def good(data: bytes) -> bool:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return {"[Content_Types].xml", "word/document.xml"} <= set(z.namelist()) and z.testzip() is None
        except Exception:  # any damage
            return False

    for c in contents:
        yield c.map(lambda d: d is not None and good(bytes(d)))


def validate(files: DataFrame, *, max_bytes: int = MAX_BYTES) -> DataFrame:
    """`files` with extension, sha256 and error_code: null, or the first check that failed.

    Order: missing (of named_files), extension, empty, size, then the format: a PDF has its mark in the first 1024 bytes and its end in the last
    4096, and no encryption in either; a DOCX is a sound archive with its two parts.
    """
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    latin = F.decode("content", "ISO-8859-1")
    head, tail = F.left(latin, F.lit(HEAD)), F.right(latin, F.lit(TAIL))
    missing = F.col("missing") if "missing" in files.columns else F.lit(False)
    code = (
        F.when(missing, "FILE_NOT_FOUND").when(~ext.isin(".pdf", ".docx"), "UNSUPPORTED_EXTENSION")
        .when(F.col("length") == 0, "EMPTY_FILE")
        .when(F.col("length") > max_bytes, "FILE_TOO_LARGE")
        .when((ext == ".pdf") & (~F.contains(head, F.lit("%PDF-")) | ~F.contains(tail, F.lit("%%EOF"))), "CORRUPT_FILE")
        .when((ext == ".pdf") & (F.contains(head, F.lit("/Encrypt")) | F.contains(tail, F.lit("/Encrypt"))), "ENCRYPTED_FILE")
        .when((ext == ".docx") & ~is_docx("content"), "CORRUPT_FILE")
    )
    return files.withColumn("extension", ext).withColumn("sha256", F.sha2("content", 256)).withColumn("error_code", code)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs and tables in order; a row is its cells joined by bars, rows without text are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def words(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t"))

    out = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            out.append(words(node))
        elif node.tag == f"{_W}tbl":
            rows = [[words(c).strip() for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
            out += [" | ".join(r) for r in rows if any(r)]
    return "\n".join(out)


#: Parsers by extension: bytes to page texts. Register others, such as for PDF, where their libraries are installed.
PARSERS: dict[str, Callable[[bytes], list[str]]] = {".docx": lambda data: [docx_text(data)]}


def parse(files: DataFrame, parsers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """(path, page_number, text, error): pages of valid files; a file that fails, or has no parser, is one row with its error."""
    ship(files.sparkSession)
    known = dict(parsers or PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, ext, data in zip(b["path"], b["extension"], b["content"], strict=True):
                try:
                    rows += [(path, k, t, None) for k, t in enumerate(known[ext](bytes(data)), 1)]
                except KeyError:
                    rows.append((path, None, None, "PARSER_PENDING"))
                except Exception as e:
                    rows.append((path, None, None, f"PARSE_FAILED:{type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "error"]).astype({"page_number": "Int32"})

    return files.where("error_code IS NULL").select("path", "extension", "content").mapInPandas(run, PAGES)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_descriptions(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """(path, text, error) of job descriptions: text files as UTF-8, others through their parser; one without text is EMPTY_TEXT."""
    rows = scan_all(spark, path)
    plain = rows.where(F.lower("path").endswith(".txt")).select("path", F.decode("content", "UTF-8").alias("text"), F.lit(None).cast("string").alias("error"))
    pages = parse(validate(rows.where(~F.lower("path").endswith(".txt"))), parsers)
    other = pages.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n").alias("text"), F.max("error").alias("error"))
    every = plain.unionByName(other)
    return every.withColumn("error", F.coalesce("error", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "EMPTY_TEXT")))


def with_fallbacks(docs: DataFrame, extractors: list[tuple[str, Callable[[DataFrame], DataFrame]]], good: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Blocks of `docs` by the first extractor that does well on each document: (doc_id, extractor, and its columns).

    `extractors`: (name, documents to blocks), in order: layout model, text recognition, markdown, plain pages. `good` gives, of
    blocks, the (doc_id) that need no other; the last extractor keeps what is left. Each sees only documents that those before it
    did not settle.
    """
    left, out = docs, None
    for k, (name, extract) in enumerate(extractors):
        found = extract(left).withColumn("extractor", F.lit(name))
        if k < len(extractors) - 1:
            fine = good(found).select("doc_id").distinct()
            found = found.join(fine, "doc_id", "left_semi")
            left = left.join(fine, "doc_id", "left_anti")
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out


def markdown_pages(markdown: DataFrame) -> DataFrame:
    """Pages (doc_id, page_number, text) of documents' markdown: one page of its lines, image marks out."""
    from folioforge.operators.prompt import effective_text

    return markdown.select("doc_id", F.lit(1).alias("page_number"), effective_text(F.col("markdown")).alias("text"))


def weights_from_json(path: str, *, sensitive: tuple[str, ...] = ("name", "email", "phone", "address", "birth", "gender")) -> dict[str, dict[str, float]]:
    """Score weights of a file on the driver ({group: {part: weight}}): each group's sum is 1, and no part is a sensitive field."""
    import json

    with open(path, encoding="utf-8") as f:
        found = {k: v for k, v in json.load(f).items() if isinstance(v, dict)}
    for group, parts in found.items():
        if abs(sum(parts.values()) - 1) > 1e-9:
            raise ValueError(f"weights of {group} do not sum to 1")
        if group == "quality" and any(s in p.lower() for p in parts for s in sensitive):
            raise ValueError(f"{group} weighs a sensitive field")
    return found
