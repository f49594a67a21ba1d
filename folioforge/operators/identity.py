"""Names of candidates from file names and from the top of a document's first page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.text import bind, decomposed, strip

from .reconciliation import NO_NAME

#: Words of file names that are no names, words that end a name, words of trade before these, and marks of versions. Fixed values.
NOISE = "cv|resume|curriculum|vitae|final|draft|copy|updated|version|file|profile"
ROLES = "developer|engineer|analyst|designer|manager|intern|scientist|architect|consultant|specialist|administrator"
MODIFIERS = "backend|front|frontend|fullstack|full|stack|software|data|science|machine|learning|web|mobile|cloud|devops|qa|ui|ux"
VERSION = r"(?i)^v?\d+(?:\.\d+)*$|^\d+(?:yrs?|years?)$"
#: Labels of a name field and titles of documents, without accents; words of section headings. Fixed values.
NAME_LABELS = ("ho va ten", "ho ten", "full name", "fullname", "name")
TITLES = ("so yeu ly lich", "curriculum vitae", "resume", "cv")
SECTIONS = r"(?iU)\b(?:summary|profile|skills?|technical skills?|experience|employment|education|projects?|certifications?|languages?|work history|kinh nghi[eệ]m|k[ỹy] n[aă]ng|h[oọ]c v[aấ]n|d[ựu] [aá]n)\b"
NAME = r"^\p{L}{2,}(?:[ '\-]\p{L}{2,}){1,4}(?:\s*\([^)]{2,40}\))?$"
FORM_PART, FONT_PART, ROW, SAME_SIZE = 0.35, 0.25, 3.0, 0.5
SURE_SOURCES = ("pdf_header_font", "pdf_header_form", "unified_header")


def plain(text: Column) -> Column:
    """Lower case without accents, and without blanks and colons at the ends; the letter with a stroke is a plain d."""
    bare = F.regexp_replace(decomposed(F.lower(text)), r"\p{Mn}", "")
    return strip(F.translate(bare, "đ", "d"), ":")


def as_name(text: Column) -> Column:
    """Two to five words of letters, "Last, First" turned round; null for anything else."""
    v = F.regexp_replace(strip(text), r"(?U)\s+", " ")
    turned = bind(F.split(v, ","), lambda parts: F.when(F.size(parts) == 2, strip(F.concat(strip(parts[1]), F.lit(" "), strip(parts[0])))).otherwise(F.array_join(parts, ",")))
    return bind(turned, lambda x: F.when(F.regexp_like(x, F.lit(NAME)), x))


def from_file_name(path: Column) -> Column:
    """The name in a file name, of confidence 0.7; null for random names, names of roles and single words.

    Noise goes from both ends, versions from the last; a word of a role ends the name, and words of trade before it go.
    """
    stem = strip(F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[A-Za-z0-9]+$", ""))
    words = F.filter(F.split(F.translate(stem, "_", " "), r"\s+"), lambda w: w != "")
    noise = lambda w: F.regexp_like(F.lower(w), F.lit(rf"^(?:{NOISE})$"))
    after = lambda ws, bad: F.coalesce(F.array_min(F.filter(F.transform(ws, lambda w, i: F.when(~bad(w), i + 1)), lambda i: i.isNotNull())), F.size(ws) + 1)

    def dropped(ws: Column, bad) -> Column:
        return bind(ws, lambda x: F.when(F.size(x) > 0, F.slice(x, after(x, bad), F.size(x))).otherwise(x))

    trade = lambda w: F.regexp_like(F.lower(w), F.lit(rf"^(?:{MODIFIERS})$"))

    def before_role(kept: Column) -> Column:
        role = F.array_position(F.transform(kept, lambda w: F.regexp_like(F.lower(w), F.lit(rf"^(?:{ROLES})$"))), True)
        return bind(role, lambda r: F.when(r > 0, F.reverse(dropped(F.reverse(F.slice(kept, F.lit(1), F.greatest(r - 1, F.lit(0)).cast("int"))), trade))).otherwise(kept))

    kept = F.reverse(dropped(F.reverse(dropped(words, noise)), lambda w: noise(w) | F.regexp_like(w, F.lit(VERSION))))
    return bind(F.array_join(bind(kept, before_role), " "), lambda told: bind(as_name(told), lambda name: F.when(~F.regexp_like(stem, F.lit("(?i)^[0-9a-f]{12,}$")) & ~F.regexp_like(name, F.lit(NO_NAME)), name)))


def flip(name: Column) -> Column:
    """`Last, First` as `First Last`; names with no comma or several stay."""
    parts = F.split(name, ",")
    return F.when(F.size(parts) == 2, F.concat(strip(parts[1]), F.lit(" "), strip(parts[0]))).otherwise(strip(name))


def trusted(source: Column, confidence: Column) -> Column:
    """Whether a header identity is sure enough to mask it alone, without blanking the header."""
    return F.coalesce((confidence >= 0.95) & source.isin(*SURE_SOURCES), F.lit(False))


def from_header(lines: DataFrame) -> DataFrame:
    """(doc_id, name, source, confidence) from the lines at the top of first pages: text, x0, y0, x1, size, height (of the page).

    A form decides first: the value behind a name label on its line, or beside it (3 points up or down, to its right).
    Else the name in the largest type of the top quarter, unless another is as large (half a point). No row where neither tells.
    """
    rows = lines.where((F.col("y0") <= F.col("height") * FORM_PART) & (strip(F.col("text")) != "")).withColumn("text", strip(F.col("text")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("y0", "x0", "text"))).withColumn("name", as_name(F.col("text"))).withColumn("key", plain(F.col("text")))
    behind = as_name(F.regexp_extract("text", r"^.*?:\s*(.+)$", 1))
    inline = rows.where(plain(F.regexp_extract("text", r"^(.*?):\s*.+$", 1)).isin(*NAME_LABELS) & behind.isNotNull()).select("doc_id", F.col("n").alias("label"), F.lit(0).alias("value"), behind.alias("name"))
    label = rows.where(F.col("key").isin(*NAME_LABELS)).select("doc_id", F.col("n").alias("label"), F.col("y0").alias("_y"), F.col("x1").alias("_x"))
    beside = label.join(rows.where("name IS NOT NULL"), "doc_id").where((F.abs(F.col("y0") - F.col("_y")) <= ROW) & (F.col("x0") >= F.col("_x") - 2)).select("doc_id", "label", F.col("n").alias("value"), "name")
    form = inline.unionByName(beside).groupBy("doc_id").agg(F.min(F.struct("label", "value", "name")).alias("x")).select("doc_id", F.col("x.name").alias("form"))
    told = rows.where((F.col("y0") <= F.col("height") * FONT_PART) & F.col("name").isNotNull() & ~F.regexp_like("text", F.lit(r"(?i)@|https?://|www\.")) & ~F.regexp_like("text", F.lit(SECTIONS)) & ~F.regexp_like("text", F.lit(NO_NAME)) & ~F.col("key").isin(*TITLES))
    by = Window.partitionBy("doc_id").orderBy(F.desc("size"), "n")
    top = told.withColumn("r", F.row_number().over(by)).withColumn("next", F.lead("size").over(by)).where("r = 1").where(F.col("next").isNull() | (F.col("size") - F.col("next") >= SAME_SIZE)).select("doc_id", F.col("name").alias("font"))
    both = form.join(top, "doc_id", "full_outer")
    return both.select("doc_id", F.coalesce("form", "font").alias("name"), F.when(F.col("form").isNotNull(), "pdf_header_form").otherwise("pdf_header_font").alias("source"), F.lit(1.0).alias("confidence"))


def identities(header: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, name, source, confidence): the header's name, else the file name's (`files`: doc_id, path)."""
    named = files.select("doc_id", from_file_name(F.col("path")).alias("_f"))
    rows = named.join(header, "doc_id", "full_outer")
    own = F.col("name").isNotNull()
    out = rows.select("doc_id", F.coalesce("name", "_f").alias("name"), F.when(own, F.col("source")).otherwise("filename_fallback").alias("source"), F.when(own, F.col("confidence")).otherwise(0.7).alias("confidence"))
    return out.where("name IS NOT NULL")
