"""Contact data: extraction, masking with numbered tokens, and restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.columns import spare

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"
URL = r"(?i)(?:https?://|www\.)[^\s<>{}\[\]]+"
DATES = r"(?:19|20)[0-9]{2}\s*(?:-|–|—|to)\s*(?:19|20)[0-9]{2}"
DOI = r"^(?:19|20)[0-9]{2}\."
ADDRESS = r"(?iu)^(?:address|location|địa chỉ)\s*[:\-]\s*(.+)$"
KINDS = ("EMAIL", "PHONE", "URL")


def is_phone(c: Column) -> Column:
    """9 to 15 digits, and neither a range of years nor the start of a DOI."""
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return digits.between(9, 15) & ~F.regexp_like(c, F.lit(DATES)) & ~F.regexp_like(F.trim(c), F.lit(DOI))


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})"), F.lit(1))


def contact_columns(text: Column) -> dict[str, Column]:
    """email, phone, urls, n_urls, first_url and address of one text, the first of each in reading order; each pattern runs
    only where the text holds a sign of it."""
    t = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<string>")
    some = F.contains(t, F.lit("://")) | F.contains(F.lower(t), F.lit("www."))
    urls = F.array_distinct(F.transform(matches(t, URL), lambda u: F.regexp_replace(u, "[.,;:)]+$", "")))
    urls = F.when(some, F.transform(urls, lambda u: F.when(F.regexp_like(u, F.lit("^(?i)https?://")), u).otherwise(F.concat(F.lit("https://"), u)))).otherwise(none)
    labelled = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_extract(F.trim(x), ADDRESS, 1))), lambda x: x != "")
    return {
        "email": F.when(F.contains(t, F.lit("@")), F.get(matches(t, EMAIL), F.lit(0))),
        "phone": F.get(F.filter(matches(t, PHONE), is_phone), F.lit(0)),
        "urls": urls, "n_urls": F.size(urls).cast("int"), "first_url": F.get(urls, F.lit(0)), "address": F.get(labelled, F.lit(0)),
    }


def contacts(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, email, phone, urls, n_urls, first_url, address) of each row; no shuffle."""
    return docs.select(F.col(doc).alias("doc_id"), *(c.alias(n) for n, c in contact_columns(F.col(text)).items()))


#: What looks like a token of ours in a text that nobody has masked yet: it is masked itself, so that restoring is exact.
TOKEN = r"\[ANON_[A-Z]+(?:_[0-9]+)?\]"
HEADER_MARK = "[HEADER_REDACTED]"
MAPPING = "array<struct<token:string,original:string>>"
HEADER_MODES = ("selective", "blanket-legacy")


def _replaced(rows: DataFrame, column: str, found: str, kept: str, kind: str, pattern: str, keep=None) -> DataFrame:
    """`rows` with the matches of a pattern in `column` replaced by tokens numbered in order of first use, and `kept`: those
    matches; `found` is a name for work in between."""
    hits = matches(F.col(column), pattern)
    good = F.filter(hits, keep) if keep is not None else hits
    rows = rows.withColumn(found, hits).withColumn(kept, F.array_distinct(good))
    token = lambda m: F.concat(F.lit(f"[ANON_{kind}_"), F.array_position(kept, m).cast("string"), F.lit("]"))
    shown = F.transform(found, lambda m: F.when(F.array_contains(kept, m), token(m)).otherwise(m))
    flags, bare = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    between = F.split(F.col(column), f"{flags}(?:{bare})", -1)
    joined = F.array_join(F.zip_with(between, shown, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    return rows.withColumn(column, F.when(F.size(found) > 0, joined).otherwise(F.col(column))).drop(found)


def quoted(c: Column) -> Column:
    """A text as a pattern that matches it alone: a backslash before all that is neither letter, digit nor space."""
    return F.regexp_replace(c, r"([^\p{L}\p{N}\s])", r"\\$1")


def mask(docs: DataFrame, *, text: str = "text", name: str | None = None) -> DataFrame:
    """`docs` with masked and mapping (token, original): a known name in any case, then e-mails, phones and URLs.

    Tokens are numbered by kind in order of first use; all of it is expressions. What looks like a token already is masked
    as well. Null text stays null, without a mapping; a null or empty name masks nothing. Columns of `docs` named masked or
    mapping are an error. The mapping is personal data: keep it apart from what leaves the cluster.
    """
    clash = {"masked", "mapping"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    out, found, *kept = spare(docs, "m", "found", *(k.lower() for k in (*KINDS, "TOKEN")))
    held = dict(zip((*KINDS, "TOKEN"), kept, strict=True))
    rows = docs.withColumn(out, F.col(text))
    given = F.nullif(F.col(name), F.lit("")) if name else F.lit(None).cast("string")
    rows = _replaced(rows, out, found, held["TOKEN"], "TOKEN", TOKEN)
    if name:
        pattern = F.concat(F.lit(r"(?iu)"), quoted(given))
        rows = rows.withColumn(out, F.when(given.isNotNull(), F.call_function("regexp_replace", F.col(out), pattern, F.lit("[ANON_NAME]"))).otherwise(F.col(out)))
    for kind, pattern, keep in (("EMAIL", EMAIL, None), ("PHONE", PHONE, is_phone), ("URL", URL, None)):
        rows = _replaced(rows, out, found, held[kind], kind, pattern, keep)
    own = F.when(given.isNotNull() & F.contains(out, F.lit("[ANON_NAME]")), F.array(F.struct(F.lit("[ANON_NAME]").alias("token"), given.alias("original")))).otherwise(F.array().cast(MAPPING))
    listed = (_pairs(k, held[k]) for k in (*KINDS, "TOKEN"))  # literal tokens are put back last
    mapping = F.coalesce(F.concat(own, *listed), F.array().cast(MAPPING)).cast(MAPPING)
    return rows.select(*docs.columns, F.col(out).alias("masked"), mapping.alias("mapping"))


def _pairs(kind: str, held: str) -> Column:
    return F.transform(held, lambda m, i: F.struct(F.concat(F.lit(f"[ANON_{kind}_"), (i + 1).cast("string"), F.lit("]")).alias("token"), m.alias("original")))


def restore(text: Column, mapping: Column) -> Column:
    """Tokens replaced by what they stand for, in the order of the mapping."""
    return F.aggregate(mapping, text, lambda t, m: F.replace(t, m["token"], m["original"]))


_BREAK = "\n\x1e\n"


def mask_blocks(blocks: DataFrame, identities: DataFrame | None = None, *, mode: str = "selective", header: int = 8) -> DataFrame:
    """(doc_id, blocks, mapping): each document's blocks (page_number, reading_order, block_id, text) masked with one numbering.

    `identities` (doc_id, name, source, confidence): the name is masked too. Unless it is a sure header identity (see
    identity.trusted), or with mode blanket-legacy, the first `header` blocks of the first page are blanked and count for nothing.
    """
    from .identity import trusted

    if mode not in HEADER_MODES:
        raise ValueError(f"mode has to be one of {HEADER_MODES}")
    one = F.struct(F.col("page_number").cast("int").alias("page_number"), F.col("reading_order").cast("int").alias("reading_order"), "block_id", "text")
    rows = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("_b"))
    known = identities if identities is not None else blocks.sparkSession.createDataFrame([], "doc_id long, name string, source string, confidence double")
    rows = rows.join(known.select("doc_id", F.col("name").alias("_name"), trusted(F.col("source"), F.col("confidence")).alias("_sure")), "doc_id", "left")
    blank = (F.lit(mode != "selective") | ~F.coalesce("_sure", F.lit(False)))
    first = F.size(F.filter("_b", lambda b: b["page_number"] == F.element_at("_b", 1)["page_number"]))
    held = F.when(blank, F.least(F.lit(header), first)).otherwise(0)
    shown = F.transform("_b", lambda b, i: F.when(i < F.col("_h"), F.lit(HEADER_MARK)).otherwise(F.coalesce(b["text"], F.lit(""))))
    rows = rows.withColumn("_h", held).withColumn("_t", F.array_join(shown, _BREAK))
    done = mask(rows, text="_t", name="_name").withColumn("_p", F.split("masked", _BREAK, -1))
    out = F.zip_with("_b", "_p", lambda b, t: b.withField("text", t))
    return done.select("doc_id", out.alias("blocks"), "mapping")


def restore_profiles(profiles: DataFrame, mappings: DataFrame) -> DataFrame:
    """Profiles (document.PROFILE) with every text restored; a missing e-mail or phone is the first one that was masked.

    `mappings` (doc_id, mapping) go through the profile as JSON, so nested texts are restored as well.
    """
    names = [c for c in profiles.columns if c != "doc_id"]
    kind = profiles.select(*names).schema
    rows = profiles.join(mappings.select("doc_id", "mapping"), "doc_id", "left")
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    safe = F.transform("mapping", lambda m: m.withField("original", F.replace(F.replace(m["original"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))))
    back = F.from_json(F.coalesce(restore(text, safe), text), kind)
    rows = rows.withColumn("_p", back).select("doc_id", "_p.*", "mapping")
    first = lambda k: F.get(F.filter("mapping", lambda m: F.startswith(m["token"], F.lit(f"[ANON_{k}"))), F.lit(0))["original"]
    if "email" in names:
        rows = rows.withColumn("email", F.coalesce(F.nullif("email", F.lit("")), first("EMAIL")))
    if "phone" in names:
        rows = rows.withColumn("phone", F.coalesce(F.nullif("phone", F.lit("")), first("PHONE")))
    return rows.drop("mapping")


def apply_identity(profiles: DataFrame, identities: DataFrame) -> DataFrame:
    """Profiles with the name, its confidence and its reference (evidence, may be null) of a local identity, where there is one."""
    have = [c for c in identities.columns if c == "evidence"]
    rows = profiles.join(identities.select("doc_id", F.col("name").alias("_n"), F.col("confidence").alias("_c"), *(F.col(c).alias("_e") for c in have)), "doc_id", "left")
    one = F.col("_n").isNotNull()
    name = F.lit("candidateName")
    put = lambda c, v: F.map_concat(F.map_filter(F.coalesce(c, F.expr("map()").cast(profiles.schema[c].dataType)), lambda k, x: k != name), F.create_map(name, v).cast(profiles.schema[c].dataType))
    rows = rows.withColumn("candidate_name", F.when(one, F.col("_n")).otherwise(F.col("candidate_name"))).withColumn("field_confidence", F.when(one, put("field_confidence", F.col("_c"))).otherwise(F.col("field_confidence")))
    if have:
        rows = rows.withColumn("field_evidence", F.when(one & F.col("_e").isNotNull(), put("field_evidence", F.array("_e"))).otherwise(F.col("field_evidence")))
    return rows.drop("_n", "_c", "_e")


def apply_contact(profiles: DataFrame, found: DataFrame) -> DataFrame:
    """Profiles with email, phone, urls and address from the document alone (see contacts), null where it has none."""
    mine = ("email", "phone", "urls", "address")
    return profiles.drop(*mine).join(found.select("doc_id", *mine), "doc_id", "left").select(*profiles.columns)


def mask_counts(masked: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_phone, n_url): how many different originals each mapping holds; a null mapping holds none."""
    def of(kind: str) -> Column:
        return F.size(F.filter(F.coalesce("mapping", F.array().cast(MAPPING)), lambda m: F.startswith(m["token"], F.lit(f"[ANON_{kind}_"))))

    sizes = [of(k).cast("int").alias(f"n_{k.lower()}") for k in KINDS]
    return masked.select("doc_id", *sizes)
