"""Named queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.functions import vectors as V
from folioforge.operators import blocks, evaluate, evidence, privacy, reports, scoring, search, sections, timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = date(2024, 6, 1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def quoted(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool | int | float):
        return str(v)
    if isinstance(v, date):
        return f"DATE '{v}'"
    if isinstance(v, list | tuple):
        return "[" + ", ".join(map(quoted, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


# ---- documents as blocks

_L = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '\r\n|\r', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_HEADING_IN = ", ".join(quoted(a) for a, _ in sections.ALIASES)
_HEADING_RE = "|".join(a for a, _ in sections.ALIASES if len(a) >= 4)
_KEY = r"regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(lower(line)), '^[#\-–—•|:]+|[#\-–—•|:]+$', '', 'g')), '^[0-9]{1,2}[.)\s-]+', '')), '\s+', ' ', 'g')"
_IS_HEADING = f"(length({_KEY}) <= 60 AND ({_KEY} IN ({_HEADING_IN}) OR regexp_matches({_KEY}, '^(?:{_HEADING_RE}) | (?:{_HEADING_RE})$')))"
_BLOCKS = f"b AS (SELECT doc_id, unnest({_L}) AS line, unnest(generate_series(1, len({_L}))) AS n FROM documents)"


@query(f"WITH {_BLOCKS} SELECT doc_id, 1 AS page_number, 'p1-b' || n AS block_id, CASE WHEN {_IS_HEADING} THEN 'section_header' ELSE 'text' END AS block_type, line AS text, CAST(n AS INTEGER) AS reading_order FROM b")
def doc_blocks(spark, sf):
    return blocks.blocks(table(spark, sf, "documents"))


_DIAGNOSE = f"""WITH {_BLOCKS}, c AS (SELECT doc_id, CAST(coalesce(sum(length(line)), 0) AS BIGINT) AS char_count, count(line) AS block_count, count(*) FILTER ({_IS_HEADING}) AS heading_count FROM documents LEFT JOIN b USING (doc_id) GROUP BY doc_id),
i AS (SELECT *, concat_ws(',', CASE WHEN char_count < 80 THEN 'TEXT_TOO_SHORT' END, CASE WHEN block_count < 2 THEN 'TOO_FEW_BLOCKS' END, CASE WHEN char_count >= 1500 AND heading_count < 2 THEN 'FEW_HEADINGS' END) AS issues, CASE WHEN char_count < 80 OR block_count < 2 THEN 'fallback_required' ELSE 'usable' END AS status FROM c)"""


@query(_DIAGNOSE + " SELECT doc_id, char_count, block_count, heading_count, status, issues FROM i")
def doc_diagnostics(spark, sf):
    return blocks.with_diagnosis(table(spark, sf, "documents")).select("doc_id", "char_count", "block_count", "heading_count", "status", "issues")


_E, _P, _U = privacy.EMAIL, privacy.PHONE, r"(?:[hH][tT][tT][pP][sS]?://|[wW][wW][wW]\.)[^\s<>{}\[\]]+"
_PHONES = f"list_filter(regexp_extract_all(t, '{_P}'), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 9 AND 15 AND NOT regexp_matches(p, '{privacy.DATES}') AND NOT regexp_matches(trim(p), '{privacy.DOI}'))"
_URLS = rf"list_distinct(list_transform(regexp_extract_all(t, '{_U}'), lambda u: CASE WHEN regexp_matches(u, '^(?i)https?://') THEN regexp_replace(u, '[.,;:)]+$', '') ELSE 'https://' || regexp_replace(u, '[.,;:)]+$', '') END))"
_CONTACTS = f"""k AS (SELECT doc_id, regexp_extract_all(t, '{_E}')[1] AS email, ({_PHONES})[1] AS phone, CAST(len({_URLS}) AS INTEGER) AS n_urls FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


@query("WITH " + _CONTACTS + " SELECT * FROM k")
def contact_extract(spark, sf):
    return privacy.contacts(table(spark, sf, "documents")).select("doc_id", "email", "phone", "n_urls")


@query(_DIAGNOSE.replace("WITH ", f"WITH {_CONTACTS}, ", 1) + " SELECT i.*, email IS NOT NULL AS has_email, phone IS NOT NULL AS has_phone, n_urls, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM i JOIN k USING (doc_id) JOIN documents USING (doc_id)")
def doc_profile(spark, sf):
    """The flagship: every document's blocks, diagnostics, contacts and tokens in one row, from one scan without a shuffle."""
    docs = table(spark, sf, "documents")
    seen = privacy.contact_columns(F.col("text"))
    rows = blocks.with_diagnosis(docs)
    more = {"has_email": seen["email"].isNotNull(), "has_phone": seen["phone"].isNotNull(), "n_urls": seen["n_urls"], "tokens": T.estimate_tokens(F.col("text"))}
    return rows.select("doc_id", "char_count", "block_count", "heading_count", "status", "issues", *(c.alias(n) for n, c in more.items()))


_BROKEN = r"[A-Za-z0-9._%+-]+\s*@\s*[A-Za-z0-9-]+(?:\s*\.\s*[A-Za-z0-9-]+)+"
_PLAIN = "nfc_normalize(translate(regexp_replace(text, '\r\n?', chr(10), 'g'), '•●▪◦‣∙', '------'))"
_JOINED = rf"array_to_string(list_transform(list_zip(string_split_regex({_PLAIN}, '{_BROKEN}'), regexp_extract_all({_PLAIN}, '{_BROKEN}')), lambda x: x[1] || coalesce(regexp_replace(x[2], '\s+', '', 'g'), '')), '')"
_JOINED = rf"regexp_replace(regexp_replace(regexp_replace({_JOINED}, '\b[hH][tT][tT][pP][sS]\s*:\s*/\s*/\s*', 'https://', 'g'), '\b[hH][tT][tT][pP]\s*:\s*/\s*/\s*', 'http://', 'g'), '\b[wW][wW][wW]\s*\.\s*', 'www.', 'g')"
_DOMAINS = r"regexp_replace(regexp_replace({}, '([A-Za-z0-9])\s*\.\s*([A-Za-z]{{2,}}(?:[^\p{{L}}\p{{N}}_]|$))', '\1.\2', 'g'), '([A-Za-z0-9])(?:\s+\.\s*|\.\s+)([A-Za-z]{{2,}}(?:[^\p{{L}}\p{{N}}_]|$))', '\1.\2', 'g')"


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split({_DOMAINS.format(_JOINED)}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t\f\v]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS normalized FROM documents""")
def text_normalize(spark, sf):
    """Every document: e-mail addresses, URLs, domains, bullets, blanks and blank lines."""
    return table(spark, sf, "documents").select("doc_id", T.normalized(F.col("text")).alias("normalized"))


@query(r"""WITH r AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))), lambda x: x <> '') AS l FROM conversations),
s AS (SELECT conv_id, count(*) AS pages FROM r GROUP BY conv_id), e AS (SELECT conv_id, unnest([l[1], l[-1]]) AS line FROM r WHERE len(l) > 0)
SELECT conv_id AS doc_id, line, count(*) AS occurrences, any_value(pages) AS pages FROM e JOIN s USING (conv_id) WHERE length(line) <= 160 AND pages > 1 GROUP BY conv_id, line HAVING count(*) >= greatest(2, (3 * any_value(pages) + 4) // 5)""")
def repeated_margins(spark, sf):
    return blocks.repeated_margins(table(spark, sf, "conversations"), doc="conv_id", page="turn")


@query("SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(rf"WITH {_BLOCKS} SELECT doc_id, 'p1-b' || n AS block_id, regexp_replace(line, '\s+', ' ', 'g') AS pruned, CAST(ceil(length(line) / 4.0) AS BIGINT) AS tokens_before, CAST(ceil(length(regexp_replace(line, '\s+', ' ', 'g')) / 4.0) AS BIGINT) AS tokens_after FROM b")
def prune_blocks(spark, sf):
    return blocks.prune(blocks.blocks(table(spark, sf, "documents")))


def _masked(source: str, out: str, kind: str, pattern: str, keep: str = "true") -> str:
    """SQL: a step that replaces the matches of a pattern in t by numbered tokens."""
    number = "list_position(f, x)"
    return f"""{out}0 AS (SELECT *, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM {source}),
{out}1 AS (SELECT *, list_filter(m, lambda x, i: {keep} AND list_position(m, x) = i) AS f FROM {out}0),
{out} AS (SELECT doc_id, n + len(f) AS n, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(list_transform([m[i]], lambda x: CASE WHEN x IS NULL THEN '' WHEN {number} > 0 THEN '[ANON_{kind}_' || {number} || ']' ELSE x END)[1], '')), '') AS t FROM {out}1)"""


_VALID = f"length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15 AND NOT regexp_matches(x, '{privacy.DATES}') AND NOT regexp_matches(trim(x), '{privacy.DOI}')"


@query(f"WITH s AS (SELECT doc_id, 0 AS n, text AS t FROM documents), {_masked('s', 'a', 'EMAIL', _E)}, {_masked('a', 'b', 'PHONE', _P, _VALID)}, {_masked('b', 'c', 'URL', _U)} SELECT doc_id, t AS masked, CAST(n AS INTEGER) AS n_tokens FROM c")
def pii_mask(spark, sf):
    return privacy.mask(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "masked", F.size("mapping").alias("n_tokens"))


#: Names with every kind of mark, one a document, and the document with its name in three spellings.
NAMED = ("O'Brien {}", "J. Doe-Lee {}", "A+B (Holding) {}", "Zoë Müller {}", "C$h | x^y {}", "[Robin] *Example* {}", "Nguyễn Văn {}", "back\\slash? {}")
_NAME = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {quoted(n.split('{')[0])}" for k, n in enumerate(NAMED)) + " END || doc_id"


@query(f"""WITH s AS (SELECT doc_id, 0 AS n, regexp_replace(nm || ' wrote: ' || coalesce(text, '') || ' (' || upper(nm) || '; ' || lower(nm) || 's)', regexp_escape(nm), '[ANON_NAME]', 'gi') AS t FROM (SELECT doc_id, text, {_NAME} AS nm FROM documents)),
{_masked('s', 'a', 'EMAIL', _E)}, {_masked('a', 'b', 'PHONE', _P, _VALID)}, {_masked('b', 'c', 'URL', _U)} SELECT doc_id, t AS masked, true AS restored FROM c""")
def pii_mask_names(spark, sf):
    """Every document under a name of its own, which no spelling of leaves the cluster and restoring brings back."""
    name = F.concat(F.element_at(F.array(*(F.lit(n.split("{")[0]) for n in NAMED)), (F.col("doc_id") % 8 + 1).cast("int")), F.col("doc_id").cast("string"))
    rows = table(spark, sf, "documents").select("doc_id", name.alias("nm"), F.concat(name, F.lit(" wrote: "), F.coalesce("text", F.lit("")), F.lit(" ("), F.upper(name), F.lit("; "), F.lower(name), F.lit("s)")).alias("text"))
    done = privacy.mask(rows, name="nm")
    return done.select("doc_id", "masked", (F.lower(privacy.restore(F.col("masked"), F.col("mapping"))) == F.lower("text")).alias("restored"))


@query(f"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_E}', '[ANON_EMAIL_0]', 'g') AS t, coalesce(text, '') AS o FROM documents)
SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(o, '{_E}'))) AS INTEGER) AS n_email, CAST(len(list_distinct({_PHONES})) AS INTEGER) AS n_phone, CAST(len(list_distinct(regexp_extract_all(t, '{_U}'))) AS INTEGER) AS n_url FROM t""")
def pii_mask_counts(spark, sf):
    return privacy.mask_counts(privacy.mask(table(spark, sf, "documents").select("doc_id", "text")))


@query("SELECT doc_id, text AS restored FROM documents")
def deanonymize(spark, sf):
    masked = privacy.mask(table(spark, sf, "documents").select("doc_id", "text"))
    return masked.select("doc_id", privacy.restore(F.col("masked"), F.col("mapping")).alias("restored"))


@query(f"WITH {_BLOCKS} SELECT doc_id, 'p1-b' || n AS block_id, CASE WHEN n <= 8 THEN '[HEADER_REDACTED]' ELSE line END AS text FROM b")
def header_blank_zone(spark, sf):
    return blocks.header_zone(blocks.blocks(table(spark, sf, "documents"))).select("doc_id", "block_id", "text")


# ---- sections, taxonomy, extraction


# ---- intervals

_JOBS = "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(30 + o_custkey % 300 AS INTEGER) AS e FROM orders"


def jobs_of_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("s"), F.expr("date_add(to_date(o_orderdate), cast(30 + o_custkey % 300 AS int))").alias("e"))


@query(f"""WITH j AS ({_JOBS}), r AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM j),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r),
g AS (SELECT o_custkey, island, max(e) - min(s) AS days, count(*) AS n FROM i GROUP BY ALL)
SELECT o_custkey, CAST(sum(n) AS BIGINT) AS intervals, count(*) AS islands, CAST(sum(days) AS BIGINT) AS days FROM g GROUP BY o_custkey""")
def experience_years(spark, sf):
    return timeline.merged_years(jobs_of_orders(spark, sf), key="o_custkey", start="s", end="e").drop("years")


@query(f"""WITH j AS ({_JOBS}) SELECT a.o_custkey, a.o_orderkey AS left_id, b.o_orderkey AS right_id, CAST(least(a.e, b.e) - greatest(a.s, b.s) AS DOUBLE) / least(a.e - a.s, b.e - b.s) AS overlap
FROM j a JOIN j b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE least(a.e, b.e) - greatest(a.s, b.s) > 0 AND CAST(least(a.e, b.e) - greatest(a.s, b.s) AS DOUBLE) / least(a.e - a.s, b.e - b.s) >= 0.5""")
def experience_overlap_pairs(spark, sf):
    return timeline.overlapping_pairs(jobs_of_orders(spark, sf), key="o_custkey", id_col="o_orderkey", start="s", end="e", least=0.5)


# ---- evidence and layout


@query("SELECT item_id AS passage_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''")
def evidence_grounding(spark, sf):
    return evidence.passages_in(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(f"WITH {_BLOCKS} SELECT a.doc_id, CAST(a.n AS INTEGER) AS anchor, CAST(b.n AS INTEGER) AS near FROM b a JOIN b ON a.doc_id = b.doc_id AND b.n BETWEEN a.n - 4 AND a.n + 4 AND a.n <> b.n")
def evidence_band_join(spark, sf):
    return evidence.context_pairs(table(spark, sf, "documents"))


# ---- scores, summaries, search


@query("""SELECT doc_id, CASE WHEN wsum > 0 THEN round(top / wsum, 6) ELSE 0 END AS score FROM (SELECT doc_id,
coalesce(0.6 * (100.0 * quality), 0) + coalesce(0.4 * CASE WHEN toxic = 0 THEN 100.0 END, 0) AS top, CASE WHEN quality IS NULL THEN 0 ELSE 0.6 END + CASE WHEN toxic = 0 THEN 0.4 ELSE 0 END AS wsum FROM documents JOIN labels USING (doc_id))""")
def weighted_score(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id")
    parts = {"a": F.col("quality") * 100.0, "b": F.when(F.col("toxic") == 0, 100.0)}
    return rows.select("doc_id", F.round(scoring.weighted(parts, {"a": 0.6, "b": 0.4}), 6).alias("score"))


_N = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@query(f"SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / {_N}, 6) AS unit_sum FROM embeddings")
def l2_normalize(spark, sf):
    unit = V.l2_normalize(F.col("embedding").cast("array<double>"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 6).alias("unit_sum"))


@query(f"""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS sim FROM embeddings, q)
SELECT vec_id, round(sim, 6) AS similarity, CAST(row_number() OVER (ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def embedding_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return search.top_matches(vectors.where("vec_id = 0"), vectors, id_col="vec_id", vector_col="embedding", k=10).withColumn("similarity", F.round("similarity", 6))


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS sim FROM embeddings, q)
SELECT query_id, vec_id, round(sim, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def embedding_topk_many(spark, sf):
    """Every hundredth vector asks all of them at once."""
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return search.top_matches(asked, vectors, id_col="vec_id", vector_col="embedding", k=5, query_id="query_id", cells=16).withColumn("similarity", F.round("similarity", 6))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embedding_backfill(spark, sf):
    return search.without_embedding(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "embeddings"), doc="doc_id", vec="vec_id")


@query("""SELECT doc_id, sha256('{"id":"' || doc_id || '","text":' || coalesce('"' || sha256(text) || '"', 'null') || ',"version":"v1"}') AS score_key, doc_id % 3 = 0 AS cached FROM documents""")
def score_cache_lookup(spark, sf):
    keyed = table(spark, sf, "documents").select("doc_id", scoring.cache_key({"text": F.sha2("text", 256), "version": F.lit("v1"), "id": F.col("doc_id").cast("string")}).alias("score_key"))
    hit, miss = scoring.missing_scores(keyed, keyed.where("doc_id % 3 = 0").select("score_key").distinct())
    return hit.withColumn("cached", F.lit(True)).unionByName(miss.withColumn("cached", F.lit(False)))


_PRF = "SELECT count(*) FILTER (quality = 1 AND a = 1) AS tp, count(*) FILTER (quality <> 1 AND a = 1) AS fp, count(*) FILTER (quality = 1 AND a <> 1) AS fn FROM (SELECT quality, CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS a FROM labels JOIN documents USING (doc_id))"


@query(f"SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM ({_PRF})")
def evaluation_prf(spark, sf):
    pairs = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", (F.col("n_chars") >= 400).cast("int").alias("a")), "doc_id")
    out = evaluate.prf(pairs, expected="quality", actual="a")
    return out.select("true_positive", "false_positive", "false_negative", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("SELECT count(*) AS files, count(*) FILTER (length(text) >= 80) AS succeeded, count(*) FILTER (text IS NULL OR length(text) < 80) AS failed FROM documents")
def batch_report(spark, sf):
    return reports.batch_report(table(spark, sf, "documents"), ~F.coalesce(F.length("text") >= 80, F.lit(False)))


# ---- features, repair, reports


@query(rf"WITH {_BLOCKS}, t AS (SELECT doc_id, sum(ceil(length(line) / 4.0)) AS a, sum(ceil(length(regexp_replace(line, '\s+', ' ', 'g')) / 4.0)) AS b FROM b GROUP BY doc_id) SELECT doc_id, CAST(round((a - b) / a * 100, 1) AS DOUBLE) AS saved_percent FROM t")
def token_reduction(spark, sf):
    sums = blocks.prune(blocks.blocks(table(spark, sf, "documents"))).groupBy("doc_id").agg(F.sum("tokens_before").alias("a"), F.sum("tokens_after").alias("b"))
    return sums.select("doc_id", reports.reduction(F.col("a"), F.col("b")).alias("saved_percent"))


from folioforge.plans import answers, deliveries, golden, recovery, resumes  # noqa: E402, F401  (their queries register themselves)
