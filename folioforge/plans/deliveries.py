"""Queries of the running engine: submissions that repeat, callbacks that are due, stored scores, measured stages, evaluation."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from folioforge.operators import caches, evaluate, measure, scoring
from folioforge.storage import materialize, shared_dir
from folioforge.streaming import outbox, submissions

from .catalog import query, table

_WAIT, _LONGEST, _MOST, _NOW = 30 * 86400, 100 * 86400, 5, "1995-06-17 00:00:00"


@query(f"""WITH t AS (SELECT l_orderkey AS k, count(*) AS n, bool_or(l_returnflag = 'R') AS done, max(CAST(l_shipdate AS TIMESTAMP)) AS last FROM lineitem GROUP BY l_orderkey)
SELECT sha256(o_custkey || chr(31) || 'scored' || chr(31) || o_orderkey) AS message_id, CAST(o_custkey AS VARCHAR) AS doc_id, CAST(coalesce(n, 0) + 1 AS INTEGER) AS attempt FROM orders LEFT JOIN t ON k = o_orderkey
WHERE n IS NULL OR (NOT done AND n < {_MOST} AND epoch(last) + least({_LONGEST}, {_WAIT} * pow(2, n - 1)) <= epoch(TIMESTAMP '{_NOW}'))""")
def callback_due(spark, sf):
    """Orders as bodies, line items as attempts at sending them: what is due on a day."""
    bodies = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit("scored").alias("step"), F.col("o_orderkey").cast("string").alias("body"), "o_orderkey")
    mark = outbox.message_id(F.col("doc_id"), F.col("step"), F.col("body"))
    log = table(spark, sf, "lineitem").join(bodies.select(F.col("o_orderkey").alias("k"), mark.alias("message_id")), F.col("l_orderkey") == F.col("k"))
    log = log.select("message_id", F.col("l_linenumber").cast("int").alias("attempt"), (F.col("l_returnflag") == "R").alias("sent"), F.lit(None).cast("string").alias("error"), F.col("l_shipdate").cast("timestamp").alias("at"))
    return outbox.due(outbox.messages(bodies), log, F.lit(_NOW).cast("timestamp"), most=_MOST, wait=_WAIT, longest=_LONGEST).select("message_id", "doc_id", "attempt")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) THEN 'fresh' ELSE 'repeated' END AS state FROM documents WHERE text IS NOT NULL")
def submissions_once(spark, sf):
    """Documents as a stream of submissions, one a second, answered once each content by a stateful query."""
    base = f"{shared_dir(spark)}/folioforge/{uuid.uuid4().hex}"
    rows = table(spark, sf, "documents").select(F.sha2("text", 256).alias("sha256"), "doc_id", F.timestamp_seconds(F.col("doc_id") + 1_000_000_000).alias("at"))
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    submissions.answer_once(stream, target=f"{base}/out", checkpoint=f"{base}/checkpoint", keep=timedelta(days=365_000), late="365000 days").awaitTermination()
    return submissions.read_answers(spark, f"{base}/out").select("doc_id", "first_doc_id", "state")


@query("SELECT doc_id, coalesce(length(text), 0) * CAST(0.5 AS DOUBLE) AS score, doc_id % 3 = 0 AS stored_before FROM documents")
def score_cache_stored(spark, sf):
    """Scores through a stored cache: a first run over every third document, a second one that computes the others alone."""
    keyed = table(spark, sf, "documents").select("doc_id", "text", scoring.cache_key({"text": F.sha2("text", 256), "version": F.lit("v1"), "id": F.col("doc_id").cast("string")}).alias("key"))
    name = f"folio_scores_{uuid.uuid4().hex}"
    cache = caches.StoredCache(spark, name, "score DOUBLE", buckets=8, path=f"{shared_dir(spark)}/folioforge/{name}")
    compute = lambda rows: rows.select("key", (F.length(F.coalesce("text", F.lit(""))) * F.lit(0.5)).alias("score"))
    cache.through(keyed.where("doc_id % 3 = 0"), compute, run="first")
    first = cache.read().where("run = 'first'").select(F.col("key").alias("k"), F.lit(True).alias("old"))
    rows, _ = cache.through(keyed, compute, run="second")
    return rows.join(first, rows["key"] == first["k"], "left").select("doc_id", "score", F.coalesce("old", F.lit(False)).alias("stored_before"))


@query("""SELECT 1 AS place, 'documents' AS stage, count(*) AS n_rows, CAST(NULL AS VARCHAR) AS metric, CAST(NULL AS DOUBLE) AS value FROM documents
UNION ALL SELECT 2, 'usable', count(*), m, CASE m WHEN 'letters' THEN sum(length(text)) ELSE max(length(text)) END FROM documents, (VALUES ('letters'), ('longest')) v(m) WHERE length(text) >= 80 GROUP BY m
UNION ALL SELECT 3, 'labelled', count(*), 'good', sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) FROM documents JOIN labels USING (doc_id) WHERE length(text) >= 80""")
def stage_measures(spark, sf):
    """Three stages, counted while they are written."""
    meter = measure.Meter(materialize, {"usable": {"letters": F.sum(F.length("text")), "longest": F.max(F.length("text"))}, "labelled": {"good": F.count_if(F.col("quality") == 1)}})
    docs = meter.stage(table(spark, sf, "documents").select("doc_id", "text"), "documents")
    usable = meter.stage(docs.where("length(text) >= 80"), "usable")
    meter.stage(usable.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id"), "labelled")
    return meter.report(spark).drop("seconds")


#: What is wanted and what was found: line items of an order by status, the found ones without returned ones and with some twice.
_GOLD = "SELECT l_orderkey AS doc_id, l_linestatus AS kind, 'item ' || l_partkey % 7 AS title FROM lineitem"
_FOUND = "SELECT l_orderkey AS doc_id, l_linestatus AS kind, ' ITEM ' || l_partkey % 7 AS title FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT l_orderkey, l_linestatus, 'item ' || l_partkey % 7 FROM lineitem WHERE l_linenumber = 3"


@query(f"""WITH g AS (SELECT doc_id, kind, lower(trim(title)) AS k, count(*) AS g FROM ({_GOLD}) GROUP BY ALL), f AS (SELECT doc_id, kind, lower(trim(title)) AS k, count(*) AS f FROM ({_FOUND}) GROUP BY ALL),
b AS (SELECT doc_id, kind, coalesce(g, 0) AS g, coalesce(f, 0) AS f FROM g FULL JOIN f USING (doc_id, kind, k)),
n AS (SELECT doc_id, kind, grouping(doc_id, kind) AS gid, sum(least(g, f)) AS tp, sum(greatest(f - g, 0)) AS fp, sum(greatest(g - f, 0)) AS fn FROM b GROUP BY GROUPING SETS ((doc_id, kind), (doc_id), (kind), ()))
SELECT CASE gid WHEN 0 THEN 'document_kind' WHEN 1 THEN 'document' WHEN 2 THEN 'kind' ELSE 'all' END AS level, doc_id, kind, CAST(tp AS BIGINT) AS true_positive, CAST(fp AS BIGINT) AS false_positive, CAST(fn AS BIGINT) AS false_negative,
  CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 9) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 9) ELSE 0 END AS recall, CASE WHEN tp > 0 THEN round(2 * tp / (2 * tp + fp + fn), 9) ELSE 0 END AS f1 FROM n""")
def entity_evaluation(spark, sf):
    items = table(spark, sf, "lineitem")
    title = F.concat(F.lit("item "), (F.col("l_partkey") % 7).cast("string"))
    of = lambda rows, t: rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("kind"), t.alias("title"))
    found = of(items.where("l_returnflag <> 'R'"), F.concat(F.lit(" "), F.upper(title))).unionByName(of(items.where("l_linenumber = 3"), title))
    out = evaluate.entity_report(of(items, title), found)
    return out.select("level", "doc_id", "kind", "true_positive", "false_positive", "false_negative", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("""SELECT c_custkey AS doc_id, least(100.0, 20 + 0.001 * abs(c_acctbal) + CASE WHEN c_mktsegment = 'BUILDING' THEN 10 ELSE 0 END) AS score, false AS differs FROM customer""")
def counterfactual_scores(spark, sf):
    """Customers' scores with the names, addresses and phones of others: none differs."""
    rows = table(spark, sf, "customer").withColumnRenamed("c_custkey", "doc_id")
    score = lambda p: p.select("doc_id", F.least(F.lit(100.0), F.lit(20) + F.lit(0.001) * F.abs("c_acctbal") + F.when(F.col("c_mktsegment") == "BUILDING", 10).otherwise(0)).alias("score"))
    return evaluate.counterfactual(rows, score, ["c_name", "c_nationkey"]).select("doc_id", "score", "differs")
