"""Whole runs: a folder of files to profiles, scores and summaries; exit codes. `python -m folioforge.jobs --help`."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import blocks as B
from folioforge.operators import extract, features, measure, publish, reconciliation, reports, search, summary, taxonomy
from folioforge.operators.document import EXPERIENCE, as_profiles, no_evidence
from folioforge.sources import files
from folioforge.storage import materialize

#: Success, usage, input, processing, not implemented.
OK, USAGE, INPUT, PROCESSING, NOT_IMPLEMENTED = 0, 2, 3, 4, 5


#: Takes a stage's table and name, gives the table back.
Stage = Callable[[DataFrame, str], DataFrame]


def local_profiles(docs: DataFrame, table: DataFrame, *, as_of: date) -> DataFrame:
    """Profiles (document.PROFILE) by rules alone of `docs` (doc_id, text): what a run without a language model has."""
    told = extract.profiles(docs, table, as_of=as_of)
    empty = F.array().cast("array<string>")
    job = F.struct("entry", F.struct("job_title", "company", F.lit(None).cast("string").alias("location"), "start_date", "end_date", "is_current", "description", "achievements", empty.alias("skills"), no_evidence().alias("evidence"), "confidence").cast(EXPERIENCE).alias("e"))
    jobs = extract.roles(docs).where("warning IS NULL").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(job)), lambda x: x["e"]).alias("experiences"))
    schools = extract.education(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("institution", "degree", "field_of_study", F.lit(None).cast("string").alias("location"), "start_date", "end_date", empty.alias("coursework"), no_evidence().alias("evidence"), F.lit(0.85).alias("confidence")))).alias("education"))
    skills = F.transform("skill_details", lambda s: F.struct(s["name"].alias("name"), s["canonical_name"].alias("canonical_name"), s["years"].alias("years"), s["level"].alias("level"), F.array(s["evidence"]).alias("evidence"), empty.alias("evidence_types"), s["confidence"].alias("confidence")))
    rows = told.withColumn("_skills", skills).drop("skills", "skill_details", "years", "n_jobs", "first_start", "n_schools", "institution").withColumnRenamed("_skills", "skills")
    rows = rows.withColumn("warnings", F.transform("warnings", lambda w: F.struct(w.alias("code"), F.lit("profile_validation").alias("stage"))))
    return as_profiles(rows.join(jobs, "doc_id", "left").join(schools, "doc_id", "left"))


def scores(done: DataFrame, scored: DataFrame) -> DataFrame:
    """Reconciled profiles with the features of their documents (features.document_features), scores and summary, one row each."""
    broken = F.exists("warnings", lambda w: w["code"] == "INVALID_TIMELINE")
    rows = done.join(features.completeness(scored), "doc_id", "left").withColumn("timeline_ok", F.when(broken, False).when(F.col("has_experience"), True)).withColumn("status", F.col("validation_status"))
    rows = features.quality(rows)
    told = rows.select("doc_id", F.col("candidate_name").alias("name"), "headline", F.col("total_experience_years").alias("years"), F.transform("skills", lambda s: s["canonical_name"]).alias("skills"), F.get("education", F.lit(0))["institution"].alias("institution"), F.size("certifications").alias("n_certificates"), "summary")
    return rows.join(summary.summarize(told).select("doc_id", "summary_text", "reused"), "doc_id")


def process(docs: DataFrame, table: DataFrame, *, as_of: date, stage: Stage | None = None) -> DataFrame:
    """One row per document: the reconciled profile, features, scores and summary, by rules alone (provider local-compatibility).

    `stage` takes each stage's table and name and gives it back, written and read again (by default in the shared folder): work
    that is lost with an executor begins at the table before it, and plans stay small.
    """
    stage = stage or materialize
    table, docs = stage(table, "skill_table"), stage(docs, "documents")
    blocks = stage(B.blocks(docs), "blocks")
    profiles = stage(local_profiles(docs, table, as_of=as_of), "profiles")
    done = stage(reconciliation.reconcile(profiles, blocks, table, provider="local-compatibility", as_of=as_of, stage=stage), "reconciled")
    return scores(done, stage(features.document_features(blocks, table), "features"))


def documents_of(spark: SparkSession, path: str, parsers: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs, failures) of a folder: doc_id is the file's hash; failures name a file's first failed check or its parser's error."""
    checked = files.validate(files.scan_all(spark, path))
    pages = files.parse(checked, parsers)
    texts = pages.where("error IS NULL").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n").alias("text"))
    docs = texts.join(checked.select("path", "sha256"), "path").select(F.col("sha256").alias("doc_id"), "text", F.col("path").alias("source_name"))
    bad = checked.where("error_code IS NOT NULL").select(F.col("path").alias("source_name"), "error_code").unionByName(pages.where("error IS NOT NULL").select(F.col("path").alias("source_name"), F.col("error").alias("error_code")))
    return docs, bad


def run_batch(spark: SparkSession, source: str, target: str, *, skills: str | None = None, as_of: date, parsers: dict | None = None) -> int:
    """A folder to results, errors, a review and a report below `target`, which must not be there yet."""
    table = taxonomy.skill_table(spark, taxonomy.skills_from_json(skills) if skills else None)
    docs, bad = documents_of(spark, source, parsers)
    if docs.isEmpty() and bad.isEmpty():
        return INPUT
    bad.write.mode("errorifexists").json(f"{target}/errors")

    def stage(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("errorifexists").parquet(f"{target}/stages/{name}")
        return spark.read.schema(rows.schema).parquet(f"{target}/stages/{name}")

    done = process(docs.select("doc_id", "text"), table, as_of=as_of, stage=stage)
    done.write.mode("errorifexists").parquet(f"{target}/results")
    kept = spark.read.parquet(f"{target}/results").join(docs.select("doc_id", "source_name"), "doc_id")
    failed = spark.read.schema("source_name string, error_code string").json(f"{target}/errors")
    reports.human_review(reports.human_review_cards(kept), failed, f"{target}/review")
    return PROCESSING if kept.isEmpty() else OK


#: Of which stage of a process report a written table is part.
REPORTED = {"documents": "parsingAndPreprocessing", "blocks": "parsingAndPreprocessing", "profiles": "profileExtraction", "validated": "reconciliation", "recovered": "reconciliation", "reconciled": "reconciliation", "features": "scoring", "total": "total"}


def run_process(spark: SparkSession, source: str, target: str, *, skills: str | None = None, as_of: date, parsers: dict | None = None) -> int:
    """One file to `target`/result (JSON) and `target`/report (Markdown), or `target`/errors; times and counts of the report are
    those of the run itself."""
    table = taxonomy.skill_table(spark, taxonomy.skills_from_json(skills) if skills else None)
    docs, bad = documents_of(spark, source, parsers)
    if not bad.isEmpty() or docs.isEmpty():
        bad.write.mode("errorifexists").json(f"{target}/errors")
        return INPUT

    def stage(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("errorifexists").parquet(f"{target}/stages/{name}")
        return spark.read.schema(rows.schema).parquet(f"{target}/stages/{name}")

    meter = measure.Meter(stage)
    done = meter.stage(process(docs.select("doc_id", "text"), table, as_of=as_of, stage=meter.stage), "total")
    done.write.mode("errorifexists").json(f"{target}/result")
    spent: dict[str, int] = dict.fromkeys(reports.STAGES, 0)
    for name, ms in meter.timings().items():
        if name != "total":
            spent[REPORTED.get(name, "scoring")] += ms
    spent["total"] = meter.timings()["total"]
    blocks = spark.read.parquet(f"{target}/stages/blocks")
    counted = blocks.groupBy("doc_id").agg(F.countDistinct("page_number").alias("pages"), F.count("*").alias("blocks"))
    pruned = B.prune(blocks).groupBy("doc_id").agg(F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"))
    timings = F.create_map(*(F.lit(x) for pair in spent.items() for x in pair))
    none = F.lit(None).cast("long")
    rows = done.join(docs.select("doc_id", "source_name"), "doc_id").join(counted, "doc_id", "left").join(pruned, "doc_id", "left").join(publish.evidence_total(done), "doc_id", "left")
    rows = rows.withColumns({"sha256": F.col("doc_id"), "timings": timings, "input_tokens": none, "output_tokens": none})
    reports.process_reports(rows).select("report").write.mode("errorifexists").text(f"{target}/report")
    return OK


def run_summarize(spark: SparkSession, results: str, target: str) -> int:
    """The review of results (a batch's Parquet table) as text below `target`."""
    rows = spark.read.parquet(results)
    named = rows if "source_name" in rows.columns else rows.withColumn("source_name", F.col("doc_id").cast("string"))
    reports.human_review(reports.human_review_cards(named), spark.createDataFrame([], "source_name string, error_code string"), target)
    return OK


def encoder(spec: str):
    """The function that `module:name` names: of (doc_id, text) to (doc_id, vector)."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def run_search(spark: SparkSession, query: str, results: str, vectors: str, embed, *, k: int) -> str:
    """The search report for one query text; `embed` takes (doc_id, text) and gives (doc_id, vector). New vectors are appended."""
    profiles = spark.read.parquet(results)
    where = spark._jvm.org.apache.hadoop.fs.Path(vectors)
    kind = "doc_id string, vector array<double>"
    held = spark.read.schema(kind).parquet(vectors) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else spark.createDataFrame([], kind)
    texts = lambda p: embed(p.select("doc_id", summary.text_of_profile(p).alias("text")))
    every, new = search.backfilled(profiles, held, texts)
    new = materialize(new, "vectors")  # before the table it is read beside grows
    new.write.mode("append").parquet(vectors)
    asked = embed(spark.createDataFrame([("query", query)], "doc_id string, text string"))
    return reports.search_report(search.search_results(asked, profiles, spark.read.schema(kind).parquet(vectors), k=k))


def run_search_file(spark: SparkSession, description: str, results: str, vectors: str, target: str, spec: str, *, k: int) -> int:
    """run_search for a job description's file; the report is written below `target`. A description without text is an input error."""
    found = files.read_descriptions(spark, description).collect()  # one file
    if len(found) != 1 or found[0]["error"] is not None:
        print(f"no text: {found[0]['error'] if found else description}", file=sys.stderr)
        return INPUT
    report = run_search(spark, found[0]["text"], results, vectors, encoder(spec), k=k)
    print(report)
    spark.createDataFrame([(report,)], "value string").coalesce(1).write.mode("errorifexists").text(target)
    return OK


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioforge")
    commands = parser.add_subparsers(dest="command")
    for name, what in (("process", "one document to its result and report"), ("batch", "a folder of documents to profiles")):
        run = commands.add_parser(name, help=what)
        run.add_argument("source")
        run.add_argument("target")
        run.add_argument("--skills", help="JSON file of the skill table")
        run.add_argument("--as-of", type=date.fromisoformat, required=True)
    told = commands.add_parser("summarize", help="a review of a batch's results")
    told.add_argument("results")
    told.add_argument("target")
    asks = commands.add_parser("search", help="the profiles that are nearest to a job description")
    asks.add_argument("description")
    asks.add_argument("results")
    asks.add_argument("vectors")
    asks.add_argument("target")
    asks.add_argument("--encoder", required=True, help="module:function of (doc_id, text) to (doc_id, vector)")
    asks.add_argument("--top-k", type=int, default=10)
    commands.add_parser("serve", help="not part of this engine: land files in a folder and stream from it")
    try:
        asked = parser.parse_args(argv)
    except SystemExit as e:
        return OK if e.code == 0 else USAGE
    if asked.command == "serve":
        return NOT_IMPLEMENTED
    if asked.command is None:
        parser.print_usage()
        return USAGE
    spark = SparkSession.builder.getOrCreate()
    try:
        if asked.command == "summarize":
            return run_summarize(spark, asked.results, asked.target)
        if asked.command == "search":
            return run_search_file(spark, asked.description, asked.results, asked.vectors, asked.target, asked.encoder, k=asked.top_k)
        run = run_process if asked.command == "process" else run_batch
        return run(spark, asked.source, asked.target, skills=asked.skills, as_of=asked.as_of)
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return INPUT if "PATH_NOT_FOUND" in str(e) or "PATH_ALREADY_EXISTS" in str(e) else PROCESSING


if __name__ == "__main__":
    sys.exit(main())
