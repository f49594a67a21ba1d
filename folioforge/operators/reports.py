"""Markdown reports over small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reduction(before: Column, after: Column) -> Column:
    """Percent of tokens saved, to one place; 0 where there were none."""
    return F.when(before > 0, F.round((before - after) / before * 100, 1)).otherwise(F.lit(0.0))


def funnel(stages: DataFrame) -> DataFrame:
    """(doc_id, pairs) of `stages` (doc_id, kind, extracted, published): "kind E/P" of each kind, in order of name."""
    shown = F.concat_ws(" ", "kind", F.concat_ws("/", F.col("extracted").cast("string"), F.col("published").cast("string")))
    return stages.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(shown)), "; ").alias("pairs"))


def markdown_table(rows: DataFrame, columns: dict[str, str], *, title: str) -> str:
    """A table of all rows, bars in cells escaped. What it shows is meant for readers: pass an aggregate or a top-k, since all of
    it goes to the driver, row by row."""
    head = [f"# {title}", "", "| " + " | ".join(columns.values()) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*head, *(markdown_row(r) for r in rows.select(*columns).toLocalIterator())]) + "\n"


def markdown_row(values) -> str:
    return "| " + " | ".join(("" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v)).replace("|", "\\|").replace("\n", " ") for v in values) + " |"


def search_report(matches: DataFrame) -> str:
    """Matches of search.search_results, in order of rank."""
    shown = matches.orderBy("rank").withColumn("similarity", F.format_string("%.4f", "similarity"))
    return markdown_table(shown, {"rank": "Rank", "candidate_name": "Candidate", "similarity": "Similarity", "top_skills": "Top skills", "doc_id": "Source"}, title="Search results")


#: Stages of one document's run in a process report. Fixed values.
STAGES = ("inputValidation", "parsingAndPreprocessing", "unifiedExtraction", "profileExtraction", "reconciliation", "scoring", "total")


def process_reports(results: DataFrame) -> DataFrame:
    """(doc_id, report): a Markdown page per document, made on the executors: file, times, tokens, quality.

    `results`: doc_id, source_name, sha256, pages, blocks, timings (map), input_tokens, output_tokens, tokens_before, tokens_after,
    validation_status, completeness_score, quality_score, evidence.
    """
    s = lambda c, other="-": F.coalesce(F.col(c).cast("string"), F.lit(other))
    line = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = lambda *names: F.lit("| " + " | ".join(names) + " |\n|" + "---|" * len(names))
    times = [F.coalesce(F.element_at("timings", k).cast("string"), F.lit("0")) for k in STAGES]
    parts = [
        F.lit("# Processing report\n\n## File\n"), head("File", "SHA-256", "Pages", "Blocks"), line(s("source_name"), s("sha256"), s("pages", "0"), s("blocks", "0")),
        F.lit("\n## Times (ms)\n"), head(*STAGES), line(*times),
        F.lit("\n## Tokens\n"), head("Input", "Output", "Before pruning", "After", "Reduction %"), line(s("input_tokens", "0"), s("output_tokens", "0"), s("tokens_before", "0"), s("tokens_after", "0"), reduction(F.col("tokens_before"), F.col("tokens_after")).cast("string")),
        F.lit("\n## Quality\n"), head("Status", "Completeness", "Quality", "Evidence"), line(s("validation_status"), s("completeness_score"), s("quality_score"), s("evidence", "0")),
    ]
    return results.select("doc_id", F.concat_ws("\n", *parts, F.lit("")).alias("report"))


def funnel_pair(counts: Column) -> Column:
    """"experiences/projects" of a map of entity counts; N/A without one of them."""
    pair = F.concat_ws("/", F.element_at(counts, "experiences").cast("string"), F.element_at(counts, "projects").cast("string"))
    return F.when(F.element_at(counts, "experiences").isNull() | F.element_at(counts, "projects").isNull(), "N/A").otherwise(pair)


def human_review_cards(profiles: DataFrame) -> DataFrame:
    """(doc_id, card): what a reviewer reads of each profile (document.PROFILE, source_name, validation_status, total_experience_years,
    completeness_score, quality_score), as Markdown made on the executors."""
    text = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("N/A"))
    summary = F.when(F.col("summary").isNotNull(), F.concat(F.left("summary", F.lit(80)), F.lit("...")))
    jobs = F.array_join(F.transform(F.slice("experiences", 1, 2), lambda e: F.concat(F.coalesce(e["job_title"], F.lit("Role")), F.lit(" @ "), F.coalesce(e["company"], F.lit("Company")))), ", ")
    schools = F.array_join(F.transform("education", lambda e: F.concat(F.coalesce(e["degree"], e["field_of_study"], F.lit("Degree")), F.lit(" @ "), F.coalesce(e["institution"], F.lit("Institution")))), ", ")
    names = F.transform("skills", lambda x: x["name"])
    skills = F.concat(F.array_join(F.slice(names, 1, 8), ", "), F.when(F.size(names) > 8, F.concat(F.lit(" (+"), (F.size(names) - 8).cast("string"), F.lit(" more)"))).otherwise(""))
    spoken = F.array_join(F.transform("language_proficiencies", lambda x: F.concat(x["language"], F.coalesce(F.concat(F.lit(" ("), F.coalesce(x["exam"], x["proficiency"]), F.lit(")")), F.lit("")))), ", ")
    awards = F.array_join(F.transform(F.slice("honors_awards", 1, 3), lambda x: x["title"]), ", ")
    done = F.flatten(F.concat(*(F.transform(c, lambda e: F.coalesce(e["achievements"], F.array().cast("array<string>"))) for c in ("experiences", "projects"))))
    sample = F.get(done, F.lit(0))
    measured = F.when(F.size(done) > 0, F.concat(F.size(done).cast("string"), F.lit(' metric(s) (e.g. "'), F.left(sample, F.lit(60)), F.when(F.length(sample) > 60, "...").otherwise(""), F.lit('")'))).otherwise("None")
    years = F.when(F.col("total_experience_years").isNotNull(), F.concat(F.col("total_experience_years").cast("string"), F.lit(" years"))).otherwise("N/A")
    row = lambda label, c: F.concat(F.lit(f"* **{label}:** "), c)
    card = F.concat_ws(
        "\n", F.concat(F.lit("### "), F.upper(F.coalesce(F.nullif("candidate_name", F.lit("")), F.lit("Unknown Candidate")))), row("File", F.concat_ws(" | ", F.col("source_name"), F.concat(F.lit("Status: "), "validation_status"))),
        row("Headline", F.coalesce(F.nullif("headline", F.lit("")), summary, F.lit("N/A"))), row("Contact", F.concat(F.lit("Email: "), text(F.col("email")), F.lit(" | Phone: "), text(F.col("phone")))),
        row("Total Experience", F.concat(years, F.lit(" | Recent Roles: "), text(jobs))), row("Education", text(schools)), row("Language Credentials", text(spoken)), row("Honors & Awards", text(awards)), row("Top Skills", text(skills)), row("Quantified Achievements", measured),
        row("Scores", F.concat(F.lit("Completeness: "), F.coalesce(F.col("completeness_score").cast("string"), F.lit("N/A")), F.lit(" | Quality: "), F.coalesce(F.col("quality_score").cast("string"), F.lit("N/A")))),
    )
    return profiles.select("doc_id", card.alias("card"))


def human_review(cards: DataFrame, failures: DataFrame, path: str) -> None:
    """The summary as text files below `path`: counts, a card for each profile in order of doc_id, failures (source_name, error_code).

    Written by the executors, whatever the number of profiles.
    """
    spark = cards.sparkSession
    ok, bad = cards.count(), failures.count()
    head = spark.createDataFrame([(0, "", f"# Review of profiles\n\n**Profiles:** {ok} | **Failures:** {bad}\n")], "part int, k string, value string")
    listed = cards.select(F.lit(1).alias("part"), F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("k"), F.concat("card", F.lit("\n")).alias("value"))
    failed = failures.select(F.lit(2).alias("part"), F.col("source_name").alias("k"), F.concat(F.lit("- "), "source_name", F.lit(": "), F.coalesce("error_code", F.lit("UNKNOWN_FAILURE"))).alias("value"))
    head.unionByName(listed).unionByName(failed).repartitionByRange("part", "k").sortWithinPartitions("part", "k").select("value").write.mode("errorifexists").text(path)


def batch_report(results: DataFrame, failed: Column) -> DataFrame:
    """(files, succeeded, failed) of a run."""
    return results.agg(F.count("*").alias("files"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"))


def write_stages(stages: dict[str, DataFrame], path: str) -> None:
    """One JSON folder for each stage's table: texts, profiles, payloads, embedding texts, audits, whatever the caller names."""
    for name, rows in stages.items():
        rows.write.mode("errorifexists").json(f"{path}/{name}")


def with_expiry(captures: DataFrame, *, days: int, now: str) -> DataFrame:
    """Raw requests and responses with expires_at, `days` after `now` (a timestamp as text); headers but a few are left out."""
    kept = ("content-type", "date", "retry-after", "x-request-id")
    rows = captures.withColumn("headers", F.map_filter("headers", lambda k, v: F.lower(k).isin(*kept))) if "headers" in captures.columns else captures
    return rows.withColumn("expires_at", F.lit(now).cast("timestamp") + F.expr(f"INTERVAL {int(days)} DAYS"))


def purge(captures: DataFrame, *, now: str) -> DataFrame:
    """Captures that have not expired; write these in place of the table."""
    return captures.where(F.col("expires_at") > F.lit(now).cast("timestamp"))


def write_captures(captures: DataFrame, path: str) -> None:
    """Adds captures (with_expiry) to `path`, laid out by the day on which they expire, in UTC."""
    captures.withColumn("expires_on", F.to_date(F.date_trunc("DAY", F.to_utc_timestamp("expires_at", F.current_timezone())))).write.mode("append").partitionBy("expires_on").parquet(path)


def read_captures(spark, path: str, *, now: str) -> DataFrame:
    """Captures that have not expired at `now`; folders of days before are not opened."""
    at = F.lit(now).cast("timestamp")
    return spark.read.parquet(path).where((F.col("expires_on") >= F.to_date(F.date_trunc("DAY", F.to_utc_timestamp(at, F.current_timezone())))) & (F.col("expires_at") > at)).drop("expires_on")


def drop_expired(spark, path: str, *, now: str) -> list[str]:
    """Deletes the folders of days all of whose captures have expired at `now`; nothing is read or written again. The days."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    today = str(spark.range(1).select(F.to_date(F.to_utc_timestamp(F.lit(now).cast("timestamp"), F.current_timezone()))).first()[0])
    gone = []
    for entry in fs.listStatus(where):  # one folder a day
        name = entry.getPath().getName()
        if name.startswith("expires_on=") and name.split("=", 1)[1] < today:
            fs.delete(entry.getPath(), True)
            gone.append(name.split("=", 1)[1])
    return sorted(gone)


def interleaved(files: DataFrame, *, repeats: int, arms: tuple[str, ...]) -> DataFrame:
    """(seq, source, repeat, arm): runs of a comparison, the order of the arms reversed in every other repeat; seq from 1.

    Files are numbered by ranges of their names, and a file's runs from its number, so no task sees all of them.
    """
    spark = files.sparkSession
    plan = [(r, p, a) for r in range(1, repeats + 1) for p, a in enumerate(arms if r % 2 else arms[::-1])]
    runs = spark.createDataFrame([(r, (r - 1) * len(arms) + p, a) for r, p, a in plan], "repeat int, place int, arm string")
    ordered = files.select("source").repartitionByRange("source").sortWithinPartitions("source").select("source", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")).cache()
    sizes = {r["_p"]: r["n"] for r in ordered.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    numbered = ordered.join(F.broadcast(spark.createDataFrame(starts, "_p int, _s long")), "_p").withColumn("_n", F.col("_s") + F.col("_i"))
    return numbered.crossJoin(F.broadcast(runs)).select((F.col("_n") * len(plan) + F.col("place") + 1).alias("seq"), "source", "repeat", "arm")


def benchmark_jobs(files: DataFrame, *, repeats: int, overrides: dict[str, int] | None = None) -> DataFrame:
    """(source, run): run 1 to `repeats` of each file, or as often as `overrides` says by file name."""
    n = F.lit(repeats)
    for name, k in (overrides or {}).items():
        n = F.when(F.regexp_extract("source", r"([^/]+)$", 1) == name, F.lit(int(k))).otherwise(n)
    return files.select("source", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))).alias("run"))
