"""Measures of a run, taken on the way: counts by DataFrame.observe while a stage is written, times by the clock around it.

No stage is scanned again for its report. Wrap the function that writes stages:

    meter = Meter(materialize, {"reconciled": {"kept": F.sum(F.size("experiences"))}})
    process(docs, table, as_of=day, stage=meter.stage)
    meter.report(spark)
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REPORT = "place int, stage string, seconds double, n_rows long, metric string, value double"


class Meter:
    """`write` takes a stage's table and name and gives it back, stored; `metrics` are aggregates by stage, beside the rows."""

    def __init__(self, write: Callable[[DataFrame, str], DataFrame], metrics: dict[str, dict[str, Column]] | None = None):
        self.write, self.metrics, self.taken = write, metrics or {}, []

    def stage(self, rows: DataFrame, name: str) -> DataFrame:
        seen = Observation(f"{name}-{len(self.taken)}")
        wanted = self.metrics.get(name, {})
        began = time.perf_counter()
        out = self.write(rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), *(c.alias(n) for n, c in wanted.items())), name)
        took = time.perf_counter() - began
        counts = seen.get
        self.taken.append((name, took, int(counts["n_rows"]), {n: float(counts[n]) if counts[n] is not None else None for n in wanted}))
        return out

    def report(self, spark: SparkSession) -> DataFrame:
        """(place, stage, seconds, n_rows, metric, value): a row for each metric of each stage, one without where it has none."""
        rows = [(k, n, t, c, m, v) for k, (n, t, c, ms) in enumerate(self.taken, 1) for m, v in (ms.items() or [(None, None)])]
        return spark.createDataFrame(rows, REPORT)

    def timings(self) -> dict[str, int]:
        """Milliseconds by stage, and total, as process reports take them."""
        out: dict[str, int] = {}
        for name, took, *_ in self.taken:
            out[name] = out.get(name, 0) + round(took * 1000)
        return out | {"total": sum(out.values())}


def funnel(report: DataFrame, stages: list[str]) -> DataFrame:
    """(place, stage, n_rows, share): what is left at each of `stages`, in this order, of the first of them."""
    order = {n: k for k, n in enumerate(stages, 1)}
    one = report.where(F.col("stage").isin(stages)).groupBy("stage").agg(F.max("n_rows").alias("n_rows"))
    at = F.create_map(*(F.lit(x) for p in order.items() for x in p))
    rows = one.withColumn("place", F.element_at(at, F.col("stage")))
    first = rows.where("place = 1").select(F.col("n_rows").alias("_first"))
    return rows.crossJoin(F.broadcast(first)).select("place", "stage", "n_rows", F.when(F.col("_first") > 0, F.col("n_rows") / F.col("_first")).otherwise(0.0).alias("share"))  # one row


MANIFEST = "seq long, source string, repeat int, arm string, place int, stage string, seconds double, n_rows long, error string"


def benchmark(spark: SparkSession, runs: DataFrame, arms: dict[str, Callable[[str, Meter], DataFrame]], write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Measured runs, one after the other: `runs` (seq, source, repeat, arm; see reports.interleaved) as a manifest with a row for
    each stage of each run, and one without a stage for a run that failed.

    An arm takes a source and a meter, whose `stage` it has to write its tables with. Runs stand in a row, so that none takes
    machines from another; the plan of a benchmark is small.
    """
    rows = []
    for r in runs.orderBy("seq").toLocalIterator():
        meter = Meter(lambda df, name, r=r: write(df, f"run{r['seq']}/{name}"))
        error = None
        try:
            meter.stage(arms[r["arm"]](r["source"], meter), "total")
        except Exception as e:
            error = type(e).__name__
        head = (r["seq"], r["source"], r["repeat"], r["arm"])
        rows += [(*head, k, name, took, n, None) for k, (name, took, n, _) in enumerate(meter.taken, 1)]
        if error:
            rows.append((*head, None, None, None, None, error))
    return spark.createDataFrame(rows, MANIFEST)


def compared(manifest: DataFrame) -> DataFrame:
    """(arm, stage, runs, failed, median_seconds, most_seconds, rows) of a manifest; a stage that a run wrote twice counts as its sum."""
    failed = manifest.groupBy("arm").agg(F.count("error").alias("failed"))
    one = manifest.where("stage IS NOT NULL").groupBy("arm", "stage", "seq").agg(F.sum("seconds").alias("seconds"), F.max("n_rows").alias("n_rows"))
    out = one.groupBy("arm", "stage").agg(F.count("*").alias("runs"), F.median("seconds").alias("median_seconds"), F.max("seconds").alias("most_seconds"), F.sum("n_rows").alias("rows"))
    return out.join(failed, "arm").select("arm", "stage", "runs", "failed", "median_seconds", "most_seconds", "rows")
