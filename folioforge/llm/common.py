"""Shared pieces of the training-data operators: tables in the shared folder, ranks, components."""

from __future__ import annotations

import ctypes
from collections.abc import Sequence
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize, shared_dir, written_tables  # noqa: F401

#: Signed 64-bit constants that reorder node numbers in each contraction round.
ROUND_MASKS = tuple((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 63) for k in range(61))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, *names: str) -> list[str]:
    """`names`, with as many leading underscores as it takes to be no column of `df`."""
    taken, before = {c.lower() for c in df.columns}, "_"
    while taken & {f"{before}{n}".lower() for n in names}:
        before += "_"
    return [before + n for n in names]


class Numbers(dict):
    """Numbers keys 0, 1, ... in order of first use."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


_scratch: dict[str, dict] = {}


def scratch(owner: str) -> dict:
    """A dictionary that a Python worker keeps from task to task of one operator; those of other operators are let go."""
    others = [k for k in _scratch if k != owner]
    for other in others:
        del _scratch[other]
    if others:
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # other C libraries keep what they like
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    return _scratch.setdefault(owner, {})


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def rank_in_group(df: DataFrame, group: Sequence[str], key: str, row: str, out: str, most: int = 50_000) -> DataFrame:
    """A gapless 0-based rank of each row within `group`, in order of `key`, a long spread evenly over 64 bits, then `row`,
    a number of its own for each row.

    A group is cut into 2^b chunks by the high bits of `key`, b from the group's own count, so that no task sorts
    much more than a thousandth of all rows (500 at least, `most` at most). `df` has to be a stable table (see
    materialize).
    """
    names = spare(df, "bits", "chunk", "c", "start", "n", *(f"g{i}" for i in range(len(group))))
    bits_, chunk_, c_, start_, n_, *same_ = names
    sizes = df.groupBy(*group).agg(F.count("*").alias(n_))
    total = sizes.agg(F.sum(n_)).first()[0] or 0
    rows = max(500, min(most, total // 1000))
    bits = materialize(sizes.select(*(F.col(c).alias(g) for c, g in zip(group, same_, strict=True)), F.greatest(F.lit(0), F.ceil(F.log2(F.col(n_) / rows))).cast("int").alias(bits_)), "group_sizes")
    same = [df[c].eqNullSafe(bits[g]) for c, g in zip(group, same_, strict=True)]
    spread = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))
    chunk = F.when(F.col(bits_) == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", spread, 64 - F.col(bits_)))
    cut = df.join(bits, same, "left").withColumn(chunk_, chunk).select(*df.columns, chunk_)
    before = Window.partitionBy(*group).orderBy(chunk_).rowsBetween(Window.unboundedPreceding, -1)
    counted = cut.groupBy(*group, chunk_).agg(F.count("*").alias(n_))
    starts = materialize(counted.select(*(F.col(c).alias(g) for c, g in zip(group, same_, strict=True)), F.col(chunk_).alias(c_), F.coalesce(F.sum(n_).over(before), F.lit(0)).alias(start_)), "starts")
    ranked = cut.withColumn(n_, F.row_number().over(Window.partitionBy(*group, chunk_).orderBy(key, row)) - 1)
    same = [ranked[c].eqNullSafe(starts[g]) for c, g in zip(group, same_, strict=True)] + [ranked[chunk_] == starts[c_]]
    return ranked.join(starts, same, "left").select(*df.columns, (F.col(start_) + F.col(n_)).cast("long").alias(out))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of `edges` (columns a, b, longs): nodes have one label if and only if connected.

    Contraction rounds: each node points at its smallest neighbour in an order that changes from round to round,
    edges are redrawn between those targets, and loops and repeats go. At least one end of each edge moves, so
    every round removes nodes; random orders remove a constant share. All steps are partial aggregates or joins of
    written tables, which AQE splits where a node is hot; nothing is gathered on the driver.
    """
    spark = edges.sparkSession
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        mask = F.lit(ROUND_MASKS[len(steps) % len(ROUND_MASKS)])
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        best = both.groupBy("u").agg(F.min(F.col("v").bitwiseXOR(mask)).alias("h"))
        to = materialize(best.select("u", F.least("h", F.col("u").bitwiseXOR(mask)).bitwiseXOR(mask).alias("p")), f"round{len(steps)}")
        steps.append(to)
        moved = edges.join(to.select(F.col("u").alias("a"), F.col("p").alias("a2")), "a").join(to.select(F.col("u").alias("b"), F.col("p").alias("b2")), "b")
        edges = materialize(moved.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), f"edges{len(steps)}")
    if not steps:
        return spark.createDataFrame([], "node long, label long")
    out = steps[0].select(F.col("u").alias("node"), F.col("p").alias("label"))
    for to in steps[1:]:
        out = out.join(to, out["label"] == to["u"], "left").select("node", F.coalesce("p", "label").alias("label"))
    return out
