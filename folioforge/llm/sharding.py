"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn exactly, as dealing all rows at random into shards
of fixed sizes would distribute it (multivariate hypergeometric, partition by partition). Each partition orders its
own rows at random and deals that many, rows go to their shards, and each shard is put in random order again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, rank_in_group, spare, table, text_or_empty

LOCAL = (1 << 33) - 1


def _hypergeometric(g: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` balls are good. Populations beyond numpy's limit: by the weights of `_weights`."""
    if good < 10**9 and bad < 10**9:
        return int(g.hypergeometric(good, bad, drawn))
    at, up, down = _weights(good, bad, drawn)
    u = g.random() * (1 + up.sum() + down.sum()) - 1
    if u < 0:
        return at
    if u < up.sum():
        return at + 1 + int(np.searchsorted(np.cumsum(up), u, side="right"))
    return at - 1 - min(int(np.searchsorted(np.cumsum(down), u - up.sum(), side="right")), len(down) - 1)


def _weights(good: int, bad: int, drawn: int, step: int = 1 << 12) -> tuple[int, np.ndarray, np.ndarray]:
    """The mode, and the weights above and below it, from ratios of neighbouring probabilities alone, the mode weighing 1.

    No logarithm of a factorial takes part, whose rounding would grow with the population. Weights end where what is left is
    less than rounding, some standard deviations out, and these are bounded by the number drawn.
    """
    lo, hi = max(0, drawn - bad), min(drawn, good)
    at = min(hi, max(lo, (drawn + 1) * (good + 1) // (good + bad + 2)))

    def side(ratio, room: int) -> np.ndarray:
        parts, last, start = [], 1.0, 0
        while start < room and last > 1e-25:
            i = np.arange(start, min(start + step, room), dtype=np.float64)
            parts.append(last * np.cumprod(ratio(i)))
            last, start = float(parts[-1][-1]), start + step
        return np.concatenate(parts) if parts else np.zeros(0)

    up = side(lambda i: (good - at - i) / (at + i + 1) * ((drawn - at - i) / (bad - drawn + at + i + 1)), hi - at)
    down = side(lambda i: (at - i) / (good - at + i + 1) * ((bad - drawn + at - i) / (drawn - at + i + 1)), at - lo)
    return at, up, down


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows: partitions of the given sizes; columns: shards, whose totals differ by one at most."""
    total, g = sum(sizes), np.random.Generator(np.random.PCG64(seed))
    left = [total // shards + (k < total % shards) for k in range(shards)]
    out = np.zeros((len(sizes), shards), np.int64)
    for p, n in enumerate(sizes):
        rest = sum(left)
        for k in range(shards):
            rest -= left[k]
            out[p, k] = x = _hypergeometric(g, left[k], rest, n) if n else 0
            n, left[k] = n - x, left[k] - x
    return out


def shuffle_into_shards(df: DataFrame, *, shards: int, seed: int = 0) -> DataFrame:
    """The rows of `df` with `shard` (int) and `slot` (long): a uniform random order, shard sizes at most one apart.

    Every row counts by itself: nulls, ties and repeated rows are dealt like any other; an empty table stays empty.
    Columns of `df` must not be named shard or slot; any others stay as they are. What the driver gathers is one count
    per input partition.
    """
    clash = {"shard", "slot"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    row, key, rank, part, cuts_, again = spare(df, "row", "key", "rank", "part", "cuts", "again")
    local = df.withColumn(row, F.monotonically_increasing_id()).withColumn(key, F.xxhash64(F.lit(seed), row))
    local = local.sortWithinPartitions(key, row).withColumn(rank, F.monotonically_increasing_id().bitwiseAND(F.lit(LOCAL)))
    local = materialize(local.withColumn(part, F.shiftright(row, 33)), "permuted")
    sizes = {r[0]: r[1] for r in local.groupBy(part).agg(F.count("*")).collect()}
    parts = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in parts], shards, seed)
    cuts = df.sparkSession.createDataFrame([(int(p), [int(x) for x in np.cumsum(n)]) for p, n in zip(parts, matrix, strict=True)], f"{part} long, {cuts_} array<long>")
    dealt = local.join(F.broadcast(cuts) if len(parts) <= 100_000 else cuts, part)
    dealt = dealt.withColumn("shard", F.size(F.filter(cuts_, lambda c: c <= F.col(rank))).cast("int"))
    dealt = dealt.withColumn(again, F.xxhash64(F.lit(~seed), row)).select(*df.columns, "shard", row, again)
    return rank_in_group(dealt, ["shard"], again, row, "slot").drop(row, again)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text_or_empty().cast("binary")).cast("long").alias("text_crc32"))
    return shuffle_into_shards(docs, shards=8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
