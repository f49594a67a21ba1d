"""Stored caches: what was computed for a key is read again, not computed again.

A cache is a table bucketed by key, so that rows that look something up are dealt to its buckets and the cache itself is
never shuffled, however large. Every run writes a partition of its own by dynamic overwrite: a run that is repeated replaces
what it wrote, and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.columns import spare


class StoredCache:
    """A cache `name` of `values` (SQL columns) by `key` (text), in `buckets` buckets below `path` (else the warehouse)."""

    def __init__(self, spark: SparkSession, name: str, values: str, *, key: str = "key", buckets: int = 64, path: str | None = None):
        self.spark, self.name, self.key = spark, name, key
        where = f"LOCATION '{path}'" if path else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({key} STRING, {values}, run STRING) USING parquet PARTITIONED BY (run) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {int(buckets)} BUCKETS {where}")
        self.values = [c for c in spark.table(name).columns if c not in (key, "run")]

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def lookup(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """`rows` whose key is held, with its values; and those whose is not. A null key is never held. Columns of `rows` named
        like a value or run are an error."""
        clash = {*self.values, "run"} & {c.lower() for c in rows.columns}
        if clash:
            raise ValueError(f"columns {sorted(clash)} would be overwritten")
        held = self.read().drop("run")
        (k,) = spare(rows, "held_key")
        held = held.withColumnRenamed(self.key, k)
        return rows.join(held, rows[self.key] == held[k]).drop(k), rows.join(held.select(k), rows[self.key] == held[k], "left_anti")

    def store(self, computed: DataFrame, *, run: str) -> int:
        """Stores `computed` (key and values) as the partition of `run`; how many keys that are."""
        new = computed.where(F.col(self.key).isNotNull()).dropDuplicates([self.key]).select(self.key, *self.values, F.lit(run).alias("run"))
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            new.write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        self.spark.catalog.refreshTable(self.name)
        return self.read().where(F.col("run") == run).count()

    def through(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], *, run: str) -> tuple[DataFrame, int]:
        """`rows` with values for every key, and how many keys were computed: `compute` takes rows with keys of their own that
        other runs do not hold (what an earlier attempt of this run stored is made again) and gives key and values."""
        others = self.read().where(F.col("run") != run).select(F.col(self.key).alias("_other"))
        missing = rows.where(F.col(self.key).isNotNull()).dropDuplicates([self.key]).join(others, F.col(self.key) == F.col("_other"), "left_anti")
        new = self.store(compute(missing), run=run)
        return self.lookup(rows)[0], new
