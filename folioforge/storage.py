"""Tables written on the way, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where that is unset, in local mode alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_folioforge_dir", None) or tempfile.mkdtemp(prefix="folioforge-")
        spark._folioforge_dir = base
    return base.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    Cuts lineage in a way that outlives executors: a later stage that is recomputed reads these files. They stay until
    the caller deletes them; see written_tables().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioforge/{uuid.uuid4().hex}/{tag}"
    df.write.option("compression", "zstd").parquet(path)
    for paths in _written.get():
        paths.append(path.rsplit("/", 1)[0])
    return spark.read.schema(df.schema).parquet(path)


#: Lists of the blocks around, of this thread alone: another thread's tables are not ours to delete.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


@contextmanager
def written_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that materialize() wrote within; results have to be stored by then."""
    paths: list[str] = []
    token = _written.set((*_written.get(), paths))
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
