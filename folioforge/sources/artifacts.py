"""JSON results as tables: reading with a schema, unreadable files apart, and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_results(spark: SparkSession, path: str, schema: StructType, *, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows of the JSON files below `path` that fit `schema`, and the raw text of those that do not."""
    wide = StructType([*schema, StructField("_corrupt_record", StringType())])
    files = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    rows = files.select(F.input_file_name().alias("source"), F.from_json("value", wide, {"mode": "PERMISSIVE"}).alias("r")).select("source", "r.*")
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record"), rows.where("_corrupt_record IS NOT NULL").select("source", "_corrupt_record")


def write_results(results: DataFrame, path: str, *, failed: str = "error_code IS NOT NULL") -> None:
    """Good rows and failed ones as JSON in two folders; a folder that is there already is an error."""
    results.where(f"NOT ({failed})").write.mode("errorifexists").json(f"{path}/results")
    results.where(failed).write.mode("errorifexists").json(f"{path}/errors")


def payloads(profiles: DataFrame) -> DataFrame:
    """(doc_id, extracted, scored, embedded): see publish.callback_payloads."""
    from folioforge.operators.publish import callback_payloads

    return callback_payloads(profiles)


def write_debug(tables: dict[str, DataFrame], path: str) -> None:
    """Debug tables (raw text, normalized text, profile, blocks: each with sha256) as JSON, a folder per document's hash."""
    for name, rows in tables.items():
        rows.write.mode("errorifexists").partitionBy("sha256").json(f"{path}/{name}")
