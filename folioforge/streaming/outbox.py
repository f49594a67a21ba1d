"""An outbox: bodies are rows before anything is sent, and only what is not confirmed is sent.

    put(rows, box)                    bodies (doc_id, step, body), once each, whatever a batch repeats
    deliver(spark, box, make, now=)   sends what is due, in rounds, and writes down what became of it

`box`/messages holds the bodies, `box`/log one row for each attempt. A message is due if no attempt was confirmed, fewer than
`most` failed, and the last is long enough ago: the wait doubles with each. A run that dies in the middle has lost no
more than the log of its round, so the next run sends these bodies, and no others, once more.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.cluster import ship

from .callbacks import Sender

LOG = "message_id string, attempt int, sent boolean, error string, at timestamp"
#: Attempts in all, seconds before the second one, the longest wait, messages of a round and of a task.
MOST, WAIT, LONGEST, ROUND, TASK = 8, 30, 3600, 10_000, 200


def message_id(doc: Column, step: Column, body: Column) -> Column:
    """A body's own mark: the same body of the same document and step is the same message."""
    return F.sha2(F.concat_ws("\x1f", F.coalesce(doc.cast("string"), F.lit("")), F.coalesce(step, F.lit("")), F.coalesce(body, F.lit(""))), 256)


def messages(rows: DataFrame) -> DataFrame:
    """(message_id, doc_id, step, body), each once; rows without a body are no messages."""
    made = rows.where("body IS NOT NULL").select(message_id(F.col("doc_id"), F.col("step"), F.col("body")).alias("message_id"), F.col("doc_id").cast("string").alias("doc_id"), "step", "body")
    return made.dropDuplicates(["message_id"])


def due(messages_: DataFrame, log: DataFrame, now: Column, *, most: int = MOST, wait: int = WAIT, longest: int = LONGEST) -> DataFrame:
    """`messages_` that have to be sent at `now`, with attempt: the number of this one, from 1.

    An attempt without a time counts as due; null in `sent` counts as failed.
    """
    tried = log.groupBy("message_id").agg(F.count("*").alias("tries"), F.max(F.coalesce("sent", F.lit(False))).alias("done"), F.max("at").alias("last"))
    rows = messages_.join(tried, "message_id", "left")
    pause = F.least(F.lit(float(longest)), F.lit(float(wait)) * F.pow(F.lit(2.0), F.col("tries") - 1))
    ready = F.col("tries").isNull() | (~F.col("done") & (F.col("tries") < most) & F.coalesce(F.unix_micros(F.col("last").cast("timestamp_ltz")) + pause * 1_000_000 <= F.unix_micros(now), F.lit(True)))
    return rows.where(ready).select(*messages_.columns, (F.coalesce("tries", F.lit(0)) + 1).cast("int").alias("attempt"))


def moment(now: datetime) -> Column:
    """A point in time, whatever zones the driver and the session are in; one without a zone is in UTC."""
    return F.timestamp_micros(F.lit(int((now if now.tzinfo else now.replace(tzinfo=UTC)).timestamp() * 1_000_000)))


def put(rows: DataFrame, box: str) -> None:
    """Adds the messages of `rows` that the box does not hold yet."""
    spark, new = rows.sparkSession, messages(rows)
    held = _read(spark, f"{box}/messages", "message_id string, doc_id string, step string, body string")
    new.join(held.select("message_id"), "message_id", "left_anti").write.mode("append").parquet(f"{box}/messages")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def log_of(spark: SparkSession, box: str) -> DataFrame:
    return _read(spark, f"{box}/log", LOG)


def _sent(rows: DataFrame, make: Callable[[], Sender], now: Column) -> DataFrame:
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for b in batches:
            errors = []
            for doc, step, body in zip(b["doc_id"], b["step"], b["body"], strict=True):
                try:
                    call(doc, step, body)
                    errors.append(None)
                except Exception as e:
                    errors.append(type(e).__name__)
            yield pd.DataFrame({"message_id": b["message_id"], "attempt": b["attempt"], "sent": [e is None for e in errors], "error": errors})

    return rows.mapInPandas(run, LOG.rsplit(",", 1)[0]).withColumn("at", now)


def deliver(spark: SparkSession, box: str, make: Callable[[], Sender], *, now: datetime, per_round: int = ROUND, per_task: int = TASK, most: int = MOST, wait: int = WAIT, longest: int = LONGEST) -> int:
    """Sends what is due at `now`; how many bodies were sent or tried. A sender's error is that body's alone.

    What is due is settled once, then sent round by round, a round's log being stored before the next begins; rounds and
    tasks are dealt by hash and hold `per_round` and `per_task` messages, about.
    """
    held = _read(spark, f"{box}/messages", "message_id string, doc_id string, step string, body string")
    path = f"{box}/due/{uuid.uuid4().hex}"
    due(held, log_of(spark, box), moment(now), most=most, wait=wait, longest=longest).write.parquet(path)
    rows = spark.read.parquet(path)
    total = rows.count()
    rounds = max(1, math.ceil(total / per_round))
    for k in range(rounds if total else 0):
        mine = rows.where(F.pmod(F.xxhash64("message_id"), F.lit(rounds)) == k)
        tasks = max(1, math.ceil(min(total, per_round) / per_task))
        _sent(mine.repartition(tasks, F.xxhash64(F.lit("task"), "message_id")), make, moment(now)).write.mode("append").parquet(f"{box}/log")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return total


def state(messages_: DataFrame, log: DataFrame, *, most: int = MOST) -> DataFrame:
    """(message_id, state, tries): sent, dead (no attempt is left) or waiting."""
    tried = log.groupBy("message_id").agg(F.count("*").alias("tries"), F.max(F.coalesce("sent", F.lit(False))).alias("done"))
    rows = messages_.select("message_id").join(tried, "message_id", "left")
    return rows.select("message_id", F.when(F.col("done"), "sent").when(F.col("tries") >= most, "dead").otherwise("waiting").alias("state"), F.coalesce("tries", F.lit(0)).cast("long").alias("tries"))
