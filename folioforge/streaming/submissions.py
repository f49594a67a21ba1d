"""Documents that are submitted again: one answer for each content, for as long as it is remembered.

State is kept for each content hash by transformWithState: who was answered first, and when that is forgotten. It lives in
the query's checkpoint, so a restart goes on with it; event-time timers clear it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioforge.cluster import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What became of a submission: it is answered, it repeats one that was, or (without one) its memory ran out.
FRESH, REPEATED, EXPIRED = "fresh", "repeated", "expired"
Answer = Row("sha256", "doc_id", "first_doc_id", "us", "state")


class Memory(StatefulProcessor):
    """The first submission of a content within `keep_ms` of the last one that was answered."""

    def __init__(self, keep_ms: int, kind: str):
        self.keep_ms, self.kind = keep_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", f"doc_id {self.kind}, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        batch = sorted((r["us"] // 1000, r["doc_id"], r["us"]) for r in rows)
        held = before = self.first.get()
        for ms, doc, us in batch:
            if held is None or ms >= held[1]:
                if held is not None:
                    self.handle.deleteTimer(held[1])
                held = (doc, ms + self.keep_ms)
                self.handle.registerTimer(held[1])
                yield Answer(key[0], doc, doc, us, FRESH)
            else:
                yield Answer(key[0], doc, held[0], us, REPEATED)
        if held is not before:
            self.first.update(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.first.get()
        if held is not None and held[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.first.clear()
            yield Answer(key[0], held[0], held[0], held[1] * 1000, EXPIRED)

    def close(self) -> None:
        pass


def once(stream: DataFrame, *, keep: timedelta = timedelta(days=30), late: str = "1 hour") -> DataFrame:
    """(sha256, doc_id, first_doc_id, at, state) of a stream of submissions (sha256, doc_id, at timestamp).

    A content is fresh at its first submission and again `keep` after one that was fresh, else repeated; of submissions at
    one time the smallest doc_id is first. Rows later than `late` behind the newest may be left out, as watermarks are.
    Rows without a hash or a time are left out, they are nobody's repetition. When memory runs out, one row says so.
    """
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keep_ms = int(keep.total_seconds() * 1000)
    kind = stream.schema["doc_id"].dataType.simpleString()
    rows = stream.select("sha256", "doc_id", "at", F.unix_micros("at").alias("us")).where("sha256 IS NOT NULL AND at IS NOT NULL AND doc_id IS NOT NULL").withWatermark("at", late)
    schema = f"sha256 string, doc_id {kind}, first_doc_id {kind}, us long, state string"
    # rows, not data frames: most contents come once, and a data frame for each of them costs more than all the rest
    told = rows.groupBy("sha256").transformWithState(Memory(keep_ms, kind), schema, "append", "eventTime")
    return told.select("sha256", "doc_id", "first_doc_id", F.timestamp_micros("us").alias("at"), "state")


def answer_once(stream: DataFrame, *, target: str, checkpoint: str, keep: timedelta = timedelta(days=30), late: str = "1 hour") -> StreamingQuery:
    """once(), written to `target` exactly once; all that there is, then it ends."""
    return once(stream, keep=keep, late=late).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def read_answers(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def latest(answers: DataFrame) -> DataFrame:
    """(sha256, first_doc_id, at): the answer that holds for each content now; contents whose memory ran out have none."""
    last = answers.where(F.col("state") != REPEATED).groupBy("sha256").agg(F.max_by(F.struct("first_doc_id", "at", "state"), F.struct("at", F.col("state") == FRESH)).alias("x"))
    return last.where(F.col("x.state") == FRESH).select("sha256", "x.first_doc_id", "x.at")
