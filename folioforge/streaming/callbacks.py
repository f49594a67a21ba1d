"""Callbacks for finished documents: three bodies each, or the failure of the step that broke, through a sender of the user's."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.cluster import ship

#: A sender takes a document's id, the step (extracted, scored, embedded) and the JSON body.
Sender = Callable[[str, str, str], None]
STEPS = ("extracted", "scored", "embedded")
FAILED = {"extract": "Extract-Failed", "score": "Score-Failed"}


def failures(errors: DataFrame) -> DataFrame:
    """(doc_id, step, body) of `errors` (doc_id, failed_step: extract or score, reason)."""
    status = F.when(F.col("failed_step") == "score", FAILED["score"]).otherwise(FAILED["extract"])
    step = F.when(F.col("failed_step") == "score", "scored").otherwise("extracted")
    return errors.select("doc_id", step.alias("step"), F.to_json(F.struct(status.alias("status"), "reason")).alias("body"))


def messages(payloads: DataFrame) -> DataFrame:
    """(doc_id, step, body): the three bodies of publish.callback_payloads as rows."""
    return payloads.select("doc_id", F.explode(F.array(*(F.struct(F.lit(s).alias("step"), F.col(s).alias("body")) for s in STEPS))).alias("m")).select("doc_id", "m.*")


def send(rows: DataFrame, make: Callable[[], Sender], *, parallel: int = 4) -> DataFrame:
    """`rows` (doc_id, step, body) with sent and error: each body is sent by itself, and one that fails stops no other.

    At most `parallel` tasks send. A task that is run again sends again: receivers go by id and step.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for b in batches:
            errors = []
            for doc, step, body in zip(b["doc_id"], b["step"], b["body"], strict=True):
                try:
                    call(str(doc), step, body)
                    errors.append(None)
                except Exception as e:
                    errors.append(type(e).__name__)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "step": b["step"], "sent": [e is None for e in errors], "error": errors})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "step", "body").coalesce(parallel).mapInPandas(run, f"doc_id {kind}, step string, sent boolean, error string")


def call_back(stream: DataFrame, process: Callable[[DataFrame], DataFrame], make: Callable[[], Sender], *, log: str, checkpoint: str) -> StreamingQuery:
    """Run `process` (documents to (doc_id, step, body)) on each micro-batch and send what it gives through an outbox at `log`.

    A batch that is repeated after a failure puts nothing again and sends only what is not confirmed; what failed is tried again
    with a later batch, once its wait is over. What became of each attempt is in `log`/log (see outbox).
    """
    from . import outbox

    def each(batch: DataFrame, number: int) -> None:
        outbox.put(process(batch), log)
        outbox.deliver(batch.sparkSession, log, make, now=datetime.now(UTC))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
