"""Callbacks by an outbox: nothing is lost, and what was confirmed is never sent again, whatever breaks off."""

import json
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioforge.streaming import outbox

NOW = datetime(2024, 6, 1, 12)
ROWS = "doc_id long, step string, body string"


def sender(folder, fails=()):
    """Writes each call down; fails for the documents named, and dies where a file says so."""

    def make():
        def call(doc, step, body):
            with open(f"{folder}/calls", "a") as f:
                f.write(json.dumps([doc, step, body]) + "\n")
            if Path(f"{folder}/die").exists() and doc == Path(f"{folder}/die").read_text():
                raise SystemExit("the worker dies")
            if int(doc) in fails:
                raise ConnectionError

        return call

    return make


def calls(folder):
    return Counter(map(tuple, map(json.loads, (folder / "calls").read_text().splitlines()))) if (folder / "calls").exists() else Counter()


def bodies(spark, n, step="scored"):
    return spark.createDataFrame([(k, step, f"body {k}") for k in range(n)] + [(n + 1, step, None)], ROWS)


def test_each_body_once(spark, tmp_path):
    box = str(tmp_path / "box")
    assert outbox.deliver(spark, box, sender(tmp_path), now=NOW) == 0
    for _ in range(2):  # a batch that is repeated puts nothing again
        outbox.put(bodies(spark, 30).unionByName(bodies(spark, 30)), box)
    assert outbox.deliver(spark, box, sender(tmp_path, fails={3, 4}), now=NOW, per_round=8) == 30
    assert set(calls(tmp_path).values()) == {1} and len(calls(tmp_path)) == 30
    assert outbox.deliver(spark, box, sender(tmp_path), now=NOW + timedelta(seconds=29)) == 0  # backs off
    outbox.put(bodies(spark, 31), box)
    assert outbox.deliver(spark, box, sender(tmp_path, fails={3}), now=NOW + timedelta(seconds=30)) == 3
    got = calls(tmp_path)
    assert {int(k[0]): n for k, n in got.items() if n > 1} == {3: 2, 4: 2} and len(got) == 31
    assert outbox.deliver(spark, box, sender(tmp_path), now=NOW + timedelta(seconds=89)) == 0
    assert outbox.deliver(spark, box, sender(tmp_path), now=NOW + timedelta(seconds=90)) == 1
    held = spark.read.parquet(f"{box}/messages")
    assert {r.state: r["count"] for r in outbox.state(held, outbox.log_of(spark, box)).groupBy("state").count().collect()} == {"sent": 31}


def test_a_run_that_dies_sends_its_round_once_more(spark, tmp_path):
    box = str(tmp_path / "box")
    outbox.put(bodies(spark, 40), box)
    (tmp_path / "die").write_text("17")
    with pytest.raises(Exception, match="dies|SystemExit|worker"):
        outbox.deliver(spark, box, sender(tmp_path), now=NOW, per_round=10, per_task=5)
    before = calls(tmp_path)
    confirmed = {r.message_id for r in outbox.log_of(spark, box).where("sent").collect()}
    (tmp_path / "die").unlink()
    outbox.deliver(spark, box, sender(tmp_path), now=NOW, per_round=10, per_task=5)
    after = calls(tmp_path)
    assert len(after) == 40 and max(after.values()) <= 2
    ids = {r.message_id: (r.doc_id, r.step, r.body) for r in spark.read.parquet(f"{box}/messages").collect()}
    assert all(after[ids[m]] == before[ids[m]] == 1 for m in confirmed)  # what was confirmed was not sent again
    assert sum(n > 1 for n in after.values()) <= 20
    assert outbox.deliver(spark, box, sender(tmp_path), now=NOW + timedelta(days=1)) == 0


def test_what_is_due(spark):
    held = spark.createDataFrame([(m,) for m in "abcdefg"], "message_id string")
    at = lambda s: NOW - timedelta(seconds=s)
    rows = [("a", 1, True, None, at(9)), ("b", 1, False, "E", at(30)), ("c", 1, False, "E", at(29)), ("d", 1, False, "E", at(99)), ("d", 2, False, "E", at(60)), ("e", 1, None, None, None), ("g", 1, False, "E", at(10**6)), ("g", 2, True, None, at(10**6)), ("x", 1, False, "E", at(1))]
    log = spark.createDataFrame(rows + [("f", k, False, "E", at(10**6)) for k in range(8)], outbox.LOG)
    got = {r.message_id: r.attempt for r in outbox.due(held, log, F.lit(NOW)).collect()}
    assert got == {"b": 2, "d": 3, "e": 2}
    assert {r.message_id: r.state for r in outbox.state(held, log).collect()} == {"a": "sent", "b": "waiting", "c": "waiting", "d": "waiting", "e": "waiting", "f": "dead", "g": "sent"}
    assert outbox.due(held.limit(0), log, F.lit(NOW)).count() == 0
