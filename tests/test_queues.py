"""A queue of many messages: log and stream against a replay that looks at every message."""

from __future__ import annotations

import datetime
import random

import pytest

from quillon.streaming import queues

SCHEMA = "queue string, event_id long, ts timestamp, action string, message string, receipt int, own string"
START = datetime.datetime(2024, 1, 1)


def replay(rows, lease, most):
    """Every receive looks at all messages."""
    out, of = {}, {}
    for queue, i, ts, action, message, receipt, _ in sorted((r for r in rows if r[0] is not None and r[2] is not None and r[3] in queues.ACTIONS), key=lambda r: (r[0], r[2], r[1])):
        at, held = (ts - START).total_seconds(), of.setdefault(queue, {})
        message, failed = message or "", []
        if action == "send":
            done = ("duplicate" if message in held else "queued", message, None)
            held.setdefault(message, [at, at, 0])
        elif action == "delete":
            good = message in held and held[message][2] and held[message][2] == receipt
            if good:
                del held[message]
            done = ("deleted" if good else "stale", message, receipt)
        else:
            done = ("empty", None, None)
            for m in sorted((m for m, (_, visible, _) in held.items() if visible <= at), key=lambda m: (held[m][0], m)):
                if held[m][2] >= most:
                    failed.append(m)
                    del held[m]
                    continue
                held[m][1:] = [at + lease, held[m][2] + 1]
                done = ("delivered", m, held[m][2])
                break
        out[queue, i] = (*done, failed)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(1500):
        queue = rng.choice(["a", "a", "a", "b", "c", None])
        action = rng.choices(["send", "receive", "delete", "peek", None], [4, 6, 3, 0.2, 0.2])[0]
        ts = START + datetime.timedelta(seconds=i * 2 + rng.choice([0, 0, 1])) if rng.random() > 0.01 else None
        out.append((queue, i, ts, action, None if action == "receive" else rng.choice([*"abcdefgh", None]), rng.choice([1, 1, 2, None]), "own"))
    return out


def _got(frame):
    return {(r.queue, r.event_id): (r.outcome, r.message, r.receipt, list(r.failed)) for r in frame}


def test_log_equals_a_replay(spark, rows):
    want = replay(rows, 60, 2)
    got = queues.queue_log(spark.createDataFrame(rows, SCHEMA).repartition(4), lease=60).collect()
    assert len(got) == len(want) and _got(got) == want
    assert {o for o, *_ in want.values()} == {"queued", "duplicate", "delivered", "empty", "deleted", "stale"} and any(f for *_, f in want.values())
    assert queues.queue_log(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_oldest_visible_message_comes_first():
    q = queues.Queue(lease=10, most=2)
    for at, message in ((0, "x"), (1, "a"), (1, "b")):
        q.send(at, message)
    assert [q.receive(2)[1] for _ in range(4)] == ["x", "a", "b", None]
    assert q.delete("a", 2)[0] == "stale" and q.delete("a", 1)[0] == "deleted"
    assert q.receive(11)[:3] == ("empty", None, None)
    assert [q.receive(12)[:3] for _ in range(3)] == [("delivered", "x", 2), ("delivered", "b", 2), ("empty", None, None)]
    assert q.delete("x", 1)[0] == "stale"
    assert q.receive(30) == ("empty", None, None, ["x", "b"]) and not q.open


def test_the_stream_equals_the_log(spark, rows, tmp_path):
    """Several batches, and a restart from the checkpoint between them."""
    ordered = sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1]))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in range(3):
            mine = ordered[part * len(ordered) // 3 : (part + 1) * len(ordered) // 3]
            spark.createDataFrame(mine, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = queues.queue_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), lease=60)
            run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            assert run.awaitTermination(180)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert _got(spark.read.schema(queues.OUTCOME).parquet(f"{tmp_path}/out").collect()) == replay(rows, 60, 2)
