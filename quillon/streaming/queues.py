"""A queue of many messages: the oldest visible one is received, hidden while it is leased, and failed after too many deliveries.

Events are (queue, event_id, ts, action, message, receipt), in order of (ts,
event_id) by queue. A receive gets the message sent first among the visible ones and
hides it; unless it is deleted by its latest receipt, it is visible again when its
lease ends. A message whose lease ends after the last delivery allowed fails when the
next receive comes upon it, and that receive goes on to the next message.

``queue_stream`` keeps a queue's open messages as state, an entry for each, and reads
and writes them by name; ``queue_log`` folds a whole log in sorted partitions. Both
hold one queue's open messages at a time, and none of those done. Rows without a queue,
time or known action have no outcome; events that arrive behind others that were folded
already are folded then.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.plans import views as V
from quillon.registry import query

EVENT = "queue string, event_id long, t long, action string, message string, receipt int"
OUTCOME = "queue string, event_id long, outcome string, message string, receipt int, failed array<string>"
ACTIONS = ("send", "receive", "delete")


class Queue:
    """The open messages of one queue: message -> (sent, visible from, deliveries)."""

    def __init__(self, open_: dict[str, tuple[int, int, int]] | None = None, lease: int = 1_800_000_000, most: int = 2):
        self.open, self.lease, self.most = dict(open_ or {}), lease, most
        self.hidden = [(visible, sent, m) for m, (sent, visible, _) in self.open.items()]
        self.ready: list[tuple[int, str]] = []  # by sending; entries of messages that have changed since are passed over
        heapq.heapify(self.hidden)
        self.changed: set[str] = set()

    def _put(self, message: str, entry: tuple[int, int, int]) -> None:
        self.open[message] = entry
        self.changed.add(message)
        heapq.heappush(self.hidden, (entry[1], entry[0], message))

    def _take(self, message: str) -> None:
        del self.open[message]
        self.changed.add(message)

    def send(self, at: int, message: str) -> tuple[str, str, None, list[str]]:
        if message in self.open:
            return "duplicate", message, None, []
        self._put(message, (at, at, 0))
        return "queued", message, None, []

    def receive(self, at: int) -> tuple[str, str | None, int | None, list[str]]:
        while self.hidden and self.hidden[0][0] <= at:
            visible, sent, message = heapq.heappop(self.hidden)
            if message in self.open and self.open[message][:2] == (sent, visible):
                heapq.heappush(self.ready, (sent, message))
        failed: list[str] = []
        while self.ready:
            sent, message = heapq.heappop(self.ready)
            entry = self.open.get(message)
            if not entry or entry[0] != sent or entry[1] > at:
                continue
            if entry[2] >= self.most:
                self._take(message)
                failed.append(message)
                continue
            self._put(message, (sent, at + self.lease, entry[2] + 1))
            return "delivered", message, entry[2] + 1, failed
        return "empty", None, None, failed

    def delete(self, message: str, receipt: int | None) -> tuple[str, str, int | None, list[str]]:
        entry = self.open.get(message)
        if not entry or not entry[2] or receipt != entry[2]:
            return "stale", message, receipt, []
        self._take(message)
        return "deleted", message, receipt, []

    def apply(self, event: tuple) -> tuple[str, str | None, int | None, list[str]]:
        _, _, at, action, message, receipt = event
        if action == "receive":
            return self.receive(at)
        message = message or ""
        return self.send(at, message) if action == "send" else self.delete(message, receipt)


def _events(events: DataFrame) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    kinds = {"queue": F.col("queue").cast("string"), "event_id": F.col("event_id").cast("long"), "t": at, "receipt": F.col("receipt").cast("int")}
    known = events.filter(F.col("queue").isNotNull() & F.col("ts").isNotNull() & F.col("action").isin(*ACTIONS))
    return known.select(kinds["queue"].alias("queue"), kinds["event_id"].alias("event_id"), kinds["t"].alias("t"), "action", "message", kinds["receipt"].alias("receipt"))


def _rows(frame: pd.DataFrame) -> Iterator[tuple]:
    for q, i, t, action, message, receipt in frame.itertuples(index=False):
        yield q, i, int(t), action, message, None if pd.isna(receipt) else int(receipt)


def _frame(out: Iterable[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])
    return frame.astype({"receipt": "Int32"})


def queue_log(events: DataFrame, lease: float = 1800.0, most: int = 2) -> DataFrame:
    """(queue, event_id, outcome, message, receipt, failed) of every event of a log."""
    micros = int(lease * 1e6)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, queue = None, Queue(lease=micros, most=most)
        for frame in frames:
            out = []
            for event in _rows(frame):
                if event[0] != name:
                    name, queue = event[0], Queue(lease=micros, most=most)
                out.append((name, event[1], *queue.apply(event)))
            yield _frame(out)

    ordered = _events(events).repartition("queue").sortWithinPartitions("queue", "t", "event_id")
    return ordered.mapInPandas(fold, OUTCOME)


class QueueProcessor(StatefulProcessor):
    """Open messages of each queue as a map in the state store."""

    def __init__(self, lease: int, most: int):
        self.lease, self.most = lease, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getMapState("messages", "message string", "sent long, visible long, deliveries int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows), ignore_index=True).sort_values(["t", "event_id"], kind="stable")
        held = {k[0]: tuple(v) for k, v in self.messages.iterator()} if self.messages.exists() else {}
        queue = Queue(held, self.lease, self.most)
        out = [(event[0], event[1], *queue.apply(event)) for event in _rows(events)]
        for message in queue.changed:
            if message in queue.open:
                self.messages.updateValue((message,), queue.open[message])
            elif message in held:
                self.messages.removeKey((message,))
        yield _frame(out)

    def close(self) -> None:
        pass


def queue_stream(events: DataFrame, lease: float = 1800.0, most: int = 2) -> DataFrame:
    """``queue_log`` of a stream; its session needs the RocksDB state store."""
    keyed = _events(events).groupBy("queue")
    return keyed.transformWithStateInPandas(QueueProcessor(int(lease * 1e6), most), OUTCOME, "Append", "None")


@query("stream_queue_many")
def stream_queue_many(spark, sf_dir):
    """The events as a log of queues: views send, clicks and sign-ups receive, purchases and errors delete what was sent a while ago."""
    e, i = V.table(spark, sf_dir, "events"), F.col("event_id")
    action = F.when(F.col("event_type") == "view", "send").when(F.col("event_type").isin("click", "signup"), "receive").otherwise("delete")
    message = F.when(action != "receive", F.concat(F.lit("m"), F.pmod(F.floor(F.col("value")), F.lit(40)).cast("string")))
    rows = e.select((F.col("user_id") % 500).cast("string").alias("queue"), i, "ts", action.alias("action"), message.alias("message"), (i % 2 + 1).cast("int").alias("receipt"))
    return queue_log(rows, lease=6 * 3600.0).withColumn("failed", F.array_join("failed", ","))
