"""Streams: a queue with visibility timeouts, a token bucket, and windowed costs.

The queue and the windowed costs are Structured Streaming operators too; the
registered queries run all of them over the ``events`` table as a batch, with the
same transitions. Tests run the streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans import views as V
from quillon.registry import query


#: How long a stream keeps the state of a message without events.
KEPT_MS = 14 * 24 * 3600 * 1000


class MessageState:
    """One message of an at-least-once queue: hidden while leased, poisoned after too many deliveries."""

    def __init__(self, visible_at: float = 0.0, deliveries: int = 0, receipt: int = 0, state: str = "queued"):
        self.visible_at, self.deliveries, self.receipt, self.state = visible_at, deliveries, receipt, state

    def receive(self, at: float, visibility: float, most: int) -> str:
        if self.state != "queued":
            return self.state
        if at < self.visible_at:
            return "hidden"
        if self.deliveries >= most:
            self.state = "failed"
            return "failed"
        self.deliveries += 1
        self.receipt += 1
        self.visible_at = at + visibility
        return "delivered"

    def delete(self, receipt: int) -> str:
        if receipt != self.receipt or self.state != "queued":
            return "stale"
        self.state = "done"
        return "deleted"


def queue_outcomes(events: DataFrame, visibility: float = 1800.0, most: int = 2) -> DataFrame:
    """(key, event_id, outcome) of (key, event_id, ts, action, receipt) rows in order of (ts, event_id) by key.

    A key's events are one message's life, which the delivery limit keeps short;
    they are folded as an array, with ``MessageState``'s transitions as columns.
    """
    event = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", (F.col("action") == "receive").alias("receive"), F.col("receipt").cast("long").alias("receipt"))
    lives = events.groupBy("key").agg(F.array_sort(F.collect_list(event)).alias("events"))
    start = F.struct(F.lit(0).cast("long").alias("visible"), F.lit(0).cast("long").alias("deliveries"), F.lit("queued").alias("state"), F.array().cast("array<struct<event_id:bigint,outcome:string>>").alias("out"))

    def step(now: Column, e: Column) -> Column:
        live, due, left = now["state"] == "queued", e["t"] >= now["visible"], now["deliveries"] < most
        delivered, failed, deleted = e["receive"] & live & due & left, e["receive"] & live & due & ~left, ~e["receive"] & live & (e["receipt"] == now["deliveries"])
        outcome = F.when(deleted, "deleted").when(~e["receive"], "stale").when(~live, now["state"]).when(~due, "hidden").when(failed, "failed").otherwise("delivered")
        return F.struct(
            F.when(delivered, e["t"] + int(visibility * 1e6)).otherwise(now["visible"]).alias("visible"), (now["deliveries"] + F.when(delivered, 1).otherwise(0)).alias("deliveries"),
            F.when(failed, "failed").when(deleted, "done").otherwise(now["state"]).alias("state"), F.concat(now["out"], F.array(F.struct(e["event_id"].alias("event_id"), outcome.alias("outcome")))).alias("out"),
        )

    return lives.select("key", F.inline(F.aggregate("events", start, step, lambda now: now["out"])))


_QUEUE_SQL = """WITH RECURSIVE e AS (SELECT key, event_id, t, action, receipt, row_number() OVER (PARTITION BY key ORDER BY t, event_id) AS rn
  FROM (SELECT user_id * 1000 + event_id // 1000 AS key, event_id, epoch_us(ts) AS t, CASE WHEN event_type = 'purchase' THEN 'delete' ELSE 'receive' END AS action, event_id % 3 AS receipt FROM events)),
r AS (
  SELECT DISTINCT key, 0::BIGINT AS rn, 0::BIGINT AS event_id, 0::BIGINT AS visible, 0::BIGINT AS deliveries, 'queued' AS state, '' AS outcome FROM e
  UNION ALL
  SELECT e.key, e.rn, e.event_id, CASE WHEN action = 'receive' AND state = 'queued' AND t >= visible AND deliveries < 2 THEN t + 1800000000 ELSE visible END,
    CASE WHEN action = 'receive' AND state = 'queued' AND t >= visible AND deliveries < 2 THEN deliveries + 1 ELSE deliveries END,
    CASE WHEN action = 'receive' AND state = 'queued' AND t >= visible AND deliveries >= 2 THEN 'failed' WHEN action = 'delete' AND state = 'queued' AND e.receipt = deliveries THEN 'done' ELSE state END,
    CASE WHEN action = 'delete' THEN CASE WHEN state = 'queued' AND e.receipt = deliveries THEN 'deleted' ELSE 'stale' END WHEN state <> 'queued' THEN state WHEN t < visible THEN 'hidden' WHEN deliveries >= 2 THEN 'failed' ELSE 'delivered' END
  FROM r JOIN e ON e.key = r.key AND e.rn = r.rn + 1)
SELECT key, event_id, outcome FROM r WHERE rn > 0"""


@query("stream_queue_visibility", "", _QUEUE_SQL)
def stream_queue_visibility(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") * 1000 + F.floor(F.col("event_id") / 1000)).alias("key"), "event_id", "ts", F.when(F.col("event_type") == "purchase", "delete").otherwise("receive").alias("action"), (F.col("event_id") % 3).alias("receipt"))
    return queue_outcomes(rows)


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """(key, event_id, wait_ms): first come, first served, with continuous refill.

    With every request served, the wait has a closed form: tokens fall behind by the
    running maximum of demand minus refill, so two window sums replace the fold.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    demand = F.sum("cost").over(order)
    rows = requests.withColumn("demand", demand).withColumn("refill", seconds * rate)
    # the bucket is full before request j: it then owes demand(i) - demand(j-1) - burst, less the refill since j
    slack = F.max(F.col("refill") - (F.col("demand") - F.col("cost"))).over(order)
    debt = F.col("demand") - burst + slack - F.col("refill")
    return rows.select("key", "event_id", F.greatest(F.lit(0), F.ceil(debt / rate * 1000 - 0.001)).cast("long").alias("wait_ms"))


@query("stream_token_bucket", "", """WITH r AS (SELECT user_id AS key, event_id, ts, epoch_us(ts) / 1e6 * 0.001 AS refill, round(value)::BIGINT AS cost, sum(round(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS demand FROM events),
s AS (SELECT *, max(refill - (demand - cost)) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS slack FROM r)
SELECT key, event_id, greatest(0, ceil((demand - 100.0 + slack - refill) / 0.001 * 1000 - 0.001))::BIGINT AS wait_ms FROM s""")
def stream_token_bucket(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "ts", F.round("value").cast("long").alias("cost"))
    return token_bucket(e, 0.001, 100.0)


def tumbling_costs(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, stage, calls, cost) in event-time windows; works on streams, with a watermark, and on tables alike."""
    rows = calls.withWatermark("ts", late).groupBy(F.window("ts", width), "stage").agg(F.count("*").alias("calls"), F.sum("cost_micro").alias("cost_micro"))
    return rows.select(F.col("window.start").alias("start"), "stage", "calls", "cost_micro")


@query("stream_tumbling_cost", "llm_calls", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, stage, count(*) AS calls, sum(cost_micro)::BIGINT AS cost_micro FROM llm_calls GROUP BY 1, 2")
def stream_tumbling_cost(spark, sf_dir):
    return tumbling_costs(V.llm_calls(spark, sf_dir))


def stream_queue(events: DataFrame, visibility: float = 1800.0, most: int = 2) -> DataFrame:
    """The same queue over a stream of (key, event_id, ts, action, receipt) rows, with its state kept by Spark.

    Rows more than an hour behind the newest are late and left out; a message's state goes once event time is ``KEPT_MS`` past its last event.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        message = MessageState(*(state.get if state.exists else ()))
        out, last = [], 0.0
        for frame in frames:
            for row in frame.sort_values(["ts", "event_id"]).itertuples(index=False):
                last = max(last, row.ts.timestamp())
                outcome = message.receive(row.ts.timestamp(), visibility, most) if row.action == "receive" else message.delete(int(row.receipt))
                out.append((key[0], row.event_id, outcome))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + KEPT_MS)
        state.update((message.visible_at, message.deliveries, message.receipt, message.state))
        yield pd.DataFrame(out, columns=["key", "event_id", "outcome"])

    marked = events.withWatermark("ts", "1 hour")
    return marked.groupBy("key").applyInPandasWithState(step, "key long, event_id long, outcome string", "visible_at double, deliveries int, receipt int, state string", "append", GroupStateTimeout.EventTimeTimeout)
