"""Ordered funnels: how many attempts of each client reach each step, and how fast.

Time is cut into buckets, and every row is copied into the buckets before its
own from which an attempt can still reach it. So each bucket of a client holds
all that the attempts beginning in it may need, whatever number of rows the
client has, and a bucket's attempts find their next steps by forward as-of
merges without exact matches. A task streams over many buckets and never holds
more than one bucket of one client (its rows of ``bucket`` plus ``within``)
beside ``CHUNK`` rows.

Quantiles are exact and split as well: waits are counted by value, values are
summed into bins of ``2**14`` microseconds, and only the bin that holds the
wanted rank is looked into. No window ever sees more than ``2**14`` values or
``within / 2**14`` bins of one key.

Rows with a null client, kind or time count for nothing, and repeated rows
count once. Rows of one client at one time have no order among them: a step is
later than the one before it, never at the same time, and an excluded row at
the time of a step ends the attempt. An empty table has no rows in the result.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Stored, bounded_batches

MINUTE = 60_000_000
#: Rows that a task gathers before it merges them.
CHUNK = 200_000
#: Bits of a bin of waits.
BIN_BITS = 14


@dataclass(frozen=True)
class Funnel:
    """Steps in their order, and the kinds that end an attempt between two of them."""

    name: str
    steps: tuple[str, ...]
    excluded: tuple[str, ...] = ()


def micros(rows: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; of one without a zone, whatever the session's zone is."""
    at = F.col(name)
    if dict(rows.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(at.cast("timestamp"))
    since = at - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    seconds = F.extract(F.lit("SECOND"), since)
    whole = (F.extract(F.lit("DAY"), since).cast("long") * 24 + F.extract(F.lit("HOUR"), since)) * 60
    return (whole + F.extract(F.lit("MINUTE"), since)) * MINUTE + (seconds * 1_000_000).cast("long")


def _kinds(funnels: Iterable[Funnel]) -> list[str]:
    return sorted({k for f in funnels for k in (*f.steps, *f.excluded)})


def bucketed(rows: DataFrame, kinds: list[str], later: set[str], within: int, bucket: int) -> DataFrame:
    """Distinct rows with their bucket's first microsecond; ``home`` is true in a row's own bucket only."""
    number = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i).cast("byte"))])
    known = rows.select(F.col("client"), number[F.col("kind")].alias("kind"), "t").filter(
        "client IS NOT NULL AND kind IS NOT NULL AND t IS NOT NULL"
    )
    start = lambda t: t - F.pmod(t, F.lit(bucket))
    t, own = F.col("t"), start(F.col("t"))
    first = F.when(F.col("kind").isin([kinds.index(k) for k in later]), start(t - F.lit(within))).otherwise(own)
    copies = F.sequence(first, own, F.lit(bucket).cast("long"))
    placed = known.distinct().withColumn("bucket", F.explode(copies))
    return placed.select("client", "bucket", (t - F.col("bucket")).alias("at"), "kind", (own == F.col("bucket")).alias("home"))


def _merged(rows: pd.DataFrame, funnels: tuple[Funnel, ...], kinds: list[str], within: int) -> Iterator[pd.DataFrame]:
    """The reached steps of all attempts that begin in whole buckets of clients."""
    new = (rows["client"] != rows["client"].shift()) | (rows["bucket"] != rows["bucket"].shift())
    rows = rows.assign(group=np.cumsum(new.to_numpy(), dtype="int64"), row=np.arange(len(rows), dtype="int64"))
    ordered = rows.sort_values("at", kind="stable")
    codes = ordered["kind"].to_numpy()
    of = {k: ordered[codes == i] for i, k in enumerate(kinds)}
    clients, starts = rows["client"], rows["bucket"].to_numpy() + rows["at"].to_numpy()
    for funnel in funnels:
        first = of[funnel.steps[0]]
        first = first[first["home"].to_numpy()]
        now = pd.DataFrame({"group": first["group"], "row": first["row"], "begun": first["at"], "before": first["at"]})
        wait = np.zeros(len(now), "int64")
        bad = ordered[np.isin(codes, [kinds.index(k) for k in funnel.excluded])]
        bad = pd.DataFrame({"group": bad["group"], "bad": bad["at"]})
        for step, kind in enumerate(funnel.steps, 1):
            if step > 1:
                following = pd.DataFrame({"group": of[kind]["group"], "next": of[kind]["at"]})
                how = {"by": "group", "left_on": "before", "direction": "forward", "allow_exact_matches": False}
                now = pd.merge_asof(now, following, right_on="next", **how)
                now = pd.merge_asof(now, bad, right_on="bad", **how)
                reached = (now["next"] - now["begun"] <= within) & ~(now["bad"] <= now["next"])
                now = now[reached.to_numpy()].astype({"next": "int64"})
                wait = (now["next"] - now["before"]).to_numpy()
            if not len(now):
                break
            at = now["row"].to_numpy()
            yield pd.DataFrame({
                "funnel": funnel.name, "client": clients.iloc[at].to_numpy(), "begun": starts[at],
                "step": np.int32(step), "wait": wait,
            })
            if step > 1:
                now = now.assign(before=now["next"]).drop(columns=["next", "bad"]).sort_values("before", kind="stable")


def attempt_steps(
    rows: DataFrame, funnels: Iterable[Funnel], client: str, kind: str, at: str, within: int = 5 * MINUTE, bucket: int = 10 * MINUTE
) -> DataFrame:
    """Each step that an attempt reaches: funnel, client, begun, step, wait (microseconds since the step before).

    An attempt begins at each row of a first step (``begun``, microseconds since
    1970). Its next step is the client's earliest later row of that kind, unless that
    is more than ``within`` after the first step or an excluded row comes between.
    """
    funnels = tuple(funnels)
    if any(not f.steps for f in funnels) or bucket < 1 or within < 0:
        raise ValueError("a funnel needs a step, and a bucket a width")
    bounded_batches(rows.sparkSession)
    kinds = _kinds(funnels)
    later = {k for f in funnels for k in (*f.steps[1:], *f.excluded)}
    named = rows.select(F.col(client).alias("client"), F.col(kind).alias("kind"), micros(rows, at).alias("t"))
    placed = bucketed(named, kinds, later, within, bucket)
    together = placed.repartition("client", "bucket").sortWithinPartitions("client", "bucket")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size < CHUNK:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = (rows["client"] == rows["client"].iloc[-1]) & (rows["bucket"] == rows["bucket"].iloc[-1])
            whole = ~last.to_numpy()
            yield from _merged(rows[whole], funnels, kinds, within)
            held = [rows[~whole]]
            size = len(held[0])
        if size:
            yield from _merged(pd.concat(held, ignore_index=True), funnels, kinds, within)

    kind_of = dict(placed.dtypes)["client"]
    return together.mapInPandas(walk, f"funnel string, client {kind_of}, begun long, step int, wait long")


def nearest_rank(counted: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """By ``keys``, the ceil(percent * n / 100)-th smallest ``wait`` of a table of counts ``n`` by keys and wait."""
    from pyspark.sql import Window

    keyed = counted.withColumn("bin", F.shiftright("wait", BIN_BITS))
    by = Window.partitionBy(*keys)
    upto = lambda column: by.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    bins = keyed.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    bins = bins.select("*", F.sum("n").over(upto("bin")).alias("upto"), F.sum("n").over(by).alias("all"))
    rank = F.expr(f"(all * {percent} + 99) div 100")
    bins = bins.withColumn("rank", rank).filter("upto >= rank AND upto - n < rank")
    inside = keyed.join(bins.select(*keys, "bin", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")), [*keys, "bin"])
    inside = inside.withColumn("upto", F.sum("n").over(upto("wait")))
    return inside.filter("upto >= rank AND upto - n < rank").select(*keys, F.col("wait").alias("quantile"))


def funnel_report(
    rows: DataFrame, funnels: Iterable[Funnel], client: str, kind: str, at: str, within: int = 5 * MINUTE, percent: int = 25
) -> DataFrame:
    """A row for each funnel and client with attempts: n1 to nk, deepest, t2 to tk (quantiles of waits), same_depth.

    ``same_depth`` counts the clients of equal funnel and deepest step; its table has
    a row for each funnel and step, and is the only one that is broadcast.
    """
    funnels = tuple(funnels)
    steps = attempt_steps(rows, funnels, client, kind, at, within)
    counted = steps.groupBy("funnel", "client", "step", "wait").agg(F.count("*").alias("n"))
    counted = Stored(counted, "funnel-waits").read()
    most = max(len(f.steps) for f in funnels)
    sums = [F.coalesce(F.sum(F.when(F.col("step") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(1, most + 1)]
    reached = counted.groupBy("funnel", "client").agg(*sums, F.max("step").alias("deepest"))
    waits = nearest_rank(counted.filter("step > 1"), ["funnel", "client", "step"], percent)
    columns = [F.max(F.when(F.col("step") == k, F.col("quantile"))).alias(f"t{k}") for k in range(2, most + 1)]
    reached = reached.join(waits.groupBy("funnel", "client").agg(*columns), ["funnel", "client"], "left")
    depths = counted.groupBy("funnel", "client").agg(F.max("step").alias("deepest"))
    depths = depths.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))
    out = reached.join(F.broadcast(depths), ["funnel", "deepest"])
    named = [f"n{k}" for k in range(1, most + 1)] + ["deepest"] + [f"t{k}" for k in range(2, most + 1)]
    return out.select("funnel", F.col("client").alias(client), *named, "same_depth")


def report_sql(table: str, funnels: Iterable[Funnel], client: str, kind: str, at: str, within: int, percent: int) -> str:
    """DuckDB SQL of ``funnel_report`` for funnels of four steps."""
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    parts = [
        f"rows_ AS (SELECT DISTINCT {client} AS c, {kind} AS k, epoch_us({at}) AS t FROM {table}"
        f" WHERE {client} IS NOT NULL AND {kind} IS NOT NULL AND {at} IS NOT NULL)"
    ]
    for i, f in enumerate(funnels):
        parts.append(f"x{i} AS (SELECT c, t FROM rows_ WHERE k IN ({listed(f.excluded)}))")
        parts.append(f"f{i}_1 AS (SELECT c, t AS t1, t AS prev FROM rows_ WHERE k = '{f.steps[0]}')")
        for n, step in enumerate(f.steps[1:], 2):
            parts.append(
                f"f{i}_{n} AS (SELECT a.c, a.t1, s.t AS prev, s.t - a.prev AS w FROM f{i}_{n - 1} a"
                f" ASOF JOIN (SELECT c, t FROM rows_ WHERE k = '{step}') s ON a.c = s.c AND a.prev < s.t"
                f" ASOF LEFT JOIN x{i} x ON a.c = x.c AND a.prev < x.t"
                f" WHERE s.t - a.t1 <= {within} AND (x.t IS NULL OR x.t > s.t))"
            )
    union = " UNION ALL ".join(
        f"SELECT '{f.name}' AS funnel, c, {n} AS step, {'0' if n == 1 else 'w'} AS w FROM f{i}_{n}"
        for i, f in enumerate(funnels)
        for n in range(1, len(f.steps) + 1)
    )
    parts.append(f"steps AS ({union})")
    quantile = lambda k: (
        f"list_extract(list_sort(list(w) FILTER (step = {k})), (({percent} * count(*) FILTER (step = {k}) + 99) // 100)::BIGINT)"
    )
    parts.append(
        "summed AS (SELECT funnel, c, "
        + ", ".join(f"count(*) FILTER (step = {k}) AS n{k}" for k in range(1, 5))
        + ", max(step)::INTEGER AS deepest, "
        + ", ".join(f"{quantile(k)} AS t{k}" for k in range(2, 5))
        + " FROM steps GROUP BY funnel, c)"
    )
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT funnel, c AS {client}, n1, n2, n3, n4, deepest, t2, t3, t4,"
        " count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM summed"
    )
