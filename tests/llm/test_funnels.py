from __future__ import annotations

import datetime
import math
import random
from collections import Counter, defaultdict

import pandas as pd
import pytest

from quillon.llm import funnels
from quillon.llm.funnels import MINUTE, Funnel, attempt_steps, funnel_report

FUNNELS = (
    Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
    Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
    Funnel("S", ("signup",)),
)
SCHEMA = "client_id long, kind string, arrived_at timestamp_ntz, bucket string, home int, wait string, n string"
START = datetime.datetime(2024, 3, 31, 1, 58)  # a night in which clocks change


def brute(rows, within=5 * MINUTE):
    """Funnel and client -> the waits of each step, attempt by attempt."""
    of = defaultdict(set)
    for client, kind, at, *_ in rows:
        if client is not None and kind is not None and at is not None:
            of[client].add((kind, (at - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)))
    out = defaultdict(lambda: defaultdict(list))
    for client, events in of.items():
        for f in FUNNELS:
            for begun in sorted(t for k, t in events if k == f.steps[0]):
                out[f.name, client][1].append(0)
                before = begun
                for n, kind in enumerate(f.steps[1:], 2):
                    later = [t for k, t in events if k == kind and t > before]
                    if not later or min(later) - begun > within:
                        break
                    if any(k in f.excluded and before < t <= min(later) for k, t in events):
                        break
                    out[f.name, client][n].append(min(later) - before)
                    before = min(later)
    return out


def report(rows):
    found = brute(rows)
    depths = Counter((f, max(steps)) for (f, _), steps in found.items())
    out = []
    for (f, client), steps in found.items():
        counts = [len(steps.get(k, [])) for k in range(1, 5)]
        waits = [sorted(w)[math.ceil(25 * len(w) / 100) - 1] if (w := steps.get(k)) else None for k in range(2, 5)]
        out.append((f, client, *counts, max(steps), *waits, depths[f, max(steps)]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    kinds = ["view", "click", "purchase", "signup", "error", "other", None]
    out = []
    for client in [1] * 900 + [2] * 150 + [3, 4, None] * 12:
        at = START + datetime.timedelta(seconds=rng.randrange(40 * 60) * rng.choice([1, 2]), microseconds=rng.choice([0, 0, 1, 999_999]))
        out.append((client, rng.choices(kinds, [40, 30, 12, 4, 3, 5, 2])[0], at if rng.random() > 0.02 else None, "own", 5, "own", "own"))
    edges = [(9, "view", 0), (9, "click", 0), (9, "click", 1), (9, "view", 2), (9, "purchase", 300), (9, "error", 301)]  # at the limit, and ties
    edges += [(8, "view", 0), (8, "click", 5), (8, "error", 5), (7, "view", 0), (7, "click", 301), (6, "signup", 0)]
    out += [(c, k, START + datetime.timedelta(seconds=s), "own", 5, "own", "own") for c, k, s in edges]
    return out + out[:200]  # repeated rows


def test_report_equals_attempt_by_attempt(spark, rows):
    clicks = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = funnel_report(clicks, FUNNELS, "client_id", "kind", "arrived_at")
    assert got.columns == ["funnel", "client_id", "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == report(rows)


@pytest.mark.parametrize("chunk, bucket", [(1, 7 * MINUTE), (50, MINUTE // 3), (10**6, 60 * MINUTE)])
def test_any_bucket_and_chunk_give_the_same_steps(spark, rows, monkeypatch, chunk, bucket):
    monkeypatch.setattr(funnels, "CHUNK", chunk)
    clicks = spark.createDataFrame(rows, SCHEMA)
    got = attempt_steps(clicks, FUNNELS, "client_id", "kind", "arrived_at", bucket=bucket).collect()
    want = Counter((f, c, n, w) for (f, c), steps in brute(rows).items() for n, waits in steps.items() for w in waits)
    assert Counter((r.funnel, r.client, r.step, r.wait) for r in got) == want
    assert len({(r.funnel, r.client, r.begun, r.step) for r in got}) == len(got)


def test_quantiles_look_into_the_right_bin(spark):
    rng = random.Random(2)
    waits = [("a", rng.randrange(1 << 20)) for _ in range(999)] + [("b", 5)] * 4 + [("c", 1 << 28), ("c", 0)]
    counted = pd.DataFrame(waits, columns=["key", "wait"]).groupby(["key", "wait"]).size().rename("n").reset_index()
    for percent in (1, 25, 50, 100):
        got = {r.key: r.quantile for r in funnels.nearest_rank(spark.createDataFrame(counted), ["key"], percent).collect()}
        for key in "abc":
            w = sorted(x for k, x in waits if k == key)
            assert got[key] == w[math.ceil(percent * len(w) / 100) - 1]


def test_zones_and_times_of_any_kind(spark):
    """Times without a zone don't depend on the session's, not even in an hour that it skips."""
    rows = [(1, "view", datetime.datetime(2024, 3, 31, 2, 30)), (1, "view", datetime.datetime(1969, 12, 31, 23, 59, 59, 5))]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        at = spark.createDataFrame(rows, "client_id long, kind string, arrived_at timestamp_ntz")
        got = sorted(r.m for r in at.select(funnels.micros(at, "arrived_at").alias("m")).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [-999_995, 1_711_852_200_000_000]


def test_nothing_gives_nothing(spark):
    clicks = spark.createDataFrame([(None, "view", START, "", 0, "", ""), (1, None, START, "", 0, "", ""), (1, "odd", START, "", 0, "", "")], SCHEMA)
    assert funnel_report(clicks, FUNNELS, "client_id", "kind", "arrived_at").collect() == []
    assert funnel_report(clicks.limit(0), FUNNELS, "client_id", "kind", "arrived_at").collect() == []
