"""What the near-duplicate stage moves: texts and arrays of the sets that need them, no others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import jaccard


def test_only_wanted_texts_are_moved(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("text_key"), "id")
    for wanted in (rows.filter("id % 400 = 0"), rows.filter("id < 0"), rows):
        left = {r.id for r in jaccard._perhaps(rows, wanted.select("text_key")).collect()}
        sought = {r.id for r in wanted.collect()}
        assert sought <= left and len(left - sought) < 2 * len(rows.take(20_000)) / jaccard.FILTER_BITS


def test_members_with_partners_are_all_that_may_be_linked():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 64, 400, np.uint64)
    sets = [np.unique(np.concatenate((base[: 400 - k], rng.integers(0, 1 << 64, k, np.uint64)))) for k in (0, 10, 30, 45, 60, 200, 400)]
    labels = np.array([0, 0, 1, 2, 3, 4, 5])
    sizes, maps = np.array(list(map(len, sets))), [jaccard.bitmap(s) for s in sets]
    found = set(jaccard._with_partners(sizes, maps, labels, 80, 100))
    linked = {x for i in range(7) for j in range(7) if labels[i] != labels[j] and jaccard.linked(sets[i], sets[j], 80, 100) for x in (i, j)}
    assert linked and linked <= found and not found & {5, 6}


def test_kept_texts_move_once(spark):
    rows = [(1, "a b c d e f g", "en", "web1", 13), (1, "a b c d e f g", "de", "web1", 13), (None, "a b c d e f g", "en", "web1", 13), (None, "q r s t u v w", "en", "web2", 13), (2, "", "en", "web1", 0), (2, "", "en", "web1", 0), (None, None, "en", "web1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
        plan = kept._jdf.queryExecution().executedPlan().toString().split("Union")[1]
        got = sorted(map(tuple, kept.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(") == 4  # two joins, of two sides each
    assert got == sorted([rows[1], rows[3], *rows[4:]], key=repr)
