"""Evaluation metrics over many runs: recall, spillover, precision, stability, injections. Ratios are integers in ten-thousandths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import exprs as E
from quillon.operators.joins import count_overlaps
from quillon.plans import views as V
from quillon.registry import query


def detected(expected: Column, verdict: Column) -> Column:
    """A missing verdict is not; an expected partial is also met by a fail."""
    return F.coalesce((verdict == expected) | ((expected == "partial") & (verdict == "fail")), F.lit(False))


def recall(expected: DataFrame, findings: DataFrame, changed: DataFrame) -> DataFrame:
    """(run, n, detected_1e4, located_1e4) of (run, check_id, expected) rows; located needs evidence in a changed range."""
    where = findings.select("run", "check_id", "path", "start", "end")
    located = count_overlaps(where, changed).select("run", "check_id").distinct().withColumn("hit", F.lit(True))
    rows = expected.join(findings.select("run", "check_id", "verdict"), ["run", "check_id"], "left").join(located, ["run", "check_id"], "left")
    found = detected(F.col("expected"), F.col("verdict"))
    sums = rows.groupBy("run").agg(F.count("*").alias("n"), F.count_if(found).alias("d"), F.count_if(found & F.coalesce("hit", F.lit(False))).alias("l"))
    return sums.select("run", "n", E.ratio_1e4(F.col("d"), F.col("n")).alias("detected"), E.ratio_1e4(F.col("l"), F.col("n")).alias("located"))


@query("eval_recall", "findings", """WITH x AS (SELECT r.run, p_partkey AS check_id, CASE WHEN p_partkey % 2 = 0 THEN 'fail' ELSE 'partial' END AS expected FROM part CROSS JOIN (SELECT DISTINCT run FROM findings) r),
c AS (SELECT o_orderkey % 50 AS path, o_custkey % 97 + 1 AS s, o_custkey % 97 + 1 + o_orderkey % 30 AS e FROM orders),
j AS (SELECT x.run, coalesce(f.verdict = x.expected OR (x.expected = 'partial' AND f.verdict = 'fail'), false) AS d, EXISTS (SELECT 1 FROM c WHERE c.path = f.path_no AND c.s <= f.start_line + 10 AND f.start_line <= c.e) AS l
    FROM x LEFT JOIN findings f ON f.run = x.run AND f.check_id = x.check_id)
SELECT run, count(*) AS n, (count(*) FILTER (WHERE d) * 20000 + count(*)) // (2 * count(*)) AS detected, (count(*) FILTER (WHERE d AND l) * 20000 + count(*)) // (2 * count(*)) AS located FROM j GROUP BY run""")
def eval_recall(spark, sf_dir):
    f = V.findings(spark, sf_dir)
    runs = f.select("run").distinct()
    expected = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("check_id"), F.when(F.col("p_partkey") % 2 == 0, "fail").otherwise("partial").alias("expected")).crossJoin(F.broadcast(runs))
    start = F.col("o_custkey") % 97 + 1
    changed = V.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("path"), start.alias("start"), (start + F.col("o_orderkey") % 30).alias("end"))
    rows = f.select("run", "check_id", "verdict", F.col("path_no").cast("long").alias("path"), F.col("start_line").cast("long").alias("start"), (F.col("start_line") + 10).cast("long").alias("end"))
    return recall(expected, rows, changed)


def flips(findings: DataFrame, base: int) -> DataFrame:
    """(run, n, flipped) against the base run over the union of checks, null-safely."""
    b = findings.filter(F.col("run") == base).select("check_id", F.col("verdict").alias("base"), F.lit(True).alias("in_base"))
    others = findings.filter(F.col("run") != base).select("run").distinct()
    left = b.crossJoin(F.broadcast(others))
    both = left.join(findings.filter(F.col("run") != base).select("run", "check_id", "verdict"), ["run", "check_id"], "full")
    return both.groupBy("run").agg(F.count("*").alias("n"), F.count_if(~F.col("base").eqNullSafe(F.col("verdict"))).alias("flipped"))


@query("eval_spillover", "findings", """WITH o AS (SELECT DISTINCT run FROM findings WHERE run <> 0), keys AS (SELECT o.run, f.check_id FROM o CROSS JOIN (SELECT check_id FROM findings WHERE run = 0) f UNION SELECT run, check_id FROM findings WHERE run <> 0),
x AS (SELECT k.run, count(*) AS n, count(*) FILTER (WHERE b.verdict IS DISTINCT FROM v.verdict) AS flipped FROM keys k LEFT JOIN findings b ON b.run = 0 AND b.check_id = k.check_id LEFT JOIN findings v ON v.run = k.run AND v.check_id = k.check_id GROUP BY 1)
SELECT (sum(CASE WHEN run > 2 THEN flipped ELSE 0 END) * 20000 + sum(CASE WHEN run > 2 THEN n ELSE 0 END))::BIGINT // (2 * sum(CASE WHEN run > 2 THEN n ELSE 0 END))::BIGINT AS variant_1e4,
       (sum(CASE WHEN run <= 2 THEN flipped ELSE 0 END) * 20000 + sum(CASE WHEN run <= 2 THEN n ELSE 0 END))::BIGINT // (2 * sum(CASE WHEN run <= 2 THEN n ELSE 0 END))::BIGINT AS base_1e4 FROM x""")
def eval_spillover(spark, sf_dir):
    """Flip rates of variants (runs 3 and 4) and among base runs (1 and 2), against base run 0."""
    x = flips(V.findings(spark, sf_dir), 0)
    part = lambda c, v: F.sum(F.when((F.col("run") > 2) == v, F.col(c)).otherwise(0))
    return x.agg(*(part(c, v).cast("long").alias(f"{c}_{v}") for c in ("n", "flipped") for v in (True, False))).select(E.ratio_1e4(F.col("flipped_True"), F.col("n_True")).alias("variant_1e4"), E.ratio_1e4(F.col("flipped_False"), F.col("n_False")).alias("base_1e4"))


@query("eval_labeled", "", """WITH p AS (SELECT l.doc_id, quality = 1 AS truth, length(text) > 1200 AS guess FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT count(*) AS n, (count(*) FILTER (WHERE guess AND truth) * 20000 + count(*) FILTER (WHERE guess)) // (2 * count(*) FILTER (WHERE guess)) AS precision_1e4, (count(*) FILTER (WHERE guess = truth) * 20000 + count(*)) // (2 * count(*)) AS accuracy_1e4 FROM p""")
def eval_labeled(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", (F.length("text") > 1200).alias("guess"))
    p = V.table(spark, sf_dir, "labels").join(docs, "doc_id").select((F.col("quality") == 1).alias("truth"), "guess")
    sums = p.agg(F.count("*").alias("n"), F.count_if("guess").alias("g"), F.count_if(F.col("guess") & F.col("truth")).alias("tp"), F.count_if(F.col("guess") == F.col("truth")).alias("eq"))
    return sums.select("n", E.ratio_1e4(F.col("tp"), F.col("g")).alias("precision_1e4"), E.ratio_1e4(F.col("eq"), F.col("n")).alias("accuracy_1e4"))


@query("eval_mech_rate", "findings", "SELECT run, (sum(CASE WHEN status = 'verified' THEN c ELSE 0 END) * 20000 + sum(c))::BIGINT // (2 * sum(c))::BIGINT AS rate_1e4 FROM (SELECT run, status, start_line % 4 AS c FROM findings WHERE check_id % 3 <> 0) GROUP BY run")
def eval_mech_rate(spark, sf_dir):
    """Citations of results that passed the mechanical check, of all model citations."""
    rows = V.findings(spark, sf_dir).filter("check_id % 3 <> 0").withColumn("c", F.col("start_line") % 4)
    sums = rows.groupBy("run").agg(F.sum(F.when(F.col("status") == "verified", F.col("c")).otherwise(0)).alias("p"), F.sum("c").alias("q"))
    return sums.select("run", E.ratio_1e4(F.col("p"), F.col("q")).alias("rate_1e4"))


@query("eval_stability", "findings", """WITH n AS (SELECT count(DISTINCT run) AS n FROM findings), agree AS (SELECT check_id, count(DISTINCT coalesce(verdict, '?')) = 1 AS same FROM findings GROUP BY check_id HAVING count(*) = (SELECT n FROM n))
SELECT count(*) AS n_checks, (count(*) FILTER (WHERE same) * 20000 + count(*)) // (2 * count(*)) AS agreement_1e4 FROM agree""")
def eval_stability(spark, sf_dir):
    """Agreement over the checks that every run has."""
    f = V.findings(spark, sf_dir)
    runs = f.agg(F.count_distinct("run").alias("runs"))
    each = f.groupBy("check_id").agg(F.count("*").alias("n"), (F.count_distinct(F.coalesce("verdict", F.lit("?"))) == 1).alias("same")).crossJoin(F.broadcast(runs)).filter("n = runs")
    return each.agg(F.count("*").alias("n_checks"), F.count_if("same").alias("s")).select("n_checks", E.ratio_1e4(F.col("s"), F.col("n_checks")).alias("agreement_1e4"))


def outside(scores: DataFrame, base_runs: Column) -> DataFrame:
    """(run, delta): how far the worst metric of each other run lies outside the range of the base runs."""
    span = scores.filter(base_runs).groupBy("metric").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    gap = F.greatest(F.lit(0), F.col("score") - F.col("hi"), F.col("lo") - F.col("score"))
    return scores.filter(~base_runs).join(span, "metric").groupBy("run").agg(F.max(gap).cast("long").alias("delta"))


@query("eval_injection", "checks findings", """WITH s AS (SELECT f.run, c.metric, count(*) FILTER (WHERE verdict = 'pass')::BIGINT AS score FROM findings f JOIN checks c ON c.check_id = f.check_id GROUP BY 1, 2),
b AS (SELECT metric, min(score) AS lo, max(score) AS hi FROM s WHERE run < 3 GROUP BY 1) SELECT run, max(greatest(0, score - hi, lo - score))::BIGINT AS delta FROM s JOIN b ON b.metric = s.metric WHERE run >= 3 GROUP BY 1""")
def eval_injection(spark, sf_dir):
    scores = V.findings(spark, sf_dir).join(V.checks(spark, sf_dir).select("check_id", "metric"), "check_id").groupBy("run", "metric").agg(F.count_if(F.col("verdict") == "pass").alias("score"))
    return outside(scores, F.col("run") < 3)


@query("eval_summary", "llm_calls", """SELECT count(*) AS runs, (sum(cost) // count(*))::BIGINT AS mean_cost, (sum(ms) // count(*))::BIGINT AS mean_ms, sum(tin)::BIGINT AS tokens_in, sum(tout)::BIGINT AS tokens_out
FROM (SELECT run, sum(cost_micro)::BIGINT AS cost, sum(latency_ms)::BIGINT AS ms, sum(tokens_in)::BIGINT AS tin, sum(tokens_out)::BIGINT AS tout FROM llm_calls GROUP BY run)""")
def eval_summary(spark, sf_dir):
    per = V.llm_calls(spark, sf_dir).groupBy("run").agg(F.sum("cost_micro").alias("cost"), F.sum("latency_ms").alias("ms"), F.sum("tokens_in").alias("tin"), F.sum("tokens_out").alias("tout"))
    return per.agg(F.count("*").alias("runs"), F.expr("sum(cost) div count(*)").alias("mean_cost"), F.expr("sum(ms) div count(*)").alias("mean_ms"), F.sum("tin").alias("tokens_in"), F.sum("tout").alias("tokens_out"))
