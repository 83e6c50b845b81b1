"""Cost summaries, call prices, projections, and the five run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans import views as V
from quillon.registry import query


def cost_summary(calls: DataFrame) -> DataFrame:
    """(level, stage, metric, calls, cost_micro, tokens): total, by stage and by metric in one pass of grouping sets; calls without a metric count in the total and their stage only."""
    calls.createOrReplaceTempView("quillon_calls")
    rows = calls.sparkSession.sql("""
        SELECT grouping_id(stage, metric) AS gid, stage, metric, count(*) AS calls, sum(cost_micro) AS cost_micro, sum(tokens_in + tokens_out) AS tokens
        FROM quillon_calls GROUP BY GROUPING SETS ((stage), (metric), ())""")
    level = F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "stage").otherwise("metric")
    return rows.select(level.alias("level"), "stage", "metric", "calls", "cost_micro", "tokens").filter("level <> 'metric' OR metric IS NOT NULL")


@query("agg_cost_summary", "llm_calls", """SELECT 'total' AS level, NULL::VARCHAR AS stage, NULL::INTEGER AS metric, count(*) AS calls, sum(cost_micro)::BIGINT AS cost_micro, sum(tokens_in + tokens_out)::BIGINT AS tokens FROM llm_calls
UNION ALL SELECT 'stage', stage, NULL, count(*), sum(cost_micro)::BIGINT, sum(tokens_in + tokens_out)::BIGINT FROM llm_calls GROUP BY stage
UNION ALL SELECT 'metric', NULL, metric, count(*), sum(cost_micro)::BIGINT, sum(tokens_in + tokens_out)::BIGINT FROM llm_calls WHERE metric IS NOT NULL GROUP BY metric""")
def agg_cost_summary(spark, sf_dir):
    return cost_summary(V.llm_calls(spark, sf_dir))


def call_cost(tokens_in: Column, cached: Column, out: Column, prices: tuple[int, int, int]) -> Column:
    """Nano-units: uncached, cached and output tokens at prices a token."""
    return (tokens_in - cached) * prices[0] + cached * prices[1] + out * prices[2]


@query("agg_call_cost", "llm_calls", "SELECT stage, sum((tokens_in - tokens_cached) * 250 + tokens_cached * 25 + tokens_out * 2000)::BIGINT AS nano FROM llm_calls GROUP BY stage")
def agg_call_cost(spark, sf_dir):
    return V.llm_calls(spark, sf_dir).groupBy("stage").agg(F.sum(call_cost(F.col("tokens_in"), F.col("tokens_cached"), F.col("tokens_out"), (250, 25, 2000))).alias("nano"))


@query("agg_projected_cost", "checks", "SELECT metric, (n * 3000 + c * 1000 + (n + 4) // 5 * 700)::BIGINT AS projected FROM (SELECT metric, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS c FROM checks WHERE NOT retired GROUP BY 1)")
def agg_projected_cost(spark, sf_dir):
    """Sessions, a third skeptic session a critical check, and entailment batches of five."""
    n, c = F.count("*"), F.count_if(F.col("severity") == "critical")
    return V.checks(spark, sf_dir).filter("NOT retired").groupBy("metric").agg((n * 3000 + c * 1000 + F.floor((n + 4) / 5) * 700).cast("long").alias("projected"))


@query("kql_cost_per_run", "llm_calls", """WITH runs AS (SELECT unnest(range(0, 10))::INTEGER AS run)
SELECT r.run, coalesce(calls, 0)::BIGINT AS calls, coalesce(hits, 0)::BIGINT AS hits, coalesce(cost, 0)::BIGINT AS cost_micro, coalesce(tok, 0)::BIGINT AS tokens FROM runs r
LEFT JOIN (SELECT run, count(*) AS calls, count(*) FILTER (WHERE cache_hit) AS hits, sum(cost_micro) AS cost, sum(tokens_in) AS tok FROM llm_calls WHERE day >= DATE '2024-01-02' GROUP BY 1) c ON c.run = r.run""")
def kql_cost_per_run(spark, sf_dir):
    calls = V.llm_calls(spark, sf_dir).filter("ts >= TIMESTAMP '2024-01-02'").groupBy("run").agg(F.count("*").alias("calls"), F.count_if("cache_hit").alias("hits"), F.sum("cost_micro").alias("cost_micro"), F.sum("tokens_in").alias("tokens"))
    runs = spark.range(10).select(F.col("id").cast("int").alias("run"))
    return runs.join(calls, "run", "left").select("run", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "hits", "cost_micro", "tokens")))


@query("kql_cost_per_metric", "llm_calls", """SELECT c.metric, c.cost_micro, t.fresh, t.cached, t.output FROM (SELECT metric, sum(cost_micro)::BIGINT AS cost_micro FROM llm_calls WHERE metric IS NOT NULL GROUP BY 1) c
LEFT JOIN (SELECT metric, sum(tokens_in - tokens_cached)::BIGINT AS fresh, sum(tokens_cached)::BIGINT AS cached, sum(tokens_out)::BIGINT AS output FROM llm_calls GROUP BY 1) t ON t.metric = c.metric""")
def kql_cost_per_metric(spark, sf_dir):
    """Cost beside tokens pivoted by kind; both sides share one partitioning on metric."""
    calls = V.llm_calls(spark, sf_dir).filter("metric IS NOT NULL")
    cost = calls.groupBy("metric").agg(F.sum("cost_micro").alias("cost_micro"))
    kinds = F.create_map(F.lit("fresh"), F.col("tokens_in") - F.col("tokens_cached"), F.lit("cached"), F.col("tokens_cached"), F.lit("output"), F.col("tokens_out"))
    tokens = calls.select("metric", F.explode(kinds).alias("kind", "n")).groupBy("metric").pivot("kind", ["fresh", "cached", "output"]).sum("n")
    return cost.join(tokens, "metric", "left")


@query("kql_verdict_mix", "checks findings", "SELECT c.metric, count(*) FILTER (WHERE verdict = 'pass') AS pass, count(*) FILTER (WHERE verdict = 'partial') AS partial, count(*) FILTER (WHERE verdict = 'fail') AS fail, count(*) FILTER (WHERE verdict = 'unknown') AS unknown FROM findings f JOIN checks c ON c.check_id = f.check_id GROUP BY 1")
def kql_verdict_mix(spark, sf_dir):
    values = ["pass", "partial", "fail", "unknown"]
    rows = V.findings(spark, sf_dir).join(V.checks(spark, sf_dir).select("check_id", "metric"), "check_id")
    mix = rows.groupBy("metric").pivot("verdict", values).agg(F.count(F.lit(1)))
    return mix.select("metric", *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


@query("kql_verifier_outcomes", "findings", "SELECT path_no % 4 AS step, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'unverified') AS unverified FROM findings GROUP BY 1")
def kql_verifier_outcomes(spark, sf_dir):
    out = V.findings(spark, sf_dir).groupBy((F.col("path_no") % 4).alias("step")).pivot("status", ["verified", "unverified"]).agg(F.count(F.lit(1)))
    return out.select("step", *(F.coalesce(v, F.lit(0)).alias(v) for v in ("verified", "unverified")))


@query("kql_run_timeline", "llm_calls", """WITH last AS (SELECT run FROM llm_calls ORDER BY ts DESC, id DESC LIMIT 1)
SELECT id, stage, latency_ms, row_number() OVER (ORDER BY ts, id)::INTEGER AS step FROM llm_calls WHERE run = (SELECT run FROM last)""")
def kql_run_timeline(spark, sf_dir):
    """The calls of the latest run, in order."""
    calls = V.llm_calls(spark, sf_dir)
    last = calls.orderBy(F.desc("ts"), F.desc("id")).limit(1).select("run")
    mine = calls.join(F.broadcast(last), "run")
    return mine.select("id", "stage", "latency_ms", F.row_number().over(Window.partitionBy("run").orderBy("ts", "id")).alias("step"))
