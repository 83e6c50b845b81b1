"""Exact metric scores, caps, counts and grades.

Weights are integers (tenths) and verdicts halves, so every score is exact and
rounded half up by integer division. One aggregation by run and metric does it all;
the rubric side of the join is small and left to the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import exprs as E
from quillon.plans import views as V
from quillon.registry import query


def judged_checks(checks: DataFrame, findings: DataFrame) -> DataFrame:
    """Every active check of every run with its effective verdict; without a finding it is unknown."""
    runs = findings.select("run").distinct()
    active = checks.filter("NOT retired").crossJoin(runs)
    return active.join(findings, ["run", "check_id"], "left").withColumn("effective", F.coalesce(E.effective_verdict(F.col("verdict"), F.col("status")), F.lit("unknown")))


def score_metrics(checks: DataFrame, findings: DataFrame, gate_percent: int = 60) -> DataFrame:
    """(run, metric, status, tenths, coverage_1e4, n_checks, capped_by).

    Score over the scored weight, half up to tenths. Coverage under the gate is
    insufficient evidence; a critical fail caps at 4.0, else a critical partial at
    6.0, and either overrides the gate. With no applicable check: not_applicable.
    """
    return score_rows(judged_checks(checks, findings), gate_percent)


def score_rows(rows: DataFrame, gate_percent: int = 60) -> DataFrame:
    """``score_metrics`` of checks (run, check_id, metric, severity, w10, effective)."""
    eff, w, critical = F.col("effective"), F.col("w10"), F.col("severity") == "critical"
    scored = eff.isin("pass", "partial", "fail")
    sums = rows.groupBy("run", "metric").agg(
        F.sum(F.when(eff != "not_applicable", w).otherwise(0)).cast("long").alias("w"),
        F.sum(F.when(scored, w).otherwise(0)).cast("long").alias("sc"),
        F.sum(F.when(eff == "pass", 2 * w).when(eff == "partial", w).otherwise(0)).cast("long").alias("num2"),
        F.count("*").alias("n_checks"),
        F.array_sort(F.collect_list(F.when(critical & (eff == "fail"), F.col("check_id")))).alias("fails"),
        F.array_sort(F.collect_list(F.when(critical & (eff == "partial"), F.col("check_id")))).alias("partials"),
    )
    raw = F.when(F.col("sc") > 0, F.expr("(100 * num2 + sc) div (2 * sc)"))
    failed, halved = F.size("fails") > 0, F.size("partials") > 0
    status = F.when(F.col("w") == 0, "not_applicable").when(F.col("sc") == 0, "insufficient_evidence").when(failed | halved, "scored").when(F.col("sc") * 100 >= F.col("w") * gate_percent, "scored").otherwise("insufficient_evidence")
    capped = F.when(failed, F.least(raw, F.lit(40))).when(halved, F.least(raw, F.lit(60))).otherwise(raw)
    out = sums.withColumn("status", status).withColumn("tenths", F.when(F.col("status") == "scored", capped).cast("long"))
    by = F.when(failed, F.col("fails")).when(halved, F.col("partials"))
    return out.select("run", "metric", "status", "tenths", E.ratio_1e4(F.col("sc"), F.col("w")).alias("coverage_1e4"), F.col("n_checks").cast("long"), F.array_join(by, ",").alias("capped_by"))


_SCORES = """
WITH joined AS (
    SELECT r.run, c.check_id, c.metric, c.severity, c.w10,
           CASE WHEN f.status = 'verified' AND f.verdict IN ('pass', 'partial', 'fail', 'not_applicable') THEN f.verdict ELSE 'unknown' END AS eff
    FROM checks c CROSS JOIN (SELECT DISTINCT run FROM findings) r
    LEFT JOIN findings f ON f.run = r.run AND f.check_id = c.check_id WHERE NOT c.retired),
sums AS (
    SELECT run, metric, sum(CASE WHEN eff <> 'not_applicable' THEN w10 ELSE 0 END)::BIGINT AS w,
           sum(CASE WHEN eff IN ('pass', 'partial', 'fail') THEN w10 ELSE 0 END)::BIGINT AS sc,
           sum(CASE eff WHEN 'pass' THEN 2 * w10 WHEN 'partial' THEN w10 ELSE 0 END)::BIGINT AS num2, count(*) AS n_checks,
           count(*) FILTER (WHERE severity = 'critical' AND eff = 'fail') AS nf, count(*) FILTER (WHERE severity = 'critical' AND eff = 'partial') AS np,
           string_agg(check_id::VARCHAR, ',' ORDER BY check_id) FILTER (WHERE severity = 'critical' AND eff = 'fail') AS fails,
           string_agg(check_id::VARCHAR, ',' ORDER BY check_id) FILTER (WHERE severity = 'critical' AND eff = 'partial') AS partials
    FROM joined GROUP BY run, metric),
raws AS (SELECT *, CASE WHEN sc > 0 THEN (100 * num2 + sc) // (2 * sc) END AS raw FROM sums),
scores AS (
    SELECT run, metric, status, CASE WHEN status = 'scored' THEN CASE WHEN nf > 0 THEN least(raw, 40) WHEN np > 0 THEN least(raw, 60) ELSE raw END END::BIGINT AS tenths,
           CASE WHEN w <> 0 THEN (sc * 20000 + w) // (2 * w) END::BIGINT AS coverage_1e4, n_checks, CASE WHEN nf > 0 THEN fails WHEN np > 0 THEN partials END AS capped_by
    FROM (SELECT *, CASE WHEN w = 0 THEN 'not_applicable' WHEN sc = 0 THEN 'insufficient_evidence' WHEN nf + np > 0 THEN 'scored'
                         WHEN sc * 100 >= w * 60 THEN 'scored' ELSE 'insufficient_evidence' END AS status FROM raws))
"""


def _scores(spark, sf_dir):
    return score_metrics(V.checks(spark, sf_dir), V.findings(spark, sf_dir))


@query("score_metric", "checks findings", _SCORES + "SELECT run, metric, status, tenths, coverage_1e4, n_checks FROM scores")
def score_metric(spark, sf_dir):
    return _scores(spark, sf_dir).drop("capped_by")


@query("score_caps", "checks findings", _SCORES + "SELECT run, metric, tenths, capped_by FROM scores WHERE capped_by IS NOT NULL")
def score_caps(spark, sf_dir):
    return _scores(spark, sf_dir).filter("capped_by IS NOT NULL").select("run", "metric", "tenths", "capped_by")


@query("score_verdict_counts", "checks findings", _SCORES + """
SELECT run, metric, count(*) FILTER (WHERE eff = 'pass') AS n_pass, count(*) FILTER (WHERE eff = 'partial') AS n_partial, count(*) FILTER (WHERE eff = 'fail') AS n_fail,
       count(*) FILTER (WHERE eff = 'unknown') AS n_unknown, count(*) FILTER (WHERE eff = 'not_applicable') AS n_not_applicable FROM joined GROUP BY run, metric""")
def score_verdict_counts(spark, sf_dir):
    """Five fixed counts, zero-filled."""
    rows = judged_checks(V.checks(spark, sf_dir), V.findings(spark, sf_dir))
    return rows.groupBy("run", "metric").agg(*(F.count_if(F.col("effective") == v).alias(f"n_{v}") for v in E.VERDICTS))


def overall(scores: DataFrame, weights: Column | None = None, least: int = 5) -> DataFrame:
    """(run, n_scored, tenths, grade): the weighted mean of rounded metric scores; null under ``least`` scored metrics."""
    w = F.when(F.col("metric") < "Brand#2", 15).when(F.col("metric") < "Brand#3", 10).otherwise(8) if weights is None else weights
    s = scores.filter("status = 'scored'").withColumn("w", w)
    sums = s.groupBy("run").agg(F.count("*").alias("n_scored"), F.sum(F.col("w") * F.col("tenths")).alias("num"), F.sum("w").alias("den"))
    tenths = F.when((F.col("n_scored") >= least) & (F.col("den") > 0), F.expr("(2 * num + den) div (2 * den)")).cast("long")
    return sums.select("run", "n_scored", tenths.alias("tenths")).withColumn("grade", E.grade(F.col("tenths")))


@query("score_overall", "checks findings", _SCORES + """
, s AS (SELECT *, CASE WHEN metric < 'Brand#2' THEN 15 WHEN metric < 'Brand#3' THEN 10 ELSE 8 END AS w FROM scores WHERE status = 'scored'),
o AS (SELECT run, count(*) AS n_scored, CASE WHEN count(*) >= 5 AND sum(w) > 0 THEN (2 * sum(w * tenths) + sum(w)) // (2 * sum(w)) END::BIGINT AS tenths FROM s GROUP BY run)
SELECT *, CASE WHEN tenths >= 85 THEN 'A' WHEN tenths >= 70 THEN 'B' WHEN tenths >= 55 THEN 'C' WHEN tenths >= 40 THEN 'D' WHEN tenths IS NOT NULL THEN 'E' END AS grade FROM o""")
def score_overall(spark, sf_dir):
    return overall(_scores(spark, sf_dir))


@query("score_dup_guard", "judged", "SELECT run, check_id, count(*) AS n FROM judged GROUP BY run, check_id HAVING count(*) > 1")
def score_dup_guard(spark, sf_dir):
    """Runs and checks with more than one finding before they are merged."""
    return V._judged(spark, sf_dir).groupBy("run", "check_id").agg(F.count("*").alias("n")).filter("n > 1")


@query("fn_grade", "", """SELECT p_partkey AS id, CASE WHEN t >= 85 THEN 'A' WHEN t >= 70 THEN 'B' WHEN t >= 55 THEN 'C' WHEN t >= 40 THEN 'D' WHEN t IS NOT NULL THEN 'E' END AS grade
FROM (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_partkey % 101 END AS t FROM part)""")
def fn_grade(spark, sf_dir):
    t = F.when(F.col("p_size") % 7 != 0, F.col("p_partkey") % 101)
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), E.grade(t).alias("grade"))


@query("fn_round_half_up", "", "SELECT o_orderkey AS id, round((o_orderkey % 1000 * 0.01)::DECIMAL(12, 2), 1)::VARCHAR AS tenths FROM orders")
def fn_round_half_up(spark, sf_dir):
    value = (F.col("o_orderkey") % 1000).cast("decimal(10,0)") * F.lit("0.01").cast("decimal(3,2)")
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(value.cast("decimal(12,2)"), 1).cast("string").alias("tenths"))
