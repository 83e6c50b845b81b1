"""Merging repeated judgements, and routing results through verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans import views as V
from quillon.registry import query

_USABLE = ("pass", "partial", "fail", "not_applicable")
_ISSUES = ("partial", "fail")


def _votes(attempts: DataFrame) -> DataFrame:
    """One row a check with its counts by verdict; no window, so attempts are combined before the shuffle."""
    usable = F.col("verdict").isin(*_USABLE)
    return attempts.groupBy("run", "check_id").agg(F.count("*").alias("n"), F.count_if(usable).alias("usable"), *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in _USABLE), F.count_if(F.col("verdict").isin(*_ISSUES)).alias("issues"))


def _majority(n: str = "usable") -> Column:
    out = F.lit(None).cast("string")
    for v in _USABLE:
        out = F.when(F.col(f"n_{v}") * 2 > F.col(n), v).otherwise(out)
    return out


_VOTES = """WITH votes AS (SELECT run, check_id, count(*) AS n, count(*) FILTER (WHERE verdict <> 'unknown') AS usable, count(*) FILTER (WHERE verdict IN ('partial', 'fail')) AS issues,
    CASE WHEN 2 * count(*) FILTER (WHERE verdict = 'pass') > count(*) FILTER (WHERE verdict <> 'unknown') THEN 'pass' WHEN 2 * count(*) FILTER (WHERE verdict = 'partial') > count(*) FILTER (WHERE verdict <> 'unknown') THEN 'partial'
         WHEN 2 * count(*) FILTER (WHERE verdict = 'fail') > count(*) FILTER (WHERE verdict <> 'unknown') THEN 'fail' WHEN 2 * count(*) FILTER (WHERE verdict = 'not_applicable') > count(*) FILTER (WHERE verdict <> 'unknown') THEN 'not_applicable' END AS majority
    FROM attempts GROUP BY run, check_id)
"""


@query("vote_majority", "attempts", _VOTES + "SELECT run, check_id, majority FROM votes WHERE majority IS NOT NULL")
def vote_majority(spark, sf_dir):
    return _votes(V.attempts(spark, sf_dir)).select("run", "check_id", _majority().alias("majority")).filter("majority IS NOT NULL")


@query("vote_undecided", "attempts", _VOTES + "SELECT run, check_id, usable FROM votes WHERE usable >= 2 AND majority IS NULL")
def vote_undecided(spark, sf_dir):
    """At least two usable judgements without a strict majority."""
    return _votes(V.attempts(spark, sf_dir)).withColumn("m", _majority()).filter("usable >= 2 AND m IS NULL").select("run", "check_id", "usable")


def merge_attempts(attempts: DataFrame) -> DataFrame:
    """(run, check_id, verdict, confidence, claim): the majority's first judgement; else, where issues have the majority, the last issue at low confidence; else unknown with all claims."""
    a = F.struct("attempt", "verdict", "confidence", "claim")
    votes = attempts.groupBy("run", "check_id").agg(
        F.count_if(F.col("verdict") != "unknown").alias("usable"), *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in _USABLE), F.count_if(F.col("verdict").isin(*_ISSUES)).alias("issues"),
        *(F.min(F.when(F.col("verdict") == v, a)).alias(f"first_{v}") for v in _USABLE), F.max(F.when(F.col("verdict").isin(*_ISSUES), a)).alias("last_issue"), F.array_sort(F.collect_list(F.struct("attempt", "claim"))).alias("claims"),
    ).withColumn("majority", _majority())
    first = F.coalesce(*(F.when(F.col("majority") == v, F.col(f"first_{v}")) for v in _USABLE))
    by_issue = (F.col("majority").isNull()) & (F.col("issues") * 2 > F.col("usable"))
    demoted = F.when(F.size("claims") > F.col("usable"), "low").otherwise(first["confidence"])
    return votes.select(
        "run", "check_id", F.when(F.col("majority").isNotNull(), F.col("majority")).when(by_issue, F.col("last_issue.verdict")).otherwise("unknown").alias("verdict"),
        F.when(F.col("majority").isNotNull(), demoted).otherwise("low").alias("confidence"),
        F.when(F.col("majority").isNotNull(), first["claim"]).when(by_issue, F.col("last_issue.claim")).otherwise(F.array_join(F.transform("claims", lambda c: c["claim"]), "; ")).alias("claim"),
    )


@query("vote_merge", "attempts", _VOTES + """
, firsts AS (SELECT a.*, row_number() OVER (PARTITION BY a.run, a.check_id, a.verdict ORDER BY attempt) AS rn FROM attempts a),
lasts AS (SELECT *, row_number() OVER (PARTITION BY run, check_id ORDER BY attempt DESC) AS rn FROM attempts WHERE verdict IN ('partial', 'fail')),
claims AS (SELECT run, check_id, string_agg(claim, '; ' ORDER BY attempt) AS claims FROM attempts GROUP BY 1, 2)
SELECT v.run, v.check_id, CASE WHEN majority IS NOT NULL THEN majority WHEN issues * 2 > usable THEN l.verdict ELSE 'unknown' END AS verdict,
    CASE WHEN majority IS NULL OR n > usable THEN 'low' ELSE f.confidence END AS confidence,
    CASE WHEN majority IS NOT NULL THEN f.claim WHEN issues * 2 > usable THEN l.claim ELSE c.claims END AS claim
FROM votes v LEFT JOIN firsts f ON f.run = v.run AND f.check_id = v.check_id AND f.verdict = v.majority AND f.rn = 1 LEFT JOIN lasts l ON l.run = v.run AND l.check_id = v.check_id AND l.rn = 1
JOIN claims c ON c.run = v.run AND c.check_id = v.check_id""")
def vote_merge(spark, sf_dir):
    return merge_attempts(V.attempts(spark, sf_dir))


def postprocess(checks: DataFrame, results: DataFrame) -> DataFrame:
    """One row a check of every run: its first result, or unknown when missing, not allowed, or without evidence; changed rows get low confidence."""
    first = results.groupBy("run", "check_id").agg(F.min(F.struct("attempt", "verdict", "confidence", "claim")).alias("x"))
    rows = checks.crossJoin(F.broadcast(results.select("run").distinct())).join(first, ["run", "check_id"], "left")
    verdict = F.col("x.verdict")
    reason = F.when(verdict.isNull(), "missing").when((verdict == "not_applicable") & ~F.col("na_allowed"), "na_not_allowed").when(verdict.isin("pass", "partial", "fail") & F.col("no_evidence"), "no_evidence")
    return rows.select("run", "check_id", F.when(reason.isNotNull(), "unknown").otherwise(verdict).alias("verdict"), F.when(reason.isNotNull(), "low").otherwise(F.col("x.confidence")).alias("confidence"), reason.alias("reason"))


@query("ver_postprocess", "checks attempts", """, f AS (SELECT * FROM attempts WHERE attempt = 1 AND check_id % 5 <> 0),
j AS (SELECT r.run, c.check_id, f.verdict, f.confidence, CASE WHEN f.verdict IS NULL THEN 'missing' WHEN f.verdict = 'not_applicable' AND c.severity = 'high' THEN 'na_not_allowed' WHEN f.verdict IN ('pass', 'partial', 'fail') AND c.check_id % 7 = 0 THEN 'no_evidence' END AS reason
    FROM checks c CROSS JOIN (SELECT DISTINCT run FROM f) r LEFT JOIN f ON f.run = r.run AND f.check_id = c.check_id)
SELECT run, check_id, CASE WHEN reason IS NOT NULL THEN 'unknown' ELSE verdict END AS verdict, CASE WHEN reason IS NOT NULL THEN 'low' ELSE confidence END AS confidence, reason FROM j""".replace(", f AS", "WITH f AS", 1))
def ver_postprocess(spark, sf_dir):
    checks = V.checks(spark, sf_dir).select("check_id", (F.col("severity") != "high").alias("na_allowed"), (F.col("check_id") % 7 == 0).alias("no_evidence"))
    return postprocess(checks, V.attempts(spark, sf_dir).filter("check_id % 5 <> 0"))


def mechanical(citations: DataFrame, files: DataFrame, seen: DataFrame, span: int = 60) -> DataFrame:
    """(result, ok): all citations of a result name a readable file, lie in it, are short, and were seen line by line."""
    at = citations.join(files, "path", "left")
    inside = F.col("n_lines").isNotNull() & (F.col("start") >= 1) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("n_lines")) & (F.col("end") - F.col("start") < span)
    good = at.withColumn("inside", F.coalesce(inside, F.lit(False)))
    wanted = good.filter("inside").withColumn("line", F.explode(F.sequence("start", "end")))
    unseen = wanted.join(seen, ["session", "path", "line"], "left_anti").select("result").distinct().withColumn("unseen", F.lit(True))
    return good.groupBy("result").agg(F.bool_and("inside").alias("inside")).join(unseen, "result", "left").select("result", (F.col("inside") & F.col("unseen").isNull()).alias("ok"))


@query("ver_mechanical", "", """WITH f AS (SELECT conv_id AS path, count(*) AS n_lines FROM conversations GROUP BY 1),
c AS (SELECT o_orderkey AS result, o_custkey % 150 AS path, o_orderkey % 4 AS s, o_orderkey % 4 + o_custkey % 3 AS e FROM orders),
seen AS (SELECT conv_id AS path, turn + 1 AS line FROM conversations WHERE (conv_id + turn) % 9 <> 0)
SELECT result, coalesce(n_lines IS NOT NULL AND s >= 1 AND s <= e AND e <= n_lines, false) AND NOT EXISTS (
    SELECT 1 FROM (SELECT unnest(range(s, e + 1)) AS line) x WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.path = c.path AND seen.line = x.line)) AS ok
FROM c LEFT JOIN f ON f.path = c.path""")
def ver_mechanical(spark, sf_dir):
    talk = V.table(spark, sf_dir, "conversations")
    files = talk.groupBy(F.col("conv_id").alias("path")).agg(F.count("*").alias("n_lines"))
    seen = talk.filter("(conv_id + turn) % 9 <> 0").select(F.lit(1).alias("session"), F.col("conv_id").alias("path"), (F.col("turn") + 1).alias("line"))
    o = V.table(spark, sf_dir, "orders")
    start = F.col("o_orderkey") % 4
    cites = o.select(F.lit(1).alias("session"), F.col("o_orderkey").alias("result"), (F.col("o_custkey") % 150).alias("path"), start.alias("start"), (start + F.col("o_custkey") % 3).alias("end"))
    return mechanical(cites, files, seen)


def route(origin: Column, verdict: Column, citations: Column, policy: Column, answer: Column, refuted: Column, critical: Column) -> Column:
    """The verification status of a result, by the decision table of its origin, evidence and answers."""
    entailed = F.when(answer == "supported", "verified").when(answer == "unsupported", "rejected").otherwise("unverified")
    llm = F.when(verdict == "unknown", "unverified").when((verdict == "not_applicable") | ((citations == 0) & (policy == "absence")), F.when(answer == "absent", "verified").otherwise("unverified")).when(citations == 0, "rejected").otherwise(entailed)
    base = F.when(origin == "deterministic", "verified").otherwise(llm)
    return F.when((origin == "llm") & (base == "verified") & critical & (verdict == "fail") & refuted, "disputed").otherwise(base)


_ROUTE_INPUT = """SELECT run, f.check_id, CASE WHEN f.check_id % 3 = 0 THEN 'deterministic' ELSE 'llm' END AS origin, verdict, start_line % 4 AS cites, CASE WHEN path_no % 5 = 0 THEN 'absence' ELSE 'cited' END AS policy,
    CASE path_no % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'absent' ELSE 'unclear' END AS answer, start_line % 2 = 0 AS refuted, severity IN ('critical', 'high') AS critical FROM findings f JOIN checks c ON c.check_id = f.check_id"""


@query("ver_routing", "checks findings", f"""WITH i AS ({_ROUTE_INPUT}),
b AS (SELECT *, CASE WHEN origin = 'deterministic' THEN 'verified' WHEN verdict = 'unknown' THEN 'unverified' WHEN verdict = 'not_applicable' OR (cites = 0 AND policy = 'absence') THEN CASE WHEN answer = 'absent' THEN 'verified' ELSE 'unverified' END
    WHEN cites = 0 THEN 'rejected' WHEN answer = 'supported' THEN 'verified' WHEN answer = 'unsupported' THEN 'rejected' ELSE 'unverified' END AS base FROM i)
SELECT run, check_id, CASE WHEN origin = 'llm' AND base = 'verified' AND critical AND verdict = 'fail' AND refuted THEN 'disputed' ELSE base END AS status FROM b""")
def ver_routing(spark, sf_dir):
    rows = V.findings(spark, sf_dir).join(V.checks(spark, sf_dir).select("check_id", "severity"), "check_id")
    p = F.col("path_no")
    answer = F.when(p % 4 == 0, "supported").when(p % 4 == 1, "unsupported").when(p % 4 == 2, "absent").otherwise("unclear")
    status = route(F.when(F.col("check_id") % 3 == 0, "deterministic").otherwise("llm"), F.col("verdict"), F.col("start_line") % 4, F.when(p % 5 == 0, "absence").otherwise("cited"), answer, F.col("start_line") % 2 == 0, F.col("severity").isin("critical", "high"))
    return rows.select("run", "check_id", status.alias("status"))


@query("win_batches", "checks findings", """SELECT run, metric, check_id, ((row_number() OVER (PARTITION BY run, metric ORDER BY check_id) - 1) // 5)::INTEGER AS batch
FROM (SELECT f.run, c.metric, f.check_id FROM findings f JOIN checks c ON c.check_id = f.check_id WHERE f.verdict IN ('fail', 'partial'))""")
def win_batches(spark, sf_dir):
    """Batches of five in each run and metric."""
    rows = V.findings(spark, sf_dir).filter("verdict IN ('fail', 'partial')").join(V.checks(spark, sf_dir).select("check_id", "metric"), "check_id")
    n = F.row_number().over(Window.partitionBy("run", "metric").orderBy("check_id"))
    return rows.select("run", "metric", "check_id", F.floor((n - 1) / 5).cast("int").alias("batch"))


def running_budget(calls: DataFrame, key: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Which calls of each key still start: what was spent before is under the budget."""
    before = F.coalesce(F.sum(cost).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return calls.withColumn("spent_before", before.cast("long")).withColumn("runs", F.col("spent_before") < budget)


@query("win_running_budget", "llm_calls", "SELECT id, spent_before, spent_before < 100000 AS runs FROM (SELECT id, coalesce(sum(cost_micro) OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM llm_calls)")
def win_running_budget(spark, sf_dir):
    return running_budget(V.llm_calls(spark, sf_dir), "user_id", ["ts", "id"], "cost_micro", 100000).select("id", "spent_before", "runs")
