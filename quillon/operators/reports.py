"""Report rows: SARIF results, the diff of two reports, and guards on generated text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import exprs as E
from quillon.plans import views as V
from quillon.registry import query


def sarif_results(findings: DataFrame) -> DataFrame:
    """(run, rule_id, level, fingerprint) of issues; the level is by severity, one lower for a partial."""
    rank = E.severity_rank(F.col("severity")) - F.when(F.col("verdict") == "partial", 1).otherwise(0)
    level = F.when(rank >= 3, "error").when(rank >= 2, "warning").otherwise("note")
    print_ = F.substring(F.sha2(F.concat_ws("|", F.col("check_id").cast("string"), F.col("path"), F.col("snippet_sha")), 256), 1, 32)
    return findings.filter("verdict IN ('fail', 'partial') AND path IS NOT NULL").select("run", F.col("check_id").alias("rule_id"), level.alias("level"), print_.alias("fingerprint"))


@query("rep_sarif_results", "checks findings", """SELECT run, check_id AS rule_id, CASE WHEN r >= 3 THEN 'error' WHEN r >= 2 THEN 'warning' ELSE 'note' END AS level, substr(sha256(check_id || '|p' || path_no || '|' || start_line), 1, 32) AS fingerprint
FROM (SELECT f.*, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END - CASE WHEN verdict = 'partial' THEN 1 ELSE 0 END AS r FROM findings f JOIN checks c ON c.check_id = f.check_id WHERE verdict IN ('fail', 'partial'))""")
def rep_sarif_results(spark, sf_dir):
    rows = V.findings(spark, sf_dir).join(V.checks(spark, sf_dir).select("check_id", "severity"), "check_id")
    return sarif_results(rows.withColumn("path", F.concat(F.lit("p"), F.col("path_no").cast("string"))).withColumn("snippet_sha", F.col("start_line").cast("string")))


def sarif_json(results: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 result object a row, as JSON."""
    body = F.struct(F.col("rule_id").cast("string").alias("ruleId"), "level", F.struct(F.col("fingerprint").alias("primary/v1")).alias("partialFingerprints"))
    return results.select("run", F.to_json(body).alias("result"))


def report_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(check_id, change): new, resolved, changed or persisting issues between two reports."""
    issue = lambda c: F.coalesce(F.col(c).isin("fail", "partial"), F.lit(False))
    both = base.select("check_id", F.col("verdict").alias("b")).join(head.select("check_id", F.col("verdict").alias("h")), "check_id", "full")
    change = F.when(~issue("b") & issue("h"), "new").when(issue("b") & ~issue("h"), "resolved").when(issue("b") & issue("h"), F.when(F.col("b") == F.col("h"), "persisting").otherwise("changed"))
    return both.select("check_id", change.alias("change")).filter("change IS NOT NULL")


@query("rep_pr_diff", "findings", """WITH b AS (SELECT check_id, verdict AS b FROM findings WHERE run = 0), h AS (SELECT check_id, verdict AS h FROM findings WHERE run = 1),
j AS (SELECT coalesce(b.check_id, h.check_id) AS check_id, b, h, coalesce(b IN ('fail', 'partial'), false) AS bi, coalesce(h IN ('fail', 'partial'), false) AS hi FROM b FULL JOIN h ON b.check_id = h.check_id)
SELECT check_id, CASE WHEN NOT bi THEN 'new' WHEN NOT hi THEN 'resolved' WHEN b = h THEN 'persisting' ELSE 'changed' END AS change FROM j WHERE bi OR hi""")
def rep_pr_diff(spark, sf_dir):
    f = V.findings(spark, sf_dir)
    return report_diff(f.filter("run = 0"), f.filter("run = 1"))


@query("guard_unknown_ids", "", "SELECT DISTINCT o_custkey % 3000 AS cited FROM orders WHERE o_custkey % 3000 NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)")
def guard_unknown_ids(spark, sf_dir):
    """Cited ids that no finding has."""
    known = V.table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("cited"))
    return V.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3000).alias("cited")).distinct().join(known, "cited", "left_anti")


def numbers(text):
    """Numbers that stand by themselves: ids and words with digits are taken out first."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[A-Za-z_-]+[0-9][A-Za-z0-9_-]*", " "), r"[0-9]+[A-Za-z_][A-Za-z0-9_-]*", " ")
    return F.regexp_extract_all(plain, F.lit(r"([0-9]+(\.[0-9]+)?)"), 1)


@query("guard_numbers", "", r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '[A-Za-z_-]+[0-9][A-Za-z0-9_-]*', ' ', 'g'), '[0-9]+[A-Za-z_][A-Za-z0-9_-]*', ' ', 'g'), '([0-9]+(\.[0-9]+)?)', 1)) AS number FROM documents)
SELECT DISTINCT doc_id, number FROM n WHERE number NOT IN (SELECT s_suppkey::VARCHAR FROM supplier)""")
def guard_numbers(spark, sf_dir):
    """Numbers in generated text that are not in the list of allowed ones."""
    allowed = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("number"))
    rows = V.table(spark, sf_dir, "documents").select("doc_id", F.explode(numbers(F.col("text"))).alias("number")).distinct()
    return rows.join(allowed, "number", "left_anti").select("doc_id", "number")
