"""Domain views over the driver's tables; the only module that knows their names.

Files, facts, checks, findings and calls are derived by fixed rules, so every
operator has deterministic input. ``oracle_views`` states the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import exprs as E


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(check_id, metric, severity, w10, retired)."""
    rest = F.col("p_size") % 4
    severity = F.when(F.col("p_size") % 50 == 0, "critical").when(rest == 0, "high").when(rest == 1, "medium").when(rest == 2, "low").otherwise("info")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("check_id"), F.col("p_brand").alias("metric"), severity.alias("severity"), (F.col("p_type") == "SMALL").alias("retired"))
    return part.withColumn("w10", E.severity_weight(F.col("severity")))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.concat("l_returnflag", "l_linestatus")
    verdict = E.choose(flag, {"AF": "pass", "NO": "pass", "AO": "partial", "NF": "fail", "RF": "not_applicable"}, "unknown")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 5).cast("int").alias("run"), F.col("l_partkey").alias("check_id"), "l_orderkey", "l_linenumber",
        verdict.alias("verdict"), F.when(F.col("l_linenumber") % 5 == 0, "unverified").otherwise("verified").alias("status"),
        F.when(F.col("l_quantity") < 17, "low").when(F.col("l_quantity") < 34, "medium").otherwise("high").alias("confidence"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, check_id, verdict, status, path_no, start_line), one for each run and check.

    The least row of a group is the minimum of one packed number, which keeps the
    aggregation hashed and in generated code; rows compare by order, line, verdict
    and status.
    """
    verdicts = sorted(E.VERDICTS)
    code = E.choose(F.col("verdict"), {v: k for k, v in enumerate(verdicts)})
    packed = F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 100 + code * 10 + F.when(F.col("status") == "verified", 1).otherwise(0)
    first = _judged(spark, sf_dir).groupBy("run", "check_id").agg(F.min(packed).alias("x"))
    order = F.expr("x div 100000")
    verdict = E.choose(F.expr("x div 10 % 10"), dict(enumerate(verdicts)))
    return first.select("run", "check_id", verdict.alias("verdict"), F.when(F.col("x") % 10 == 1, "verified").otherwise("unverified").alias("status"), (order % 50).cast("int").alias("path_no"), (order % 97 + 1).cast("int").alias("start_line"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, check_id, attempt, verdict, confidence, claim): up to three judgements of one check."""
    order = Window.partitionBy("run", "check_id").orderBy("l_orderkey", "l_linenumber", "verdict", "status", "confidence")
    rows = _judged(spark, sf_dir).withColumn("attempt", F.row_number().over(order)).filter("attempt <= 3")
    return rows.select("run", "check_id", "attempt", "verdict", "confidence", F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("claim"))


def llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ts, day, run, stage, metric, cost_micro, tokens_in, tokens_cached, tokens_out, cache_hit, latency_ms)."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", F.to_date("ts").alias("day"), (F.col("event_id") % 7).cast("int").alias("run"), F.col("event_type").alias("stage"),
        F.when(F.col("user_id") % 10 != 0, (F.col("user_id") % 10).cast("int")).alias("metric"), F.round(F.col("value") * 100).cast("long").alias("cost_micro"),
        (k * 100).alias("tokens_in"), (k * 30).alias("tokens_cached"), (k * 7).alias("tokens_out"), (k % 4 == 0).alias("cache_hit"), (F.col("user_id") * 10 + k).alias("latency_ms"), "user_id",
    )


EXTENSIONS = {0: ".py", 1: ".ts", 2: ".cs", 3: ".go", 4: ".md", 5: ".json", 6: ".yml", 7: ".java"}
LANGUAGES = {".py": "python", ".ts": "typescript", ".cs": "csharp", ".go": "go", ".java": "java", ".md": "markdown", ".json": "json", ".yml": "yaml"}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, ext, language, size, text): documents as source files."""
    i = F.col("doc_id")
    top = F.when(i % 11 == 0, "vendor").when(i % 13 == 0, "tests").when(i % 17 == 0, "tests/fixtures/app").when(i % 19 == 0, "build").otherwise("src")
    ext = E.choose(i % 8, EXTENSIONS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", ext.alias("ext"), top.alias("top"))
    name = F.concat(F.when(i % 10 == 0, "test_mod").otherwise("mod"), i.cast("string"))
    return docs.select("doc_id", F.concat_ws("/", "top", "source", "lang", F.concat(name, "ext")).alias("path"), "ext", E.choose(F.col("ext"), LANGUAGES).alias("language"), F.octet_length("text").cast("long").alias("size"), "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, line_no, line)."""
    return files(spark, sf_dir).select("doc_id", "path", F.posexplode(E.split_lines(F.col("text")))).select("doc_id", "path", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): distinct import edges without self-loops."""
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
    return orders.select((F.col("o_custkey") % 40).alias("src"), (F.col("o_orderkey") * 7 % 40).alias("dst")).filter("src <> dst").distinct()
