"""Aggregates over files, lines and facts, and the scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import exprs as E
from quillon.operators.joins import ancestors
from quillon.plans import views as V
from quillon.registry import query


@query("agg_language_loc", "files", "SELECT language, sum(len(string_split(text, chr(10))))::BIGINT AS loc FROM files GROUP BY 1")
def agg_language_loc(spark, sf_dir):
    return V.files(spark, sf_dir).groupBy("language").agg(F.sum(F.size(F.split("text", "\n"))).alias("loc"))


def language_shares(files: DataFrame, least_percent: int = 10) -> DataFrame:
    """(language, size, flagged): at least that share of all bytes; the total is one broadcast row."""
    sums = files.groupBy("language").agg(F.sum("size").alias("size"))
    total = sums.agg(F.sum("size").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("language", "size", (F.col("size") * 100 >= F.col("total") * least_percent).alias("flagged"))


@query("agg_language_share", "files", "SELECT language, size, size * 100 >= (SELECT sum(size) FROM files) * 10 AS flagged FROM (SELECT language, sum(size)::BIGINT AS size FROM files GROUP BY 1)")
def agg_language_share(spark, sf_dir):
    return language_shares(V.files(spark, sf_dir))


@query("agg_profile_flags", "files", """SELECT split_part(path, '/', 2) AS source, bool_or(language = 'python') AS has_python, bool_or(path LIKE 'tests/%') AS has_tests, bool_or(contains(text, 'token = ')) AS has_secret,
 bool_or(size > 20000) AS has_large FROM files WHERE path NOT LIKE 'tests/fixtures/%' GROUP BY 1""")
def agg_profile_flags(spark, sf_dir):
    rows = V.files(spark, sf_dir).filter(~F.col("path").startswith("tests/fixtures/"))
    return rows.groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("source")).agg(
        F.bool_or(F.col("language") == "python").alias("has_python"), F.bool_or(F.col("path").startswith("tests/")).alias("has_tests"), F.bool_or(F.col("text").contains("token = ")).alias("has_secret"), F.bool_or(F.col("size") > 20000).alias("has_large"),
    )


@query("agg_sorted_set", "llm_calls", "SELECT user_id, string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages FROM llm_calls GROUP BY 1")
def agg_sorted_set(spark, sf_dir):
    return V.llm_calls(spark, sf_dir).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("stages"))


@query("agg_fact_counts", "llm_calls", "SELECT stage AS kind, count(*) AS n FROM llm_calls GROUP BY 1")
def agg_fact_counts(spark, sf_dir):
    return V.llm_calls(spark, sf_dir).groupBy(F.col("stage").alias("kind")).agg(F.count("*").alias("n"))


@query("agg_dir_rollup", "files", """WITH p AS (SELECT path, string_split(path, '/') AS s FROM files), d AS (SELECT array_to_string(s[1:n], '/') AS dir FROM p, (SELECT unnest(range(0, 7)) AS n) WHERE n < len(s))
SELECT dir, count(*) AS n_files FROM d GROUP BY 1""")
def agg_dir_rollup(spark, sf_dir):
    """Files below each folder, the root included: a roll-up over path prefixes."""
    return V.files(spark, sf_dir).select(F.explode(ancestors(F.col("path"))).alias("dir")).groupBy("dir").agg(F.count("*").alias("n_files"))


def entropy_milli(value: Column) -> Column:
    """Shannon entropy of the characters in thousandths of a bit, rounded down; in one expression, without a shuffle."""
    letters = F.split(value, "")
    n = F.length(value)
    terms = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda s, c: s - (F.size(F.filter(letters, lambda x: x == c)) / n) * F.log2(F.size(F.filter(letters, lambda x: x == c)) / n))
    return F.when(n > 0, F.floor(terms * 1000 + 0.000001)).otherwise(0).cast("long")


@query("agg_entropy", "", """WITH v AS (SELECT p_partkey AS id, p_name AS v FROM part), c AS (SELECT id, ch, count(*)::DOUBLE AS k, sum(count(*)) OVER (PARTITION BY id) AS n FROM (SELECT id, unnest(string_split(v, '')) AS ch FROM v) GROUP BY 1, 2)
SELECT id, floor(-sum(k / n * log2(k / n)) * 1000 + 0.000001)::BIGINT AS entropy FROM c GROUP BY 1""")
def agg_entropy(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), entropy_milli(F.col("p_name")).alias("entropy"))


@query("fn_safe_ratio", "", "SELECT o_custkey % 100 AS g, CASE WHEN q <> 0 THEN (p * 20000 + q) // (2 * q) END::BIGINT AS ratio FROM (SELECT o_custkey % 100 AS o_custkey, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS p, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderkey % 40 = 0) AS q FROM orders GROUP BY 1)")
def fn_safe_ratio(spark, sf_dir):
    sums = V.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("g")).agg(F.count_if(F.col("o_orderpriority") == "5-LOW").alias("p"), F.count_if((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 40 == 0)).alias("q"))
    return sums.select("g", E.ratio_1e4(F.col("p"), F.col("q")).alias("ratio"))


@query("fn_clamp", "", "SELECT p_partkey AS id, greatest(5, least(20, coalesce(CASE WHEN p_size % 4 <> 0 THEN p_size END, 10))) AS size FROM part")
def fn_clamp(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), E.clamp(F.when(F.col("p_size") % 4 != 0, F.col("p_size")), 5, 20, 10).alias("size"))


@query("fn_trim_claim", "", r"""SELECT conv_id, turn, CASE WHEN length(t) > 60 THEN regexp_replace(substr(t, 1, 59), '\s+$', '') || '…' ELSE t END AS claim
FROM (SELECT conv_id, turn, text, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM conversations)""")
def fn_trim_claim(spark, sf_dir):
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", E.trim_claim(F.col("text"), 60).alias("claim"))
