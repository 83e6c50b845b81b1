"""Window-shaped operators: islands, round robin, byte budgets, previous lines, merged spans, and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import exprs as E
from quillon.plans import views as V
from quillon.plans.cases import cases, cases_sql
from quillon.registry import query


def islands(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, start, end): runs of consecutive numbers; repeats count once."""
    once = rows.select(*keys, at).distinct()
    run = F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    return once.withColumn("run", run).groupBy(*keys, "run").agg(F.min(at).alias("start"), F.max(at).alias("end")).drop("run")


@query("win_islands", "", """WITH x AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE (conv_id + turn) % 4 <> 0)
SELECT conv_id, min(turn) AS start, max(turn) AS "end" FROM (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM x) GROUP BY conv_id, g""")
def win_islands(spark, sf_dir):
    return islands(V.table(spark, sf_dir, "conversations").filter("(conv_id + turn) % 4 <> 0"), ["conv_id"], "turn")


def round_robin(facts: DataFrame, limit: int) -> DataFrame:
    """Facts of a run by tier, highest first, then in turn over paths in order of first appearance, ``limit`` a run."""
    inside = Window.partitionBy("run", "tier", "path").orderBy("ord")
    turns = facts.withColumn("turn", F.row_number().over(inside)).withColumn("path_ord", F.min("ord").over(Window.partitionBy("run", "tier", "path")))
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("tier"), "turn", "path_ord"))
    return turns.withColumn("place", place).filter(F.col("place") <= limit).select("run", "place", "path", "ord")


_ROUND = """WITH f AS (SELECT run, check_id AS ord, path_no AS path, CASE c.severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS tier FROM findings JOIN checks c USING (check_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY run, tier, path ORDER BY ord) AS turn, min(ord) OVER (PARTITION BY run, tier, path) AS path_ord FROM f)
SELECT run, place, path, ord FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY tier DESC, turn, path_ord)::INTEGER AS place FROM t) WHERE place <= 100"""


@query("win_round_robin", "checks findings", _ROUND)
def win_round_robin(spark, sf_dir):
    rows = V.findings(spark, sf_dir).join(V.checks(spark, sf_dir), "check_id")
    return round_robin(rows.select("run", F.col("check_id").alias("ord"), F.col("path_no").alias("path"), E.severity_rank(F.col("severity")).alias("tier")), 100)


def byte_budget(rows: DataFrame, keys: list[str], order: list[str], size: Column, most: int) -> DataFrame:
    """The first rows of each key whose sizes sum to the budget; the first row always stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).withColumn("upto", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("rn") == 1) | (F.col("upto") <= most)).drop("rn", "upto")


@query("win_byte_budget", "lines", """SELECT path, line_no FROM (SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no) AS rn, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS upto FROM lines) WHERE rn = 1 OR upto <= 2400""")
def win_byte_budget(spark, sf_dir):
    return byte_budget(V.lines(spark, sf_dir).select("path", "line_no", "line"), ["path"], ["line_no"], F.octet_length("line") + 1, 2400).select("path", "line_no")


@query("win_prev_nonblank", "lines", """SELECT path, line_no, last_value(CASE WHEN trim(line) <> '' THEN line_no END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM lines""")
def win_prev_nonblank(spark, sf_dir):
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return V.lines(spark, sf_dir).select("path", "line_no", F.last(F.when(F.trim("line") != "", F.col("line_no")), ignorenulls=True).over(w).alias("previous"))


def merge_spans(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, stop): overlapping or touching spans merged."""
    order = Window.partitionBy(key).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    grouped = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "group").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("group")


@query("win_span_merge", "", """WITH s AS (SELECT o_custkey AS path, o_orderkey % 500 AS start, o_orderkey % 500 + o_orderkey % 90 AS stop FROM orders),
n AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY path ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS grp FROM n) SELECT path, min(start) AS start, max(stop) AS stop FROM g GROUP BY path, grp""")
def win_span_merge(spark, sf_dir):
    k = F.col("o_orderkey")
    return merge_spans(V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), (k % 500).alias("start"), (k % 500 + k % 90).alias("stop")), "path")


@query("topk_hash_sample", "findings", "SELECT check_id, run FROM findings ORDER BY sha256(run || ':' || check_id || ':seed'), check_id LIMIT 50")
def topk_hash_sample(spark, sf_dir):
    """A seeded sample of fifty: the least hashes, a heap in each task."""
    key = F.sha2(F.concat(F.col("run").cast("string"), F.lit(":"), F.col("check_id").cast("string"), F.lit(":seed")), 256)
    return V.findings(spark, sf_dir).select("check_id", "run", key.alias("h")).orderBy("h", "check_id").limit(50).drop("h")


@query("set_union_names", "", "SELECT p_name AS name FROM part UNION SELECT split_part(url, '/', 3) FROM pages")
def set_union_names(spark, sf_dir):
    names = V.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return names.union(V.table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)))).distinct()


@query("set_intersect", "", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 5000")
def set_intersect(spark, sf_dir):
    a = V.table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    return a.intersect(V.table(spark, sf_dir, "supplier").filter("s_acctbal < 5000").select("s_nationkey"))


def changed_keys(base: DataFrame, head: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed between two tables, null-safely."""
    b = base.select(key, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    h = head.select(key, F.col(value).alias("h"), F.lit(True).alias("in_h"))
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_h").isNull(), "removed").when(~F.col("b").eqNullSafe(F.col("h")), "changed")
    return b.join(h, key, "full").select(key, change.alias("change")).filter("change IS NOT NULL")


@query("set_changed_paths", "files", """WITH b AS (SELECT path, sha256(text) AS h FROM files WHERE doc_id % 10 <> 3), n AS (SELECT path, CASE WHEN doc_id % 6 = 0 THEN sha256(text || '.') ELSE sha256(text) END AS h FROM files WHERE doc_id % 10 <> 4)
SELECT coalesce(b.path, n.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN n ON b.path = n.path WHERE b.path IS NULL OR n.path IS NULL OR b.h <> n.h""")
def set_changed_paths(spark, sf_dir):
    f = V.files(spark, sf_dir)
    base = f.filter("doc_id % 10 <> 3").select("path", F.sha2("text", 256).alias("h"))
    head = f.filter("doc_id % 10 <> 4").select("path", F.sha2(F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("h"))
    return changed_keys(base, head, "path", "h")


@query("set_schema_drift", "", "SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'missing' WHEN n_nationkey % 5 = 1 THEN 'unexpected' ELSE 'changed' END AS drift FROM nation WHERE n_nationkey % 5 < 3")
def set_schema_drift(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation")
    code = n.filter("n_nationkey % 5 <> 1").select("n_name", F.sha1("n_name").alias("h"))
    kept = n.filter("n_nationkey % 5 <> 0").select("n_name", F.when(F.col("n_nationkey") % 5 == 2, "old").otherwise(F.sha1("n_name")).alias("h"))
    drift = changed_keys(code, kept, "n_name", "h")
    return drift.select(F.col("n_name").alias("name"), F.when(F.col("change") == "removed", "missing").when(F.col("change") == "added", "unexpected").otherwise("changed").alias("drift"))


def patch_ranges(diffs: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, start, end): runs of added lines of unified diffs (keys, text), by numbers of the new files; deleted files have none."""
    lines = diffs.select(*keys, F.posexplode(E.split_lines(F.col("text"))).alias("pos", "line"))
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    header, target = F.col("line").rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@"), F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t]+)", 1)
    # a line that begins like a file's header is one only outside the lines that its hunk counts
    size = F.coalesce(F.expr("try_cast(nullif(regexp_extract(line, '^@@ -[0-9]+(?:,[0-9]+)? \\\\+[0-9]+(?:,([0-9]+))? @@', 1), '') AS INT)"), F.lit(1))
    first = F.expr("try_cast(regexp_extract(line, '^@@ -[0-9]+(?:,[0-9]+)? \\\\+([0-9]+)', 1) AS INT)")
    marked = lines.withColumn("hunk", F.last(F.when(header, F.struct("pos", first.alias("first"), size.alias("size"))), ignorenulls=True).over(order))
    inside = Window.partitionBy(*keys, "hunk.pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("line").startswith("+") | F.col("line").startswith(" ") | (F.col("line") == "")
    counted = marked.withColumn("before", F.when(F.col("hunk").isNotNull(), F.coalesce(F.count_if(new & ~header).over(inside), F.lit(0))))
    within = F.col("hunk").isNotNull() & ~header & (F.col("before") < F.col("hunk.size"))
    named = counted.withColumn("path", F.last(F.when(~F.coalesce(within, F.lit(False)) & F.col("line").startswith("+++ "), target), ignorenulls=True).over(order))
    added = named.filter(within & F.col("line").startswith("+") & (F.col("path") != "/dev/null"))
    return islands(added.select(*keys, "path", (F.col("hunk.first") + F.col("before")).cast("long").alias("line")), [*keys, "path"], "line")


_PATCHES = [
    ("diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,5 @@\n a\n+b\n+c\n d\n-e\n+f\n@@ -20 +22,2 @@ def g():\n z\n+++ odd\n",),
    ("--- /dev/null\n+++ b/new/y.js\n@@ -0,0 +1,2 @@\n+1\n+2\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n--- a/z\n+++ b/z\n@@ -5,2 +5,2 @@\n-p\n+q\n r\n",),
    ("",),
]


@query("win_patch_ranges", "", cases_sql(len(_PATCHES), "VARCHAR path, BIGINT start, BIGINT end", [(0, "x.py", 2, 3), (0, "x.py", 5, 5), (0, "x.py", 23, 23), (1, "new/y.js", 1, 2), (1, "z", 5, 5)]))
def win_patch_ranges(spark, sf_dir):
    return patch_ranges(cases(spark, sf_dir, _PATCHES, "text string").drop("case"), "id")
