"""Records of runs: plans of evaluations, their statistics, locks, views and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import exprs as E
from quillon.operators.joins import overlap_join
from quillon.plans import views as V
from quillon.plans.cases import cases, cases_sql
from quillon.registry import query


def score_stability(scores: DataFrame, bases: int) -> DataFrame:
    """The mean over metrics, of those with a score in every base run, of the population's standard deviation; four decimals."""
    each = scores.filter("score IS NOT NULL").groupBy("metric").agg(F.stddev_pop("score").alias("std"), F.count("*").alias("n")).filter(F.col("n") == bases)
    return each.agg(F.round(F.avg("std"), 4).alias("std"))


@query("eval_score_std", "llm_calls", """WITH s AS (SELECT run, metric, CASE WHEN sum(cost_micro) % 7 > 0 THEN sum(cost_micro) % 101 / 10.0 END AS score FROM llm_calls WHERE metric IS NOT NULL AND run < 3 GROUP BY 1, 2)
SELECT round(avg(std), 4) AS std FROM (SELECT stddev_pop(score::DOUBLE) AS std FROM s WHERE score IS NOT NULL GROUP BY metric HAVING count(*) = 3)""")
def eval_score_std(spark, sf_dir):
    sums = V.llm_calls(spark, sf_dir).filter("metric IS NOT NULL AND run < 3").groupBy("run", "metric").agg(F.sum("cost_micro").alias("n"))
    return score_stability(sums.select("run", "metric", F.when(F.col("n") % 7 > 0, F.col("n") % 101 / 10.0).alias("score")), 3)


def injected_only(evidence: DataFrame, injected: DataFrame) -> DataFrame:
    """(run, check_id) of findings all of whose evidence in code lies on injected lines; evidence is (run, check_id, path, start, end), one row an item."""
    items = evidence.withColumn("item", F.row_number().over(Window.partitionBy("run", "check_id").orderBy("path", "start", "end")))
    hit = overlap_join(items, injected.select("path", "start", "end")).select("run", "check_id", "item").distinct().withColumn("hit", F.lit(True))
    marked = items.join(hit, ["run", "check_id", "item"], "left")
    return marked.groupBy("run", "check_id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("all")).filter("all").select("run", "check_id")


@query("eval_injected_only", "findings", """WITH e AS (SELECT run, check_id, path_no AS path, start_line AS s, start_line + 3 AS e FROM findings UNION ALL SELECT run, check_id, (path_no + check_id) % 50, start_line + 5, start_line + 9 FROM findings WHERE check_id % 3 = 0),
i AS (SELECT o_orderkey % 50 AS path, o_custkey % 97 + 1 AS s, o_custkey % 97 + 2 AS e FROM orders WHERE o_orderstatus = 'P')
SELECT run, check_id FROM e GROUP BY run, check_id HAVING bool_and(EXISTS (SELECT 1 FROM i WHERE i.path = e.path AND i.s <= e.e AND e.s <= i.e))""")
def eval_injected_only(spark, sf_dir):
    f = V.findings(spark, sf_dir).withColumn("path", F.col("path_no").cast("long"))
    one = f.select("run", "check_id", "path", F.col("start_line").cast("long").alias("start"), (F.col("start_line") + 3).cast("long").alias("end"))
    two = f.filter("check_id % 3 = 0").select("run", "check_id", ((F.col("path") + F.col("check_id")) % 50).alias("path"), (F.col("start_line") + 5).cast("long").alias("start"), (F.col("start_line") + 9).cast("long").alias("end"))
    start = F.col("o_custkey") % 97 + 1
    lines = V.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select((F.col("o_orderkey") % 50).alias("path"), start.alias("start"), (start + 1).alias("end"))
    return injected_only(one.unionByName(two), lines.distinct())


def plan_problems(suite: DataFrame, repos: DataFrame, variants: DataFrame) -> DataFrame:
    """(n, problem) of suite entries (n, repo, variant): unknown repositories and variants, variants of another repository, entries listed twice."""
    known = suite.join(repos.select("repo", F.lit(True).alias("known")).distinct(), "repo", "left")
    both = known.join(variants.select(F.col("variant"), F.col("repo").alias("of"), F.lit(True).alias("listed")), "variant", "left")
    both = both.withColumn("again", F.row_number().over(Window.partitionBy("repo", "variant").orderBy("n")) > 1)
    base, again = F.col("variant") == "base", F.col("again")
    problems = F.array_compact(F.array(
        F.when(F.col("known").isNull(), "unknown repo"), F.when(F.col("known").isNotNull() & again, "listed twice"),
        F.when(F.col("known").isNotNull() & ~base & F.col("listed").isNull(), "unknown variant"), F.when(F.col("known").isNotNull() & ~base & (F.col("of") != F.col("repo")), "variant of another repo"),
    ))
    return both.select("n", F.explode(problems).alias("problem"))


@query("eval_plan_problems", "", """WITH s AS (SELECT p_partkey AS n, 'r' || p_size % 7 AS repo, CASE WHEN p_partkey % 4 = 0 THEN 'base' ELSE 'v' || p_partkey % 9 END AS variant FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY repo, variant ORDER BY n) AS rn, regexp_extract(variant, '\\d+')::VARCHAR AS v FROM s)
SELECT n, unnest(list_filter([CASE WHEN repo IN ('r5', 'r6') THEN 'unknown repo' END, CASE WHEN repo NOT IN ('r5', 'r6') AND rn > 1 THEN 'listed twice' END, CASE WHEN repo NOT IN ('r5', 'r6') AND variant IN ('v7', 'v8') THEN 'unknown variant' END,
  CASE WHEN repo NOT IN ('r5', 'r6') AND variant NOT IN ('base', 'v7', 'v8') AND 'r' || v <> repo THEN 'variant of another repo' END], lambda x: x IS NOT NULL)) AS problem FROM k""")
def eval_plan_problems(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    name = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    suite = p.select(F.col("p_partkey").alias("n"), name("r", F.col("p_size") % 7).alias("repo"), F.when(F.col("p_partkey") % 4 == 0, "base").otherwise(name("v", F.col("p_partkey") % 9)).alias("variant"))
    repos = spark.range(5).select(name("r", F.col("id")).alias("repo"))
    return plan_problems(suite, repos, spark.range(7).select(name("v", F.col("id")).alias("variant"), name("r", F.col("id")).alias("repo")))


def effective_mutations(entries: DataFrame, failing: DataFrame) -> DataFrame:
    """(variant, entry, kept): an entry of mutations joined by + goes if the precondition of any of them fails."""
    parts = entries.withColumn("mutation", F.explode(F.transform(F.split("entry", r"\+"), lambda m: F.trim(m))))
    lost = parts.join(failing.select("mutation").distinct().withColumn("lost", F.lit(True)), "mutation", "left")
    return lost.groupBy("variant", "entry").agg((~F.coalesce(F.bool_or("lost"), F.lit(False))).alias("kept"))


@query("eval_variants", "", """SELECT p_partkey AS variant, 'm' || p_partkey % 11 || ' + m' || p_size % 11 AS entry, NOT (p_partkey % 11 IN (3, 4) OR p_size % 11 IN (3, 4)) AS kept FROM part""")
def eval_variants(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    entry = F.concat(F.lit("m"), (F.col("p_partkey") % 11).cast("string"), F.lit(" + m"), (F.col("p_size") % 11).cast("string"))
    failing = spark.createDataFrame([("m3",), ("m4",)], "mutation string")
    return effective_mutations(p.select(F.col("p_partkey").alias("variant"), entry.alias("entry")), failing)


def lock_problems(prompts: DataFrame, lock: DataFrame) -> DataFrame:
    """(prompt, problem): prompts (prompt, version, sha256) against their lock."""
    both = prompts.select("prompt", "version", "sha256", F.lit(True).alias("here")).join(lock.select("prompt", F.col("version").alias("v"), F.col("sha256").alias("s"), F.lit(True).alias("locked")), "prompt", "full")
    changed, bumped = F.col("s") != F.col("sha256"), F.col("v") != F.col("version")
    problem = F.when(F.col("locked").isNull(), "not locked").when(F.col("here").isNull(), "prompt is gone").when(changed & ~bumped, "changed without a new version").when(changed | bumped, "new version isn't locked")
    return both.select("prompt", problem.alias("problem")).filter("problem IS NOT NULL")


@query("set_prompt_lock", "", """SELECT p_partkey AS prompt, CASE WHEN p_partkey % 10 = 0 THEN 'not locked' WHEN p_partkey % 10 = 1 THEN 'prompt is gone' WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN 'changed without a new version' ELSE 'new version isn''t locked' END AS problem
FROM part WHERE p_partkey % 10 IN (0, 1) OR p_partkey % 3 = 0 OR p_size % 2 = 1""")
def set_prompt_lock(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("prompt"), "p_size")
    prompts = p.filter("prompt % 10 <> 1").select("prompt", F.lit("2").alias("version"), F.lit("b").alias("sha256"))
    lock = p.filter("prompt % 10 <> 0").select("prompt", F.when(F.col("p_size") % 2 == 1, "1").otherwise("2").alias("version"), F.when(F.col("prompt") % 3 == 0, "a").otherwise("b").alias("sha256"))
    return lock_problems(prompts, lock)


def concat_facts(*tables: DataFrame) -> DataFrame:
    """The facts of all sources one after another: ``source`` and ``ord`` keep the order."""
    out = None
    for k, table in enumerate(tables):
        one = table.withColumn("source", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


@query("set_concat_facts", "", "SELECT 0 AS source, p_partkey AS ord, p_name AS name, NULL::INTEGER AS nation FROM part UNION ALL SELECT 1, s_suppkey, NULL, s_nationkey FROM supplier")
def set_concat_facts(spark, sf_dir):
    parts = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))
    return concat_facts(parts, V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_nationkey").alias("nation")))


def capped_evidence(evidence: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` distinct places of a finding's evidence (run, check_id, ord, place), in order, and three examples."""
    first = evidence.groupBy("run", "check_id", "place").agg(F.min("ord").alias("ord"))
    ranked = first.withColumn("rn", F.row_number().over(Window.partitionBy("run", "check_id").orderBy("ord"))).filter(F.col("rn") <= most)
    return ranked.groupBy("run", "check_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rn", "place"))), 1, 3), lambda x: x["place"]), ", ").alias("examples"))


@query("rep_evidence_cap", "judged", """WITH d AS (SELECT run, check_id % 40 AS check_id, 'p' || l_orderkey % 50 AS place, min(l_orderkey * 10 + l_linenumber) AS ord FROM judged GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY run, check_id ORDER BY ord, place) AS rn FROM d)
SELECT run, check_id, count(*) FILTER (WHERE rn <= 20) AS n, string_agg(place, ', ' ORDER BY rn) FILTER (WHERE rn <= 3) AS examples FROM r GROUP BY 1, 2""")
def rep_evidence_cap(spark, sf_dir):
    line = V.table(spark, sf_dir, "lineitem")
    rows = line.select((F.col("l_suppkey") % 5).cast("int").alias("run"), (F.col("l_partkey") % 40).alias("check_id"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.concat(F.lit("p"), (F.col("l_orderkey") % 50).cast("string")).alias("p")).alias("ord"), F.concat(F.lit("p"), (F.col("l_orderkey") % 50).cast("string")).alias("place"))
    return capped_evidence(rows)


def in_report_order(findings: DataFrame) -> DataFrame:
    """Findings with their number in a report, by metric and check."""
    return findings.withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy("metric", "check_id")))


@query("rep_finding_order", "checks findings", "SELECT run, c.check_id, row_number() OVER (PARTITION BY run ORDER BY metric, c.check_id)::INTEGER AS n FROM findings f JOIN checks c ON c.check_id = f.check_id")
def rep_finding_order(spark, sf_dir):
    rows = V.findings(spark, sf_dir).join(V.checks(spark, sf_dir).select("check_id", "metric"), "check_id")
    return in_report_order(rows).select("run", "check_id", "n")


def finding_view(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """Findings with the check's severity and metric, its rank for sorting (unknown checks last), and the last verification step."""
    known = findings.join(checks.select("check_id", "metric", "severity"), "check_id", "left")
    rank = E.choose(F.col("severity"), {s: k for k, s in enumerate(reversed(E.SEVERITIES))}, 9)
    return known.withColumn("rank", rank).withColumn("detail", F.try_element_at(F.col("steps"), F.lit(-1)))


@query("rep_finding_view", "checks findings", """SELECT f.run, f.check_id, metric, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 9 END AS rank,
CASE WHEN start_line % 3 = 0 THEN NULL WHEN start_line % 3 = 1 THEN 'mechanical' ELSE status END AS detail FROM findings f LEFT JOIN (SELECT * FROM checks WHERE check_id % 5 <> 0) c ON c.check_id = f.check_id""")
def rep_finding_view(spark, sf_dir):
    n = F.col("start_line") % 3
    steps = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("mechanical"))).otherwise(F.array(F.lit("mechanical"), F.col("status")))
    rows = finding_view(V.findings(spark, sf_dir).withColumn("steps", steps), V.checks(spark, sf_dir).filter("check_id % 5 <> 0"))
    return rows.select("run", "check_id", "metric", "rank", "detail")


def recheck_hashes(evidence: DataFrame, snippets: DataFrame) -> DataFrame:
    """(result, state): evidence (result, path, start, sha256) against the snapshot's snippets: same, changed or gone."""
    now = snippets.select("path", "start", F.col("sha256").alias("now"))
    state = F.when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("sha256"), "same").otherwise("changed")
    return evidence.join(now, ["path", "start"], "left").select("result", state.alias("state"))


@query("ver_hash_recheck", "lines", """WITH s AS (SELECT path, line_no AS start, sha256(line) AS sha256 FROM lines)
SELECT o_orderkey AS result, CASE WHEN s.sha256 IS NULL THEN 'gone' WHEN o_orderkey % 4 = 0 THEN 'changed' ELSE 'same' END AS state
FROM orders o LEFT JOIN (SELECT path, doc_id FROM files) f ON f.doc_id = o_custkey LEFT JOIN s ON s.path = f.path AND s.start = o_orderkey % 5""")
def ver_hash_recheck(spark, sf_dir):
    paths = V.files(spark, sf_dir).select("doc_id", "path")
    snippets = V.lines(spark, sf_dir).select("path", F.col("line_no").cast("long").alias("start"), F.sha2("line", 256).alias("sha256"))
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("result"), F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 5).alias("start"))
    cited = o.join(paths, "doc_id", "left").join(snippets, ["path", "start"], "left")
    evidence = cited.select("result", "path", "start", F.when(F.col("result") % 4 == 0, "other").otherwise(F.col("sha256")).alias("sha256"))
    return recheck_hashes(evidence, snippets)


def ablate(checks: DataFrame, deterministic_rules: bool, self_consistency: bool) -> DataFrame:
    """Checks without the features that are off: rules become questions with positive evidence, and each is asked once."""
    out = checks
    if not deterministic_rules:
        ruled = F.col("type") == "deterministic"
        out = out.withColumns({"type": F.lit("llm"), "rule": F.when(~ruled, F.col("rule")), "evidence_policy": F.when(ruled, "positive_required").otherwise(F.col("evidence_policy")), "na_allowed": ~ruled & F.col("na_allowed")})
    return out if self_consistency else out.withColumn("self_consistency", F.lit(1))


@query("eval_ablation", "checks", """SELECT check_id, 'llm' AS type, CASE WHEN check_id % 2 = 1 THEN 'r' || check_id END AS rule, CASE WHEN check_id % 2 = 0 THEN 'positive_required' ELSE 'absence' END AS evidence_policy, check_id % 2 = 1 AND check_id % 3 = 0 AS na_allowed, 1 AS self_consistency FROM checks""")
def eval_ablation(spark, sf_dir):
    c = F.col("check_id")
    checks = V.checks(spark, sf_dir).select("check_id", F.when(c % 2 == 0, "deterministic").otherwise("llm").alias("type"), F.concat(F.lit("r"), c.cast("string")).alias("rule"), F.lit("absence").alias("evidence_policy"), (c % 3 == 0).alias("na_allowed"), F.lit(3).alias("self_consistency"))
    return ablate(checks, False, False)


def run_progress(stages: DataFrame) -> DataFrame:
    """(run, stage, state, done, total): each run's latest stage and its state, and how many of its stages are done; by one aggregate."""
    last = F.max_by(F.struct("stage", "state"), "ord")
    each = stages.groupBy("run", "stage").agg(F.max_by("state", "ord").alias("state"), F.max("ord").alias("ord"))
    return each.groupBy("run").agg(last.alias("x"), F.count_if(F.col("state") == "done").alias("done"), F.count("*").alias("total")).select("run", "x.stage", "x.state", "done", "total")


@query("store_run_progress", "", """WITH s AS (SELECT user_id AS run, event_type AS stage, CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'running' END AS state, event_id AS ord FROM events),
e AS (SELECT run, stage, max_by(state, ord) AS state, max(ord) AS ord FROM s GROUP BY 1, 2)
SELECT run, max_by(stage, ord) AS stage, max_by(state, ord) AS state, count(*) FILTER (WHERE state = 'done') AS done, count(*) AS total FROM e GROUP BY run""")
def store_run_progress(spark, sf_dir):
    state = F.when(F.col("event_id") % 3 == 0, "done").otherwise("running")
    return run_progress(V.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), state.alias("state"), F.col("event_id").alias("ord")))


def absence(hits: Column, read: Column, skipped: Column) -> Column:
    """What replaying the probes of an absence shows: found, or absent if all files could be read, else inconclusive."""
    return F.when(hits > 0, "found").when((read == 0) | (skipped > 0), "inconclusive").otherwise("absent")


@query("ver_absence", "files", """SELECT split_part(path, '/', 2) AS source, CASE WHEN count(*) FILTER (WHERE size <= 2000000 AND regexp_matches(text, 'token = "[0-9a-f]+"')) > 0 THEN 'found' WHEN count(*) FILTER (WHERE size <= 2000000) = 0 OR count(*) FILTER (WHERE size > 2000000) > 0 THEN 'inconclusive' ELSE 'absent' END AS outcome FROM files GROUP BY 1""")
def ver_absence(spark, sf_dir):
    """A probe for secrets over the files of each source; those above 2 MB count as unread."""
    read = F.col("size") <= 2_000_000
    rows = V.files(spark, sf_dir).groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("source"))
    sums = rows.agg(F.count_if(read & F.col("text").rlike('token = "[0-9a-f]+"')).alias("hits"), F.count_if(read).alias("read"), F.count_if(~read).alias("skipped"))
    return sums.select("source", absence(F.col("hits"), F.col("read"), F.col("skipped")).alias("outcome"))


def unique_in_order(items: Column) -> Column:
    return F.array_distinct(items)


_ITEMS = [(["b", "a", "b", "c", "a"], "b,a,c"), ([], ""), (["x"], "x")]


@query("fn_unique", "", cases_sql(len(_ITEMS), "VARCHAR items", [(k, want) for k, (_, want) in enumerate(_ITEMS)]))
def fn_unique(spark, sf_dir):
    return cases(spark, sf_dir, [(i,) for i, _ in _ITEMS], "items array<string>").select("id", F.array_join(unique_in_order(F.col("items")), ",").alias("items"))


def over_limits(files: DataFrame, total_bytes: int = 300_000_000, most_files: int = 30_000) -> DataFrame:
    """(key, reason) of snapshots that may not be read: too many files, or too many bytes."""
    sums = files.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return sums.withColumn("reason", F.when(F.col("n") > most_files, "too many files").when(F.col("bytes") > total_bytes, "too large")).filter("reason IS NOT NULL").select("key", "reason")


@query("src_limits", "files", """SELECT split_part(path, '/', 2) AS key, CASE WHEN count(*) > 12 THEN 'too many files' ELSE 'too large' END AS reason FROM files GROUP BY 1 HAVING count(*) > 12 OR sum(size) > 40000""")
def src_limits(spark, sf_dir):
    return over_limits(V.files(spark, sf_dir).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("key"), "size"), 40_000, 12)
