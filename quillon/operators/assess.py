"""From files to verdicts and scores: extractors, profile, rules and scores over all repositories at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import exprs as E
from quillon.functions import fixed
from quillon.operators import facts as fact_tables
from quillon.operators import rules
from quillon.operators.filters import generated, vendored
from quillon.operators.profile import profiles, tells
from quillon.operators.scoring import overall, score_rows
from quillon.operators.versions import VERSION, Alike, Versions
from quillon.plans import views as V
from quillon.registry import query
from quillon.sources.stores import language_of
from quillon.sources.tables import stored


@dataclass(frozen=True)
class Check:
    """A check of a rubric: it belongs to a metric and asks a rule."""

    metric: str
    rule: str
    severity: str
    params: dict | None = None


def profile_facts(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of the kinds flag, framework and file, which rules ask for beside those of extractors.

    ``files`` is (run, path, text). Texts go into facts only of the files that may hold
    settings of coverage.
    """
    path, text = F.col("path"), F.col("text")
    unread = F.coalesce(F.instr(F.substring(text, 1, 8192), "\0") > 0, F.lit(True))
    versions = Versions(files.select("run", "path", "text"), keep=stored)
    known = stored(versions.once.select(
        VERSION, "path", language_of(path).alias("language"), F.size(E.split_lines(text)).alias("loc"), "text", vendored(path).alias("vendored"), generated(path, text).alias("generated"), (~unread).alias("readable")
    ))
    read = facts.filter(F.col("kind").isin("route", *fixed.PROFILE_NAMES)).select("run", "kind", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("severity"), "attributes")
    held = versions.held(known.filter(tells(path, F.col("language"))))
    rows = held.select("run", F.lit("file").alias("kind"), "path", F.col(VERSION).alias("attributes")).unionByName(read.select("run", "kind", "path", "attributes"))
    alike = Alike(rows, "run")  # a profile is made once for runs of the same files and facts that it depends on
    a = rules.typed(alike.first(read))
    name = F.lit(None).cast("string")
    for kind, key in fixed.PROFILE_NAMES.items():
        name = F.when(F.col("kind") == kind, F.col(f"a.{key}")).otherwise(name)
    name = F.when((F.col("kind") == "import_edge") & F.col("a.internal"), F.lit(None)).otherwise(name)
    found = profiles(alike.first(held).join(known, ["path", VERSION]).drop(VERSION), a.select("run", "kind", name.alias("name")))
    settings = F.when(rules.path_matches(path, tuple(g for g, _ in fixed.COVERAGE_CONTENT)) & F.col("readable"), text)
    as_fact = lambda key, kind, path, **attributes: [
        key, F.lit(kind).alias("kind"), path.alias("path"), F.lit(None).cast("string").alias("severity"), F.to_json(F.struct(*(c.alias(n) for n, c in attributes.items()))).alias("attributes"),
    ]
    none = F.lit(None).cast("string")
    listed = versions.back(known.select(*as_fact(VERSION, "file", path, text=settings, vendored=F.col("vendored"), unreadable=~F.col("readable"))))
    found = stored(found.select("run", "flags", "frameworks"))
    on = found.select("run", F.explode(F.map_keys(F.map_filter("flags", lambda k, v: v))).alias("name")).select(*as_fact("run", "flag", none, name=F.col("name")))
    frameworks = found.select("run", F.explode("frameworks").alias("name")).select(*as_fact("run", "framework", none, name=F.col("name")))
    return listed.unionByName(alike.back(on.unionByName(frameworks)))


def assess(files: DataFrame, runs: DataFrame, rubric: list[Check], scanned: DataFrame | None = None, tool_runs: DataFrame | None = None) -> DataFrame:
    """(run, rule, verdict, reason, n_facts, place) of every run and check of the rubric.

    ``files`` is (run, path, text). ``scanned`` adds facts (run, kind, path, severity,
    attributes) of scanners, ``tool_runs`` (run, tool, tool_status, ord) their records;
    extractors have run on all.
    """
    files = stored(files)
    found, states = fact_tables.stored_facts(files)
    found = found.select("run", "kind", "path", "severity", "attributes")
    every = found.unionByName(stored(profile_facts(files, found)))  # read by the scan and by the search for cycles
    every = every.unionByName(scanned) if scanned is not None else every
    ran = {s: "ok" if v == "ok" else "error" for s, v in states.items()}
    return rules.run_rules_once({c.rule: c.params for c in rubric}, every, runs, tool_runs, ran)


def assessed_scores(verdicts: DataFrame, rubric: list[Check]) -> DataFrame:
    """Scores of every run and metric, from verdicts that the rules gave."""
    rows = [(c.rule, c.metric, c.severity) for c in rubric]
    of = verdicts.sparkSession.createDataFrame(rows, "check_id string, metric string, severity string").withColumn("w10", E.severity_weight(F.col("severity")))
    judged = verdicts.withColumnRenamed("rule", "check_id").join(F.broadcast(of), "check_id")  # the rubric's own list
    return score_rows(judged.withColumn("effective", F.col("verdict")))


#: The rubric of the queries below.
RUBRIC = [
    Check("security", "secrets.none_found", "critical"), Check("security", "vulns.max_severity", "high"), Check("security", "sast.max_severity", "high"),
    Check("security", "iac.max_severity", "medium"), Check("structure", "size.max_file_loc", "medium"), Check("structure", "complexity.ccn_ratio", "medium"),
    Check("structure", "imports.no_cycles", "high"), Check("structure", "data.migrations_present", "low"), Check("structure", "deps.lockfile_present", "medium"),
    Check("logging", "imports.any_of", "medium"), Check("logging", "ast.debug_output_ratio", "low"), Check("logging", "observability.present", "high"),
    Check("tests", "tests.present", "critical"), Check("tests", "tests.ratio", "medium"), Check("tests", "tests.coverage_configured", "low"),
    Check("ci", "ci.present", "high"), Check("ci", "ci.stages", "medium"), Check("ci", "ci.runs_tests", "high"), Check("ci", "ci.actionlint_clean", "low"),
    Check("ci", "ci.permissions_restricted", "medium"), Check("ci", "ci.actions_pinned", "medium"), Check("containers", "docker.non_root", "high"),
    Check("containers", "docker.pinned_base", "medium"), Check("containers", "docker.multistage", "low"), Check("containers", "docker.healthcheck", "medium"),
    Check("containers", "docker.hadolint_errors", "low"), Check("containers", "deploy.resource_limits", "medium"), Check("docs", "files.any_exists", "high", {"globs": ["README*"]}),
    Check("docs", "docs.api_spec", "medium"), Check("docs", "docs.architecture", "medium"), Check("docs", "docs.docstring_ratio", "low"),
]

_GOOD_IMAGE = "FROM node:20 AS b\nFROM python:3.12\nUSER app\nHEALTHCHECK CMD x"
_WORKFLOWS = {
    1: "on: push\npermissions: read-all\njobs:\n  a:\n    steps:\n    - uses: actions/checkout@v4\n    - run: pytest --cov\n    - run: ruff check .\n    - run: docker build .",
    2: "on: [push]\npermissions: write-all\njobs:\n  a:\n    steps:\n    - uses: other/x@v1\n    - run: docker build .",
}
_SERVICE = "  {}: {{image: x{}}}"
#: The files of a repository: path, text, and for which number of which remainder they are there.
_FILES = [
    ("Dockerfile", "FROM python:latest", "a = 1"), ("Dockerfile", _GOOD_IMAGE, "a = 2"), ("Dockerfile", "FROM python:3.12", "a = 3"), ("api/Dockerfile", _GOOD_IMAGE, "a = 3"),
    (".github/workflows/ci.yml", _WORKFLOWS[1], "b = 1"), (".github/workflows/ci.yml", _WORKFLOWS[2], "b = 2"),
    ("app/main.py", 'import logging\nlog = logging.getLogger()\n\n@app.get("/health")\ndef health():\n    """Doc."""\n    log.info("x")', "c = 0"),
    ("app/main.py", '@app.get("/items")\ndef items():\n    print(1)\n    print(2)', "c = 1"),
    ("app/a.py", "from app import b\n\ndef f():\n    return b", "c = 2"), ("app/b.py", "import app.a\nlogger.error('x')", "c = 2"),
    ("web/index.ts", "/** Doc. */\nexport function f() {}\nexport function g() {}\napp.get('/metrics', f)\nconsole.log(1)\nlogger.info(2)", "c = 3"),
    ("requirements.txt", "flask==2", "d = 0"), ("package.json", '{"dependencies": {"left-pad": "1"}}', "d = 1"), ("pyproject.toml", '[project]\ndependencies = ["fastapi>=1"]', "d = 2"), ("uv.lock", "", "d = 2"),
    ("compose.yaml", "services:\n" + _SERVICE.format("x", ", mem_limit: 1g, healthcheck: {test: y}"), "e = 3"),
    ("compose.yaml", "services:\n" + _SERVICE.format("x", ", cpus: 1") + "\n" + _SERVICE.format("y", ""), "e = 4"), ("compose.yaml", "services:\n" + _SERVICE.format("x", ""), "e > 4"),
    ("tests/test_x.py", "def test_x():\n    assert 1", "f = 1"), ("README.md", "# x", "run % 6 <> 1"), ("docs/adr/1.md", "x", "run % 11 = 0"), ("db/migrations/001.sql", "x", "run % 13 = 0"), ("openapi.yaml", "openapi: 3.0.0", "run % 17 = 0"),
]


def repositories(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Runs, and (run, path, text) of their files: a repository for each customer, put together by the remainders of its numbers."""
    k = F.col("c_custkey")
    parts = {"a": k % 4, "b": F.col("c_nationkey") % 3, "c": k % 5, "d": k % 3, "e": k % 7, "f": k % 2}
    runs = V.table(spark, sf_dir, "customer").select(k.alias("run"), *(c.alias(n) for n, c in parts.items()))
    known = F.array(*(F.when(F.expr(where), F.struct(F.lit(path).alias("path"), F.lit(text).alias("text"))) for path, text, where in _FILES))
    spread = runs.repartition(max(1, spark.sparkContext.defaultParallelism), "run")  # a row here stands for a whole repository
    return runs.select("run"), spread.select("run", F.inline(F.array_compact(known)))


# What each rule says of a repository, by hand: verdict, and the reason where there is one.
_SAYS = {
    "files.any_exists": ("CASE WHEN run % 6 <> 1 THEN 'pass' ELSE 'fail' END", "NULL"),
    "data.migrations_present": ("CASE WHEN run % 13 = 0 THEN 'pass' ELSE 'fail' END", "NULL"),
    "docs.architecture": ("CASE WHEN run % 11 = 0 THEN 'pass' ELSE 'fail' END", "NULL"),
    "docs.api_spec": ("CASE WHEN run % 17 = 0 OR d = 2 THEN 'pass' ELSE 'fail' END", "NULL"),
    "size.max_file_loc": ("CASE WHEN c <> 4 OR f = 1 THEN 'pass' ELSE 'not_applicable' END", "CASE WHEN c = 4 AND f = 0 THEN 'no_source_code' END"),
    "ast.debug_output_ratio": ("CASE WHEN c IN (0, 2) THEN 'pass' WHEN c = 4 THEN 'not_applicable' ELSE 'fail' END", "CASE WHEN c = 4 THEN 'no_output_calls' END"),
    "tests.ratio": ("CASE WHEN c = 4 THEN 'not_applicable' WHEN f = 0 THEN 'fail' WHEN c = 0 THEN 'partial' ELSE 'pass' END", "CASE WHEN c = 4 THEN 'no_source_code' END"),
    "docs.docstring_ratio": ("CASE c WHEN 0 THEN 'pass' WHEN 3 THEN 'partial' WHEN 4 THEN 'not_applicable' ELSE 'fail' END", "CASE WHEN c = 4 THEN 'no_public_functions' END"),
    "imports.any_of": ("CASE c WHEN 0 THEN 'pass' WHEN 2 THEN 'fail' ELSE 'not_applicable' END", "CASE WHEN c NOT IN (0, 2) THEN 'no_imports' END"),
    "imports.no_cycles": ("CASE WHEN c = 2 THEN 'fail' WHEN c = 4 AND f = 0 THEN 'not_applicable' ELSE 'pass' END", "CASE WHEN c = 4 AND f = 0 THEN 'language_not_supported' END"),
    "observability.present": ("CASE WHEN c IN (0, 3) THEN 'pass' ELSE 'fail' END", "NULL"),
    "tests.present": ("CASE WHEN f = 1 THEN 'pass' ELSE 'fail' END", "NULL"),
    "tests.coverage_configured": ("CASE WHEN b = 1 THEN 'pass' ELSE 'fail' END", "NULL"),
    "ci.present": ("CASE WHEN b = 0 THEN 'fail' ELSE 'pass' END", "NULL"),
    "ci.stages": ("CASE b WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'pass' ELSE 'partial' END", "CASE WHEN b = 0 THEN 'no_ci' END"),
    "ci.runs_tests": ("CASE b WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'pass' ELSE 'fail' END", "CASE WHEN b = 0 THEN 'no_ci' END"),
    "ci.permissions_restricted": ("CASE b WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'pass' ELSE 'fail' END", "CASE WHEN b = 0 THEN 'no_github_workflows' END"),
    "ci.actions_pinned": ("CASE b WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'pass' ELSE 'fail' END", "CASE WHEN b = 0 THEN 'no_github_workflows' END"),
    "docker.non_root": ("CASE a WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'fail' WHEN 2 THEN 'pass' ELSE 'partial' END", "CASE WHEN a = 0 THEN 'no_dockerfile' END"),
    "docker.pinned_base": ("CASE a WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'fail' ELSE 'pass' END", "CASE WHEN a = 0 THEN 'no_dockerfile' END"),
    "docker.multistage": ("CASE a WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'fail' WHEN 2 THEN 'pass' ELSE 'partial' END", "CASE WHEN a = 0 THEN 'no_dockerfile' END"),
    "docker.healthcheck": ("CASE WHEN a >= 2 OR e = 3 THEN 'pass' WHEN a = 1 OR e > 3 THEN 'fail' ELSE 'not_applicable' END", "CASE WHEN a = 0 AND e < 3 THEN 'no_container_config' END"),
    "deploy.resource_limits": ("CASE WHEN e < 3 THEN 'not_applicable' WHEN e = 3 THEN 'pass' WHEN e = 4 THEN 'partial' ELSE 'fail' END", "CASE WHEN e < 3 THEN 'no_deploy_config' END"),
    "deps.lockfile_present": ("CASE WHEN d = 1 THEN 'fail' ELSE 'pass' END", "NULL"),
}
_REPOS_SQL = "repos AS (SELECT c_custkey AS run, c_custkey % 4 AS a, c_nationkey % 3 AS b, c_custkey % 5 AS c, c_custkey % 3 AS d, c_custkey % 7 AS e, c_custkey % 2 AS f FROM customer)"
_VERDICTS_SQL = "verdicts AS (" + " UNION ALL ".join(
    "SELECT run, '{}' AS rule, {} AS verdict, {} AS reason FROM repos".format(c.rule, *_SAYS.get(c.rule, ("'unknown'", "'tool_not_run'"))) for c in RUBRIC
) + ")"
_SCORES_SQL = (
    "rubric(rule, metric, severity) AS (VALUES " + ", ".join(f"('{c.rule}', '{c.metric}', '{c.severity}')" for c in RUBRIC) + """),
weighed AS (SELECT *, CASE severity WHEN 'critical' THEN 50 WHEN 'high' THEN 30 WHEN 'medium' THEN 20 WHEN 'low' THEN 10 ELSE 0 END AS w10 FROM verdicts JOIN rubric USING (rule)),
sums AS (
    SELECT run, metric, sum(w10) FILTER (verdict <> 'not_applicable') AS w, coalesce(sum(w10) FILTER (verdict IN ('pass', 'partial', 'fail')), 0) AS sc,
           coalesce(sum(CASE verdict WHEN 'pass' THEN 2 * w10 WHEN 'partial' THEN w10 END), 0) AS num2, bool_or(severity = 'critical' AND verdict = 'fail') AS failed,
           bool_or(severity = 'critical' AND verdict = 'partial') AS halved FROM weighed GROUP BY run, metric),
scores AS (
    SELECT run, metric, CASE WHEN coalesce(w, 0) = 0 THEN 'not_applicable' WHEN sc = 0 THEN 'insufficient_evidence' WHEN failed OR halved OR sc * 100 >= w * 60 THEN 'scored' ELSE 'insufficient_evidence' END AS status,
           least((100 * num2 + sc) // nullif(2 * sc, 0), CASE WHEN failed THEN 40 WHEN halved THEN 60 ELSE 100 END)::BIGINT AS t FROM sums)"""
)


@query("assess_verdicts", "", f"WITH {_REPOS_SQL}, {_VERDICTS_SQL} SELECT run, rule, verdict, reason FROM verdicts")
def assess_verdicts(spark, sf_dir):
    """All rules over the facts that the extractors find in the files of every repository."""
    runs, files = repositories(spark, sf_dir)
    return assess(files, runs, RUBRIC).select("run", "rule", "verdict", "reason")


@query("assess_repo", "", f"WITH {_REPOS_SQL}, {_VERDICTS_SQL}, {_SCORES_SQL} SELECT run, metric, status, CASE WHEN status = 'scored' THEN t END AS tenths FROM scores")
def assess_repo(spark, sf_dir):
    """From the files of every repository to its scores."""
    runs, files = repositories(spark, sf_dir)
    return assessed_scores(assess(files, runs, RUBRIC), RUBRIC).select("run", "metric", "status", "tenths")


@query("assess_grade", "", f"""WITH {_REPOS_SQL}, {_VERDICTS_SQL}, {_SCORES_SQL},
o AS (SELECT run, count(*) AS n_scored, CASE WHEN count(*) >= 5 THEN (2 * sum(t) + count(*)) // (2 * count(*)) END::BIGINT AS tenths FROM scores WHERE status = 'scored' GROUP BY run)
SELECT *, CASE WHEN tenths >= 85 THEN 'A' WHEN tenths >= 70 THEN 'B' WHEN tenths >= 55 THEN 'C' WHEN tenths >= 40 THEN 'D' WHEN tenths IS NOT NULL THEN 'E' END AS grade FROM o""")
def assess_grade(spark, sf_dir):
    """The grade of every repository; metrics weigh alike."""
    runs, files = repositories(spark, sf_dir)
    return overall(assessed_scores(assess(files, runs, RUBRIC), RUBRIC), weights=F.lit(1))
