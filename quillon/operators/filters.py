"""Row filters: applicability, file classes, globs, images, workflows, searches, paths and addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import exprs as E
from quillon.functions import fixed
from quillon.plans import views as V
from quillon.plans.cases import cases, cases_sql
from quillon.registry import query

LARGEST_DATA_FILE = 64_000
SOURCE_LANGUAGES = ("python", "typescript", "csharp", "go", "java")


def facts_by_kind(facts: DataFrame, *kinds: str) -> DataFrame:
    """Facts of the kinds; their order is the column ``ord``, as tables have none."""
    return facts.filter(F.col("kind").isin(*kinds))


@query("flt_facts_by_kind", "lines", """SELECT doc_id, line_no, kind FROM (
    SELECT doc_id, line_no, CASE WHEN line LIKE '%token = %' THEN 'secret' WHEN line LIKE '%MIT%' OR line LIKE '%Apache%' THEN 'license' ELSE 'text' END AS kind FROM lines)
WHERE kind IN ('secret', 'license')""")
def flt_facts_by_kind(spark, sf_dir):
    line = F.col("line")
    kind = F.when(line.contains("token = "), "secret").when(line.contains("MIT") | line.contains("Apache"), "license").otherwise("text")
    return facts_by_kind(V.lines(spark, sf_dir).select("doc_id", "line_no", kind.alias("kind")), "secret", "license")


def applies_when(on: Column, all_: Column, any_: Column, none: Column) -> Column:
    """All of ``all_`` are on, any of ``any_`` is (or it is empty), none of ``none`` is; flags not listed are off."""
    return (F.size(F.array_except(all_, on)) == 0) & ((F.size(any_) == 0) | F.arrays_overlap(any_, on)) & ~F.arrays_overlap(none, on)


@query("flt_applies_when", "checks", """
WITH flags AS (SELECT o_orderkey % 2 = 0 AS py, o_orderkey % 3 = 0 AS web, o_orderkey % 5 = 0 AS docker, count(*) AS n FROM orders GROUP BY 1, 2, 3)
SELECT check_id, sum(n)::BIGINT AS n_runs FROM checks CROSS JOIN flags
WHERE (check_id % 2 <> 0 OR py) AND (check_id % 3 <> 0 OR web OR docker) AND (check_id % 7 <> 0 OR NOT docker) GROUP BY check_id""")
def flt_applies_when(spark, sf_dir):
    """For each check the number of runs, of all, that it applies to. A run's flags are one of few profiles, so each check is tried once a profile."""
    k, c = F.col("o_orderkey"), F.col("check_id")
    on = F.array_compact(F.array(F.when(k % 2 == 0, "py"), F.when(k % 3 == 0, "web"), F.when(k % 5 == 0, "docker")))
    runs = V.table(spark, sf_dir, "orders").select(k.alias("run"), on.alias("on"))
    none = F.array().cast("array<string>")
    rules = V.checks(spark, sf_dir).select(
        "check_id", F.when(c % 2 == 0, F.array(F.lit("py"))).otherwise(none).alias("all"), F.when(c % 3 == 0, F.array(F.lit("web"), F.lit("docker"))).otherwise(none).alias("any"), F.when(c % 7 == 0, F.array(F.lit("docker"))).otherwise(none).alias("none"),
    )
    profiles = runs.groupBy("on").agg(F.count("*").alias("n"))  # at most eight
    applies = rules.crossJoin(F.broadcast(profiles)).filter(applies_when(F.col("on"), F.col("all"), F.col("any"), F.col("none")))
    return applies.groupBy("check_id").agg(F.sum("n").alias("n_runs"))


@query("flt_applicable_checks", "checks", "SELECT check_id, metric, severity FROM checks WHERE NOT retired AND (check_id % 3 <> 0 OR severity <> 'info')")
def flt_applicable_checks(spark, sf_dir):
    return V.checks(spark, sf_dir).filter(~F.col("retired") & ((F.col("check_id") % 3 != 0) | (F.col("severity") != "info"))).select("check_id", "metric", "severity")


def _dirs(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def vendored(path: Column) -> Column:
    """Below a folder of vendored code or test data, or below a fixture folder that is itself below a test folder."""
    dirs = _dirs(path)
    at = lambda names: F.filter(F.transform(dirs, lambda d, i: F.when(d.isin(*names), i)), lambda i: i.isNotNull())
    known = F.arrays_overlap(dirs, F.array(*map(F.lit, (*fixed.VENDOR_DIRS, *fixed.DATA_DIRS))))
    return known | F.coalesce(F.array_max(at(fixed.FIXTURE_DIRS)) > F.array_min(at(fixed.TEST_DIRS)), F.lit(False))


def _one_of(names: tuple[str, ...]) -> str:
    return "(" + "|".join(map(re.escape, names)) + ")"


_VENDORED_SQL = f"(regexp_matches('/' || path, '/{_one_of((*fixed.VENDOR_DIRS, *fixed.DATA_DIRS))}/') OR regexp_matches('/' || path, '/{_one_of(fixed.TEST_DIRS)}/(.*/)?{_one_of(fixed.FIXTURE_DIRS)}/'))"


@query("flt_vendored_path", "files", f"SELECT path, {_VENDORED_SQL} AS vendored FROM files")
def flt_vendored_path(spark, sf_dir):
    return V.files(spark, sf_dir).select("path", vendored(F.col("path")).alias("vendored"))


GENERATED_PATH = rf"(^|/){_one_of(fixed.BUILD_DIRS)}/|{_one_of(fixed.GENERATED_SUFFIXES)}$|(^|/){_one_of(fixed.LOCKFILES)}$"


def generated(path: Column, text: Column) -> Column:
    """A lockfile, a suffix or folder of build output, or a marker in the first 1024 characters."""
    return path.rlike(GENERATED_PATH) | F.coalesce(F.substring(text, 1, 1024).rlike(fixed.GENERATED_MARKER), F.lit(False))


def test_path(path: Column) -> Column:
    return path.rlike(fixed.TEST_PATH)


test_path.__test__ = False

_GENERATED_SQL = f"(regexp_matches(path, '{GENERATED_PATH}') OR coalesce(regexp_matches(substr(text, 1, 1024), '{fixed.GENERATED_MARKER}'), false))"


@query("flt_generated", "files", f"SELECT path, {_GENERATED_SQL} AS generated FROM files")
def flt_generated(spark, sf_dir):
    return V.files(spark, sf_dir).select("path", generated(F.col("path"), F.col("text")).alias("generated"))


def source_files(files: DataFrame, languages=SOURCE_LANGUAGES, with_generated: bool = False) -> DataFrame:
    out = files.filter(F.col("language").isin(*languages) & ~vendored(F.col("path")))
    return out if with_generated else out.filter(~generated(F.col("path"), F.col("text")))


@query("flt_source_files", "files", f"SELECT path, language FROM files WHERE language IN ('python', 'typescript', 'csharp', 'go', 'java') AND NOT {_VENDORED_SQL} AND NOT {_GENERATED_SQL}")
def flt_source_files(spark, sf_dir):
    return source_files(V.files(spark, sf_dir)).select("path", "language")


@query("flt_test_path", "files", rf"SELECT path FROM files WHERE regexp_matches(path, '{fixed.TEST_PATH}')")
def flt_test_path(spark, sf_dir):
    return V.files(spark, sf_dir).filter(test_path(F.col("path"))).select("path")


@query("flt_glob", "files", r"""SELECT path, regexp_matches(path, '^src/([^/]+/)*mod[^/]*\.(py|ts)$') AS sources, regexp_matches(path, '^([^/]+/)*test_[^/]*$') AS tests,
       regexp_matches(path, '^src/[^/]*/en/[^/]*$') AS english FROM files""")
def flt_glob(spark, sf_dir):
    path = F.col("path")
    match = lambda g: path.rlike(E.glob_regex(g))
    return V.files(spark, sf_dir).select("path", match("src/**/mod*.{py,ts}").alias("sources"), match("**/test_*").alias("tests"), match("src/*/en/*").alias("english"))


def pinned_image(image: Column) -> Column:
    """Variables, scratch and digests are pinned; else a tag other than latest on the last segment."""
    last = F.element_at(F.split(image, "/"), -1)
    return F.when(image.contains("$") | (image == "scratch") | image.contains("@"), True).otherwise(last.contains(":") & ~last.endswith(":latest"))


_IMAGE_SQL = "CASE s_suppkey % 6 WHEN 0 THEN 'scratch' WHEN 1 THEN 'python:latest' WHEN 2 THEN 'registry:5000/app' WHEN 3 THEN 'registry:5000/app:' || s_suppkey WHEN 4 THEN 'node@sha256:' || s_suppkey ELSE '${BASE}' END"


@query("flt_pinned_image", "", f"""SELECT image, CASE WHEN contains(image, '$') OR image = 'scratch' OR contains(image, '@') THEN true
    ELSE contains(split_part(image, '/', -1), ':') AND NOT image LIKE '%:latest' END AS pinned FROM (SELECT {_IMAGE_SQL} AS image FROM supplier)""")
def flt_pinned_image(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    image = F.element_at(F.array(F.lit("scratch"), F.lit("python:latest"), F.lit("registry:5000/app"), F.concat(F.lit("registry:5000/app:"), k), F.concat(F.lit("node@sha256:"), k), F.lit("${BASE}")), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return V.table(spark, sf_dir, "supplier").select(image.alias("image")).withColumn("pinned", pinned_image(F.col("image")))


def restricted_workflow(top: Column, jobs: Column, given: Column) -> Column:
    """No job writes all, and the permissions at the top are set and not to write all, or every job has its own.

    ``given`` maps jobs to their permissions.
    """
    given = F.coalesce(given, F.create_map().cast("map<string,string>"))
    own = F.transform(jobs, lambda j: F.try_element_at(given, j))
    none = ~F.exists(own, lambda p: F.coalesce(p == "write-all", F.lit(False)))
    every = (F.size(jobs) > 0) & F.forall(own, lambda p: p.isNotNull())
    return none & (F.coalesce(top != "write-all", F.lit(False)) | every)


@query("flt_workflow_restricted", "", """SELECT o_orderkey AS id, coalesce(a, '') <> 'write-all' AND coalesce(b, '') <> 'write-all' AND (coalesce(t, 'write-all') <> 'write-all' OR (a IS NOT NULL AND b IS NOT NULL)) AS restricted
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write-all' END AS t, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'write-all' ELSE 'read' END AS a, CASE WHEN o_custkey % 2 = 0 THEN 'read' END AS b FROM orders)""")
def flt_workflow_restricted(spark, sf_dir):
    k = F.col("o_orderkey")
    a = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "write-all").otherwise("read")
    given = F.create_map(F.lit("build"), a, F.lit("test"), F.when(F.col("o_custkey") % 2 == 0, "read"))
    top, jobs = F.when(k % 3 == 0, "read").when(k % 3 == 1, "write-all"), F.array(F.lit("build"), F.lit("test"))
    return V.table(spark, sf_dir, "orders").select(k.alias("id"), restricted_workflow(top, jobs, given).alias("restricted"))


def search_findings(rows: DataFrame, needle: str, verdicts, severities, limit: int) -> DataFrame:
    """Matching findings in order of severity and id, with the total before the limit."""
    hit = rows.filter(F.col("verdict").isin(*verdicts) & F.col("severity").isin(*severities) & F.lower("title").contains(needle.lower()))
    total = hit.agg(F.count("*").alias("total"))
    top = hit.withColumn("rank", E.severity_rank(F.col("severity"))).orderBy(F.desc("rank"), "check_id", "run").limit(limit)
    return top.crossJoin(F.broadcast(total)).drop("rank")


@query("flt_search_findings", "checks findings", """
WITH hit AS (SELECT f.run, f.check_id, c.severity, f.verdict, p.p_name AS title, CASE c.severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS r
    FROM findings f JOIN checks c ON f.check_id = c.check_id JOIN part p ON p.p_partkey = c.check_id
    WHERE f.verdict IN ('fail', 'partial') AND c.severity IN ('critical', 'high') AND contains(lower(p.p_name), 'ring'))
SELECT run, check_id, severity, verdict, title, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY r DESC, check_id, run LIMIT 25""")
def flt_search_findings(spark, sf_dir):
    titles = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("check_id"), F.col("p_name").alias("title"))
    rows = V.findings(spark, sf_dir).join(V.checks(spark, sf_dir), "check_id").join(titles, "check_id").select("run", "check_id", "severity", "verdict", "title")
    return search_findings(rows, "Ring", ("fail", "partial"), ("critical", "high"), 25)


def path_allowed(path: Column) -> Column:
    """Relative, without drive, backslash or a parent step."""
    return ~(path.startswith("/") | path.rlike(r"^[A-Za-z]:") | path.contains("\\") | path.rlike(r"(^|/)\.\.(/|$)") | (path == ""))


@query("flt_path_jail", "files", r"""SELECT doc_id, NOT (starts_with(p, '/') OR regexp_matches(p, '^[A-Za-z]:') OR contains(p, chr(92)) OR regexp_matches(p, '(^|/)\.\.(/|$)') OR p = '') AS allowed
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '/' || path WHEN 1 THEN 'C:' || path WHEN 2 THEN 'a/../' || path WHEN 3 THEN 'a..b/' || path ELSE path END AS p FROM files)""")
def flt_path_jail(spark, sf_dir):
    i, path = F.col("doc_id"), F.col("path")
    bad = F.when(i % 5 == 0, F.concat(F.lit("/"), path)).when(i % 5 == 1, F.concat(F.lit("C:"), path)).when(i % 5 == 2, F.concat(F.lit("a/../"), path)).when(i % 5 == 3, F.concat(F.lit("a..b/"), path)).otherwise(path)
    return V.files(spark, sf_dir).select("doc_id", path_allowed(bad).alias("allowed"))


def url_allowed(url: Column, hosts: tuple[str, ...]) -> Column:
    """https, a listed host without user or port, exactly owner and repository, no query or fragment."""
    names = "|".join(h.replace(".", r"\.") for h in hosts)
    return url.rlike(rf"^https://({names})/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/?$")


_URL_RE = r"^https://(m\.ththth\.example\.net|shth\.example\.org)/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/?$"


@query("flt_url_policy", "", f"SELECT page_id, regexp_matches(url, '{_URL_RE}') AS allowed, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
def flt_url_policy(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", url_allowed(F.col("url"), ("m.ththth.example.net", "shth.example.org")).alias("allowed"), F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"))


@query("flt_indexable", "files", f"SELECT path FROM files WHERE NOT {_VENDORED_SQL} AND NOT {_GENERATED_SQL} AND (language NOT IN ('json', 'yaml') OR size <= 64000)")
def flt_indexable(spark, sf_dir):
    rows = V.files(spark, sf_dir).filter(~vendored(F.col("path")) & ~generated(F.col("path"), F.col("text")))
    return rows.filter(~F.col("language").isin("json", "yaml") | (F.col("size") <= LARGEST_DATA_FILE)).select("path")


def project_facts(facts: DataFrame, evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Facts that are secrets or attempted injections, have no evidence in code, or have some outside vendored files."""
    where = evidence.join(files.select("path", vendored(F.col("path")).alias("vendored")), "path")
    own = where.groupBy("fact_id").agg(F.bool_or(~F.col("vendored")).alias("own"))
    return facts.join(own, "fact_id", "left").filter(F.col("kind").isin("secret", "injection_attempt") | F.coalesce("own", F.lit(True))).drop("own")


@query("flt_project_facts", "files", f"""
WITH facts AS (SELECT doc_id AS fact_id, CASE WHEN doc_id % 9 = 0 THEN 'secret' WHEN doc_id % 10 = 0 THEN 'injection_attempt' ELSE 'route' END AS kind FROM documents),
own AS (SELECT f.fact_id, bool_or(NOT {_VENDORED_SQL}) AS own FROM facts f JOIN files d ON d.doc_id = f.fact_id OR d.doc_id = f.fact_id + 1 WHERE f.fact_id % 4 <> 0 GROUP BY f.fact_id)
SELECT f.fact_id, f.kind FROM facts f LEFT JOIN own ON own.fact_id = f.fact_id WHERE f.kind IN ('secret', 'injection_attempt') OR coalesce(own.own, true)""")
def flt_project_facts(spark, sf_dir):
    files = V.files(spark, sf_dir).select("doc_id", "path")
    facts = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fact_id"), F.when(F.col("doc_id") % 9 == 0, "secret").when(F.col("doc_id") % 10 == 0, "injection_attempt").otherwise("route").alias("kind"))
    evidence = files.select(F.explode(F.array(F.col("doc_id"), F.col("doc_id") - 1)).alias("fact_id"), "path").filter("fact_id % 4 <> 0")
    return project_facts(facts, evidence.join(facts, "fact_id", "left_semi"), files)


# Paths and the first line of each file; by hand: vendored, generated, test, language, type of documentation.
_PATHS = [
    ("src/app/main.py", "x = 1", False, False, False, "python", None),
    ("node_modules/a/index.js", "", True, False, False, "javascript", None),
    ("web/.venv/lib/x.pyi", "", True, False, False, "python", None),
    ("tests/fixtures/a.go", "", True, False, True, "go", None),
    ("fixtures/a.rs", "", False, False, False, "rust", None),
    ("fixtures/tests/a.rb", "", False, False, True, "ruby", None),
    ("src/__snapshots__/x.ts", "", True, False, False, "typescript", None),
    ("Pods/x.swift", "", True, False, False, "swift", None),
    ("dist/app.css", "", False, True, False, "css", None),
    ("a/b.min.js", "", False, True, False, "javascript", None),
    ("proto/x_pb2.py", "", False, True, False, "python", None),
    ("uv.lock", "", False, True, False, None, None),
    ("api/go.sum", "", False, True, False, None, None),
    ("a/client.ts", "// This file is auto-generated by a tool", False, True, False, "typescript", None),
    ("a/model.go", "// Code generated by protoc. DO NOT EDIT.", False, True, False, "go", None),
    ("a/id.py", "# id is auto-generated by the database", False, False, False, "python", None),
    ("a/0002.py", "# Generated by Django 4.2", False, True, False, "python", None),
    ("pkg/x_test.go", "", False, False, True, "go", None),
    ("a/App.spec.tsx", "", False, False, True, "typescript", None),
    ("src/test/java/A.java", "", False, False, True, "java", None),
    ("a/OrderTests.cs", "", False, False, True, "csharp", None),
    ("test_util.py", "", False, False, True, "python", None),
    ("a/contest.py", "", False, False, False, "python", None),
    ("Dockerfile", "", False, False, False, "dockerfile", None),
    ("a/Dockerfile.dev", "", False, False, False, "dockerfile", None),
    ("a/web.Dockerfile", "", False, False, False, "dockerfile", None),
    ("Containerfile", "", False, False, False, "dockerfile", None),
    ("x/Makefile", "", False, False, False, "make", None),
    ("x/A.KT", "", False, False, False, "kotlin", None),
    ("LICENSE", "", False, False, False, None, None),
    ("README.md", "", False, False, False, "markdown", "readme"),
    ("docs/adr/0001.md", "", False, False, False, "markdown", "adr"),
    ("docs/ARCHITECTURE-v2.rst", "", False, False, False, None, "architecture"),
    ("api/openapi.v1.yaml", "", False, False, False, "yaml", "openapi"),
    ("CONTRIBUTING", "", False, False, False, None, "contributing"),
    ("a/CHANGES.txt", "", False, False, False, None, "changelog"),
    ("notes/readme-old.md", "", False, False, False, "markdown", None),
]


@query("flt_path_classes", "", cases_sql(len(_PATHS), "VARCHAR path, BOOLEAN vendored, BOOLEAN generated, BOOLEAN test, VARCHAR language, VARCHAR doc_type", [(k, p, *rest) for k, (p, _, *rest) in enumerate(_PATHS)]))
def flt_path_classes(spark, sf_dir):
    """Every class of every path, by the full tables of names."""
    from quillon.operators.extract import doc_type
    from quillon.sources.stores import language_of

    rows = cases(spark, sf_dir, [(p, t) for p, t, *_ in _PATHS], "path string, text string")
    path = F.col("path")
    return rows.select("id", "path", vendored(path).alias("vendored"), generated(path, F.col("text")).alias("generated"), test_path(path).alias("test"), language_of(path).alias("language"), doc_type(path).alias("doc_type"))


def action_pinned(uses: Column) -> Column:
    """Local actions, images, and references to a commit of 40 hex digits."""
    return uses.startswith("./") | uses.startswith("docker://") | uses.rlike("@[0-9a-f]{40}$")


def key_valid(kind: str, value: Column) -> Column:
    """Whether a name may be one of a stored thing of that kind."""
    return value.rlike(fixed.KEY_PATTERNS[kind].replace("$", r"\z"))


_KEYS = [
    ("run_id", "run-1_A", True), ("run_id", "", False), ("run_id", "a/b", False), ("run_id", "a" * 65, False), ("run_id", "x\n", False), ("artifact", "report.json", True), ("artifact", ".hidden", False), ("checkpoint", "evaluate/security", True),
    ("checkpoint", "a/b/c", False), ("checkpoint", "Facts", False), ("namespace", "embed", True), ("namespace", "a-b", False), ("cache_key", "m:1.2_x-", True), ("cache_key", "a b", False), ("key_id", "0123abcd", True), ("key_id", "0123ABCD", False),
]


@query("flt_key_valid", "", cases_sql(len(_KEYS), "VARCHAR kind, BOOLEAN valid", [(k, kind, ok) for k, (kind, _, ok) in enumerate(_KEYS)]))
def flt_key_valid(spark, sf_dir):
    valid = F.lit(False)
    for kind in fixed.KEY_PATTERNS:
        valid = F.when(F.col("kind") == kind, key_valid(kind, F.col("value"))).otherwise(valid)
    return cases(spark, sf_dir, [(kind, value) for kind, value, _ in _KEYS], "kind string, value string").select("id", "kind", valid.alias("valid"))


_USES = [("actions/checkout@v4", False), ("./.github/actions/x", True), ("docker://alpine:3", True), ("docker://x@sha", True), ("o/r@" + "a" * 40, True), ("o/r@" + "a" * 39, False), ("o/r/sub@main", False)]


@query("flt_action_pinned", "", cases_sql(len(_USES), "VARCHAR uses, BOOLEAN pinned", [(k, *row) for k, row in enumerate(_USES)]))
def flt_action_pinned(spark, sf_dir):
    return cases(spark, sf_dir, [(u,) for u, _ in _USES], "uses string").select("id", "uses", action_pinned(F.col("uses")).alias("pinned"))


def user_not_root(user: Column) -> Column:
    """A user is set, and the part before a colon is not root by name or number."""
    name = F.trim(F.coalesce(user, F.lit("")))
    return (name != "") & ~F.element_at(F.split(name, ":"), 1).isin("root", "0")


_USERS = [(None, False), ("", False), (" app ", True), ("root", False), ("0:0", False), ("root:app", False), ("1000:0", True), ("rooter", True)]


@query("flt_non_root", "", cases_sql(len(_USERS), "VARCHAR user, BOOLEAN non_root", [(k, *row) for k, row in enumerate(_USERS)]))
def flt_non_root(spark, sf_dir):
    return cases(spark, sf_dir, [(u,) for u, _ in _USERS], "user string").select("id", "user", user_not_root(F.col("user")).alias("non_root"))


def fact_path(evidence: Column, attributes: Column) -> Column:
    """The file a fact is about: its first evidence in code, else the attribute file, manifest or path; null if none is a text."""
    first = F.try_element_at(F.filter(evidence, lambda e: e["kind"] == "code"), F.lit(1))["path"]
    named = [F.when(F.get_json_object(attributes, f"$.{k}") != "", F.get_json_object(attributes, f"$.{k}")) for k in ("file", "manifest", "path")]
    return F.coalesce(first, *named)


_FACTS = [
    ([("scan", None), ("code", "a.py"), ("code", "b.py")], '{"path": "c"}', "a.py"), ([("scan", None)], '{"manifest": "m.toml", "path": "p"}', "m.toml"), ([], '{"file": "f", "manifest": "m"}', "f"), ([], '{"file": "", "path": "p"}', "p"), ([], "{}", None),
]


@query("flt_fact_path", "", cases_sql(len(_FACTS), "VARCHAR path", [(k, row[2]) for k, row in enumerate(_FACTS)]))
def flt_fact_path(spark, sf_dir):
    rows = cases(spark, sf_dir, [row[:2] for row in _FACTS], "evidence array<struct<kind:string,path:string>>, attributes string")
    return rows.select("id", fact_path(F.col("evidence"), F.col("attributes")).alias("path"))
