"""The profile of a repository: sixteen flags and six lists, each by one aggregate over files and facts of all runs at once."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import fixed
from quillon.plans.cases import cases, cases_sql
from quillon.registry import query

FLAGS = (
    "has_http_api", "has_database", "has_message_consumer", "has_outbound_http", "has_dockerfile", "has_compose", "has_k8s", "has_iac", "has_ci", "has_deploy_step", "has_tests",
    *fixed.LANGUAGE_FLAGS,
)
#: The least share of the lines of code that makes a language one of the repository's.
SHARE = 0.10


def begins_with(name: Column, prefixes: tuple[str, ...]) -> Column:
    """A name, whatever its capitals, is one of the prefixes or goes on after it with a dot, slash or hyphen."""
    return F.coalesce(F.lower(name).rlike("^(" + "|".join(map(re.escape, prefixes)) + ")([./-].*)?$"), F.lit(False))


def detected(name: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The labels whose prefixes a name begins with."""
    return F.array_compact(F.array(*(F.when(begins_with(name, prefixes), label) for label, prefixes in table.items())))


def outbound_call(language: Column, text: Column) -> Column:
    """Whether a text calls out without an import that would show it."""
    out = F.lit(False)
    for name, pattern in fixed.OUTBOUND_TEXT.items():
        out = F.when(language == name, F.coalesce(text.rlike(pattern), F.lit(False))).otherwise(out)
    return out


def tells(path: Column, language: Column) -> Column:
    """Whether a profile can depend on a file, as it may on code, and on what is known by its path."""
    named = reduce(or_, (path.rlike(p) for p in (fixed.K8S_MARKERS, fixed.IAC_FILES, fixed.ENTRYPOINTS, *(p for _, p in fixed.PACKAGE_MANAGERS))))
    return F.coalesce(language.isin("dockerfile", *fixed.CODE_LANGUAGES, *fixed.OUTBOUND_TEXT, *(n for names in fixed.LANGUAGE_FLAGS.values() for n in names)), F.lit(False)) | named


def profiles(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(run, flags, frameworks, package_managers, ci_systems, test_frameworks, entrypoints, languages).

    ``files`` is (run, path, language, loc, text, vendored, generated, readable);
    ``facts`` is (run, kind, name), name being what the profile reads of a fact: a
    package, an external module, a kind of deployment, a system, a step's kind or a
    test framework. ``flags`` maps every flag to true or false; lists are sorted,
    languages by lines of code.
    """
    own, code = ~F.col("vendored"), ~F.col("vendored") & ~F.col("generated")
    loc = lambda names: F.coalesce(F.sum(F.when(code & F.col("language").isin(*names), F.col("loc"))), F.lit(0))
    some = lambda condition: F.coalesce(F.bool_or(condition), F.lit(False))
    listed = lambda value: F.array_sort(F.collect_set(value))
    managers = F.array_compact(F.array(*(F.when(own & F.col("path").rlike(p), name) for name, p in fixed.PACKAGE_MANAGERS)))
    by_file = files.groupBy("run").agg(
        some(own & (F.col("language") == "dockerfile")).alias("dockerfile"), some(own & F.col("path").rlike(fixed.K8S_MARKERS)).alias("k8s"), some(own & F.col("path").rlike(fixed.IAC_FILES)).alias("iac"),
        some(code & F.col("readable") & outbound_call(F.col("language"), F.col("text"))).alias("calls"), listed(F.when(own & F.col("path").rlike(fixed.ENTRYPOINTS), F.col("path"))).alias("entrypoints"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(managers)))).alias("package_managers"), loc(fixed.CODE_LANGUAGES).alias("total"), *(loc(names).alias(flag) for flag, names in fixed.LANGUAGE_FLAGS.items()),
    )
    sums = files.filter(code & F.col("language").isin(*fixed.CODE_LANGUAGES)).groupBy("run", "language").agg(F.sum("loc").alias("n"))
    languages = sums.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "language"))), lambda x: x["language"]).alias("languages"))

    kind, name = F.col("kind"), F.col("name")
    named = kind.isin("dependency", "import_edge")
    labels = {key: F.when(named, detected(name, table)).otherwise(F.array().cast("array<string>")) for key, table in (("http", fixed.HTTP_FRAMEWORKS), ("data", fixed.DATA_LIBRARIES), ("messaging", fixed.MESSAGING))}
    rows = facts.withColumns(labels)
    by_fact = rows.groupBy("run").agg(
        some(kind == "route").alias("route"), some((kind == "deploy_config") & (name == "compose_service")).alias("compose"), some((kind == "deploy_config") & (name == "k8s_workload")).alias("workload"), some(kind == "ci_workflow").alias("ci"),
        some((kind == "ci_step") & (name == "deploy")).alias("deploys"), some(kind == "test_file").alias("tests"), some(named & begins_with(name, fixed.OUTBOUND_HTTP)).alias("outbound"),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_set(k)))).alias(k) for k in labels), listed(F.when(kind == "ci_workflow", name)).alias("ci_systems"), listed(F.when(kind == "test_file", name)).alias("test_frameworks"),
    )
    both = by_file.join(by_fact, "run", "full").join(languages, "run", "left")
    yes = lambda *columns: F.coalesce(*(F.col(c) for c in columns), F.lit(False))
    any_of = lambda key: F.coalesce(F.size(key) > 0, F.lit(False))
    flags = {
        "has_http_api": yes("route") | any_of("http"), "has_database": any_of("data"), "has_message_consumer": any_of("messaging"), "has_outbound_http": yes("outbound") | yes("calls"), "has_dockerfile": yes("dockerfile"), "has_compose": yes("compose"),
        "has_k8s": yes("workload") | yes("k8s"), "has_iac": yes("iac"), "has_ci": yes("ci"), "has_deploy_step": yes("deploys"), "has_tests": yes("tests"),
    } | {flag: F.coalesce((F.col("total") > 0) & (F.col(flag) / F.greatest(F.col("total"), F.lit(1)) >= SHARE), F.lit(False)) for flag in fixed.LANGUAGE_FLAGS}
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(c, empty).alias(c) for c in ("package_managers", "ci_systems", "test_frameworks", "entrypoints", "languages")]
    frameworks = F.array_sort(F.array_union(F.array_union(F.coalesce("http", empty), F.coalesce("data", empty)), F.coalesce("messaging", empty)))
    return both.select("run", F.map_from_arrays(F.array(*map(F.lit, FLAGS)), F.array(*(flags[f] for f in FLAGS))).alias("flags"), frameworks.alias("frameworks"), *lists)


_FILE = "path:string,language:string,loc:int,text:string,vendored:boolean,generated:boolean,readable:boolean"


def _file(path: str, language: str | None, loc: int = 10, text: str = "", vendored: bool = False, generated: bool = False, readable: bool = True) -> tuple:
    return path, language, loc, text, vendored, generated, readable


_RUNS = [
    (
        [_file("src/app/main.py", "python", 900), _file("web/index.ts", "typescript", 99, "fetch('x')"), _file("Dockerfile", "dockerfile"), _file("uv.lock", None), _file("infra/a.tf", "terraform"), _file("dist/x.js", "javascript", 5000, generated=True), _file("requirements-dev.txt", None)],
        [("dependency", "FastAPI"), ("import_edge", "sqlalchemy.orm"), ("dependency", "celery-beat"), ("import_edge", "requestsx"), ("deploy_config", "compose_service"), ("ci_workflow", "github_actions"), ("ci_step", "deploy"), ("test_file", "pytest")],
    ),
    (
        [_file("cmd/main.go", "go", 50), _file("go.mod", None), _file("Program.cs", "csharp", 50, "var c = new HttpClient();", readable=False), _file("vendor/Dockerfile", "dockerfile", vendored=True), _file("charts/Chart.yaml", "yaml"), _file("Application.kt", "kotlin", 11), _file("vendor/package-lock.json", None, vendored=True)],
        [("import_edge", "net/http"), ("import_edge", "github.com/jackc/pgx/v5"), ("dependency", "nextra"), ("deploy_config", "k8s_workload"), ("ci_step", "test"), ("route", None)],
    ),
    ([_file("README.md", "markdown")], []),
    ([_file("a.ts", "typescript", 1, "fetch(url)"), _file("b.cs", "csharp", 9, "IHttpClientFactory f")], [("dependency", "next"), ("dependency", "@nestjs/common"), ("dependency", "pg-pool"), ("test_file", "js"), ("test_file", "dotnet"), ("test_file", "js")]),
]
_ON = [
    {"has_http_api", "has_database", "has_message_consumer", "has_dockerfile", "has_compose", "has_iac", "has_ci", "has_deploy_step", "has_tests", "has_outbound_http", "lang_python"},
    {"has_http_api", "has_database", "has_outbound_http", "has_k8s", "lang_go", "lang_dotnet"},
    set(),
    {"has_http_api", "has_database", "has_outbound_http", "has_tests", "lang_js_ts", "lang_dotnet"},
]
_LISTS = [
    ("celery,fastapi,sqlalchemy", "pip,uv", "github_actions", "pytest", "src/app/main.py", "python,typescript"),
    ("go-sql", "go-modules", "", "", "Application.kt,Program.cs,cmd/main.go", "csharp,go,kotlin"),
    ("", "", "", "", "", ""),
    ("knex,nestjs,nextjs", "", "", "dotnet,js", "", "csharp,typescript"),
]
_ON[1] |= {"lang_java"} if 11 / 111 >= SHARE else set()


def example_profiles(spark, sf_dir) -> DataFrame:
    rows = cases(spark, sf_dir, _RUNS, f"files array<struct<{_FILE}>>, facts array<struct<kind:string,name:string>>").withColumnRenamed("id", "run")
    return profiles(rows.select("run", F.inline("files")), rows.select("run", F.inline("facts")))


@query("agg_profile", "", cases_sql(len(_RUNS), "VARCHAR flag, VARCHAR is_on", [(k, flag, str(flag in on).lower()) for k, on in enumerate(_ON) for flag in FLAGS]))
def agg_profile(spark, sf_dir):
    """All sixteen flags of each run."""
    return example_profiles(spark, sf_dir).select(F.col("run").alias("id"), F.explode("flags").alias("flag", "is_on")).withColumn("is_on", F.col("is_on").cast("string"))


@query("agg_profile_lists", "", cases_sql(len(_RUNS), "VARCHAR frameworks, VARCHAR package_managers, VARCHAR ci_systems, VARCHAR test_frameworks, VARCHAR entrypoints, VARCHAR languages", [(k, *row) for k, row in enumerate(_LISTS)]))
def agg_profile_lists(spark, sf_dir):
    names = ("frameworks", "package_managers", "ci_systems", "test_frameworks", "entrypoints", "languages")
    return example_profiles(spark, sf_dir).select(F.col("run").alias("id"), *(F.array_join(c, ",").alias(c) for c in names))
