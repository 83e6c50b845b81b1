"""Deterministic rules: facts in, one verdict row a run out, with missing tools told apart.

A fact is (run, kind, path, severity, attributes), attributes being JSON with the
names and types that ``fixed.FACT_ATTRIBUTES`` gives its kind. Files of a
snapshot are facts of the kind ``file`` (attributes text, vendored, unreadable),
flags and frameworks of a profile facts of the kinds ``flag`` and ``framework``.

A rule says which facts it is about and what follows from them, as aggregates
over conditions. So any number of rules are one grouped scan of the facts, whose
attributes are parsed once; only cycles of imports are looked for apart.
"""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import exprs as E
from quillon.functions import fixed
from quillon.operators.filters import action_pinned, pinned_image, restricted_workflow, user_not_root
from quillon.operators.versions import Alike
from quillon.plans import views as V
from quillon.plans.cases import cases, cases_sql
from quillon.registry import query
from quillon.sources.tables import stored

_NAME = re.compile(r"^[a-z]+\.[a-z_]+$")


@dataclass(frozen=True)
class Outcome:
    """What facts say: ``about`` holds for the facts that count; verdict and reason are aggregates over a run's facts.

    A run has an outcome if ``found`` holds: by default if it has any fact that counts.
    ``hits`` are the facts that the verdict points to: by default those that count.
    Facts that ``lacks`` holds for make the verdict unknown.
    """

    about: Column
    verdict: Column
    reason: Column | None = None
    found: Column | None = None
    hits: Column | None = None
    lacks: Column | None = None


@dataclass(frozen=True)
class Rule:
    """``outcome``: params to an ``Outcome``, or (facts, **params) to (run, verdict, reason) if ``apart``; ``empty``: verdict and reason of runs without one.

    ``kinds`` are those of the facts that it looks at.
    """

    outcome: Callable
    tools: tuple[str, ...]
    kinds: tuple[str, ...]
    empty: tuple[str, str | None]
    defaults: dict
    apart: bool = False


_RULES: dict[str, Rule] = {}


def rule(name: str, *tools: str, kinds: str, empty: tuple[str, str | None] = ("pass", None), apart: bool = False, **defaults) -> Callable:
    """Register an outcome as ``family.name``, which depends on ``tools`` and on facts of ``kinds`` alone; names are unique."""
    if not _NAME.match(name) or name in _RULES:
        raise ValueError(f"bad or duplicate rule name {name}")

    def register(function: Callable) -> Callable:
        _RULES[name] = Rule(function, tools, tuple(kinds.split()), empty, defaults, apart)
        return function

    return register


def rule_names() -> list[str]:
    return sorted(_RULES)


def _valid(value: object, default: object) -> bool:
    number = isinstance(default, (int, float)) and isinstance(value, (int, float))
    both = isinstance(default, (list, tuple)) and isinstance(value, (list, tuple))
    return (number and not isinstance(value, bool)) or both or type(value) is type(default)


def last_tool_runs(tool_runs: DataFrame) -> DataFrame:
    """(run, tool, tool_status): the last record of each, by ``ord`` where there is one."""
    if "ord" not in tool_runs.columns:
        return tool_runs.select("run", "tool", "tool_status").distinct()
    return tool_runs.groupBy("run", "tool").agg(F.max_by("tool_status", "ord").alias("tool_status"))


#: All attributes of all kinds, as one schema; a name has one type whatever the kind.
_ATTRIBUTES = ", ".join(f"`{n}` {t}" for n, t in sorted({(n, t) for kind in fixed.FACT_ATTRIBUTES.values() for n, t in kind.items()}))


def typed(facts: DataFrame) -> DataFrame:
    """Facts with their attributes parsed as ``a``; what isn't JSON, or of another type, is null."""
    return facts.select("run", "kind", "path", "severity", F.from_json("attributes", _ATTRIBUTES).alias("a"))


VERDICTS = "run, rule, verdict, reason, n_facts, place"


def run_rules(
    chosen: Mapping[str, dict | None], facts: DataFrame, runs: DataFrame, tool_runs: DataFrame | None = None
) -> DataFrame:
    """(run, rule, verdict, reason, n_facts, place) of every run and rule, by one grouped scan of the facts.

    ``chosen`` has the rules' parameters by name. Unknown rules, bad parameters, broken
    rules and missing tools give rows, not errors. ``n_facts`` counts the facts that a
    verdict points to, ``place`` is the first of their paths. ``tool_runs`` has (run,
    tool, tool_status) and perhaps ord: a skipped tool makes a rule not applicable, one
    that failed or has no record makes it unknown.
    """
    lost, ready, apart = [], {}, {}
    try:
        rows = typed(facts)
    except PySparkException:
        rows = None
    for name, params in chosen.items():
        of = _RULES.get(name)
        if not of:
            lost.append((name, "rule_unknown"))
        elif set(params or {}) - set(of.defaults) or any(not _valid(v, of.defaults[k]) for k, v in (params or {}).items()):
            lost.append((name, "params_invalid"))
        elif rows is None:
            lost.append((name, "rule_error"))
        else:
            try:
                if of.apart:
                    apart[name] = of.outcome(rows, **(of.defaults | (params or {}))).select("run", "verdict", "reason")
                else:
                    ready[name] = of.outcome(**(of.defaults | (params or {})))
            except (PySparkException, ValueError, TypeError, KeyError, re.error):
                lost.append((name, "rule_error"))
    out = _judged(ready, rows, runs, tool_runs) if ready else None
    for name, found in apart.items():
        one = runs.select("run").join(found, "run", "left").withColumns({"found": F.col("verdict").isNotNull(), "n_facts": F.lit(0).cast("long"), "place": F.lit(None).cast("string")})
        one = _concluded([name], one.select("run", F.struct("found", "verdict", "reason", "n_facts", "place").alias("r0")), runs, tool_runs)
        out = one if out is None else out.unionByName(one)
    if lost:
        names = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(r).alias("reason")) for n, r in lost))).alias("x")
        gone = runs.select("run", names).select("run", "x.rule", F.lit("unknown").alias("verdict"), "x.reason", F.lit(0).cast("long").alias("n_facts"), F.lit(None).cast("string").alias("place"))
        out = gone if out is None else out.unionByName(gone)
    return out


def run_rules_once(
    chosen: Mapping[str, dict | None], facts: DataFrame, runs: DataFrame, tool_runs: DataFrame | None = None, everywhere: Mapping[str, str] | None = None
) -> DataFrame:
    """As ``run_rules``, for many runs that are alike in parts: rules on the same kinds of facts are asked once for each different set of such facts.

    ``everywhere`` has the states of tools that are the same in all runs. Where most
    sets differ, the runs themselves are asked.
    """
    parts: dict[tuple, list[str]] = {}
    for name in chosen:
        parts.setdefault(_RULES[name].kinds if name in _RULES else (), []).append(name)
    names, kinds = list(parts.values()), list(parts)
    tools = [sorted({t for n in some if n in _RULES for t in _RULES[n].tools}) for some in names]

    def shared(key: str, of: list) -> Column:
        at = {x: [i for i, mine in enumerate(of) if x in mine] for x in {x for mine in of for x in mine}}
        return F.explode(reduce(lambda out, x: F.when(F.col(key) == x, F.array(*map(F.lit, at[x]))).otherwise(out), sorted(at), F.lit(None).cast("array<int>"))).alias("part")

    columns = ["kind", "path", "severity", "attributes"]
    told = facts.select("run", shared("kind", kinds), *columns)
    ran = None
    if tool_runs is not None:
        last = last_tool_runs(tool_runs)
        ran = last.select("run", shared("tool", tools), "tool", "tool_status")
        as_fact = ran.select("run", "part", F.lit("").alias("kind"), F.col("tool").alias("path"), F.col("tool_status").alias("severity"), F.lit(None).cast("string").alias("attributes"))
    alike = Alike((told if ran is None else told.unionByName(as_fact)).withColumn("of", F.col("part")), "run", "part")
    same = {t: s for t, s in (everywhere or {}).items() if any(t in mine for mine in tools)}

    def everyone(some: DataFrame) -> DataFrame:
        states = F.explode(F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(s).alias("tool_status")) for t, s in sorted(same.items())))).alias("t")
        return some.select("run", states).select("run", "t.*")

    if alike.classes.count() * 2 > alike.members.count():
        every = everyone(runs) if same else None
        every = last if every is None and ran is not None else every if ran is None else every.join(last, ["run", "tool"], "left_anti").unionByName(last)
        return run_rules(chosen, facts, runs, every if every is not None or everywhere is None else _no_tools(runs))
    run = F.struct("run", "part").alias("run")
    none = runs.sparkSession.range(len(names)).select(F.lit(None).cast(dict(runs.dtypes)["run"]).alias("run"), F.col("id").cast("int").alias("part"))
    asked = alike.classes.select(F.col("first_").alias("run")).unionByName(none.select(run))
    every = everyone(asked) if same else _no_tools(asked) if everywhere is not None else None
    if ran is not None:
        mine = alike.first(ran).select(run, "tool", "tool_status")
        every = mine if every is None else every.join(mine, ["run", "tool"], "left_anti").unionByName(mine)
    said = run_rules(chosen, alike.first(told).select(run, *columns), asked, every)
    own = reduce(or_, ((F.col("run.part") == i) & F.col("rule").isin(*some) for i, some in enumerate(names)))
    said = said.filter(own).groupBy("run").agg(F.collect_list(F.struct("rule", "verdict", "reason", "n_facts", "place")).alias("said"))
    return alike.everywhere(runs.select("run", F.explode(F.array(*map(F.lit, range(len(names))))).alias("part")), stored(said.select("run.*", "said")), "part").select("run", F.inline("said"))


def _no_tools(runs: DataFrame) -> DataFrame:
    return runs.limit(0).select("run", F.lit("").alias("tool"), F.lit("").alias("tool_status"))


def run_rule(name: str, facts: DataFrame, runs: DataFrame, params: dict | None = None, tool_runs: DataFrame | None = None) -> DataFrame:
    """(run, rule, verdict, reason) of one rule for every run."""
    return run_rules({name: params}, facts, runs, tool_runs).select("run", "rule", "verdict", "reason")


def _judged(ready: dict[str, Outcome], rows: DataFrame, runs: DataFrame, tool_runs: DataFrame | None) -> DataFrame:
    """All outcomes as one aggregate: a struct for each rule, then a row for each."""
    columns = []
    for i, o in enumerate(ready.values()):
        hits = o.about if o.hits is None else o.hits
        lacks = F.lit(False) if o.lacks is None else F.coalesce(F.bool_or(o.about & o.lacks), F.lit(False))
        reason = F.lit(None).cast("string") if o.reason is None else o.reason
        columns.append(
            F.struct(
                (F.count_if(o.about) > 0 if o.found is None else o.found).alias("found"),
                F.when(lacks, "unknown").otherwise(o.verdict).alias("verdict"), F.when(lacks, "attribute_missing").otherwise(reason).alias("reason"),
                F.count_if(hits).alias("n_facts"), F.min(F.when(hits, F.col("path"))).alias("place"),
            ).alias(f"r{i}")
        )
    found = rows.groupBy("run").agg(*columns)
    return _concluded(list(ready), runs.select("run").join(found, "run", "left"), runs, tool_runs)


def _concluded(names: list[str], found: DataFrame, runs: DataFrame, tool_runs: DataFrame | None) -> DataFrame:
    """Verdicts of runs without an outcome, and of rules whose tools are missing; a row for each run and rule."""
    tools = sorted({t for n in names for t in _RULES[n].tools}) if tool_runs is not None else []
    if tools:
        states = last_tool_runs(tool_runs).filter(F.col("tool").isin(*tools)).groupBy("run")
        states = states.agg(*(F.max(F.when(F.col("tool") == t, F.col("tool_status"))).alias(f"state{i}") for i, t in enumerate(tools)))
        found = found.join(states, "run", "left")
    said = []
    for i, name in enumerate(names):
        of, r = _RULES[name], f"r{i}"
        has = F.coalesce(F.col(f"{r}.found"), F.lit(False))
        verdict, reason = (F.when(has, F.col(f"{r}.{c}")).otherwise(F.lit(e)) for c, e in zip(("verdict", "reason"), of.empty, strict=True))
        if tools and of.tools:
            verdict, reason = _with_tools(name, verdict, reason, [F.col(f"state{tools.index(t)}") for t in of.tools])
        said.append(F.struct(F.lit(name).alias("rule"), verdict.alias("verdict"), reason.alias("reason"), F.when(has, F.col(f"{r}.n_facts")).otherwise(0).alias("n_facts"), F.when(has, F.col(f"{r}.place")).alias("place")))
    return found.select("run", F.inline(F.array(*said)))


def _with_tools(name: str, verdict: Column, reason: Column, states: list[Column]) -> tuple[Column, Column]:
    """Verdict and reason after the states of the rule's tools."""
    lost = [F.when(s.isNull(), "tool_not_run").when(s.isin("error", "timeout"), F.concat(F.lit("tool_"), s)) for s in states]
    if name == "observability.present":  # one of two extractors is enough
        gone = F.when(lost[0].isNotNull() & lost[1].isNotNull(), "tool_error")
    elif name == "tests.coverage_configured":  # only what CI steps might have shown is missing
        gone = F.when(verdict != "pass", lost[0])
    else:
        gone = F.coalesce(*lost)
    skipped = F.coalesce(states[0] == "skipped", F.lit(False)) if len(states) == 1 and name != "tests.coverage_configured" else F.lit(False)
    return (
        F.when(gone.isNotNull(), "unknown").when(skipped, "not_applicable").otherwise(verdict),
        F.when(gone.isNotNull(), gone).when(skipped, "tool_skipped").otherwise(reason),
    )


def band(part: Column, whole: Column, passes: float, partial: float, low_is_good: bool = True) -> Column:
    """Three bands of a ratio; not applicable without a whole. Compared as products, so nothing is divided."""
    p, q = (part < passes * whole, part < partial * whole) if low_is_good else (part >= passes * whole, part >= partial * whole)
    return F.when(whole == 0, "not_applicable").when(p, "pass").when(q, "partial").otherwise("fail")


def worst(severity: Column, fail_at: str, partial_at: str) -> Column:
    """The worst severity against two thresholds; null severities reach neither."""
    rank = F.max(E.severity_rank(severity))
    at = {s: i for i, s in enumerate(E.SEVERITIES)}
    return F.when(rank >= at[fail_at], "fail").when(rank >= at[partial_at], "partial").otherwise("pass")


def all_some_none(ok: Column) -> Column:
    return F.when(F.bool_and(ok), "pass").when(F.bool_or(ok), "partial").otherwise("fail")


def offenders(bad: Column, most: int) -> Column:
    n = F.count_if(bad)
    return F.when(n == 0, "pass").when(n <= most, "partial").otherwise("fail")


def coverage(values: Column, required: tuple[str, ...]) -> Column:
    n = F.size(F.array_intersect(F.collect_set(values), F.array(*map(F.lit, required))))
    return F.when(n == len(required), "pass").when(n > 0, "partial").otherwise("fail")


def attr(key: str) -> Column:
    """An attribute; null if it is missing."""
    return F.col(f"a.{key}")


def flag(key: str) -> Column:
    return F.coalesce(attr(key), F.lit(False))


def number(key: str) -> Column:
    return F.coalesce(attr(key), F.lit(0).cast("long"))


def items(key: str) -> Column:
    """An attribute that is a list of texts; empty if it is missing."""
    return F.coalesce(attr(key), F.array().cast("array<string>"))


def _kind(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def _sum(about: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(about, value)), F.lit(0))


def _only(about: Column, ok: Column) -> Column:
    """A condition on the facts that count; null for the others."""
    return F.when(about, ok)


def _pass_if(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")


def _any(about: Column) -> Outcome:
    """Any such fact is enough."""
    return Outcome(F.coalesce(about, F.lit(False)), F.lit("pass"))


def matches_any(text: Column, names: tuple[str, ...], glob: bool = False) -> Column:
    """Whether a module is one of the names or lies below one; or, with ``glob``, whether a text fits one of the patterns."""
    if not names:
        return F.lit(False)
    if glob:
        return F.coalesce(text.rlike("|".join("^" + fnmatch.translate(n).replace(r"\Z", "$").replace(r"\z", "$") for n in names)), F.lit(False))
    return F.coalesce(text.rlike("^(" + "|".join(map(re.escape, names)) + r")([./].*)?$"), F.lit(False))


def path_matches(path: Column, globs: tuple[str, ...]) -> Column:
    return F.coalesce(path.rlike("|".join(E.glob_regex(g) for g in globs)), F.lit(False)) if globs else F.lit(False)


@rule("secrets.none_found", "gitleaks", kinds="secret", exclude_globs=())
def _secrets(exclude_globs):
    return Outcome(_kind("secret") & ~path_matches(F.col("path"), exclude_globs), F.lit("fail"))


def _severe(about: Column, fail_at: str, partial_at: str) -> Outcome:
    least = E.severity_rank(F.col("severity")) >= E.SEVERITIES.index(partial_at)
    return Outcome(about, worst(F.when(about, F.col("severity")), fail_at, partial_at), hits=about & F.coalesce(least, F.lit(False)))


@rule("vulns.max_severity", "osv-scanner", kinds="vuln_dependency", fail_at="high", partial_at="medium")
def _vulns(fail_at, partial_at):
    return _severe(_kind("vuln_dependency"), fail_at, partial_at)


@rule("sast.max_severity", "semgrep", kinds="sast_finding", fail_at="high", partial_at="medium", exclude_rule_globs=())
def _sast(fail_at, partial_at, exclude_rule_globs):
    return _severe(_kind("sast_finding") & ~matches_any(attr("rule_id"), exclude_rule_globs, glob=True), fail_at, partial_at)


@rule("iac.max_severity", "checkov", kinds="iac_finding iac_parse_error", fail_at="high", unknown_severity_fail_count=5)
def _iac(fail_at, unknown_severity_fail_count):
    """Unknown if nothing was found but some files could not be parsed."""
    finding = _kind("iac_finding")
    found = F.count_if(finding)
    severe = F.count_if(finding & (E.severity_rank(F.col("severity")) >= E.SEVERITIES.index(fail_at)))
    unrated = F.count_if(finding & F.col("severity").isNull())
    verdict = F.when(found == 0, "unknown").when((severe > 0) | (unrated >= unknown_severity_fail_count), "fail").otherwise("partial")
    return Outcome(_kind("iac_finding", "iac_parse_error"), verdict, F.when(found == 0, "iac_unparsed"))


def _any_file(globs):
    return _any(_kind("file") & path_matches(F.col("path"), globs))


rule("files.any_exists", kinds="file", empty=("fail", None), globs=())(_any_file)
rule("data.migrations_present", kinds="file", empty=("fail", None), globs=fixed.MIGRATION_GLOBS)(_any_file)
rule("docs.architecture", kinds="file", empty=("fail", None), globs=fixed.ARCHITECTURE_GLOBS)(_any_file)


@rule("docs.api_spec", kinds="file framework dependency", empty=("fail", None), globs=fixed.SPEC_GLOBS)
def _api_spec(globs):
    """A specification, a framework that serves one, or a package that makes one."""
    name = F.lower(attr("name"))
    made = name.rlike("^(" + "|".join(map(re.escape, fixed.AUTODOC_PACKAGES)) + ")") | name.isin(*fixed.AUTODOC_FRAMEWORKS)
    return _any(_kind("file") & path_matches(F.col("path"), globs) | _kind("framework") & name.isin(*fixed.AUTODOC_FRAMEWORKS) | _kind("dependency") & made)


@rule("size.max_file_loc", "ast:metrics", kinds="file_metrics", empty=("not_applicable", "no_source_code"), threshold=1000, partial_max_offenders=2)
def _file_size(threshold, partial_max_offenders):
    about = _kind("file_metrics") & ~flag("is_generated")
    long = about & (number("loc") > threshold)
    return Outcome(about, offenders(long, partial_max_offenders), hits=long)


@rule("complexity.ccn_ratio", "lizard", kinds="function_metrics", empty=("not_applicable", "no_functions"), ccn=15, pass_below=0.03, partial_below=0.08)
def _complexity(ccn, pass_below, partial_below):
    about = _kind("function_metrics")
    complex_ = about & (number("ccn") > ccn)
    return Outcome(about, band(F.count_if(complex_), F.count_if(about), pass_below, partial_below), hits=complex_)


@rule("ast.debug_output_ratio", "ast:logging", kinds="print_call log_call", empty=("not_applicable", "no_output_calls"), pass_below=0.05, partial_below=0.2)
def _debug_output(pass_below, partial_below):
    about = _kind("print_call", "log_call") & ~flag("in_test")
    printed = about & _kind("print_call")
    return Outcome(about, band(F.count_if(printed), F.count_if(about), pass_below, partial_below), hits=printed)


@rule("tests.ratio", "ast:metrics", kinds="file_metrics", empty=("not_applicable", "no_source_code"), pass_at=0.3, partial_at=0.1)
def _test_ratio(pass_at, partial_at):
    about = _kind("file_metrics") & ~flag("is_generated")
    test, source = (_sum(about & (flag("is_test") == v), number("loc")) for v in (True, False))
    return Outcome(about, band(test, source, pass_at, partial_at, False), F.when(source == 0, "no_source_code"))


@rule("docs.docstring_ratio", "ast:metrics", kinds="file_metrics", empty=("not_applicable", "no_public_functions"), pass_at=0.6, partial_at=0.3)
def _docstrings(pass_at, partial_at):
    about = _kind("file_metrics") & ~flag("is_test") & ~flag("is_generated")
    documented, public = _sum(about, number("documented_functions")), _sum(about, number("public_functions"))
    return Outcome(about, band(documented, public, pass_at, partial_at, False), F.when(public == 0, "no_public_functions"), hits=about & (number("documented_functions") < number("public_functions")))


@rule("imports.any_of", "ast:imports", kinds="import_edge", empty=("not_applicable", "no_imports"), modules=fixed.LOGGING_MODULES)
def _imports_any(modules):
    about = _kind("import_edge")
    ok = matches_any(attr("to_module"), modules)
    return Outcome(about, _pass_if(F.bool_or(_only(about, ok))), hits=about & ok)


@rule("imports.no_cycles", "ast:imports", kinds="flag import_edge", empty=("not_applicable", "language_not_supported"), apart=True)
def _cycles(facts):
    """Cycles of two or more modules among internal edges; only for Python, JavaScript and TypeScript."""
    from quillon.operators.graph import cyclic_nodes

    judged = facts.filter(_kind("flag") & attr("name").isin("lang_python", "lang_js_ts")).select("run").distinct()
    node = lambda key: F.regexp_replace(attr(key), "/index$", "")
    edges = facts.filter(_kind("import_edge") & flag("internal")).select("run", node("from_module").alias("src"), node("to_module").alias("dst"))
    edges = edges.filter("src <> '' AND dst <> ''").join(judged, "run", "left_semi")
    cyclic = cyclic_nodes(edges, "run").select("run").distinct().withColumn("verdict", F.lit("fail"))
    return judged.join(cyclic, "run", "left").select("run", F.coalesce("verdict", F.lit("pass")).alias("verdict"), F.lit(None).cast("string").alias("reason"))


@rule("observability.present", "ast:imports", "ast:routes", kinds="import_edge route", empty=("fail", None), modules=fixed.TELEMETRY_MODULES, route_patterns=fixed.HEALTH_ROUTES)
def _observability(modules, route_patterns):
    """A telemetry import, or a route whose path or last segment is one of health, readiness or metrics."""
    route = F.regexp_replace(F.coalesce(attr("path"), F.lit("")), "/+$", "")
    whole, tail = F.when(route == "", "/").otherwise(route), F.concat(F.lit("/"), F.element_at(F.split(route, "/"), -1))
    served = _kind("route") & (matches_any(whole, route_patterns, glob=True) | matches_any(tail, route_patterns, glob=True))
    return _any(served | _kind("import_edge") & matches_any(attr("to_module"), modules))


@rule("tests.present", "ast:tests", kinds="test_file", empty=("fail", None), min_test_files=1)
def _tests_present(min_test_files):
    about = _kind("test_file")
    return Outcome(about, _pass_if(F.count_if(about) >= min_test_files))


@rule("tests.coverage_configured", "ast:ci", kinds="file ci_step", empty=("fail", None))
def _coverage_configured():
    """A coverage file, coverage settings in a file that holds them, or a CI step that measures or uploads coverage."""
    settings = F.lit(False)
    for glob, pattern in reversed(fixed.COVERAGE_CONTENT):  # the first glob that fits a path decides
        settings = F.when(path_matches(F.col("path"), (glob,)), F.coalesce(attr("text").rlike(pattern), F.lit(False))).otherwise(settings)
    own = _kind("file") & ~flag("vendored") & ~flag("unreadable")
    step = F.concat_ws("\n", F.coalesce(attr("run"), F.lit("")), F.coalesce(attr("uses"), F.lit(""))).rlike(fixed.COVERAGE_STEP)
    return _any(own & (path_matches(F.col("path"), fixed.COVERAGE_FILES) | settings) | _kind("ci_step") & step)


@rule("ci.present", "ast:ci", kinds="ci_workflow", empty=("fail", None))
def _ci_present():
    return _any(_kind("ci_workflow"))


def step_kinds() -> Column:
    """All kinds that a step's command or action fits, and the kind it was given."""
    text = F.concat_ws("\n", F.coalesce(attr("run"), F.lit("")), F.coalesce(attr("uses"), F.lit("")))
    return F.array_compact(F.array(F.coalesce(attr("run_kind"), F.lit("other")), *(F.when(text.rlike(p), k) for k, p in fixed.STEP_KINDS)))


def _in_ci(kind: str, system: str | None = None) -> Column:
    return _kind(kind) & F.coalesce(attr("system") == system, F.lit(False)) if system else _kind(kind)


def first_steps(facts: DataFrame) -> DataFrame:
    """(run, stage, path, ord): the first step of each stage, by ``ord``, of the runs that have a workflow."""
    rows = facts.withColumn("a", F.from_json("attributes", _ATTRIBUTES))
    steps = rows.filter(_kind("ci_step")).withColumn("stage", F.explode(F.array_distinct(step_kinds())))
    steps = steps.join(rows.filter(_kind("ci_workflow")).select("run").distinct(), "run", "left_semi")
    return steps.groupBy("run", "stage").agg(F.min_by("path", "ord").alias("path"), F.min("ord").alias("ord"))


@rule("ci.stages", "ast:ci", kinds="ci_workflow ci_step", empty=("not_applicable", "no_ci"), required=("build", "lint", "test"))
def _ci_stages(required):
    step = _kind("ci_step")
    has = [F.coalesce(F.bool_or(_only(step, F.array_contains(step_kinds(), r))), F.lit(False)) for r in required]
    verdict = F.when(reduce(and_, has, F.lit(True)), "pass").when(reduce(or_, has, F.lit(False)), "partial").otherwise("fail")
    return Outcome(step, verdict, found=F.count_if(_kind("ci_workflow")) > 0)


@rule("ci.runs_tests", "ast:ci", kinds="ci_workflow ci_step", empty=("not_applicable", "no_ci"))
def _runs_tests():
    step = _kind("ci_step")
    test = F.array_contains(step_kinds(), "test")
    return Outcome(step, _pass_if(F.bool_or(_only(step, test))), found=F.count_if(_kind("ci_workflow")) > 0, hits=step & _only(step, test))


@rule("ci.actionlint_clean", "actionlint", kinds="actionlint_finding", max_errors=0)
def _actionlint(max_errors):
    about = _kind("actionlint_finding")
    return Outcome(about, _pass_if(F.count_if(about) <= max_errors))


@rule("ci.permissions_restricted", "ast:ci", kinds="ci_workflow", empty=("not_applicable", "no_github_workflows"))
def _permissions():
    about = _in_ci("ci_workflow", "github_actions")
    ok = restricted_workflow(attr("permissions"), items("jobs"), attr("job_permissions"))
    return Outcome(about, _pass_if(F.bool_and(_only(about, ok))), hits=about & ~ok)


@rule("ci.actions_pinned", "ast:ci", kinds="ci_workflow ci_step", empty=("not_applicable", "no_github_workflows"), allow_owners=("actions", "github"))
def _actions_pinned(allow_owners):
    uses = attr("uses")
    owner = F.lower(F.element_at(F.split(uses, "/"), 1))
    loose = _in_ci("ci_step", "github_actions") & F.coalesce((uses != "") & ~owner.isin(*(o.lower() for o in allow_owners)) & ~action_pinned(uses), F.lit(False))
    return Outcome(loose, _pass_if(F.count_if(loose) == 0), found=F.count_if(_in_ci("ci_workflow", "github_actions")) > 0)


_NO_DOCKERFILE = ("not_applicable", "no_dockerfile")


def _dockerfiles(judge: Callable[[Column], Column], ok: Column, needs: str | None = None) -> Outcome:
    about = _kind("dockerfile")
    return Outcome(about, judge(_only(about, ok)), hits=about & ~F.coalesce(ok, F.lit(False)), lacks=attr(needs).isNull() if needs else None)


@rule("docker.non_root", "ast:docker", kinds="dockerfile", empty=_NO_DOCKERFILE)
def _non_root():
    return _dockerfiles(all_some_none, user_not_root(attr("user")))


@rule("docker.pinned_base", "ast:docker", kinds="dockerfile", empty=_NO_DOCKERFILE)
def _pinned_base():
    return _dockerfiles(lambda ok: _pass_if(F.bool_and(ok)), F.forall(items("external_bases"), pinned_image), "external_bases")


@rule("docker.multistage", "ast:docker", kinds="dockerfile", empty=_NO_DOCKERFILE)
def _multistage():
    return _dockerfiles(all_some_none, number("stages") > 1, "stages")


@rule("docker.healthcheck", "ast:docker", "ast:deploy", kinds="dockerfile deploy_config", empty=("not_applicable", "no_container_config"))
def _healthcheck():
    about = _kind("dockerfile", "deploy_config")
    probed = about & (flag("has_healthcheck") | _kind("deploy_config") & (flag("has_liveness") | flag("has_readiness")))
    some = F.count_if(probed) > 0
    silent = F.count_if(_kind("dockerfile") & attr("has_healthcheck").isNull()) > 0
    return Outcome(about, F.when(some, "pass").when(silent, "unknown").otherwise("fail"), F.when(~some & silent, "attribute_missing"), hits=probed)


@rule("docker.hadolint_errors", "hadolint", kinds="hadolint_finding", max_errors=0)
def _hadolint(max_errors):
    about = _kind("hadolint_finding") & F.coalesce(F.col("severity") == "high", F.lit(False))
    return Outcome(about, _pass_if(F.count_if(about) <= max_errors))


@rule("deploy.resource_limits", "ast:deploy", kinds="deploy_config", empty=("not_applicable", "no_deploy_config"))
def _limits():
    about = _kind("deploy_config")
    return Outcome(about, all_some_none(_only(about, flag("has_limits"))), hits=about & ~flag("has_limits"), lacks=attr("has_limits").isNull())


@rule("deps.lockfile_present", "ast:manifests", kinds="manifest", empty=("not_applicable", "no_manifests"))
def _lockfiles():
    about = _kind("manifest")
    return Outcome(about, _pass_if(F.bool_and(_only(about, flag("has_lockfile")))), hits=about & ~flag("has_lockfile"), lacks=attr("has_lockfile").isNull())


def _order_rows(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").withColumn("g", (F.col("o_custkey") % 50).cast("int"))


@query("rule_ratio_band", "", "SELECT (o_custkey % 50)::INTEGER AS g, CASE WHEN b * 10 < n * 2 THEN 'pass' WHEN b * 4 < n THEN 'partial' ELSE 'fail' END AS verdict FROM (SELECT o_custkey % 50 AS o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS b FROM orders GROUP BY 1)")
def rule_ratio_band(spark, sf_dir):
    n, bad = F.count("*"), F.count_if(F.col("o_orderpriority") == "1-URGENT")
    return _order_rows(spark, sf_dir).groupBy("g").agg(F.when(n == 0, "not_applicable").when(bad * 10 < n * 2, "pass").when(bad * 4 < n, "partial").otherwise("fail").alias("verdict"))


@query("rule_sum_ratio", "files", """SELECT language, CASE WHEN s = 0 THEN 'not_applicable' WHEN t * 10 >= s * 2 THEN 'pass' WHEN t * 20 >= s THEN 'partial' ELSE 'fail' END AS verdict
FROM (SELECT language, sum(CASE WHEN path LIKE 'tests/%' THEN size ELSE 0 END) AS t, sum(CASE WHEN path NOT LIKE 'tests/%' THEN size ELSE 0 END) AS s FROM files GROUP BY language)""")
def rule_sum_ratio(spark, sf_dir):
    test = F.col("path").startswith("tests/")
    sums = V.files(spark, sf_dir).groupBy("language").agg(F.sum(F.when(test, F.col("size")).otherwise(0)).alias("t"), F.sum(F.when(~test, F.col("size")).otherwise(0)).alias("s"))
    return sums.select("language", F.when(F.col("s") == 0, "not_applicable").when(F.col("t") * 10 >= F.col("s") * 2, "pass").when(F.col("t") * 20 >= F.col("s"), "partial").otherwise("fail").alias("verdict"))


@query("rule_max_severity", "checks findings", """SELECT run, metric, CASE WHEN r >= 3 THEN 'fail' WHEN r >= 2 THEN 'partial' ELSE 'pass' END AS verdict FROM (
SELECT f.run, c.metric, max(CASE WHEN f.verdict <> 'fail' OR c.check_id % 9 = 0 THEN -1 WHEN severity = 'critical' THEN 4 WHEN severity = 'high' THEN 3 WHEN severity = 'medium' THEN 2 WHEN severity = 'low' THEN 1 ELSE 0 END) AS r
FROM findings f JOIN checks c ON f.check_id = c.check_id GROUP BY 1, 2)""")
def rule_max_severity(spark, sf_dir):
    rows = V.findings(spark, sf_dir).join(V.checks(spark, sf_dir), "check_id")
    severity = F.when((F.col("verdict") == "fail") & (F.col("check_id") % 9 != 0), F.col("severity"))
    return rows.groupBy("run", "metric").agg(worst(severity, "high", "medium").alias("verdict"))


@query("rule_all_some_none", "findings", "SELECT check_id, CASE WHEN bool_and(verdict = 'pass') THEN 'pass' WHEN bool_or(verdict = 'pass') THEN 'partial' ELSE 'fail' END AS verdict FROM findings GROUP BY check_id")
def rule_all_some_none(spark, sf_dir):
    return V.findings(spark, sf_dir).groupBy("check_id").agg(all_some_none(F.col("verdict") == "pass").alias("verdict"))


@query("rule_offenders", "files", "SELECT language, CASE WHEN n = 0 THEN 'pass' WHEN n <= 3 THEN 'partial' ELSE 'fail' END AS verdict FROM (SELECT language, count(*) FILTER (WHERE size > 15000) AS n FROM files GROUP BY 1)")
def rule_offenders(spark, sf_dir):
    return V.files(spark, sf_dir).groupBy("language").agg(offenders(F.col("size") > 15000, 3).alias("verdict"))


@query("rule_set_coverage", "llm_calls", "SELECT user_id, CASE n WHEN 3 THEN 'pass' WHEN 0 THEN 'fail' ELSE 'partial' END AS verdict FROM (SELECT user_id, count(DISTINCT stage) FILTER (WHERE stage IN ('click', 'error', 'purchase')) AS n FROM llm_calls WHERE cost_micro > 2000 GROUP BY 1)")
def rule_set_coverage(spark, sf_dir):
    return V.llm_calls(spark, sf_dir).filter("cost_micro > 2000").groupBy("user_id").agg(coverage(F.col("stage"), ("click", "error", "purchase")).alias("verdict"))


@query("topk_complexity", "files", "SELECT language, path, size FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY size DESC, path) AS rn FROM files) WHERE rn <= 3")
def topk_complexity(spark, sf_dir):
    """The three largest of each language, by a window whose row limit Spark applies before the exchange too."""
    top = V.files(spark, sf_dir).withColumn("rn", F.row_number().over(_largest()))
    return top.filter("rn <= 3").select("language", "path", "size")


def _largest():
    from pyspark.sql import Window

    return Window.partitionBy("language").orderBy(F.desc("size"), "path")


# Facts of eight example runs: all tools ran and found nothing, were skipped, left no record, timed out; then runs with facts.
_FACT = "kind string, path string, severity string, attributes string"


def _f(kind: str, at: str | None = None, /, severity: str | None = None, **attributes) -> dict:
    return {"kind": kind, "path": at, "severity": severity, "attributes": json.dumps(attributes)}


_SHA = "0123456789abcdef0123456789abcdef01234567"
_GOOD = [
    _f("flag", name="lang_python"), _f("file", "README.md"), _f("file", "db/migrations/001.sql"), _f("file", "docs/architecture.md"), _f("file", "api/openapi.yaml"), _f("file", ".coveragerc"),
    _f("vuln_dependency", severity="low"), _f("sast_finding", severity="info", rule_id="a.b"), _f("file_metrics", loc=1000, public_functions=5, documented_functions=3),
    _f("file_metrics", loc=300, is_test=True, public_functions=9), _f("file_metrics", loc=9000, is_generated=True), _f("function_metrics", ccn=15), _f("import_edge", from_module="a", to_module="logging.handlers", internal=False),
    _f("import_edge", from_module="a", to_module="b", internal=True), _f("import_edge", from_module="b", to_module="c", internal=True), _f("manifest", has_lockfile=True), _f("log_call"), _f("print_call", in_test=True),
    _f("route", path="/api/v1/health/"), _f("test_file"), _f("ci_workflow", system="github_actions", permissions="read-all", jobs=["x"], job_permissions={"x": None}),
    _f("ci_step", system="github_actions", run="ruff check . && pytest", run_kind="test", uses=None), _f("ci_step", system="github_actions", run="docker build .", run_kind="build"),
    _f("ci_step", system="github_actions", uses=f"o/a@{_SHA}"), _f("ci_step", system="github_actions", uses="actions/checkout@v4"), _f("ci_step", system="github_actions", uses="./local"), _f("ci_step", system="github_actions", uses="docker://x:1"),
    _f("dockerfile", user="app:app", stages=2, external_bases=["python:3", "$BASE", "x@sha256:1", "scratch", "r:5000/y:1"], has_healthcheck=True), _f("hadolint_finding", severity="medium"), _f("deploy_config", has_limits=True),
]
_BAD = [
    _f("flag", name="lang_js_ts"), _f("secret", "src/a.py"), _f("vuln_dependency", severity="critical"), _f("sast_finding", severity="high", rule_id="x"), *[_f("file_metrics", loc=1001, public_functions=10, documented_functions=2)] * 3,
    _f("file_metrics", loc=100, is_test=True), _f("function_metrics", ccn=16), _f("import_edge", from_module="a/index", to_module="b", internal=True), _f("import_edge", from_module="b", to_module="a", internal=True),
    _f("manifest", has_lockfile=True), _f("manifest", has_lockfile=False), _f("print_call"), _f("log_call", in_test=True), _f("route", path="/items"), _f("ci_workflow", system="github_actions", permissions="read-all", jobs=["x"], job_permissions={"x": "write-all"}),
    _f("ci_step", system="github_actions", run="echo hi", uses=None), _f("ci_step", system="github_actions", uses="o/a@v1"), _f("actionlint_finding"), _f("dockerfile", user="root:app", stages=1, external_bases=["python"], has_healthcheck=False),
    _f("hadolint_finding", severity="high"), _f("iac_finding", severity="high"), _f("deploy_config", has_limits=False, has_healthcheck=False),
]
_MIXED = [
    _f("flag", name="lang_go"), _f("file", "package.json", text='{"jest": {"collectCoverage": true}}'), _f("vuln_dependency", severity="medium"), _f("vuln_dependency"), _f("sast_finding", severity="medium", rule_id="x"), _f("file_metrics", loc=1001, public_functions=10, documented_functions=3),
    _f("file_metrics", loc=101, is_test=True), *[_f("function_metrics", ccn=1)] * 19, _f("function_metrics", ccn=99), _f("import_edge", from_module="a", to_module="a", internal=True), *[_f("log_call")] * 9, _f("print_call"), _f("dependency", name="Swashbuckle.AspNetCore"),
    _f("import_edge", from_module="a", to_module="@opentelemetry/api", internal=False), _f("ci_workflow", system="gitlab_ci"), _f("ci_step", system="gitlab_ci", run="npm run lint", run_kind="lint"),
    _f("dockerfile", user="app", stages=1, external_bases=["a:latest"]), _f("dockerfile", user="0", stages=3, external_bases=[]), _f("deploy_config", has_limits=True, has_readiness=True), _f("deploy_config", has_limits=False), *[_f("iac_finding")] * 4,
]
_ODD = [
    _f("flag", name="lang_python"), _f("file", "vendor/x/.coveragerc", vendored=True), _f("file", "setup.cfg", text="[coverage:run]", unreadable=True), _f("framework", name="fastapi"), _f("vuln_dependency"), _f("sast_finding"), _f("file_metrics", loc=5, is_test=True),
    _f("import_edge", from_module="a", to_module="loggingx", internal=False), _f("ci_workflow", system="github_actions", jobs=["x", "y"], job_permissions={"x": "read", "y": "read"}), _f("ci_step", system="github_actions", run="go test ./... -coverprofile c.out", run_kind="other"),
    _f("iac_parse_error", "a.tf"), *[_f("actionlint_finding")] * 2,
]
_UNRATED = [*[_f("iac_finding")] * 5, _f("iac_parse_error", "a.tf")]
_TOOLS = tuple(sorted({t for r in _RULES.values() for t in r.tools}))
_RUNS = [(f, [{"tool": t, "tool_status": s, "ord": k} for t in _TOOLS for k, s in enumerate(states)]) for f, states in (([], ("error", "ok")), ([], ("skipped",)), ([], ()), ([], ("ok", "timeout")), (_GOOD, ("ok",)), (_BAD, ("ok",)), (_MIXED, ("ok",)), (_ODD, ("ok",)), (_UNRATED, ("ok",)))]

# What each rule says of the nine runs, by hand: P pass, H partial, F fail, N not applicable, U unknown; and why a rule may not apply.
_SAYS = {
    "secrets.none_found": ("PNUUPFPPP", None),
    "vulns.max_severity": ("PNUUPFHPP", None),
    "sast.max_severity": ("PNUUPFHPP", None),
    "iac.max_severity": ("PNUUPFHUF", None),
    "files.any_exists": ("FFFFPFFFF", None),
    "data.migrations_present": ("FFFFPFFFF", None),
    "docs.architecture": ("FFFFPFFFF", None),
    "docs.api_spec": ("FFFFPFPPF", None),
    "size.max_file_loc": ("NNUUPFHPN", "no_source_code"),
    "complexity.ccn_ratio": ("NNUUPFHNN", "no_functions"),
    "ast.debug_output_ratio": ("NNUUPFHNN", "no_output_calls"),
    "tests.ratio": ("NNUUPFHNN", "no_source_code"),
    "docs.docstring_ratio": ("NNUUPFHNN", "no_public_functions"),
    "imports.any_of": ("NNUUPFFFN", "no_imports"),
    "imports.no_cycles": ("NNUUPFNPN", "language_not_supported"),
    "observability.present": ("FFUUPFPFF", None),
    "tests.present": ("FNUUPFFFF", None),
    "tests.coverage_configured": ("FFUUPFPPF", None),
    "ci.present": ("FNUUPPPPF", None),
    "ci.stages": ("NNUUPFHHN", "no_ci"),
    "ci.runs_tests": ("NNUUPFFPN", "no_ci"),
    "ci.actionlint_clean": ("PNUUPFPFP", None),
    "ci.permissions_restricted": ("NNUUPFNPN", "no_github_workflows"),
    "ci.actions_pinned": ("NNUUPFNPN", "no_github_workflows"),
    "docker.non_root": ("NNUUPFHNN", "no_dockerfile"),
    "docker.pinned_base": ("NNUUPFFNN", "no_dockerfile"),
    "docker.multistage": ("NNUUPFHNN", "no_dockerfile"),
    "docker.healthcheck": ("NNUUPFPNN", "no_container_config"),
    "docker.hadolint_errors": ("PNUUPFPPP", None),
    "deploy.resource_limits": ("NNUUPFHNN", "no_deploy_config"),
    "deps.lockfile_present": ("NNUUPFNNN", "no_manifests"),
}
_VERDICT = {"P": "pass", "H": "partial", "F": "fail", "N": "not_applicable", "U": "unknown"}
_FAMILIES = {
    "rule_scanners": ("secrets", "vulns", "sast", "iac", "complexity", "ci.actionlint_clean", "docker.hadolint_errors"),
    "rule_files": ("files", "data", "docs", "size", "ast", "tests"),
    "rule_imports": ("imports", "observability", "deps"),
    "rule_ci": ("ci.present", "ci.stages", "ci.runs_tests", "ci.permissions_restricted", "ci.actions_pinned"),
    "rule_docker": ("docker.non_root", "docker.pinned_base", "docker.multistage", "docker.healthcheck", "deploy"),
}


def _of_family(names: tuple[str, ...]) -> list[str]:
    return [n for n in _SAYS if n in names or n.split(".")[0] in names and n not in ("ci.actionlint_clean", "docker.hadolint_errors")]


def _expected(names: list[str]):
    for name in names:
        says, none = _SAYS[name]
        for run, letter in enumerate(says):
            reason = none if letter == "N" else "iac_unparsed" if letter == "U" and run > 3 else None
            if run == 1 and letter == "N" and name != "docker.healthcheck":
                reason = "tool_skipped"
            if run in (2, 3) and letter == "U":
                reason = "tool_error" if name == "observability.present" else ("tool_not_run", "tool_timeout")[run - 2]
            yield run, name, _VERDICT[letter], reason


def example_runs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, facts (in the order of ``ord``) and tool runs of the nine examples, one for each part."""
    rows = cases(spark, sf_dir, _RUNS, f"facts array<struct<{_FACT.replace(' string', ':string')}>>, tools array<struct<tool:string, tool_status:string, ord:int>>")
    runs = rows.select(F.col("id").alias("run"))
    facts = rows.select(F.col("id").alias("run"), F.posexplode("facts").alias("ord", "f")).select("run", "ord", "f.*")
    return runs, facts, rows.select(F.col("id").alias("run"), F.inline("tools"))


def _register(key: str, names: list[str]) -> None:
    @query(key, "", cases_sql(len(_RUNS), "VARCHAR rule, VARCHAR verdict, VARCHAR reason", _expected(names)))
    def outcomes(spark, sf_dir):
        runs, facts, tools = example_runs(spark, sf_dir)
        chosen = {n: {"globs": ("README*",)} if n == "files.any_exists" else None for n in names}
        return run_rules(chosen, facts, runs, tools).select(F.col("run").alias("id"), "rule", "verdict", "reason")


for _key, _names in _FAMILIES.items():
    _register(_key, _of_family(_names))


@query("rule_first_steps", "", cases_sql(len(_RUNS), "VARCHAR stage, INTEGER ord", [(4, "test", 21), (4, "lint", 21), (4, "build", 22), (4, "other", 23), (5, "other", 17), (6, "lint", 41), (7, "other", 9), (7, "test", 9)]))
def rule_first_steps(spark, sf_dir):
    """The first step of each CI stage, in the order of the facts."""
    return first_steps(example_runs(spark, sf_dir)[1]).select(F.col("run").alias("id"), "stage", "ord")
