"""Captured scanner output as facts: nested JSON is read by schema on the JVM, no row by row code."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import exprs as E
from quillon.plans.cases import cases, cases_sql
from quillon.registry import query

MESSAGE_CHARS = 500


def relative(path: Column, root: str) -> Column:
    """A scanner's path, relative to the folder it scanned."""
    return F.regexp_replace(path, "^(" + root.rstrip("/").replace(".", r"\.") + r"/|\./|/)", "")


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    """The rows of ``raw`` with ``item``: each element of the JSON text, which is one object or a list of them; null and broken texts give none."""
    text = F.trim("json")
    listed = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return raw.withColumn("item", F.explode(F.from_json(listed, f"array<struct<{schema}>>"))).filter("item IS NOT NULL").drop("json")


def _cut(message: Column) -> Column:
    return F.substring(F.coalesce(message, F.lit("")), 1, MESSAGE_CHARS)


def semgrep(raw: DataFrame, root: str = "/src") -> DataFrame:
    """sast_finding rows: the severity is the rule's impact, else its level."""
    rows = _parsed(raw, "results:array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<message:string,severity:string,metadata:struct<impact:string,category:string>>>>")
    rows = rows.withColumn("r", F.explode("item.results")).drop("item")
    impact = E.choose(F.upper("r.extra.metadata.impact"), {"HIGH": "high", "MEDIUM": "medium", "LOW": "low"})
    level = E.choose(F.upper("r.extra.severity"), {"ERROR": "high", "WARNING": "medium", "INFO": "low"})
    return rows.select(
        *[c for c in rows.columns if c != "r"], relative(F.col("r.path"), root).alias("path"), F.col("r.start.line").alias("start_line"), F.col("r.end.line").alias("end_line"), F.col("r.check_id").alias("rule_id"),
        F.coalesce("r.extra.metadata.category", F.lit("")).alias("category"), _cut(F.col("r.extra.message")).alias("message"), F.coalesce(impact, level).alias("severity"),
    )


def hadolint(raw: DataFrame, root: str = "/src") -> DataFrame:
    """hadolint_finding rows."""
    rows = _parsed(raw, "code:string,file:string,level:string,line:int,message:string")
    severity = E.choose(F.col("item.level"), {"error": "high", "warning": "medium", "info": "low", "style": "low"})
    return rows.select(*[c for c in rows.columns if c != "item"], relative(F.col("item.file"), root).alias("path"), F.col("item.line").alias("line"), F.col("item.code").alias("code"), F.col("item.level").alias("level"), _cut(F.col("item.message")).alias("message"), severity.alias("severity"))


def actionlint(raw: DataFrame, root: str = "/src") -> DataFrame:
    """actionlint_finding rows; a missing line is the first."""
    rows = _parsed(raw, "message:string,filepath:string,line:int,kind:string")
    line = F.when(F.coalesce("item.line", F.lit(0)) == 0, 1).otherwise(F.col("item.line"))
    return rows.select(*[c for c in rows.columns if c != "item"], relative(F.col("item.filepath"), root).alias("path"), line.alias("line"), F.coalesce("item.kind", F.lit("")).alias("kind"), _cut(F.col("item.message")).alias("message"))


_CHECKOV = "check_type:string,results:struct<failed_checks:array<struct<check_id:string,check_name:string,file_abs_path:string,file_path:string,file_line_range:array<int>,resource:string,severity:string>>,parsing_errors:array<string>>,summary:struct<parsing_errors:int>"


def checkov(raw: DataFrame, root: str = "/src") -> DataFrame:
    """(kind, path, framework, check_id, severity, start_line, end_line): iac_finding and iac_parse_error rows, and one of kind ``error`` for a block that counts more parse errors than it lists."""
    rows = _parsed(raw, _CHECKOV)
    keys = [c for c in rows.columns if c != "item"]
    framework = F.coalesce("item.check_type", F.lit("")).alias("framework")
    listed = F.coalesce("item.results.parsing_errors", F.array().cast("array<string>"))
    severity = E.choose(F.upper("c.severity"), {"CRITICAL": "critical", "HIGH": "high", "MEDIUM": "medium", "LOW": "low", "INFO": "info"})
    none, no_line = F.lit(None).cast("string"), F.lit(None).cast("int")
    found = rows.select(*keys, framework, F.explode("item.results.failed_checks").alias("c"))
    range_ = F.coalesce("c.file_line_range", F.array(F.lit(1), F.lit(1)))
    path = relative(F.coalesce(F.when(F.col("c.file_abs_path") != "", F.col("c.file_abs_path")), "c.file_path"), root)
    findings = found.select(*keys, F.lit("iac_finding").alias("kind"), path.alias("path"), "framework", F.col("c.check_id").alias("check_id"), severity.alias("severity"), F.element_at(range_, 1).alias("start_line"), F.element_at(range_, -1).alias("end_line"))
    unparsed = rows.select(*keys, framework, F.explode(listed).alias("p")).select(*keys, F.lit("iac_parse_error").alias("kind"), relative(F.col("p"), root).alias("path"), "framework", none.alias("check_id"), none.alias("severity"), no_line.alias("start_line"), no_line.alias("end_line"))
    wrong = rows.filter(F.coalesce("item.summary.parsing_errors", F.lit(0)) > F.size(listed))
    errors = wrong.select(*keys, F.lit("error").alias("kind"), none.alias("path"), framework, none.alias("check_id"), none.alias("severity"), no_line.alias("start_line"), no_line.alias("end_line"))
    return findings.unionByName(unparsed).unionByName(errors)


# Folders of infrastructure files.
IAC_DIRS = ("k8s", "kubernetes", "manifests", "deploy", "deployment", "deployments", "helm", "charts", "infra", "infrastructure", "cloudformation", "cfn", "iac", "arm")


def hidden_iac(files: DataFrame) -> DataFrame:
    """Infrastructure files below a hidden folder, which the scanner skips without a word."""
    name, dirs = F.element_at(F.split("path", "/"), -1), F.split(F.lower("path"), "/")
    own = name.rlike(r"\.(tf|bicep)$|\.tf\.json$|^azuredeploy") | (name.rlike(r"\.(ya?ml|json)$") & F.arrays_overlap(F.slice(dirs, 1, F.size(dirs) - 1), F.array(*map(F.lit, IAC_DIRS))))
    return files.filter(own & F.col("path").rlike(r"(^|/)\."))


def gitleaks(raw: DataFrame, files: DataFrame | None = None, root: str = "/src") -> DataFrame:
    """secret rows in files of the snapshot; columns after the first line are one too high in the report."""
    rows = _parsed(raw, "RuleID:string,StartLine:int,EndLine:int,StartColumn:int,EndColumn:int,File:string")
    keys = [c for c in rows.columns if c != "item"]
    column = lambda line, at: F.when(F.col(line) > 1, F.col(at) - 1).otherwise(F.col(at))
    out = rows.select(
        *keys, relative(F.col("item.File"), root).alias("path"), F.col("item.RuleID").alias("rule_id"), F.col("item.StartLine").alias("start_line"), column("item.StartLine", "item.StartColumn").alias("start_col"),
        F.col("item.EndLine").alias("end_line"), column("item.EndLine", "item.EndColumn").alias("end_col"),
    )
    out = out.withColumn("fingerprint", F.concat_ws(":", "path", "rule_id", F.col("start_line").cast("string")))
    return out if files is None else out.join(files.select(*keys, "path").distinct(), [*keys, "path"], "left_semi")


def lizard(raw: DataFrame) -> DataFrame:
    """function_metrics rows of a report of functions."""
    rows = _parsed(raw, "file:string,name:string,ccn:int,nloc:int,params:int,start_line:int")
    return rows.select(*[c for c in rows.columns if c != "item"], F.col("item.file").alias("path"), F.col("item.name").alias("name"), F.col("item.ccn").alias("ccn"), F.col("item.nloc").alias("nloc"), F.col("item.params").alias("params"), F.col("item.start_line").alias("line"))


def _semgrep_case(check: str, path: str, line: int, message: str | None, severity: str | None, **metadata) -> dict:
    return {"check_id": check, "path": path, "start": {"line": line}, "end": {"line": line + 1}, "extra": {"message": message, "severity": severity, "metadata": metadata}}


_SEMGREP = [
    (json.dumps({"results": [_semgrep_case("py.sqli", "/src/app/db.py", 4, "SQL built from input", "ERROR", impact="MEDIUM", category="security"), _semgrep_case("py.open", "app/io.py", 9, "x" * 600, "WARNING")], "errors": []}),),
    (json.dumps({"results": []}),),
    (None,),
    ("not json",),
    (json.dumps({"results": [_semgrep_case("a.b", "./c.js", 1, None, "INFO", impact="none"), _semgrep_case("c.d", "/src/e.go", 2, "m", "odd")]}),),
]
_SEMGREP_ROWS = [
    (0, "app/db.py", 4, 5, "py.sqli", "security", 20, "medium"), (0, "app/io.py", 9, 10, "py.open", "", 500, "medium"), (4, "c.js", 1, 2, "a.b", "", 0, "low"), (4, "e.go", 2, 3, "c.d", "", 1, None),
]


@query("fact_semgrep", "", cases_sql(len(_SEMGREP), "VARCHAR path, INTEGER start_line, INTEGER end_line, VARCHAR rule_id, VARCHAR category, INTEGER message_chars, VARCHAR severity", _SEMGREP_ROWS))
def fact_semgrep(spark, sf_dir):
    out = semgrep(cases(spark, sf_dir, _SEMGREP, "json string").drop("case"))
    return out.withColumn("message_chars", F.length("message")).drop("message")


_HADOLINT = [
    (json.dumps([{"code": "DL3006", "column": 1, "file": "Dockerfile", "level": "warning", "line": 1, "message": "Always tag the version"}, {"code": "SC2046", "column": 3, "file": "/src/a/Dockerfile", "level": "error", "line": 7, "message": "Quote"}]),),
    ("[]",),
    (json.dumps([{"code": "DL4000", "file": "x/Dockerfile", "level": "style", "line": 2}, {"code": "DL1", "file": "y", "level": "ignore", "line": 3, "message": ""}]),),
]
_HADOLINT_ROWS = [(0, "Dockerfile", 1, "DL3006", "warning", "Always tag the version", "medium"), (0, "a/Dockerfile", 7, "SC2046", "error", "Quote", "high"), (2, "x/Dockerfile", 2, "DL4000", "style", "", "low"), (2, "y", 3, "DL1", "ignore", "", None)]


@query("fact_hadolint", "", cases_sql(len(_HADOLINT), "VARCHAR path, INTEGER line, VARCHAR code, VARCHAR level, VARCHAR message, VARCHAR severity", _HADOLINT_ROWS))
def fact_hadolint(spark, sf_dir):
    return hadolint(cases(spark, sf_dir, _HADOLINT, "json string").drop("case"))


_ACTIONLINT = [(json.dumps([{"message": "unknown key", "filepath": ".github/workflows/ci.yml", "line": 12, "column": 3, "kind": "syntax-check", "snippet": "x", "end_column": 5}, {"message": "no line", "filepath": "/src/.github/workflows/b.yml", "line": 0}]),), (None,)]
_ACTIONLINT_ROWS = [(0, ".github/workflows/ci.yml", 12, "syntax-check", "unknown key"), (0, ".github/workflows/b.yml", 1, "", "no line")]


@query("fact_actionlint", "", cases_sql(len(_ACTIONLINT), "VARCHAR path, INTEGER line, VARCHAR kind, VARCHAR message", _ACTIONLINT_ROWS))
def fact_actionlint(spark, sf_dir):
    return actionlint(cases(spark, sf_dir, _ACTIONLINT, "json string").drop("case"))


_CHECKOV_CASES = [
    (json.dumps({"check_type": "terraform", "results": {"failed_checks": [{"check_id": "CKV_1", "check_name": "n", "file_abs_path": "/src/infra/a.tf", "file_path": "/a.tf", "file_line_range": [3, 9], "resource": "r", "severity": None}], "parsing_errors": ["/src/infra/bad.tf"]}, "summary": {"parsing_errors": 1}}),),
    (json.dumps([{"check_type": "dockerfile", "results": {"failed_checks": [{"check_id": "CKV_2", "file_path": "/Dockerfile", "severity": "critical"}]}}, {"check_type": "kubernetes", "results": {"parsing_errors": []}, "summary": {"parsing_errors": 2}}]),),
    ("{}",),
]
_CHECKOV_ROWS = [
    (0, "iac_finding", "infra/a.tf", "terraform", "CKV_1", None, 3, 9), (0, "iac_parse_error", "infra/bad.tf", "terraform", None, None, None, None),
    (1, "iac_finding", "Dockerfile", "dockerfile", "CKV_2", "critical", 1, 1), (1, "error", None, "kubernetes", None, None, None, None),
]


@query("fact_checkov", "", cases_sql(len(_CHECKOV_CASES), "VARCHAR kind, VARCHAR path, VARCHAR framework, VARCHAR check_id, VARCHAR severity, INTEGER start_line, INTEGER end_line", _CHECKOV_ROWS))
def fact_checkov(spark, sf_dir):
    return checkov(cases(spark, sf_dir, _CHECKOV_CASES, "json string").drop("case"))


_GITLEAKS = [
    (json.dumps([{"RuleID": "aws", "StartLine": 1, "EndLine": 1, "StartColumn": 5, "EndColumn": 24, "File": "/src/a.py"}, {"RuleID": "key", "StartLine": 3, "EndLine": 5, "StartColumn": 2, "EndColumn": 9, "File": "b.pem"}, {"RuleID": "git", "StartLine": 1, "EndLine": 1, "StartColumn": 1, "EndColumn": 2, "File": ".git/config"}]), ["a.py", "b.pem"]),
    ("[]", ["a.py"]),
]
_GITLEAKS_ROWS = [(0, "a.py", "aws", 1, 5, 1, 24, "a.py:aws:1"), (0, "b.pem", "key", 3, 1, 5, 8, "b.pem:key:3")]


@query("fact_gitleaks", "", cases_sql(len(_GITLEAKS), "VARCHAR path, VARCHAR rule_id, INTEGER start_line, INTEGER start_col, INTEGER end_line, INTEGER end_col, VARCHAR fingerprint", _GITLEAKS_ROWS))
def fact_gitleaks(spark, sf_dir):
    rows = cases(spark, sf_dir, _GITLEAKS, "json string, files array<string>").drop("case")
    return gitleaks(rows.select("id", "json"), rows.select("id", F.explode("files").alias("path")))


_LIZARD = [(json.dumps([{"file": "a.py", "name": "f", "ccn": 3, "nloc": 10, "params": 2, "start_line": 4}, {"file": "a.py", "name": "g", "ccn": 21, "nloc": 90, "params": 0, "start_line": 30}]),), ("[]",)]


@query("fact_lizard", "", cases_sql(len(_LIZARD), "VARCHAR path, VARCHAR name, INTEGER ccn, INTEGER nloc, INTEGER params, INTEGER line", [(0, "a.py", "f", 3, 10, 2, 4), (0, "a.py", "g", 21, 90, 0, 30)]))
def fact_lizard(spark, sf_dir):
    return lizard(cases(spark, sf_dir, _LIZARD, "json string").drop("case"))


_HIDDEN = [(".infra/a.tf",), ("infra/a.tf",), (".github/k8s/x.yaml",), ("a/.cache/notes.json",), ("a/.b/azuredeploy.json",), ("k8s/.x.yml",)]


@query("flt_hidden_iac", "", cases_sql(len(_HIDDEN), "VARCHAR path", [(0, ".infra/a.tf"), (2, ".github/k8s/x.yaml"), (4, "a/.b/azuredeploy.json"), (5, "k8s/.x.yml")]))
def flt_hidden_iac(spark, sf_dir):
    return hidden_iac(cases(spark, sf_dir, _HIDDEN, "path string")).select("id", "path")
