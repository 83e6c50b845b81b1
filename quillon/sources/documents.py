"""Rubrics, label sheets and reports as documents: YAML and Markdown in, JSON, JSON lines, SARIF and Markdown out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import exprs as E
from quillon.plans.cases import cases, cases_sql
from quillon.registry import query

VERDICTS = ("pass", "partial", "fail", "not_applicable", "unknown")


def rubric_checks(files: DataFrame) -> DataFrame:
    """(keys, path, metric, check_id, type, severity, weight, rule, problem) of rubric files (keys, path, text).

    A file that isn't YAML, whose metric isn't its name, or which lists a check
    twice has one row a problem; so has a check without what its type needs.
    """
    keys = [c for c in files.columns if c not in ("path", "text")]
    columns = ["metric", "check_id", "type", "severity", "weight", "rule", "problem"]

    def read(path: str, text: str) -> Iterator[tuple]:
        import yaml

        from quillon.operators.rules import rule_names

        try:
            data = yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        except yaml.YAMLError:
            data = None
        if not isinstance(data, dict):
            yield None, None, None, None, None, None, "cannot read YAML"
            return
        metric, seen = data.get("metric"), set()
        if metric != path.rpartition("/")[2].removesuffix(".yaml"):
            yield metric, None, None, None, None, None, "metric isn't the file's name"
        for check in data.get("checks") or []:
            name, kind, rule = check.get("id"), check.get("type"), check.get("rule")
            problem = None
            if name in seen:
                problem = "listed twice"
            elif check.get("severity") not in E.SEVERITIES:
                problem = "unknown severity"
            elif kind == "deterministic" and rule not in rule_names():
                problem = "unknown rule"
            elif kind == "llm" and not check.get("guidance"):
                problem = "no guidance"
            seen.add(name)
            weight = check.get("weight")
            yield metric, name, kind, check.get("severity"), None if weight is None else float(weight), rule, problem

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [list(read(p, t or "")) for p, t in zip(frame["path"], frame["text"], strict=True)]
            one = frame.drop(columns="text").assign(found=found).explode("found").dropna(subset="found").reset_index(drop=True)
            yield pd.concat([one.drop(columns="found"), pd.DataFrame(one["found"].tolist(), columns=columns)], axis=1)

    rows = files.filter(F.col("path").rlike(r"(^|/)[^_/][^/]*\.yaml$")).select(*keys, "path", "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInPandas(parse, f"{schema}, metric string, check_id string, type string, severity string, weight double, rule string, problem string")


_RUBRICS = [
    ("rubrics/security.yaml", "metric: security\nchecks:\n- {id: S-1, type: deterministic, severity: critical, rule: secrets.none_found, weight: 2.5}\n- {id: S-2, type: llm, severity: low, guidance: look}\n- {id: S-2, type: llm, severity: low, guidance: again}\n"),
    ("rubrics/data.yaml", "metric: other\nchecks:\n- {id: D-1, type: deterministic, severity: high, rule: no.such}\n- {id: D-2, type: llm, severity: medium}\n- {id: D-3, type: llm, severity: odd, guidance: x}\n"),
    ("rubrics/bad.yaml", "a: [b"),
    ("rubrics/_shared.yaml", "metric: x"),
]
_CHECKS = [
    (0, "security", "S-1", "deterministic", "critical", 2.5, "secrets.none_found", None), (0, "security", "S-2", "llm", "low", None, None, None), (0, "security", "S-2", "llm", "low", None, None, "listed twice"),
    (1, "other", None, None, None, None, None, "metric isn't the file's name"), (1, "other", "D-1", "deterministic", "high", None, "no.such", "unknown rule"), (1, "other", "D-2", "llm", "medium", None, None, "no guidance"),
    (1, "other", "D-3", "llm", "odd", None, None, "unknown severity"), (2, None, None, None, None, None, None, "cannot read YAML"),
]


@query("src_rubrics", "", cases_sql(len(_RUBRICS), "VARCHAR metric, VARCHAR check_id, VARCHAR type, VARCHAR severity, DOUBLE weight, VARCHAR rule, VARCHAR problem", _CHECKS))
def src_rubrics(spark, sf_dir):
    return rubric_checks(cases(spark, sf_dir, _RUBRICS, "path string, text string").drop("case")).drop("path")


def sheet_fields(sheets: DataFrame, heading: str) -> DataFrame:
    """(keys, name, line, fields) of Markdown sheets (keys, text): the ``- field: value`` lines below each heading; fenced lines are skipped."""
    keys = [c for c in sheets.columns if c != "text"]
    lines = sheets.select(*keys, F.posexplode(E.split_lines(F.col("text"))).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").startswith("```") | F.col("line").startswith("~~~")
    open_ = lines.withColumn("fences", F.count_if(fence).over(order)).filter(~fence & (F.col("fences") % 2 == 0))
    name = F.when(F.col("line").rlike(heading), F.regexp_extract("line", heading, 1))
    marked = open_.withColumn("block", F.last(F.when(name.isNotNull(), F.struct((F.col("pos") + 1).alias("line"), name.alias("name"))), ignorenulls=True).over(order)).filter("block IS NOT NULL")
    field, value = F.regexp_extract("line", r"^- (\w+):", 1), F.trim(F.regexp_replace(F.regexp_extract("line", r"^- \w+:(.*)$", 1), "^ *`|`$", ""))
    pairs = marked.withColumn("field", F.when(F.col("line").rlike(r"^- \w+:"), F.struct(field.alias("k"), value.alias("v"))))
    return pairs.groupBy(*keys, "block").agg(F.map_from_entries(F.collect_list("field")).alias("fields")).select(*keys, "block.name", "block.line", "fields")


def labels(sheets: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """(keys, check_id, verdict, path, problem) of filled label sheets; checks without a label are left out."""
    keys = [c for c in sheets.columns if c != "text"]
    found = sheet_fields(sheets, r"^### ([A-Z][A-Z0-9]*-\d+)\b.*$")
    verdict = F.lower(F.try_element_at("fields", F.lit("label")))
    path = F.regexp_replace(F.coalesce(F.try_element_at("fields", F.lit("path")), F.lit("")), r"^\./", "")
    rows = found.select(*keys, F.col("name").alias("check_id"), verdict.alias("verdict"), F.when(path != "", path).alias("path")).filter("verdict <> ''")
    problem = F.when(~F.col("verdict").isin(*VERDICTS), "unknown verdict")
    if checks is not None:
        rows = rows.join(checks.select("check_id", F.lit(True).alias("known")).distinct(), "check_id", "left")
        problem = F.when(F.col("known").isNull(), "unknown check").otherwise(problem)
    return rows.select(*keys, "check_id", "verdict", "path", problem.alias("problem"))


_SHEETS = [
    ("# Labels\n- label: none\n### SEC-1 No secrets\nText\n```\n- label: pass\n```\n- label: Fail\n- path: `./src/a.py`\n### SEC-2\n- label:\n- path:\n### LOG-10 x\n- label: odd\n",),
    ("### DATA-1\n- label: not_applicable\n### Notes\n- path: b\n### ZZ-9\n- label: pass",),
    ("",),
]


@query("src_labels", "", cases_sql(len(_SHEETS), "VARCHAR check_id, VARCHAR verdict, VARCHAR path, VARCHAR problem", [(0, "SEC-1", "fail", "src/a.py", None), (0, "LOG-10", "odd", None, "unknown verdict"), (1, "DATA-1", "not_applicable", "b", None), (1, "ZZ-9", "pass", None, "unknown check")]))
def src_labels(spark, sf_dir):
    known = spark.createDataFrame([("SEC-1",), ("SEC-2",), ("LOG-10",), ("DATA-1",)], "check_id string")
    return labels(cases(spark, sf_dir, _SHEETS, "text string").drop("case"), known)


def write_facts(facts: DataFrame, folder: str) -> None:
    """One JSON object a line, a file a partition."""
    facts.write.mode("overwrite").json(folder)


def report_json(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """(run, report): the findings and scores of a run as one JSON text, in report order; a run has a finding for each check at the most."""
    f = findings.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("metric", "check_id", "verdict", "severity"))).alias("findings"))
    s = scores.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("metric", "status", "score"))).alias("metric_scores"))
    return f.join(s, "run", "full").select("run", F.to_json(F.struct("run", F.coalesce("findings", F.array()).alias("findings"), F.coalesce("metric_scores", F.array()).alias("metric_scores"))).alias("report"))


def sarif_log(results: DataFrame, name: str, version: str) -> DataFrame:
    """(run, log): a SARIF 2.1.0 log of a run's results (run, rule_id, level, message, path, start_line, end_line, fingerprint)."""
    region = F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    one = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary/v1")).alias("partialFingerprints"))
    runs = results.groupBy("run").agg(F.array_sort(F.collect_list(one)).alias("results"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    rules = F.transform("rules", lambda r: F.struct(r.alias("id")))
    driver = F.struct(F.struct(F.lit(name).alias("name"), F.lit(version).alias("semanticVersion"), rules.alias("rules")).alias("driver"))
    body = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(F.struct(driver.alias("tool"), F.struct(F.concat(F.lit(f"{name}/"), F.col("run").cast("string")).alias("id")).alias("automationDetails"), F.col("results"))).alias("runs"))
    return runs.select("run", F.to_json(body).alias("log"))


def markdown_report(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """(run, report): a table of scores and a list of findings as Markdown, all text escaped."""
    from quillon.operators.texts import markdown_text

    def listed(rows: DataFrame, line: Column, out: str) -> DataFrame:
        texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])
        return rows.groupBy("run").agg(F.array_join(texts, "\n").alias(out))

    score = F.when(F.col("score").isNull(), "–").otherwise(F.format_string("%.1f", F.col("score").cast("double")))
    table = listed(scores.withColumn("ord", F.col("metric")), F.concat(F.lit("| "), markdown_text(F.col("metric")), F.lit(" | "), score, F.lit(" | "), markdown_text(F.col("status")), F.lit(" |")), "table")
    items = listed(findings.withColumn("ord", F.struct("metric", "check_id")), F.concat(F.lit("- **"), markdown_text(F.col("check_id").cast("string")), F.lit("** "), F.col("verdict"), F.lit(": "), markdown_text(F.col("claim"))), "list")
    head = F.lit("| Metric | Score | Status |\n|---|---|---|\n")
    return table.join(items, "run", "full").select("run", F.concat(F.lit("# Run "), F.col("run").cast("string"), F.lit("\n\n"), head, F.coalesce("table", F.lit("")), F.lit("\n\n"), F.coalesce("list", F.lit(""))).alias("report"))


def diff_comment(diff: DataFrame) -> DataFrame:
    """(comment) of a diff (check_id, change): new and changed issues first, resolved ones counted."""
    rank = E.choose(F.col("change"), {"new": 0, "changed": 1, "resolved": 2, "persisting": 3})
    line = F.concat(F.lit("- "), F.col("change"), F.lit(": "), F.col("check_id").cast("string"))
    rows = diff.withColumn("rank", rank)
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") < 2, F.struct("rank", "check_id", line.alias("line"))))), lambda x: x["line"])
    head = F.concat_ws(", ", *(F.concat(F.count_if(F.col("change") == c).cast("string"), F.lit(f" {c}")) for c in ("new", "changed", "resolved", "persisting")))
    return rows.agg(F.concat(head, F.lit("\n"), F.array_join(lines, "\n")).alias("comment"))
