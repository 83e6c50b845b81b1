"""Captured scanner runs: the data source, states, adapters, and what rules make of them."""

from __future__ import annotations

import json

import pytest

from quillon.operators import assess, rules
from quillon.sources import scans

OUTPUTS = {
    "semgrep": {"results": [{"check_id": "a.b", "path": "/src/x.py", "start": {"line": 1}, "end": {"line": 2}, "extra": {"severity": "ERROR", "metadata": {}}}]},
    "hadolint": [{"code": "DL1", "file": "Dockerfile", "level": "error", "line": 1, "message": "m"}],
    "actionlint": [{"message": "m", "filepath": ".github/workflows/a.yml", "line": 3, "kind": "k"}],
    "checkov": [{"check_type": "kubernetes", "results": {"failed_checks": [{"check_id": "C1", "file_abs_path": "/src/k.yml", "severity": "HIGH"}], "parsing_errors": ["/src/b.yml"]}, "summary": {"parsing_errors": 1}}],
    "gitleaks": [{"RuleID": "key", "StartLine": 1, "EndLine": 1, "StartColumn": 1, "EndColumn": 9, "File": "/src/.env"}],
    "osv-scanner": {"results": [{"packages": [{"package": {"name": "p", "version": "1"}, "vulnerabilities": [], "groups": [{"ids": ["G-1"], "max_severity": "9.8"}]}]}]},
    "lizard": [{"file": "x.py", "name": "f", "ccn": 99, "nloc": 5, "params": 0, "start_line": 1}, {"file": "x.py", "name": "g", "ccn": 1, "nloc": 5, "params": 0, "start_line": 9}],
}


def _capture(root, run, tool, output, **record):
    folder = root / run / tool
    folder.mkdir(parents=True)
    (folder / "record.json").write_text(json.dumps({"exit_code": 0, "version": "1.0", "duration_ms": 5} | record))
    if output is not None:
        (folder / "output.json").write_text(output if isinstance(output, str) else json.dumps(output))


@pytest.fixture
def captured(tmp_path):
    for tool, output in OUTPUTS.items():
        _capture(tmp_path, "found", tool, output, exit_code=1 if 1 in scans.ADAPTERS[tool].ok_exit_codes else 0)
        _capture(tmp_path, "clean", tool, {"results": []} if isinstance(output, dict) else [])
        _capture(tmp_path, "skipped", tool, None, skipped=True)
    _capture(tmp_path, "odd", "semgrep", OUTPUTS["semgrep"], exit_code=2, error="bad rule")
    _capture(tmp_path, "odd", "hadolint", "{not json")
    _capture(tmp_path, "odd", "checkov", OUTPUTS["checkov"], timed_out=True)
    _capture(tmp_path, "odd", "osv-scanner", None)
    _capture(tmp_path, "odd", "unheard-of", [])
    (tmp_path / "odd/gitleaks").mkdir()
    (tmp_path / "odd/gitleaks/record.json").write_text("[]")
    (tmp_path / "odd/lizard").mkdir()
    (tmp_path / "odd/lizard/output.json").write_text("[]")
    (tmp_path / "README").write_text("not a capture")
    return str(tmp_path)


def test_states_of_captures(spark, captured):
    got = {(r.run, r.tool): (r.tool_status, r.error) for r in scans.read_scans(spark, captured).collect()}
    assert len(got) == 3 * 7 + 7
    assert {s for (run, _), (s, _) in got.items() if run in ("found", "clean")} == {"ok"} and {s for (run, _), (s, _) in got.items() if run == "skipped"} == {"skipped"}
    assert {t: s for (run, t), s in got.items() if run == "odd"} == {
        "semgrep": ("error", "exit 2: bad rule"), "hadolint": ("error", "output is no JSON"), "checkov": ("timeout", "timed out"), "osv-scanner": ("ok", None),
        "unheard-of": ("error", "no adapter of this tool"), "gitleaks": ("error", "exit None:"), "lizard": ("error", "no record of the run"),
    }
    assert scans.read_scans(spark, f"file://{captured}").rdd.getNumPartitions() >= 28
    assert scans.read_scans(spark, f"{captured}/nothing-here").count() == 0


def test_captures_become_facts_and_verdicts(spark, captured):
    read = scans.read_scans(spark, captured)
    facts = scans.scanned_facts(read)
    assert {r.kind for r in facts.filter("run = 'found'").collect()} == {k for a in scans.ADAPTERS.values() for k in a.kinds}
    assert facts.filter("run <> 'found'").count() == 0
    names = ["secrets.none_found", "vulns.max_severity", "sast.max_severity", "iac.max_severity", "complexity.ccn_ratio", "ci.actionlint_clean", "docker.hadolint_errors"]
    runs = spark.createDataFrame([("found",), ("clean",), ("skipped",), ("odd",), ("none",)], "run string")
    got = {(r.run, r.rule): (r.verdict, r.reason) for r in rules.run_rules(dict.fromkeys(names), facts, runs, scans.tool_runs(read)).collect()}
    assert [got["found", n][0] for n in names] == ["fail"] * 7
    assert [got["clean", n][0] for n in names] == ["pass"] * 4 + ["not_applicable"] + ["pass"] * 2
    assert {got["skipped", n] for n in names} == {("not_applicable", "tool_skipped")}
    assert [got["odd", n] for n in names] == [
        ("unknown", "tool_error"), ("pass", None), ("unknown", "tool_error"), ("unknown", "tool_timeout"), ("unknown", "tool_error"), ("unknown", "tool_not_run"), ("unknown", "tool_error"),
    ]
    assert {got["none", n] for n in names} == {("unknown", "tool_not_run")}


def test_scans_join_an_assessment(spark, captured):
    read = scans.read_scans(spark, captured)
    files = spark.createDataFrame([("found", "README.md", "x")], "run string, path string, text string")
    rubric = [assess.Check("s", "secrets.none_found", "critical"), assess.Check("d", "files.any_exists", "low", {"globs": ["README*"]})]
    got = assess.assess(files, files.select("run"), rubric, scans.scanned_facts(read), scans.tool_runs(read)).collect()
    assert {(r.rule, r.verdict, r.place) for r in got} == {("secrets.none_found", "fail", ".env"), ("files.any_exists", "pass", "README.md")}


def test_adapters_are_registered_once(monkeypatch):
    monkeypatch.setattr(scans, "ADAPTERS", dict(scans.ADAPTERS))
    with pytest.raises(ValueError):
        scans.adapter("semgrep", "sast_finding")
    with pytest.raises(ValueError):
        scans.adapter("new", "no_such_kind")
    scans.adapter("new", "secret")(lambda raw: raw)
    assert scans.ADAPTERS["new"].ok_exit_codes == {0}
