"""Captured scanner runs as a data source, and adapters that turn them into facts.

A capture is a folder ``<run>/<tool>`` with ``record.json`` (exit_code, timed_out,
skipped, version, duration_ms, error) and ``output.json``. The source reads each
folder as a partition of its own and gives one row for it, with a state instead of
an error: ok, skipped, timeout or error. An adapter names its tool, the exit codes
that aren't failures, and how its output becomes rows of facts; more of them can
be registered.

``spark.dataSource.register(CapturedScans)`` makes the source known to a session;
``read_scans`` does so.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.functions import fixed
from quillon.operators import extract, scanners

SCHEMA = "run string, tool string, tool_status string, version string, duration_ms long, error string, json string"


@dataclass(frozen=True)
class Adapter:
    """``facts``: rows (run, json) of runs that are ok to rows (run, kind, path, severity, and the kind's attributes)."""

    tool: str
    kinds: tuple[str, ...]
    facts: Callable[[DataFrame], DataFrame]
    ok_exit_codes: frozenset[int] = frozenset({0})


ADAPTERS: dict[str, Adapter] = {}


def adapter(tool: str, *kinds: str, ok_exit_codes: tuple[int, ...] = (0,)) -> Callable:
    """Register the facts of a tool's output; tools are unique, kinds are those of ``fixed.FACT_ATTRIBUTES``."""
    if tool in ADAPTERS or not set(kinds) <= set(fixed.FACT_ATTRIBUTES):
        raise ValueError(f"duplicate tool {tool}, or an unknown kind among {', '.join(kinds)}")

    def register(function: Callable[[DataFrame], DataFrame]) -> Callable:
        ADAPTERS[tool] = Adapter(tool, kinds, function, frozenset(ok_exit_codes))
        return function

    return register


def _as(kind: str, rows: DataFrame, severity: Column | None = None, **attributes: str) -> DataFrame:
    """Rows as facts of one kind: attributes by the columns that hold them."""
    path = F.col("path") if "path" in rows.columns else F.lit(None).cast("string")
    level = F.lit(None).cast("string") if severity is None else severity
    return rows.select("run", F.lit(kind).alias("kind"), path.alias("path"), level.alias("severity"), *(F.col(c).alias(n) for n, c in attributes.items()))


@adapter("semgrep", "sast_finding", ok_exit_codes=(0, 1))
def _semgrep(raw: DataFrame) -> DataFrame:
    return _as("sast_finding", scanners.semgrep(raw), F.col("severity"), rule_id="rule_id")


@adapter("hadolint", "hadolint_finding")
def _hadolint(raw: DataFrame) -> DataFrame:
    return _as("hadolint_finding", scanners.hadolint(raw), F.col("severity"), rule_id="code")


@adapter("actionlint", "actionlint_finding", ok_exit_codes=(0, 1))
def _actionlint(raw: DataFrame) -> DataFrame:
    return _as("actionlint_finding", scanners.actionlint(raw).withColumnRenamed("kind", "rule"), rule_id="rule")


@adapter("checkov", "iac_finding", "iac_parse_error")
def _checkov(raw: DataFrame) -> DataFrame:
    rows = scanners.checkov(raw)
    found = _as("iac_finding", rows.filter("kind = 'iac_finding'"), F.col("severity"), rule_id="check_id")
    return found.unionByName(_as("iac_parse_error", rows.filter("kind <> 'iac_finding'")), allowMissingColumns=True)


@adapter("gitleaks", "secret")
def _gitleaks(raw: DataFrame) -> DataFrame:
    return _as("secret", scanners.gitleaks(raw), rule_id="rule_id")


@adapter("osv-scanner", "vuln_dependency", ok_exit_codes=(0, 1))
def _osv(raw: DataFrame) -> DataFrame:
    return _as("vuln_dependency", extract.osv_severities(raw), F.col("severity"), name="name", vuln_id="group")


@adapter("lizard", "function_metrics")
def _lizard(raw: DataFrame) -> DataFrame:
    return _as("function_metrics", scanners.lizard(raw), name="name", ccn="ccn")


class _Folder(InputPartition):
    def __init__(self, run: str, tool: str):
        self.run, self.tool = run, tool


def _filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if ":" in root.split("/")[0] else f"file://{root}")


class _Reader(DataSourceReader):
    def __init__(self, root: str, accepted: dict[str, frozenset[int]]):
        self.root, self.accepted = root, accepted

    def partitions(self) -> list[_Folder]:
        """A partition for each run and tool; their names are all that the driver lists."""
        files, base = _filesystem(self.root)
        found = files.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
        names = sorted({tuple(f.path[len(base.rstrip("/")) + 1 :].split("/")[:2]) for f in found if f.type == pafs.FileType.File})
        return [_Folder(*n) for n in names if len(n) == 2]

    def read(self, folder: _Folder | None) -> Iterator[tuple]:
        if folder is None:  # there are no partitions
            return
        files, base = _filesystem(self.root)

        def text(name: str) -> str | None:
            try:
                with files.open_input_stream(f"{base}/{folder.run}/{folder.tool}/{name}") as stream:
                    return stream.read().decode("utf-8", "replace")
            except FileNotFoundError:
                return None

        yield (folder.run, folder.tool, *state(text("record.json"), text("output.json"), self.accepted.get(folder.tool)))


def state(record: str | None, output: str | None, accepted: frozenset[int] | None) -> tuple:
    """(tool_status, version, duration_ms, error, json) of one capture; output only of runs that are ok."""
    try:
        said = json.loads(record or "")
        said = said if isinstance(said, dict) else {}
    except ValueError:
        return "error", None, None, "no record of the run", None
    about = (said.get("version"), said.get("duration_ms"))
    if accepted is None:
        return "error", *about, "no adapter of this tool", None
    if said.get("skipped"):
        return "skipped", *about, said.get("error"), None
    if said.get("timed_out"):
        return "timeout", *about, said.get("error") or "timed out", None
    if said.get("exit_code") not in accepted:
        return "error", *about, f"exit {said.get('exit_code')}: {said.get('error') or ''}".strip(), None
    try:
        json.loads(output or "null")
    except ValueError:
        return "error", *about, "output is no JSON", None
    return "ok", *about, None, output


class CapturedScans(DataSource):
    """``spark.read.format("captured_scans").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "captured_scans"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], {a.tool: a.ok_exit_codes for a in ADAPTERS.values()})


def read_scans(spark: SparkSession, root: str) -> DataFrame:
    """(run, tool, tool_status, version, duration_ms, error, json) of each capture below a folder."""
    spark.dataSource.register(CapturedScans)
    return spark.read.format("captured_scans").load(root)


def scanned_facts(scans: DataFrame) -> DataFrame:
    """Facts (run, kind, path, severity, attributes) of all runs that are ok, by their tools' adapters."""
    out = []
    for a in ADAPTERS.values():
        raw = scans.filter((F.col("tool") == a.tool) & (F.col("tool_status") == "ok")).select("run", "json")
        rows = a.facts(raw)
        attributes = [c for c in rows.columns if c not in ("run", "kind", "path", "severity")]
        text = F.to_json(F.struct(*attributes)) if attributes else F.lit("{}")
        out.append(rows.select("run", "kind", "path", "severity", text.alias("attributes")))
    return reduce(DataFrame.unionByName, out)


def tool_runs(scans: DataFrame) -> DataFrame:
    """(run, tool, tool_status, ord) as rules read them."""
    return scans.select("run", "tool", "tool_status", F.lit(1).alias("ord"))
