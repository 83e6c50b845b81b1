"""Mutations: edits of a repository's files that plant one defect each, with the verdicts that they must bring about.

A mutation says which files it needs, what becomes of their text (or that they go),
which files it adds, and which rules then say what. All variants of all repositories
are files under one more key, so they are assessed in one go; what rules say of a
variant and didn't say of its repository are the mutation's effects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import assess
from quillon.operators.versions import Alike
from quillon.plans import views as V
from quillon.plans.cases import literal
from quillon.registry import query
from quillon.sources.tables import stored

#: The name of the variant that changes nothing.
BASE = "base"


@dataclass(frozen=True)
class Mutation:
    """``where``: the path pattern of files that it needs; ``edit``: their new text, none to delete them; ``holds``: what their text must have.

    A repository without such a file has no variant of the mutation.
    """

    name: str
    where: str
    expected: dict[str, str]
    edit: Callable[[Column], Column] | None = None
    holds: str = ""
    adds: dict[str, str] = field(default_factory=dict)

    def hits(self, path: Column, text: Column) -> Column:
        return path.rlike(self.where) & F.coalesce(text.rlike(self.holds), F.lit(False))


def replaced(pattern: str, by: str) -> Callable[[Column], Column]:
    return lambda text: F.regexp_replace(text, pattern, by)


def _gone(name: str, where: str, **expected: str) -> Mutation:
    return Mutation(name, where, {k.replace("__", "."): v for k, v in expected.items()})


_DOCKER, _CI, _CODE = r"(^|/)Dockerfile$", r"^\.github/workflows/.*\.ya?ml$", r"\.py$"
MUTATIONS = (
    Mutation("root-user", _DOCKER, {"docker.non_root": "fail"}, replaced(r"(?m)^USER .*\n?", ""), r"(?m)^USER "),
    Mutation("latest-image", _DOCKER, {"docker.pinned_base": "fail"}, replaced(r"(?m)^FROM ([\w/]+):[\w.-]+", "FROM $1:latest"), r"(?m)^FROM [\w/]+:"),
    Mutation("one-stage", _DOCKER, {"docker.multistage": "fail"}, replaced(r"(?m)\A(.*\n)*?(?=FROM .*\n(?:(?!FROM).*\n?)*\z)", ""), r"(?m)^FROM .* AS "),
    Mutation("no-health-check", _DOCKER, {"docker.healthcheck": "fail"}, replaced(r"(?m)^HEALTHCHECK .*\n?", ""), r"(?m)^HEALTHCHECK "),
    Mutation("write-all", _CI, {"ci.permissions_restricted": "fail"}, replaced("permissions: read-all", "permissions: write-all"), "permissions: read-all"),
    Mutation("loose-action", _CI, {"ci.actions_pinned": "fail"}, replaced(r"uses: actions/", "uses: someone/"), r"uses: actions/[\w-]+@v"),
    Mutation("untested-build", _CI, {"ci.runs_tests": "fail", "ci.stages": "partial", "tests.coverage_configured": "fail"}, replaced(r"(?m)^ *- run: pytest.*\n?", ""), "- run: pytest --cov"),
    _gone("no-workflows", _CI, ci__present="fail", ci__stages="not_applicable", ci__runs_tests="not_applicable", ci__permissions_restricted="not_applicable", ci__actions_pinned="not_applicable", tests__coverage_configured="fail"),
    _gone("no-tests", r"^tests/", tests__present="fail", tests__ratio="fail"),
    _gone("no-lockfile", r"(^|/)uv\.lock$", deps__lockfile_present="fail"),
    _gone("no-decisions", r"^docs/adr/", docs__architecture="fail"),
    _gone("no-migrations", r"/migrations/", data__migrations_present="fail"),
    Mutation("no-health-route", _CODE, {"observability.present": "fail"}, replaced('"/health"', '"/items"'), '"/health"'),
    Mutation("prints", _CODE, {"ast.debug_output_ratio": "fail"}, replaced(r"\blog\.info\(", "print("), r"\blog\.info\("),
    Mutation("no-docstring", _CODE, {"docs.docstring_ratio": "fail"}, replaced(r'(?m)^ +"""Doc\."""\n', ""), '"""Doc'),
    Mutation("no-limits", r"(^|/)compose\.yaml$", {"deploy.resource_limits": "fail"}, replaced(r"mem_limit: \w+, ", ""), "mem_limit: "),
    Mutation("import-cycle", r"^app/main\.py$", {"imports.no_cycles": "fail"}, lambda text: F.concat(F.lit("import app.loop\n"), text), "", {"app/loop.py": "import app.main"}),
)


def mutated(files: DataFrame, mutations: tuple[Mutation, ...] = MUTATIONS) -> DataFrame:
    """(run, mutation, path, text) of ``files`` (run, path, text): each repository as it is, and each variant whose precondition holds."""
    path, text, name = F.col("path"), F.col("text"), F.col("mutation")
    hit, new, gone = F.lit(False), text, F.lit(False)
    for m in mutations:
        mine = (name == m.name) & m.hits(path, text)
        hit = hit | mine
        new = F.when(mine, m.edit(text)).otherwise(new) if m.edit else new
        gone = gone | mine if not m.edit else gone
    names = F.array(*(F.lit(m.name) for m in mutations))
    variants = files.select("run", "path", "text", F.explode(names).alias("mutation")).withColumn("hit", hit)
    able = variants.groupBy("run", "mutation").agg(F.bool_or("hit").alias("able")).filter("able").drop("able")
    kept = variants.withColumns({"text": new, "gone": gone}).filter("NOT gone").join(able, ["run", "mutation"], "left_semi")
    added = [(m.name, p, t) for m in mutations for p, t in m.adds.items()]
    extra = F.explode(F.array(*(F.struct(F.lit(n).alias("mutation"), F.lit(p).alias("path"), F.lit(t).alias("text")) for n, p, t in added))).alias("x")
    more = files.select("run").distinct().select("run", extra).select("run", "x.*").join(able, ["run", "mutation"], "left_semi") if added else None
    columns = ["run", "mutation", "path", "text"]
    out = files.select("run", F.lit(BASE).alias("mutation"), "path", "text").unionByName(kept.select(*columns))
    return out.unionByName(more.select(*columns)) if added else out


def effects(files: DataFrame, rubric: list[assess.Check], mutations: tuple[Mutation, ...] = MUTATIONS) -> DataFrame:
    """(run, mutation, rule, before, after): verdicts of variants that aren't those of their repositories.

    Repositories of the same files have the same effects, so that each is edited and assessed once.
    """
    files = stored(files)
    alike = Alike(files, "run")
    variants = stored(mutated(alike.first(files), mutations))
    key = F.to_json(F.struct("run", "mutation"))
    runs = variants.select(key.alias("run")).distinct()
    said = assess.assess(variants.select(key.alias("run"), "path", "text"), runs, rubric)
    kind = f"run {dict(files.dtypes)['run']}, mutation string"
    said = said.select(F.from_json("run", kind).alias("k"), "rule", "verdict").select("k.*", "rule", "verdict")
    base = said.filter(F.col("mutation") == BASE).select("run", "rule", F.col("verdict").alias("before"))
    after = said.filter(F.col("mutation") != BASE).withColumnRenamed("verdict", "after")
    changed = after.join(base, ["run", "rule"]).filter("before <> after").select("run", "mutation", "rule", "before", "after")
    return alike.back(stored(changed))


_MAIN = 'import logging\nlog = logging.getLogger()\n\n@app.get("/health")\ndef health():\n    """Doc."""\n    log.info("x")'
#: A repository without defects.
GOOD = {
    "Dockerfile": "FROM node:20 AS b\nRUN x\nFROM python:3.12\nUSER app\nHEALTHCHECK CMD x\n",
    ".github/workflows/ci.yml": "on: push\npermissions: read-all\njobs:\n  a:\n    steps:\n    - uses: actions/checkout@v4\n    - run: pytest --cov\n    - run: ruff check .\n    - run: docker build .\n",
    "app/main.py": _MAIN, "pyproject.toml": '[project]\ndependencies = ["fastapi>=1"]', "uv.lock": "", "compose.yaml": "services:\n  x: {mem_limit: 1g, image: y}",
    "tests/test_x.py": "def test_x():\n" + "\n".join(["    assert 1"] * 9), "README.md": "# x", "docs/adr/1.md": "x", "db/migrations/001.sql": "x",
}


def _expected_sql() -> str:
    """What each mutation must bring about; repositories lack what their number says."""
    rows = [(m.name, rule, after) for m in MUTATIONS for rule, after in m.expected.items()]
    values = ", ".join(f"({', '.join(map(literal, row))})" for row in rows)
    missing = "(s_suppkey % 2 = 1 AND mutation = 'no-decisions') OR (s_suppkey % 3 = 1 AND mutation = 'no-limits') OR (s_suppkey % 5 = 1 AND mutation = 'no-migrations')"
    return f"SELECT s_suppkey AS run, mutation, rule, 'pass' AS before, after FROM supplier, (VALUES {values}) e(mutation, rule, after) WHERE NOT ({missing})"


@query("eval_mutations", "", _expected_sql())
def eval_mutations(spark, sf_dir):
    """Every mutation of a repository for each supplier changes the verdicts that it says, and no others."""
    k = F.col("s_suppkey")
    gone = {"docs/adr/1.md": k % 2 == 1, "compose.yaml": k % 3 == 1, "db/migrations/001.sql": k % 5 == 1}
    known = F.array(*(F.when(~gone.get(p, F.lit(False)), F.struct(F.lit(p).alias("path"), F.lit(t).alias("text"))) for p, t in GOOD.items()))
    suppliers = V.table(spark, sf_dir, "supplier").repartition(max(1, spark.sparkContext.defaultParallelism), "s_suppkey")
    return effects(suppliers.select(k.alias("run"), F.inline(F.array_compact(known))), assess.RUBRIC)
