"""Facts of all extractors in one table: a registry by source, names of facts by hash, and a state for each source.

A fact is (keys, fact_id, source, kind, path, line, severity, attributes), the
attributes as JSON with the names and types of its kind in
``fixed.FACT_ATTRIBUTES``, which the rules read.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import exprs as E
from quillon.functions import fixed
from quillon.operators import code, configs, manifests, texts
from quillon.operators.extract import doc_type, dockerfiles, injections
from quillon.operators.filters import generated, test_path, vendored
from quillon.operators.versions import VERSION, Versions, once_for_alike
from quillon.plans import views as V
from quillon.plans.cases import cases, cases_sql
from quillon.registry import query
from quillon.sources.stores import language_of
from quillon.sources.tables import sizes_at_run_time, stored

#: By source: what it finds in files, as rows (path, attributes and perhaps line) by kind. Their key is the version of
#: the file where they follow from it alone, and the snapshot's keys where they depend on its other files too.
EXTRACTORS: dict[str, Callable[[Files], dict[str, DataFrame]]] = {}


class Files:
    """The files of snapshots as extractors see them: readable ones, none of others' code.

    ``all`` is (version_, path, language, size, loc, generated, text), each version of a
    file once and stored, so that each extractor reads the files of its languages and
    the columns that it needs; ``versions`` knows which snapshots hold them.
    ``source`` is the code among them that isn't generated. Python files are parsed
    once, for all who ask.
    """

    def __init__(self, files: DataFrame, largest: int = 2_000_000):
        self.keys = [VERSION]
        size = F.octet_length("text")
        known = files.filter(~vendored(F.col("path")) & (size <= largest) & (F.instr(F.substring("text", 1, 8192), "\0") == 0))
        self.versions = Versions(known, keep=stored)
        known = self.versions.once.select(
            *self.keys, "path", language_of(F.col("path")).alias("language"), size.alias("size"), F.size(E.split_lines(F.col("text"))).alias("loc"),
            generated(F.col("path"), F.col("text")).alias("generated"), "text",
        )
        self.all = stored(known)
        self.code = self.all.filter(F.col("language").isin(*fixed.CODE_LANGUAGES))
        self.source = self.code.filter("NOT generated")
        self._parsed: DataFrame | None = None

    def plain(self, rows: DataFrame | None = None) -> DataFrame:
        """(keys, path, text)."""
        return (self.all if rows is None else rows).select(*self.keys, "path", "text")

    def named(self) -> DataFrame:
        """(keys, path, language, text) of source code."""
        return self.source.select(*self.keys, "path", "language", "text")

    def python(self, with_generated: bool = False) -> DataFrame:
        """What all readers find in Python files."""
        if self._parsed is None:
            mine = self.code.filter("language = 'python'").select(*self.keys, "path", "text", "generated")
            self._parsed = stored(code.python_facts(mine))
        rows = self._parsed if with_generated else self._parsed.filter("NOT generated")
        return rows.drop("generated")


def extractor(source: str) -> Callable:
    """Register an extractor; sources are unique."""
    if source in EXTRACTORS:
        raise ValueError(f"duplicate extractor {source}")

    def register(function: Callable[[Files], dict[str, DataFrame]]) -> Callable:
        EXTRACTORS[source] = function
        return function

    return register


@extractor("ast:imports")
def _imports(files: Files) -> dict[str, DataFrame]:
    back = files.versions.back
    script = files.plain(files.source.filter("language IN ('javascript', 'typescript')"))
    own = files.versions.held(files.source.filter("language = 'python'"))
    parsed = files.python().filter("reader = 'imports'")
    # modules are looked up among those of the snapshot
    found = once_for_alike(own, files.versions.keys, lambda first: code.python_imports(first.drop(VERSION), first.join(parsed, ["path", VERSION]).drop(VERSION)))
    return {"import_edge": found.unionByName(back(texts.js_edges(script)), allowMissingColumns=True)}


@extractor("ast:manifests")
def _manifests(files: Files) -> dict[str, DataFrame]:
    listed = manifests.dependencies(files.plain())
    # a lockfile may lie anywhere in the snapshot
    own = files.versions.placed.filter(manifests.manifest_type(F.col("path")).isNotNull() | manifests.is_lockfile(F.col("path")))
    found = once_for_alike(own, files.versions.keys, lambda first: manifests.manifests(first.drop(VERSION), first.join(listed, ["path", VERSION]).drop(VERSION)))
    return {"manifest": found, "dependency": listed}


@extractor("ast:ci")
def _ci(files: Files) -> dict[str, DataFrame]:
    ci = configs.ci_files(files.plain(files.all.filter(configs.ci_system(F.col("path")).isNotNull())), keep=stored)
    return {"ci_workflow": configs.ci_workflows(ci), "ci_step": configs.ci_steps(ci)}


@extractor("ast:docker")
def _docker(files: Files) -> dict[str, DataFrame]:
    found = dockerfiles(files.plain(files.all.filter("language = 'dockerfile'")))
    bases = F.filter(F.split("bases", ","), lambda b: b != "")
    return {"dockerfile": found.withColumns({"external_bases": bases, "has_healthcheck": F.col("healthcheck")})}


@extractor("ast:deploy")
def _deploy(files: Files) -> dict[str, DataFrame]:
    return {"deploy_config": configs.deploy_configs(files.plain(files.all.filter("language = 'yaml'"))).withColumnRenamed("kind", "config")}


@extractor("ast:routes")
def _routes(files: Files) -> dict[str, DataFrame]:
    found = code.python_routes(files.python()).unionByName(code.pattern_routes(files.named()), allowMissingColumns=True)
    return {"route": found}


@extractor("ast:tests")
def _tests(files: Files) -> dict[str, DataFrame]:
    return {"test_file": code.python_tests(files.python()).unionByName(code.pattern_tests(files.named()))}


@extractor("ast:logging")
def _calls(files: Files) -> dict[str, DataFrame]:
    lines = files.named().select(*files.keys, "path", "language", F.posexplode(E.split_lines(F.col("text"))).alias("pos", "text_line"))
    lines = lines.select(*files.keys, "path", "language", (F.col("pos") + 1).alias("line_no"), F.col("text_line").alias("line"))
    others = code.pattern_calls(lines).select(*files.keys, "path", "kind", F.col("line_no").alias("line"))
    found = code.python_calls(files.python()).unionByName(others, allowMissingColumns=True)
    found = found.withColumnRenamed("kind", "call").withColumn("in_test", test_path(F.col("path")))
    return {kind: found.filter(F.col("call") == kind).drop("call") for kind in ("print_call", "log_call")}


@extractor("ast:metrics")
def _metrics(files: Files) -> dict[str, DataFrame]:
    return {"file_metrics": code.source_metrics(files.code.drop("size"), files.python(with_generated=True))}


@extractor("fs:docs")
def _docs(files: Files) -> dict[str, DataFrame]:
    return {"doc_file": files.all.select(*files.keys, "path", doc_type(F.col("path")).alias("type")).filter("type IS NOT NULL")}


@extractor("fs:injection")
def _injections(files: Files) -> dict[str, DataFrame]:
    own = files.all.filter("NOT generated")
    lines = own.select(*files.keys, "path", "size", F.posexplode(E.split_lines(F.col("text"))).alias("pos", "line"))
    found = injections(lines.withColumn("line_no", F.col("pos") + 1), keys=tuple(files.keys))
    return {"injection_attempt": found.withColumnRenamed("line_no", "line")}


def fact_id(source: Column, kind: Column, attributes: Column, path: Column) -> Column:
    """The kind and twelve hex digits of a hash over what the fact says."""
    payload = F.concat(F.lit("["), F.concat_ws(", ", texts.json_text(source), texts.json_text(kind), attributes, texts.json_text(path)), F.lit("]"))
    return F.concat(kind, F.lit(":"), F.substring(F.sha1(payload), 1, 12))


def as_facts(rows: DataFrame, source: str, kind: str, keys: list[str]) -> DataFrame:
    """Rows (keys, path, perhaps line and severity, and all attributes of the kind) as facts."""
    wanted = fixed.FACT_ATTRIBUTES[kind]
    if missing := set(wanted) - set(rows.columns) - {"path"}:
        raise ValueError(f"{source} gives {kind} without {', '.join(sorted(missing))}")
    # a route's path is an attribute of the fact, beside the path of its file
    named = {n: F.col("route") if (kind, n) == ("route", "path") else F.col(n) for n in wanted}
    attributes = F.struct(*(c.cast(wanted[n]).alias(n) for n, c in named.items())) if named else F.lit("{}")
    text = F.to_json(attributes, {"ignoreNullFields": "false"}) if named else attributes
    more = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (("line", "int"), ("severity", "string"))]
    return rows.select(*keys, F.lit(source).alias("source"), F.lit(kind).alias("kind"), "path", *more, text.alias("attributes"))


def _found(source: str, seen: Files, inner: list[str]) -> list[DataFrame]:
    """One source's facts: those of versions, and those of snapshots."""
    tables: dict[bool, list[DataFrame]] = {}
    for kind, rows in EXTRACTORS[source](seen).items():
        alone = VERSION in rows.columns
        tables.setdefault(alone, []).append(as_facts(rows, source, kind, [VERSION] if alone else inner))
    return [reduce(DataFrame.unionByName, t).withColumn("fact_id", fact_id(F.col("source"), F.col("kind"), F.col("attributes"), F.col("path"))) for t in tables.values()]


def _placed(found: list[DataFrame], seen: Files, names: dict[str, str]) -> DataFrame:
    """All facts of all snapshots, the keys under the names that they came with."""
    alone = [t for t in found if VERSION in t.columns]
    whole = [t for t in found if VERSION not in t.columns]
    whole += [seen.versions.back(reduce(DataFrame.unionByName, alone))] if alone else []
    return reduce(DataFrame.unionByName, whole).select(*(F.col(i).alias(k) for i, k in names.items()), *_KINDS)


def _seen(files: DataFrame) -> tuple[Files, dict[str, str]]:
    """The files under inner names of their keys, so that keys may have any names, also those of attributes."""
    keys = [c for c in files.columns if c not in ("path", "text")]
    names = {f"key{i}_": k for i, k in enumerate(keys)}
    return Files(files.select(*(F.col(k).alias(i) for i, k in names.items()), "path", "text")), names


_WRONG = (PySparkException, ValueError, KeyError, TypeError)
_KINDS = {"source": "string", "kind": "string", "path": "string", "line": "int", "severity": "string", "attributes": "string", "fact_id": "string"}


def _none(files: DataFrame) -> DataFrame:
    keys = [c for c in files.columns if c not in ("path", "text")]
    return files.limit(0).select(*keys, *(F.lit(None).cast(t).alias(c) for c, t in _KINDS.items()))


def stored_facts(files: DataFrame, sources: list[str] | None = None, at_once: int = 4) -> tuple[DataFrame, dict[str, str]]:
    """As ``run_extractors``, what each source found being written to the shared folder.

    Sources are planned and run a few at a time, so that the small ones don't wait for
    each other, and one that fails while it runs doesn't stop the others either.
    """
    with sizes_at_run_time(files.sparkSession):
        seen, names = _seen(files)
        if not sources or any(s in ("ast:imports", "ast:routes", "ast:tests", "ast:logging", "ast:metrics") for s in sources):
            seen.python()  # before several ask for it

        def store(source: str) -> tuple[str, list[DataFrame], str]:
            try:
                return source, [stored(t) for t in _found(source, seen, list(names))], "ok"
            except _WRONG as wrong:
                return source, [], f"error: {wrong}".splitlines()[0]

        with ThreadPoolExecutor(at_once) as pool:
            done = list(pool.map(inheritable_thread_target(files.sparkSession)(store), sources or sorted(EXTRACTORS)))
    found = [t for _, tables, _ in done for t in tables]
    return _placed(found, seen, names) if found else _none(files), {source: state for source, _, state in done}


def run_extractors(files: DataFrame, sources: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Facts of all sources over ``files`` (keys, path, text), and each source's state: ok, or what is wrong with its plan.

    A source that can't be planned doesn't stop the others.
    """
    seen, names = _seen(files)
    out, states = [], {}
    for source in sources or sorted(EXTRACTORS):
        try:
            out += _found(source, seen, list(names))
            states[source] = "ok"
        except _WRONG as wrong:
            states[source] = f"error: {wrong}".splitlines()[0]
    return _placed(out, seen, names) if out else _none(files), states


_REPO = [
    (
        [
            ("src/app/main.py", "import os\nfrom app import db\nlog.info('x')\n@app.get('/health')\ndef health():\n    print(1)\n"), ("src/app/db.py", ""), ("src/app/__init__.py", ""), ("tests/test_a.py", "def test_a():\n    assert 1\n"), ("web/a.ts", "import x from './b'\nimport y from 'z'\n"),
            ("pyproject.toml", "[project]\ndependencies = ['a']\n"), (".github/workflows/ci.yml", "jobs: {a: {steps: [{run: pytest}, {uses: x/y@v1}]}}"), ("compose.yaml", "services: {a: {}, b: {}}"), ("Dockerfile", "FROM a:1\nUSER b\n"), ("README.md", "# x"), ("docs/adr/1.md", ""),
        ],
    ),
    ([("Dockerfile", "FROM x AS y\nFROM y\n"), ("a/Dockerfile.dev", "FROM z"), ("broken.py", "def (")],),
]
_COUNTS = [
    (0, "ast:imports", "import_edge", 4), (0, "ast:manifests", "manifest", 1), (0, "ast:manifests", "dependency", 1), (0, "ast:ci", "ci_workflow", 1), (0, "ast:ci", "ci_step", 2),
    (0, "ast:deploy", "deploy_config", 2), (0, "ast:routes", "route", 1), (0, "ast:tests", "test_file", 1), (0, "ast:logging", "log_call", 1), (0, "ast:logging", "print_call", 1),
    (0, "ast:docker", "dockerfile", 1), (0, "ast:metrics", "file_metrics", 5), (0, "fs:docs", "doc_file", 2), (1, "ast:docker", "dockerfile", 2), (1, "ast:metrics", "file_metrics", 1),
]


@query("fact_all_sources", "", cases_sql(len(_REPO), "VARCHAR source, VARCHAR kind, BIGINT n", _COUNTS))
def fact_all_sources(spark, sf_dir):
    """How many different facts each source finds in each repository."""
    files = cases(spark, sf_dir, _REPO, "files array<struct<path:string,text:string>>").select("id", F.inline("files"))
    return stored_facts(files)[0].groupBy("id", "source", "kind").agg(F.count_distinct("fact_id").alias("n"))


@query("fn_fact_id", "", """SELECT p_partkey, 'part:' || substr(sha1('["src", "part", {"name": "' || p_name || '"}, "' || p_brand || '"]'), 1, 12) AS fact_id FROM part""")
def fn_fact_id(spark, sf_dir):
    attributes = texts.canonical({"name": texts.json_text(F.col("p_name"))})
    return V.table(spark, sf_dir, "part").select("p_partkey", fact_id(F.lit("src"), F.lit("part"), attributes, F.col("p_brand")).alias("fact_id"))


def inputs_key(files: DataFrame, keys: list[str], version: str) -> DataFrame:
    """(keys, key): a hash over the sorted paths, sizes and hashes of a metric's files, beside the rubric's version; a snapshot holds 30 000 files at the most."""
    row = F.concat(F.lit("["), F.concat_ws(",", texts.json_text(F.col("path")), F.col("size").cast("string"), texts.json_text(F.col("sha256"))), F.lit("]"))
    listed = files.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", row.alias("row")))), lambda x: x["row"]), ",").alias("rows"))
    return listed.select(*keys, F.sha2(F.concat(F.lit('{"files":['), "rows", F.lit(f'],"rubric_version":"{version}"}}')), 256).alias("key"))


@query("ver_inputs_key", "files", """SELECT split_part(path, '/', 2) AS source, sha256('{"files":[' || string_agg('["' || path || '",' || size || ',"' || sha256(text) || '"]', ',' ORDER BY path) || '],"rubric_version":"1.2"}') AS key FROM files GROUP BY 1""")
def ver_inputs_key(spark, sf_dir):
    rows = V.files(spark, sf_dir).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("source"), "path", "size", F.sha2("text", 256).alias("sha256"))
    return inputs_key(rows, ["source"], "1.2")
