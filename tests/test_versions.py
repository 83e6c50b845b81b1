"""Files are read once a version, and what is found lies in every snapshot that holds it."""

from __future__ import annotations

from quillon.operators import code, configs, facts, trees, versions
from quillon.sources import tables

_CI = "jobs: {a: {steps: [{run: pytest}, {uses: x/y@v1}]}}"
_COMPOSE = "services: {a: {mem_limit: 1g}, b: {}}"


def _files(spark, n):
    rows = [(i, p, t) for i in range(n) for p, t in ((".github/workflows/ci.yml", _CI), ("compose.yaml", _COMPOSE), (".gitlab-ci.yml", None))]
    return spark.createDataFrame([*rows, (0, "x/compose.yaml", _COMPOSE), (1, "y/Jenkinsfile", "sh 'make'")], "id int, path string, text string")


def _counted(monkeypatch):
    read, nodes = [], trees.nodes
    monkeypatch.setattr(trees, "nodes", lambda files, form: read.append(files.count()) or nodes(files, form))
    return read


def test_ci_files_are_parsed_once_a_version(spark, monkeypatch):
    read = _counted(monkeypatch)
    ci = configs.ci_files(_files(spark, 9))
    steps = configs.ci_steps(ci).groupBy("id", "path").count().collect()
    assert read == [3]  # of 19 files
    assert {(r["id"], r["path"], r["count"]) for r in steps} == {(i, ".github/workflows/ci.yml", 2) for i in range(9)} | {(1, "y/Jenkinsfile", 1)}
    flows = configs.ci_workflows(ci).groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in flows} == {".github/workflows/ci.yml": 9, ".gitlab-ci.yml": 9, "y/Jenkinsfile": 1}


def test_deploy_files_are_parsed_once_a_version(spark, monkeypatch):
    read = _counted(monkeypatch)
    rows = configs.deploy_configs(_files(spark, 9)).groupBy("id").count().collect()
    assert read == [3]  # of 19 files
    assert {r["id"]: r["count"] for r in rows} == {0: 4} | dict.fromkeys(range(1, 9), 2)


def test_extractors_see_each_version_once(spark):
    files = facts.Files(_files(spark, 9))
    assert files.all.count() == 4 and files.versions.placed.count() == 20  # files without a text aren't read


def test_files_say_nothing_of_sizes_while_facts_are_stored(spark):
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(static)
    with tables.sizes_at_run_time(spark):
        assert (spark.conf.get(static), spark.conf.get(adaptive)) == ("-1", before)
    assert (spark.conf.get(static), spark.conf.get(adaptive, None)) == (before, None)


def test_keys_of_the_same_rows_are_one_class(spark):
    rows = [(1, "a", None), (1, "b", "x"), (2, "b", "x"), (2, "a", None), (3, None, "a"), (3, "b", "x"), (4, "a", None), (4, "b", "x"), (4, "b", "x"), (None, "a", "")]
    rows = spark.createDataFrame(rows, "id int, path string, text string").filter("id IS NOT NULL")
    alike = versions.Alike(rows, "id")
    first = alike.first(rows)
    assert {r["id"] for r in first.collect()} == {1, 3, 4} and first.count() == 7
    back = alike.back(first.groupBy("id").agg({"path": "count"}).toDF("id", "n")).collect()
    assert sorted(tuple(r) for r in back) == [(1, 2), (2, 2), (3, 1), (4, 3)]


def test_imports_are_looked_up_once_for_the_same_python_files(spark, monkeypatch):
    rows = [(i, p, t) for i in range(9) for p, t in (("a.py", "import b\nimport os"), ("b.py", "import a" if i < 6 else ""), (f"{i}.md", "x"))]
    files = spark.createDataFrame(rows, "id int, path string, text string")
    want = {(i, "a", "b", True) for i in range(9)} | {(i, "a", "os", False) for i in range(9)} | {(i, "b", "a", True) for i in range(6)}
    seen, edges = [], code._edges
    monkeypatch.setattr(code, "_edges", lambda files, parsed: seen.append(files.select("id").distinct().count()) or edges(files, parsed))
    got = code.python_imports(files).collect()
    monkeypatch.undo()
    assert seen == [2] and {(r["id"], r["from_module"], r["to_module"], r["internal"]) for r in got} == want
    found, _ = facts.run_extractors(files, ["ast:imports"])
    assert found.groupBy("id").count().filter("count = 3").count() == 6 and found.count() == len(want)
