"""Mutations: preconditions, edits, and that each changes what it says and nothing else."""

from __future__ import annotations

from quillon.operators import mutations
from quillon.operators.mutations import BASE, MUTATIONS


def test_variants_have_their_edits_only(spark):
    rows = [(1, p, t) for p, t in mutations.GOOD.items()] + [(2, "README.md", "x"), (2, "Dockerfile", None), (2, "a.py", "log.info(1)")]
    got = mutations.mutated(spark.createDataFrame(rows, "run int, path string, text string")).collect()
    of = {}
    for r in got:
        of.setdefault((r.run, r.mutation), {})[r.path] = r.text
    assert {m for run, m in of if run == 1} == {BASE, *(m.name for m in MUTATIONS)}
    assert {m for run, m in of if run == 2} == {BASE, "prints"} and of[2, "prints"]["a.py"] == "print(1)"
    assert of[1, BASE] == mutations.GOOD
    for m in MUTATIONS:
        variant = of[1, m.name]
        changed = {p for p in {*variant, *mutations.GOOD} if variant.get(p) != mutations.GOOD.get(p)}
        assert changed and all(p in m.adds or p in mutations.GOOD for p in changed), m.name
        if not m.edit:
            assert not changed & set(variant), m.name
    assert of[1, "one-stage"]["Dockerfile"].startswith("FROM python:3.12") and "app/loop.py" in of[1, "import-cycle"]


def test_names_are_unique_and_expectations_are_of_the_rubric():
    from quillon.operators.assess import RUBRIC

    assert len({m.name for m in MUTATIONS} | {BASE}) == len(MUTATIONS) + 1 == 18
    assert {r for m in MUTATIONS for r in m.expected} <= {c.rule for c in RUBRIC} and all(m.expected for m in MUTATIONS)


def test_repositories_of_the_same_files_are_assessed_once(spark, monkeypatch):
    rows = [(run, p, t) for run in range(7) for p, t in (("README.md", "x"), ("uv.lock", "" if run < 5 else "x"), ("a.txt", None))]
    rows += [(run, "a.txt", None) for run in (3, 4)]  # a file more
    seen = []

    def assessed(files, runs, rubric):
        seen.append(runs.count())
        assert files.count() == 3 * 3 + 1 + 3 * 2 + 1
        return runs.selectExpr("run", "'deps.lockfile_present' AS rule", "if(run LIKE '%base%', 'pass', 'fail') AS verdict")

    monkeypatch.setattr(mutations.assess, "assess", assessed)
    files = spark.createDataFrame(rows, "run int, path string, text string")
    got = mutations.effects(files, [], tuple(m for m in MUTATIONS if m.name == "no-lockfile")).collect()
    assert seen == [2 * 3]  # of 14
    assert {tuple(r) for r in got} == {(run, "no-lockfile", "deps.lockfile_present", "pass", "fail") for run in range(7)} and len(got) == 7
