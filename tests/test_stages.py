"""A run that is stopped goes on behind its last finished stage."""

from __future__ import annotations

import pytest

from quillon.sources.stages import Stage, StageStore


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/runs"


def _stages(spark, calls, stop=None, version="1"):
    def first(before):
        calls.append("first")
        assert before == {}
        return {"a": spark.range(5), "none": spark.range(0)}

    def second(before):
        calls.append("second")
        if stop == "second":
            raise RuntimeError
        return {"b": before["a"].selectExpr("id * 2 AS x")}

    def third(before):
        calls.append("third")
        table = before["b"].join(before["a"].selectExpr("id AS x"), "x")
        if stop == "third":  # while its table is being written
            table = table.selectExpr("assert_true(x < 0) AS wrong")
        return {"c": table}

    return [Stage("first", first), Stage("second", second, version), Stage("third", third)]


@pytest.mark.parametrize("stop", ["second", "third"])
def test_a_stopped_run_goes_on(spark, root, stop):
    calls: list[str] = []
    store = StageStore(spark, root, "r")
    with pytest.raises(Exception):  # noqa: B017
        store.run(_stages(spark, calls, stop))
    done = calls[:-1]
    tables, built = StageStore(spark, root, "r").run(_stages(spark, calls))
    assert built == [s for s in ("first", "second", "third") if s not in done]
    assert sorted(r.x for r in tables["c"].collect()) == [0, 2, 4] and tables["none"].count() == 0
    gone = store.sweep()
    assert len(gone) == (stop == "third") and all(g.startswith("third-") for g in gone)
    assert store.run(_stages(spark, calls))[1] == [] and sorted(r.id for r in tables["a"].collect()) == [0, 1, 2, 3, 4]


def test_another_version_is_built_anew_with_all_behind_it(spark, root):
    calls: list[str] = []
    store = StageStore(spark, root, "r")
    store.run(_stages(spark, calls))
    assert store.run(_stages(spark, calls, version="2"))[1] == ["second", "third"]
    assert len(store.sweep()) == 2
    assert store.run(_stages(spark, calls, version="2"))[1] == []
    assert StageStore(spark, root, "other").run(_stages(spark, calls))[1] == ["first", "second", "third"]


def test_broken_manifests_and_names(spark, root, tmp_path):
    calls: list[str] = []
    store = StageStore(spark, root, "r")
    assert store.sweep() == [] and store.manifest("first") is None
    store.run(_stages(spark, calls))
    for text in ("", "{", "[]", '{"key": 1}'):
        (tmp_path / "runs/r/manifests/second.json").write_text(text)
        (tmp_path / "runs/r/manifests/.second.json.crc").unlink(missing_ok=True)
        assert store.run(_stages(spark, calls))[1] == ["second"]
    with pytest.raises(ValueError):
        StageStore(spark, root, "../r")
    with pytest.raises(ValueError):
        store.run([*_stages(spark, calls), Stage("again", lambda before: {"a": spark.range(1)})])
