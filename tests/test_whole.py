"""Queries over all rows of small tables, against brute force; the rows lie where an id bound or a modulo would cut them off."""

from __future__ import annotations

from quillon.catalogue import QUERIES


def _tables(spark, folder, **tables):
    """A folder of tables; each is (schema, rows)."""
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _rows(name, spark, sf_dir):
    return sorted(tuple(r) for r in QUERIES[name](spark, sf_dir).collect())


def test_ver_mechanical_takes_all_orders(spark, tmp_path):
    orders = [(k, k * 7 % 160) for k in [*range(40), *range(3990, 4030), 149_999]]
    talk = [(c, t) for c in range(120) for t in range(c % 6 + 1)]
    sf = _tables(spark, tmp_path, orders=("o_orderkey long, o_custkey long", orders), conversations=("conv_id long, turn int", talk))
    n, seen = {}, {(c, t + 1) for c, t in talk if (c + t) % 9}
    for c, _ in talk:
        n[c] = n.get(c, 0) + 1
    want = []
    for k, cust in orders:
        path, s = cust % 150, k % 4
        e = s + cust % 3
        want.append((k, 1 <= s <= e <= n.get(path, 0) and all((path, i) in seen for i in range(s, e + 1))))
    assert {ok for k, ok in want if k >= 4000} == {True, False}
    assert _rows("ver_mechanical", spark, sf) == sorted(want)


def test_flt_applies_when_takes_all_pairs(spark, tmp_path):
    keys, ids = [*range(12), 28, 29, 30, 31, 60, 149_999], [*range(1, 45), 199, 200, 210, 19_999]
    part = [(i, "b", 1, "t") for i in ids]
    sf = _tables(spark, tmp_path, orders=("o_orderkey long", [(k,) for k in keys]), part=("p_partkey long, p_brand string, p_size int, p_type string", part))
    applies = lambda k, c: (c % 2 or k % 2 == 0) and (c % 3 or k % 3 == 0 or k % 5 == 0) and (c % 7 or k % 5)
    want = [(c, n) for c in ids if (n := sum(bool(applies(k, c)) for k in keys))]
    assert _rows("flt_applies_when", spark, sf) == sorted(want)


def _findings(lines):
    """The findings view over (orderkey, linenumber, partkey, suppkey, flag, status): (run, check) to (verdict, path, start)."""
    verdicts = {"AF": "pass", "NO": "pass", "AO": "partial", "NF": "fail", "RF": "not_applicable"}
    return {(s % 5, p): (verdicts.get(f + t, "unknown"), k % 50, k % 97 + 1) for k, _, p, s, f, t in sorted(lines, reverse=True)}


LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string"


def _lines(n):
    return [(i * 37 % 500, i % 7 + 1, i * 11 % 60 + 1, i * 3 % 23, "NAR"[i * i % 3], "FO"[i % 5 % 2]) for i in range(n)]


def _lineitem(n):
    return (LINES + ", l_quantity double", [(*x, 1.0) for x in _lines(n)])


def test_join_semi_unconfirmed_takes_all_touches(spark, tmp_path):
    orders = [(k, "P" if k % 3 else "F") for k in [7, 8, 200, 203, 211, 333, 448, 1214, 1219, 149_999]]
    sf = _tables(spark, tmp_path, lineitem=_lineitem(400), orders=("o_orderkey long, o_orderstatus string", orders))
    touched = {k % 50 for k, s in orders if s == "P"}
    failed = {key: path for key, (v, path, _) in _findings(_lines(400)).items() if v == "fail"}
    want = sorted(key for key, path in failed.items() if path not in touched)
    assert 0 < len(want) < len(failed)
    assert _rows("join_semi_unconfirmed", spark, sf) == want


def test_join_range_overlap_and_eval_recall_take_all_rows(spark, tmp_path):
    orders = [(k, k * 13 % 400) for k in [*range(1, 90), 1003, 1021, 149_999]] * 2
    part = [(i,) for i in range(1, 61)]
    sf = _tables(spark, tmp_path, lineitem=_lineitem(400), part=("p_partkey long", part), orders=("o_orderkey long, o_custkey long", orders))
    ranges = [(k % 50, c % 97 + 1, c % 97 + 1 + k % 30) for k, c in orders]
    found = _findings(_lines(400))
    n = {key: sum(p == path and s <= start + 10 and start <= e for p, s, e in ranges) for key, (_, path, start) in found.items()}
    assert _rows("join_range_overlap", spark, sf) == sorted((*key, k) for key, k in n.items() if k)
    want = []
    for run in range(5):
        hit = {i for (i,) in part if (v := found.get((run, i))) and (v[0] == "fail" or i % 2 and v[0] == "partial")}
        share = lambda k: (k * 20000 + len(part)) // (2 * len(part))
        want.append((run, len(part), share(len(hit)), share(sum(n[run, i] > 0 for i in hit))))
    assert any(0 < w[3] < w[2] for w in want)
    assert _rows("eval_recall", spark, sf) == want


def test_file_limits_are_the_reference_s(spark, tmp_path):
    sizes = {0: 20_001, 8: 2_000_000, 16: 2_000_001, 5: 2001, 21: 64_000, 29: 64_001, 6: 64_000, 30: 64_001}
    sf = _tables(spark, tmp_path, documents=("doc_id long, text string, lang string, source string", [(i, "x" * n, "en", "s") for i, n in sizes.items()]))
    large = {r["size"]: (r["too_large"], r["sha256"] is None, r["loc"], r["readable"]) for r in QUERIES["src_file_profile"](spark, sf).collect()}
    assert large == {n: (True, True, 0, False) if n > 2_000_000 else (False, False, 1, True) for n in sizes.values()}
    paths = {p.rpartition("mod")[2].partition(".")[0] for (p,) in _rows("flt_indexable", spark, sf)}
    assert paths == {"8", "16", "5", "21", "6"}


def test_rule_max_severity_takes_all_checks(spark, tmp_path):
    size = {i: (50, 4, 1, 2, 3)[i % 5] if i % 6 == 0 or i % 4 == 1 else (2, 3)[i % 2] for i in range(1, 61)}
    part = [(i, f"b{i % 4}", s, "t") for i, s in size.items()]
    sf = _tables(spark, tmp_path, lineitem=_lineitem(400), part=("p_partkey long, p_brand string, p_size int, p_type string", part))
    rank = lambda s: 4 if s == 50 else (3, 2, 1, 0)[s % 4]
    worst, worst_cut = {}, {}
    for (run, i), (v, _, _) in _findings(_lines(400)).items():
        r, key = rank(size[i]) if v == "fail" and i % 9 else -1, (run, f"b{i % 4}")
        worst[key] = max(worst.get(key, -1), r)
        if i % 6 and i % 4 != 1:
            worst_cut[key] = max(worst_cut.get(key, -1), r)
    assert worst != worst_cut
    assert _rows("rule_max_severity", spark, sf) == sorted((*key, "fail" if r >= 3 else "partial" if r == 2 else "pass") for key, r in worst.items())


def test_graph_scc_takes_all_orders(spark, tmp_path):
    orders = [(k, c, s, p) for k, c, s, p in [(1, 14, "F", "1-URGENT"), (2, 47, "F", "1-URGENT"), (13, 9, "F", "1-URGENT"), (3, 21, "O", "1-URGENT"), (5, 3, "F", "2-HIGH")]]
    sf = _tables(spark, tmp_path, orders=("o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string", orders))
    assert _rows("graph_scc", spark, sf) == [(7, 7), (14, 7)]  # 14 -> 7 -> 14; 9 -> 11 and what is not F and urgent closes no cycle
