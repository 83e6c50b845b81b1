"""The domain views in DuckDB SQL, for the oracles."""

from __future__ import annotations

VIEWS = {
    "checks": """
SELECT *, CASE severity WHEN 'critical' THEN 50 WHEN 'high' THEN 30 WHEN 'medium' THEN 20 WHEN 'low' THEN 10 ELSE 0 END AS w10
FROM (SELECT p_partkey AS check_id, p_brand AS metric,
             CASE WHEN p_size % 50 = 0 THEN 'critical' WHEN p_size % 4 = 0 THEN 'high' WHEN p_size % 4 = 1 THEN 'medium'
                  WHEN p_size % 4 = 2 THEN 'low' ELSE 'info' END AS severity,
             p_type = 'SMALL' AS retired FROM part)""",
    "judged": """
SELECT (l_suppkey % 5)::INTEGER AS run, l_partkey AS check_id, l_orderkey, l_linenumber,
       CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'pass' WHEN 'NO' THEN 'pass' WHEN 'AO' THEN 'partial'
            WHEN 'NF' THEN 'fail' WHEN 'RF' THEN 'not_applicable' ELSE 'unknown' END AS verdict,
       CASE WHEN l_linenumber % 5 = 0 THEN 'unverified' ELSE 'verified' END AS status,
       CASE WHEN l_quantity < 17 THEN 'low' WHEN l_quantity < 34 THEN 'medium' ELSE 'high' END AS confidence
FROM lineitem""",
    "findings": """
SELECT run, check_id, verdict, status, (l_orderkey % 50)::INTEGER AS path_no, (l_orderkey % 97 + 1)::INTEGER AS start_line
FROM (SELECT *, row_number() OVER (PARTITION BY run, check_id ORDER BY l_orderkey, l_linenumber, verdict, status) AS rn FROM judged)
WHERE rn = 1""",
    "attempts": """
SELECT run, check_id, attempt, verdict, confidence, 'order ' || l_orderkey AS claim
FROM (SELECT *, row_number() OVER (PARTITION BY run, check_id ORDER BY l_orderkey, l_linenumber, verdict, status, confidence)::INTEGER AS attempt FROM judged)
WHERE attempt <= 3""",
    "llm_calls": r"""
SELECT event_id AS id, ts, ts::DATE AS day, (event_id % 7)::INTEGER AS run, event_type AS stage,
       nullif(user_id % 10, 0)::INTEGER AS metric, round(value * 100)::BIGINT AS cost_micro,
       k * 100 AS tokens_in, k * 30 AS tokens_cached, k * 7 AS tokens_out, k % 4 = 0 AS cache_hit, user_id * 10 + k AS latency_ms, user_id
FROM (SELECT *, regexp_extract(props, '(\d+)', 1)::BIGINT AS k FROM events)""",
    "files": """
SELECT doc_id, concat_ws('/', CASE WHEN doc_id % 11 = 0 THEN 'vendor' WHEN doc_id % 13 = 0 THEN 'tests'
                                   WHEN doc_id % 17 = 0 THEN 'tests/fixtures/app' WHEN doc_id % 19 = 0 THEN 'build' ELSE 'src' END,
                 source, lang, CASE WHEN doc_id % 10 = 0 THEN 'test_mod' ELSE 'mod' END || doc_id || ext) AS path, ext,
       CASE ext WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.cs' THEN 'csharp' WHEN '.go' THEN 'go'
                WHEN '.java' THEN 'java' WHEN '.md' THEN 'markdown' WHEN '.json' THEN 'json' ELSE 'yaml' END AS language,
       octet_length(encode(text))::BIGINT AS size, text
FROM (SELECT *, CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.cs' WHEN 3 THEN '.go' WHEN 4 THEN '.md'
                     WHEN 5 THEN '.json' WHEN 6 THEN '.yml' ELSE '.java' END AS ext FROM documents)""",
    "lines": r"""
SELECT doc_id, path, generate_subscripts(parts, 1)::INTEGER AS line_no, unnest(parts) AS line
FROM (SELECT doc_id, path, string_split_regex(text, '\r\n|\n|\r') AS parts FROM files)""",
    "edges": """
SELECT DISTINCT o_custkey % 40 AS src, o_orderkey * 7 % 40 AS dst FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_custkey % 40 <> o_orderkey * 7 % 40""",
}
NEEDS = {"findings": ["judged"], "attempts": ["judged"], "lines": ["files"]}


def with_views(names: str, body: str) -> str:
    """``body``, a SELECT or the rest of a WITH list, after the views it names."""
    wanted: list[str] = []
    for name in names.split():
        for one in [*NEEDS.get(name, []), name]:
            if one not in wanted:
                wanted.append(one)
    if not wanted:
        return body
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    body = body.replace("RECURSIVE", "", 1).strip()
    more = body.startswith("WITH")
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in wanted)
    return f"WITH {recursive}{ctes}" + (",\n" + body[4:].strip() if more else "\n" + body)
