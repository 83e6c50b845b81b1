"""All queries and their DuckDB SQL, by name."""

from __future__ import annotations

from quillon.operators import assess, code, configs, costs, evalstats, extract, facts, filters, graph, inverted, joins, judging, manifests, mutations, profile, profiles, records, reports, retrieval, rules, scanners, scoring, texts, tools, windows  # noqa: F401
from quillon.registry import ORACLES, QUERIES  # noqa: F401
from quillon.sources import documents, stages, stores  # noqa: F401
from quillon.streaming import flows, queues  # noqa: F401
