"""Where queries register themselves, with their DuckDB SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from quillon.plans import oracle_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", oracle: str | None = None) -> Callable:
    """Register ``(spark, sf_dir) -> DataFrame`` under ``name``; ``oracle`` may use the named domain views."""

    def register(function: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle_views.with_views(views, oracle)
        return function

    return register
