"""Worked examples as tables: each row of ``part`` carries one of a list of inputs, by its key.

An operator that reads text or nested values runs over as many inputs as the
table has rows; its SQL joins the hand-written results of each input back to the
rows that carry it, so the two sides share no code.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans import views as V


def cases(spark: SparkSession, sf_dir: str, inputs: Sequence[tuple], schema: str) -> DataFrame:
    """(id, case, and the columns of ``schema``): input number id % n for every part ``id``."""
    n = len(inputs)
    known = spark.createDataFrame([(k, *row) for k, row in enumerate(inputs)], f"case int, {schema}")
    ids = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % n).cast("int").alias("case"))
    # a row here stands for a whole file or run, so few rows are spread over all cores
    return ids.repartition(max(1, spark.sparkContext.defaultParallelism), "id").join(F.broadcast(known), "case")  # the inputs of one module


def literal(value: object) -> str:
    """A DuckDB literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple, dict)):
        value = json.dumps(value)
    text = str(value).replace("'", "''")
    parts = text.split("\n")  # chr(10) keeps the statement on its lines
    return "'" + "' || chr(10) || '".join(parts) + "'" if len(parts) > 1 else f"'{text}'"


def cases_sql(n: int, columns: str, rows: Iterable[tuple]) -> str:
    """SQL for the expected rows (case, *columns) of ``n`` inputs, for every part; ``columns`` are types and names."""
    names = [c.strip().split(" ") for c in columns.split(",")]
    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    cast = ", ".join(f'e."{name}"::{kind} AS "{name}"' for kind, name in names)
    plain = ", ".join(f'"{name}"' for _, name in names)
    return f'SELECT p_partkey AS id, {cast} FROM part JOIN (VALUES {values}) e("case", {plain}) ON p_partkey % {n} = e."case"'
