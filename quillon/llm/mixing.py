"""Mixing sources to target weights, by hierarchical budgeting; DataFrame operations only.

A token budget goes down a tree of domain, language and source. At each node
it is split in proportion to the children's weights; what a child cannot
supply (its tokens times the most epochs) goes to its siblings first, and only
what all of them cannot supply goes to the parent's siblings: the supply of a
node is the sum of its children's, and every split fills up to it.

A leaf reads its documents in seeded epochs. Each epoch has an order of its own,
by a hash of seed, epoch and doc_id; whole epochs are taken first, and from the
next one the prefix whose tokens fit into what is left.

Prefix sums are taken within ranges of the order hash, whose totals are summed
first, so a leaf that holds a third of all rows is spread over many tasks.

Edge cases: null or empty texts have no tokens and come along in every epoch
that is taken whole or reached; null domains, languages or sources are a value of
their own (an empty string); rows with equal doc_id are taken or left together;
weights that are missing are 1, of zero nothing is taken; an empty table stays
empty; columns named mix_tokens, mix_epochs or mix_target are replaced, all
others pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import Stored, fresh, parts

LEVELS = ("domain", "language", "source")
#: Rows of one range of a leaf's order.
RANGE_ROWS = 20_000
_OWN = ("mix_tokens", "mix_epochs", "mix_target")


def n_words(text: Column) -> Column:
    """Tokens of a text: its runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, float]) -> Column:
    name = F.col(level)
    return reduce(lambda e, kv: F.when(name == kv[0], F.lit(float(kv[1]))).otherwise(e), weights.items(), F.lit(1.0))


def _fill(nodes: DataFrame, parent: list[str], level: str, weights: Mapping[str, float]) -> DataFrame:
    """Split each parent's ``budget`` over its children (``parent`` + [level], ``supply``): water filling.

    In rising order of supply per weight the children fill up one by one, as long
    as the share of what is left is enough for it; the others share the rest.
    """
    ranked = nodes.withColumn("weight", _weight(level, weights)).withColumn("ratio", F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")))
    order = Window.partitionBy(*parent).orderBy(F.col("ratio").asc_nulls_last(), level)
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    share = F.col("weight") * F.greatest(F.col("budget") - F.col("taken"), F.lit(0.0)) / F.col("rest")
    ranked = ranked.withColumn("taken", F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("supply"))).over(before), F.lit(0)).cast("double")).withColumn("rest", F.sum("weight").over(onward))
    # the first child that does not fill up fixes the level for all after it
    level_at = F.when(F.col("weight") > 0, F.when(F.col("supply") > share, (F.col("budget") - F.col("taken")) / F.col("rest")))
    water = F.first(level_at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = ranked.withColumn("water", water)
    got = F.when(F.col("weight") <= 0, F.lit(0.0)).otherwise(F.least(F.col("supply").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.col("supply").cast("double"))))
    return filled.withColumn("budget", got).select(*parent, level, "supply", "budget")


def leaf_budgets(leaves: DataFrame, budget: float, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(domain, language, source, target) from (domain, language, source, supply); ``budget`` is a share of one epoch's tokens or a number of tokens."""
    root = leaves.agg(F.sum("supply").cast("double").alias("all"))
    amount = F.least(F.lit(float(budget)), F.col("all"))
    domains = leaves.groupBy("domain").agg(F.sum("supply").alias("supply")).crossJoin(F.broadcast(root.select(amount.alias("budget"))))
    domains = _fill(domains.withColumn("root", F.lit(0)), ["root"], "domain", weights.get("domain", {})).drop("root")
    languages = leaves.groupBy("domain", "language").agg(F.sum("supply").alias("supply")).join(domains.drop("supply"), "domain")
    languages = _fill(languages, ["domain"], "language", weights.get("language", {}))
    sources = leaves.join(languages.drop("supply"), ["domain", "language"])
    sources = _fill(sources, ["domain", "language"], "source", weights.get("source", {}))
    return sources.select(*LEVELS, F.floor("budget").alias("target"))


def mix(docs: DataFrame, domain: Column, budget_share: float, weights: Mapping[str, Mapping[str, float]] | None = None, max_epochs: int = 2, seed: int = 0, language: str = "lang", source: str = "source") -> DataFrame:
    """The documents taken, with mix_tokens (words), mix_epochs (times taken) and mix_target (their leaf's tokens).

    The budget is ``budget_share`` times the words of all ``docs``.
    """
    docs = docs.drop(*_OWN)
    names = {level: fresh(docs, f"mix_{level}") for level in LEVELS}
    names = {level: f"{name}_" if fresh(docs, f"{name}_of") != f"{name}_of" else name for level, name in names.items()}
    given = docs.columns
    keyed = docs.select(*given, F.coalesce(domain, F.lit("")).alias(names["domain"]), F.coalesce(F.col(language), F.lit("")).alias(names["language"]), F.coalesce(F.col(source), F.lit("")).alias(names["source"]), n_words(F.col("text")).alias("mix_tokens"))
    leaf = list(names.values())
    # the light columns alone: the order and its sums never move a text
    light = Stored(keyed.select("doc_id", *leaf, "mix_tokens"), "mix-rows")
    rows = light.read()
    totals = Stored(rows.groupBy(*leaf).agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("n")), "mix-leaves").read()
    n, tokens = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    leaves = totals.select(*(F.col(v).alias(k) for k, v in names.items()), (F.col("tokens") * max_epochs).alias("supply"))
    targets = leaf_budgets(leaves, int(tokens * budget_share), weights or {})
    plan = totals.join(targets.select(*(F.col(k).alias(v) for k, v in names.items()), "target"), leaf)
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.least(F.floor(F.col("target") / F.col("tokens")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long"))
    plan = Stored(plan.withColumn("left", F.col("target") - F.col("whole") * F.col("tokens")), "mix-plan").read()

    ranges = parts(n, RANGE_ROWS, 16)
    # a row per leaf, of which there are as many as sources, not as documents
    placed = rows.join(plan.select(*leaf, "whole", "left", "target"), leaf)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole"), F.col("doc_id").cast("string")))
    placed = placed.withColumn("order", key).withColumn("range", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)))
    per_range = placed.groupBy(*leaf, "range").agg(F.sum("mix_tokens").alias("of_range"))
    offsets = per_range.select(*leaf, "range", F.coalesce(F.sum("of_range").over(Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*leaf, "range").orderBy("order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("upto", F.sum("mix_tokens").over(within)).join(offsets, [*leaf, "range"])
    epochs = F.col("whole") + F.when((F.col("upto") + F.col("offset") <= F.col("left")) & (F.col("left") > 0), 1).otherwise(0)
    chosen_id = fresh(docs, "mix_id")
    chosen = summed.select(F.col("doc_id").alias(chosen_id), *(F.col(c).alias(f"{c}_of") for c in leaf), epochs.cast("int").alias("mix_epochs"), F.col("target").alias("mix_target")).filter("mix_epochs > 0").distinct()
    match = F.col("doc_id").eqNullSafe(F.col(chosen_id))
    for name in leaf:
        match = match & (F.col(name) == F.col(f"{name}_of"))
    return keyed.join(chosen, match).select(*given, "mix_tokens", "mix_epochs", "mix_target")
