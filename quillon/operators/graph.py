"""Cycles in import graphs: strongly connected components, of small graphs in one task each, of large ones by colouring, in rows linear in the edges."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans import views as V
from quillon.registry import query
from quillon.sources.tables import checkpointed


#: Edges of a graph that one task may hold.
LOCAL_EDGES = 500_000
#: Steps along edges between two checkpoints.
STEPS = 4


def _state(rows: DataFrame, *columns: str) -> tuple:
    """Something that changes when the rows do."""
    return tuple(rows.agg(F.count("*"), F.bit_xor(F.xxhash64(*columns))).first())


def _trimmed(edges: DataFrame, *keys: str) -> DataFrame:
    """The edges left after a few rounds of dropping nodes without edges both in and out."""
    for _ in range(STEPS // 2):
        leaves, enters = edges.select(*keys, F.col("src").alias("dst")), edges.select(*keys, F.col("dst").alias("src"))
        edges = edges.join(leaves, [*keys, "dst"], "left_semi").join(enters, [*keys, "src"], "left_semi").select(*keys, "src", "dst")
    return checkpointed(edges)


def _spread(labels: DataFrame, edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, node, label): the least label among each node's own and those of all nodes that lead to it."""
    now, before = checkpointed(labels), None
    while (state := _state(now, *keys, "node", "label")) != before:
        before = state
        for _ in range(STEPS):
            sent = edges.join(now.withColumnRenamed("node", "src"), [*keys, "src"]).select(*keys, F.col("dst").alias("node"), "label")
            now = now.unionByName(sent).groupBy(*keys, "node").agg(F.min("label").alias("label"))
        now = checkpointed(now)
    return now


def _walk(starts: list, follow: dict, seen: set) -> Iterator[list]:
    """From each start the nodes not seen before, in the order in which a depth-first walk leaves them."""
    for start in starts:
        if start in seen:
            continue
        seen.add(start)
        left, stack = [], [(start, iter(follow.get(start, ())))]
        while stack:
            node, onward = stack[-1]
            for then in onward:
                if then not in seen:
                    seen.add(then)
                    stack.append((then, iter(follow.get(then, ()))))
                    break
            else:
                stack.pop()
                left.append(node)
        yield left


def _components(edges: list[tuple]) -> list[tuple]:
    """(node, component) of one graph's edges, by two walks."""
    forward, back = defaultdict(list), defaultdict(list)
    for a, b in edges:
        forward[a].append(b)
        back[b].append(a)
    order = [node for tree in _walk(sorted(forward), forward, set()) for node in tree]
    found = [tree for tree in _walk(order[::-1], back, set()) if len(tree) > 1]
    return [(node, least) for tree in found for least in [min(tree)] for node in tree]


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys, node, component) of graphs whose edges (keys, src, dst) lie one graph behind the other; a graph may go on in the next batch."""
    now, edges, kinds = None, [], None

    def components() -> Iterator[tuple]:
        return ((*now, *row) for row in _components(edges)) if len(edges) > 1 else iter(())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))

    for one in batches:
        *keys, src, dst = one.schema
        kinds, out = [*keys, src.with_name("node"), dst.with_name("component").with_type(src.type)], []
        for *key, a, b in zip(*(c.to_pylist() for c in one.columns), strict=True):
            if key != now:
                out += components()
                now, edges = key, []
            edges.append((a, b))
        yield batch(out)
    if kinds:
        yield batch(list(components()))


def strong_components(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, node, component) for nodes on a cycle of two or more nodes; a component is its least node.

    Many graphs, told apart by keys, are each walked in one task, one behind the other,
    if none has more than ``LOCAL_EDGES`` edges; larger ones, and a single graph, are
    coloured by joins.
    """
    plain = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(*keys, "src", "dst").distinct()
    if not keys or (plain.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > LOCAL_EDGES:
        return _coloured(plain, *keys)
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return plain.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_walked, f"{named}, node {kinds['src']}, component {kinds['src']}")


def _coloured(edges: DataFrame, *keys: str) -> DataFrame:
    """The same by joins alone.

    Each round colours every node with the least node that leads to it; the nodes
    of a colour that lead back to its node are that node's component, and leave.
    Rows never outnumber nodes and edges; rounds follow the longest path.
    """
    left = _trimmed(edges, *keys)
    out = None
    while not left.isEmpty():
        nodes = left.select(*keys, F.col("src").alias("node")).union(left.select(*keys, "dst")).distinct()
        colours = _spread(nodes.withColumn("label", F.col("node")), left, *keys)
        of = lambda c: colours.select(*keys, F.col("node").alias(c), F.col("label").alias(f"{c}_colour"))  # noqa: E731, B023
        same = left.join(of("src"), [*keys, "src"]).join(of("dst"), [*keys, "dst"]).filter("src_colour = dst_colour")
        same = checkpointed(same.select(*keys, F.col("src_colour").alias("colour"), "src", "dst"))
        found, before = checkpointed(colours.filter("node = label").select(*keys, F.col("label").alias("colour"), "node")), None
        while (state := _state(found, *keys, "colour", "node")) != before:
            before = state
            for _ in range(STEPS):
                led = same.join(found.withColumnRenamed("node", "dst"), [*keys, "colour", "dst"]).select(*keys, "colour", F.col("src").alias("node"))
                found = found.unionByName(led).distinct()
            found = checkpointed(found)
        sizes = found.groupBy(*keys, "colour").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        done = checkpointed(found.join(sizes, [*keys, "colour"]).select(*keys, "node", F.col("colour").alias("component")))
        out = done if out is None else out.unionByName(done)
        gone = found.select(*keys, "node")
        left = left.join(gone.withColumnRenamed("node", "src"), [*keys, "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_anti")
        left = _trimmed(left.select(*keys, "src", "dst"), *keys)
    if out is None:
        return left.select(*keys, F.col("src").alias("node"), F.col("dst").alias("component"))
    return out


def cyclic_nodes(edges: DataFrame, *keys: str) -> DataFrame:
    return strong_components(edges, *keys).select(*keys, "node")


@query("graph_scc", "edges", """
WITH RECURSIVE reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)
SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src""")
def graph_scc(spark, sf_dir):
    return strong_components(V.edges(spark, sf_dir))
