"""Embedding near-dedup: exact cosine links by PCA-ordered tiles.

Vectors are rotated onto the principal axes of the whole table and tiled along
the first one. Two tiles are compared only if their intervals on that axis come
closer than linked vectors can lie apart. Within a pair of tiles, block by block,
the leading dimensions are multiplied first; the product of the suffix norms
bounds what the remaining dimensions can add, and a pair stops as soon as it
cannot reach the threshold. Survivors get their cosine from the original
components in double precision.

A block leaves counts of links and a star for each of its own components, so
neither memory nor rows grow with the number of links. Equal vectors are one
vector with a weight, so a group of copies of any size costs as much as one.
Vectors with equal first coordinates spread over all tiles that may hold them.
A tile travels once to each tile near it, in the narrowest type that holds it;
where vectors fill all directions evenly, nearly all tiles are near each other,
and the comparisons, as in any exact method, grow with the square of the vectors.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are kept; a shorter vector counts as filled up
with zeros; rows with equal vec_id are vectors of their own, which share the
component that has their least vec_id; rows with a null vec_id are vectors like
any other, but never name a component: one of null ids alone has a null
component_id and is kept; an empty table stays empty; further columns are left
alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Stored, bounded_batches, parts
from quillon.llm.components import connected_components

#: Vectors of one tile, and of one block of a tile.
TILE, BLOCK = 16_384, 1024
#: Shares of the dimensions after which the bound is tested.
STEPS = (0.25, 0.5)
#: Pairs whose cosines are computed at a time.
PAIRS = 1 << 16
#: What rounding may take off a bound.
SLACK = 1e-9


def _usable(vector: list | None) -> np.ndarray | None:
    if not vector or None in vector:
        return None
    x = np.array(vector, np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Side:
    """Vectors ready for comparing: units, their rotation, and the norms of what lies beyond each step."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        self.units = unit(x)
        self.turned = self.units @ axes
        dims = x.shape[1]
        self.steps = [*sorted({max(1, int(dims * s)) for s in STEPS} - {dims}), dims]
        squares = (self.turned * self.turned)[:, ::-1].cumsum(axis=1)[:, ::-1]
        self.rest = [np.sqrt(np.maximum(squares[:, s], 0)) if s < dims else np.zeros(len(x)) for s in self.steps]

    def __len__(self) -> int:
        return len(self.units)

    def block(self, at: int) -> Side:
        out = object.__new__(Side)
        cut = slice(at, at + BLOCK)
        out.units, out.turned, out.steps, out.rest = self.units[cut], self.turned[cut], self.steps, [r[cut] for r in self.rest]
        return out


def linked_pairs(a: Side, b: Side, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of rows whose cosine is at least ``least``."""
    first = a.steps[0]
    part = a.turned[:, :first] @ b.turned[:, :first].T
    left, right = np.nonzero(part + np.outer(a.rest[0], b.rest[0]) >= least - SLACK)
    out = []
    for at in range(0, len(left), PAIRS):
        i, j = left[at : at + PAIRS], right[at : at + PAIRS]
        sums = part[i, j]
        for k, (low, high) in enumerate(zip(a.steps, a.steps[1:], strict=False), 1):
            sums = sums + np.einsum("ij,ij->i", a.turned[i, low:high], b.turned[j, low:high])
            open_ = sums + a.rest[k][i] * b.rest[k][j] >= least - SLACK
            i, j, sums = i[open_], j[open_], sums[open_]
        sure = np.einsum("ij,ij->i", a.units[i], b.units[j]) >= least
        out.append((i[sure], j[sure]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (left, right)


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node of each node's component among n nodes."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        label = np.minimum(label, label[label])
        if (label == before).all():
            return label


def _axes(distinct: DataFrame, dims: int) -> np.ndarray:
    """Principal axes of all unit vectors, the widest first; the sums are dims * dims rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch["raw"].to_pylist(), dims)
            if len(x):
                x = unit(x)
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"at": np.arange(dims * dims), "value": total.ravel()})

    total = np.zeros(dims * dims)
    for at, value in distinct.select("raw").mapInArrow(moments, "at long, value double").groupBy("at").agg(F.sum("value")).collect():
        total[at] = value
    return np.linalg.eigh(total.reshape(dims, dims))[1][:, ::-1].copy()


def _bytes(x: np.ndarray) -> bytes:
    """The components up to the last that isn't zero, in single precision if that holds them exactly; the last byte tells."""
    x = np.trim_zeros(x + 0.0, "b")
    with np.errstate(over="ignore"):
        narrow = x.astype(np.float32)
    return narrow.tobytes() + b"4" if (narrow.astype(np.float64) == x).all() else x.tobytes() + b"8"


def _matrix(raw: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(raw), dims))
    for k, value in enumerate(raw):
        row = np.frombuffer(value, np.float32 if value[-1:] == b"4" else np.float64, (len(value) - 1) // int(value[-1:]))
        out[k, : len(row)] = row
    return out


def _compare(left: Side, weight_left: np.ndarray, right: Side, weight_right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of the rows of both sides, and the least row of each one's component; one side given twice is compared with itself."""
    same, n, m = left is right, len(left), len(right)
    shift = 0 if same else n
    links = np.zeros(n + (0 if same else m))
    edges = []
    for r in range(0, n, BLOCK):
        one = left.block(r)
        for s in range(r if same else 0, m, BLOCK):
            x, y = linked_pairs(one, right.block(s), least)
            if same and r == s:
                x, y = x[x < y], y[x < y]
            if not len(x):
                continue
            links[r : r + len(one)] += np.bincount(x, weight_right[y + s], len(one))
            width = min(BLOCK, m - s)
            links[shift + s : shift + s + width] += np.bincount(y, weight_left[x + r], width)
            at = np.concatenate((np.arange(len(one)) + r, np.arange(width) + s + shift))
            if same and r == s:
                star = _stars(len(one), x, y)
            else:
                star = _stars(len(at), x, y + len(one))
            moved = np.flatnonzero(star != np.arange(len(star)))
            edges.append((at[moved], at[star[moved]]))
    i, j = (np.concatenate(e) for e in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 2
    return links.astype(np.int64), _stars(len(links), i, j)


def embedding_links(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    bounded_batches(spark)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, sizes = [], []
            for value in batch["embedding"].to_pylist():
                x = _usable(value)
                raw.append(None if x is None else _bytes(x))
                sizes.append(None if x is None else len(x))
            # a vector's node is 64 bits of its hash
            nodes = [None if r is None else xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in raw]
            yield pa.RecordBatch.from_pydict({"vec_id": batch["vec_id"], "node": pa.array(nodes, pa.int64()), "raw": pa.array(raw, pa.binary()), "dims": pa.array(sizes, pa.int32())})

    named = Stored(vectors.select("vec_id", "embedding").mapInArrow(name, "vec_id long, node long, raw binary, dims int"), "vectors").read()
    grouped = named.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.max("raw").alias("raw"), F.max("dims").alias("dims"))
    distinct = Stored(grouped, "distinct-vectors").read()
    n, dims = distinct.agg(F.count("*"), F.max("dims")).first()
    ids = named.select("vec_id", "node")
    if not n:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    axes = _axes(distinct, dims)

    def first_axis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["raw"].to_pylist(), dims)
            at = unit(x) @ axes[:, 0] if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"node": batch["node"], "weight": batch["weight"], "raw": batch["raw"], "x": pa.array(at, pa.float64())})

    placed = Stored(distinct.select("node", "weight", "raw").mapInArrow(first_axis, "node long, weight long, raw binary, x double"), "placed-vectors").read()
    tiles = parts(n, TILE)
    cuts = np.array(placed.agg(F.percentile_approx("x", [k / tiles for k in range(1, tiles)], 10 * tiles)).first()[0] if tiles > 1 else [])
    reach = float(np.sqrt(2 - 2 * least)) + SLACK

    def near(t: int) -> np.ndarray:
        """The tiles that hold vectors within reach of tile ``t``'s."""
        low, high = np.concatenate(([-np.inf], cuts)), np.concatenate((cuts, [np.inf]))
        return np.flatnonzero((low - high[t] <= reach) & (low[t] - high <= reach))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, node = batch["x"].to_numpy(), batch["node"].to_numpy()
            first, last = (np.searchsorted(cuts, x, side=side) for side in ("left", "right"))
            tile = first + (node % (last - first + 1) if len(cuts) else 0)  # several tiles begin or end at a frequent coordinate
            for t in np.unique(tile).tolist():
                mine = batch.filter(pa.array(tile == t)).select(["node", "weight", "raw"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, mine.schema) as out:
                    out.write_batch(mine)
                data = sink.getvalue().to_pybytes()
                for u in near(t).tolist():
                    yield pa.RecordBatch.from_pydict({"i": pa.array([min(t, u)], pa.int32()), "j": pa.array([max(t, u)], pa.int32()), "tile": pa.array([t], pa.int32()), "data": pa.array([data], pa.binary())})

    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()

        def load(t: int):
            blocks = [pa.ipc.open_stream(d).read_all() for k, d in zip(table["tile"].to_pylist(), table["data"].to_pylist(), strict=True) if k == t]
            if not blocks:
                return None
            tile = pa.concat_tables(blocks)
            return tile["node"].to_numpy(), tile["weight"].to_numpy(), Side(_matrix(tile["raw"].to_pylist(), dims), axes)

        one = load(i)
        two = one if i == j else load(j)
        if not (one and two):
            return out.empty_table()
        nodes = one[0] if i == j else np.concatenate((one[0], two[0]))
        links, star = _compare(one[2], one[1], two[2], two[1], least)
        has = links > 0
        return pa.Table.from_arrays([pa.array(v) for v in (nodes[has], nodes[star][has], links[has])], schema=out)

    packed = placed.mapInArrow(pack, "i int, j int, tile int, data binary")
    found = Stored(packed.groupBy("i", "j").applyInArrow(compare, "a long, b long, n long"), "vector-links").read()
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    groups = connected_components(found.select("a", "b"))
    whole = distinct.select("node", "id", "weight").join(links, "node", "left").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    whole = Stored(whole.select("node", "id", "group", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "vector-groups").read()
    least_ids = whole.groupBy("group").agg(F.min("id").alias("component_id"))
    by_node = whole.join(least_ids, "group").select("node", "n_links", "component_id")
    rows = ids.join(by_node, "node", "left")
    alone = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    rows = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), alone.alias("component_id"))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
