"""N-gram Jaccard join: exact links between whole-text shingle sets.

Documents with equal sets are one set from the start. Sets are dealt into
size-banded tiles: a band pairs the sizes that can still reach the threshold,
and within it the shingles' hash space is cut into more parts than two linked
sets can differ in, so linked sets have at least one part in common. Each tile
holds the sets of one band that agree in one part. Inside a tile, hashed parity
bitmaps bound the overlap from above: every bit in which two bitmaps differ is a
shingle that only one set has. Pairs that survive the bound are intersected
exactly, as sorted arrays.

A tile yields no more pairs than it has members: a spanning forest of its
surviving pairs, the surest pairs first. Where a pair of a forest fails the
exact test and its two sets are not linked by other ways either, its tile is
searched once more between the components found so far, now with the sets
themselves at hand of those members whose bitmaps leave it open, so that only pairs that pass the exact test join components.
Then every surviving pair of the tile lies within one component, or fails the
exact test; no link between different sets is lost, without any cap on tiles or
partners.

No task holds a whole tile that is large: a tile of more than ``CELL`` loads (a
set of up to ``LOAD`` shingles is one) is searched in cells of about that many,
dealt by hash, and then, if it still holds several components, in pairs of cells
of which each holds one component or the small ones; two cells of the same single
component are not compared. A tile of copies of one text is one component after
the first round and costs no more.

Edge cases: null or empty texts and texts without words have no shingles, no
links and a component of their own; with fewer words than a shingle has the
whole sequence is one shingle; rows with equal doc_id share the least component;
null doc_ids are kept and never name a component, but for their own; texts of
any length are read whole; an empty table gives no rows; further columns are
left alone, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import BoundedCache, Stored, bounded_batches
from quillon.llm.components import connected_components
from quillon.llm.mphf import mixed

#: Loads of one cell of a large tile, and shingles of one load.
CELL, LOAD = 1024, 4096
#: Parts beyond what linked sets can differ in; a set with more empty parts than these matches on empty ones too.
SPARE_PARTS = 3
#: Rows of one block of bitmaps.
BLOCK = 4096
#: Bytes that a Python worker's cache of word hashes may hold.
WORD_BYTES = 64 << 20
#: Sets that a Python worker keeps in mind, so as not to send them again.
SEEN = 500_000
#: Words of a text that are looked up at a time.
RUN = 1 << 16
#: Bits of a filter for each wanted text, and the most texts for which there is one (of 16 MB).
FILTER_BITS, FILTER_TEXTS = 16, 1 << 23


class _WordHashes(BoundedCache):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        self.put(word, value)
        return value


_WORDS = _WordHashes(WORD_BYTES)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.empty(len(tokens), np.uint64)
    for at in range(0, len(tokens), RUN):
        _WORDS.trim()
        h[at : at + RUN] = np.fromiter(map(_WORDS.__getitem__, tokens[at : at + RUN]), np.uint64)
    k = min(words, len(h))
    n = len(h) - k + 1
    total = h[:n].copy()
    for j in range(1, k):  # integer arrays wrap around
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += h[j : n + j]
    total = mixed(total, k)
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    with np.errstate(over="ignore"):
        total = shingles.sum(dtype=np.uint64, keepdims=True)
    return int(mixed(total, len(shingles)).view(np.int64)[0])


def bitmap(shingles: np.ndarray, each: int = 4) -> bytes:
    """Parity bitmap of a power of two of bits, at least ``each`` to a shingle."""
    width = max(64, 1 << (each * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


class Bands:
    """The size bands for a threshold num/den, and the parts of each band."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.edges, self._cuts = num, den, [1], {}

    def _grow(self, size: int) -> None:
        while self.edges[-1] <= size or len(self.edges) < 3:
            low = self.edges[-1]
            self.edges.append(max(low + 1, (low - 1) * self.den // self.num + 1))

    def cuts(self, k: int) -> np.ndarray:
        """The bounds between ``k`` equal parts of the hash space."""
        if k not in self._cuts:
            self._cuts[k] = np.array([-(-(i << 64) // k) for i in range(1, k)], np.uint64)
        return self._cuts[k]

    def of(self, size: int) -> list[tuple[int, int]]:
        """(band, parts) of the one or two bands in which a set of this size meets others."""
        self._grow(size)
        own = bisect_right(self.edges, size) - 1
        self._grow(self.edges[own])
        out = []
        for band in (own, own - 1):
            if band < 0:
                continue
            small = self.edges[band + 1] - 1
            large = small * self.den // self.num
            if size <= large:
                out.append((band, (self.den - self.num) * (small + large) // (self.den + self.num) + 1 + SPARE_PARTS))
        return out


def signatures(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """One 64-bit signature for each band and part in which the set can match.

    Parts are ranges of the sorted shingles, so their sums are differences of one running sum.
    """
    out = []
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(shingles, dtype=np.uint64)))
    for band, k in bands.of(len(shingles)):
        at = np.concatenate(([0], np.searchsorted(shingles, bands.cuts(k)), [len(shingles)]))
        filled = at[1:] > at[:-1]
        if k - filled.sum() > SPARE_PARTS:
            filled[:] = True
        part = np.flatnonzero(filled)
        sums = running[at[part + 1]] - running[at[part]]
        out.append(mixed(sums + part.astype(np.uint64) * np.uint64(0xA0761D6478BD642F), 500 + band))
    return np.concatenate(out)


def _documents(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_id, bitmap) of every document; the last two null without shingles."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, maps = [], [], []
            for text in batch["text"]:
                s = shingle_set(text.as_py() or "", words)
                sizes.append(len(s))
                names.append(set_id(s) if len(s) else None)
                maps.append(bitmap(s) if len(s) else None)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "text_key": batch["text_key"], "n_shingles": pa.array(sizes, pa.int64()),
                "set_id": pa.array(names, pa.int64()), "bitmap": pa.array(maps, pa.binary()),
            })

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(describe, "doc_id long, text_key long, n_shingles long, set_id long, bitmap binary")


def _tiles(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(tile, load, set_id, own): the tiles of at least two sets; tiles with the same members are one. ``load`` sums up ``own``.

    A worker sends a set's signatures once, however many copies it reads.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for batch in batches:
            sigs, names, loads = [], [], []
            if len(seen) > SEEN:
                seen.clear()
            for text in batch["text"]:
                s = shingle_set(text.as_py() or "", words)
                if len(s) and (name := set_id(s)) not in seen:
                    seen.add(name)
                    sigs.append(signatures(s, bands))
                    names.append(np.full(len(sigs[-1]), name, np.int64))
                    loads.append(np.full(len(sigs[-1]), -(-len(s) // LOAD), np.int32))
            if sigs:
                yield pa.RecordBatch.from_pydict({"sig": np.concatenate(sigs).view(np.int64), "set_id": np.concatenate(names), "own": np.concatenate(loads)})

    entries = docs.select("text").mapInArrow(emit, "sig long, set_id long, own int").repartition("sig").distinct()
    same = Window.partitionBy("sig")
    held = entries.withColumn("size", F.count("*").over(same)).filter("size > 1")
    # the parity of well mixed hashes stands for the members
    named = held.withColumn("tile", F.xxhash64("size", F.bit_xor(F.xxhash64(F.lit(600), "set_id")).over(same)))
    return named.select("tile", F.sum("own").over(same).alias("load"), "set_id", "own").distinct()


def _closest(n: np.ndarray, rows: np.ndarray, labels: np.ndarray, num: int, den: int, sure: bool = False, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs of indexes: a spanning forest of the pairs that survive the bound, between members of different labels.

    Members are in rising order of size ``n``, ``rows`` are their bitmaps. If ``sure``, only pairs that most
    likely pass the exact test; with ``sets``, only those that do pass it.
    """
    open_, edges, width = np.ones(len(n), bool), [], 64 * rows.shape[1]
    by_label: dict[int, list[int]] = {}
    for i, label in enumerate(labels.tolist()):
        by_label.setdefault(label, []).append(i)
    rest = np.arange(len(n))
    for root in range(len(n)):
        if not open_[root]:
            continue
        queue = by_label[int(labels[root])].copy()
        open_[queue] = False
        while queue:
            u = queue.pop()
            if len(rest) > 2 * open_.sum():
                rest = rest[open_[rest]]
            lo = np.searchsorted(n[rest], -(-int(n[u]) * num // den))
            hi = np.searchsorted(n[rest], int(n[u]) * den // num, side="right")
            for at in range(lo, hi, BLOCK):
                v = rest[at : min(hi, at + BLOCK)]
                v = v[open_[v]]
                if not len(v):
                    continue
                both = n[v] + n[u]
                apart = np.bitwise_count(rows[v] ^ rows[u]).sum(axis=1, dtype=np.int64)
                if sure:  # as many shingles apart as make that many bits differ, and twice the error of that
                    apart = np.log1p(-np.minimum(2 * apart / width, 0.99)) / math.log1p(-2 / width)
                    apart += 2 * apart / math.sqrt(2 * width)
                for w in v[(den + num) * (both - apart) >= 2 * num * both].tolist():
                    if open_[w] and (sets is None or linked(sets[u], sets[w], num, den)):
                        edges.append((u, w))
                        same = by_label[int(labels[w])]
                        open_[same] = False
                        queue += same
    return edges


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """The exact test, on sorted arrays."""
    merged = np.concatenate((x, y))
    merged.sort(kind="stable")
    common = int((merged[1:] == merged[:-1]).sum())
    return den * common >= num * (len(merged) - common)


def _folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps folded to the narrowest one's width, a row each."""
    width = min(map(len, maps))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, width), axis=0) for m in maps]).view(np.uint64)


def _forest(sizes: np.ndarray, maps: list[bytes], labels: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of indexes: a spanning forest of the surviving pairs between members of different labels, of sure pairs as far as they go."""
    order = np.argsort(sizes, kind="stable")
    rows = _folded([maps[i] for i in order])
    n, labels = sizes[order], labels[order]
    edges = _closest(n, rows, labels, num, den, sure=True)
    up = {label: label for label in labels.tolist()}

    def root(label: int) -> int:
        while up[label] != label:
            up[label] = label = up[up[label]]
        return label

    for u, w in edges:
        up[root(int(labels[u]))] = root(int(labels[w]))
    labels = np.array([root(label) for label in labels.tolist()], np.int64)
    if (labels != labels[0]).any():
        edges += _closest(n, rows, labels, num, den)
    return [(order[u], order[w]) for u, w in edges]


def _with_partners(sizes: np.ndarray, maps: list[bytes], labels: np.ndarray, num: int, den: int) -> list[int]:
    """Indexes of the members that survive the bound with a member of another label."""
    order = np.argsort(sizes, kind="stable")
    n, labels, rows, found = sizes[order], labels[order], _folded([maps[i] for i in order]), np.zeros(len(sizes), bool)
    for u in range(len(n)):
        hi = np.searchsorted(n, int(n[u]) * den // num, side="right")
        for at in range(u + 1, hi, BLOCK):
            v = np.arange(at, min(hi, at + BLOCK))
            v = v[labels[v] != labels[u]]
            both = n[v] + n[u]
            apart = np.bitwise_count(rows[v] ^ rows[u]).sum(axis=1, dtype=np.int64)
            v = v[(den + num) * (both - apart) >= 2 * num * both]
            found[v] = True
            found[u] |= len(v) > 0
    return order[found].tolist()


def _exact_forest(sets: list[np.ndarray], labels: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of indexes: a spanning forest of the links between members of different labels."""
    sizes = np.array(list(map(len, sets)))
    order = np.argsort(sizes, kind="stable")
    sets = [sets[i] for i in order]
    rows = _folded([bitmap(s, 32) for s in sets])
    return [(order[u], order[w]) for u, w in _closest(sizes[order], rows, labels[order], num, den, sets=sets)]


def _labelled(cells: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``cells`` with each set's component so far."""
    if labels is None:
        return cells.withColumn("label", F.col("set_id"))
    of = labels.select(F.col("node").alias("set_id"), "component")
    return cells.join(of, "set_id", "left").withColumn("label", F.coalesce("component", "set_id")).drop("component")


def _searched(members: DataFrame, forest: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """(cell, a, b): ``forest`` of each cell that holds several labels, for rows (cell, set_id, label, ...); it gives pairs of row numbers."""
    out = pa.schema([("cell", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def done(table: pa.Table) -> pa.RecordBatch:
        cell, names, labels = (table[c].to_numpy() for c in ("cell", "set_id", "label"))
        start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else []
        found = []
        for i, j in zip(start, [*start[1:], len(cell)], strict=True):
            if (labels[i:j] != labels[i]).any():
                pairs = (sorted((int(names[i + x]), int(names[i + y]))) for x, y in forest(table.slice(i, j - i)))
                found += [(int(cell[i]), a, b) for a, b in pairs]
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=out)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # at most a cell and a batch
        for batch in batches:
            waiting.append(batch)
            cell = batch["cell"].to_numpy()
            if len(cell) and cell[0] != cell[-1]:
                table = pa.Table.from_batches(waiting).combine_chunks()
                cut = int(np.searchsorted(table["cell"].to_numpy(), cell[-1]))
                yield done(table.slice(0, cut))
                waiting = table.slice(cut).to_batches()
        if waiting:
            yield done(pa.Table.from_batches(waiting).combine_chunks())

    return members.repartition("cell").sortWithinPartitions("cell").mapInArrow(search, "cell long, a long, b long")


def _candidates(cells: DataFrame, sets: DataFrame, num: int, den: int, labels: DataFrame | None) -> DataFrame:
    """(cell, a, b): a forest of each cell, of pairs that survive the bound."""

    def forest(cell: pa.Table) -> list[tuple[int, int]]:
        return _forest(cell["n_shingles"].to_numpy(), cell["bitmap"].to_pylist(), cell["label"].to_numpy(), num, den)

    members = _labelled(cells.select("cell", "set_id"), labels).join(sets.select("set_id", "n_shingles", "bitmap"), "set_id")
    return _searched(members, forest)


def _undecided(cells: DataFrame, sets: DataFrame, num: int, den: int, labels: DataFrame) -> DataFrame:
    """(cell, set_id): the members of each cell that may be linked with one of another label, as far as bitmaps tell.

    The others need no arrays; few pairs lie so close to the threshold.
    """

    def marked(cell: pa.Table) -> list[tuple[int, int]]:
        return [(i, i) for i in _with_partners(cell["n_shingles"].to_numpy(), cell["bitmap"].to_pylist(), cell["label"].to_numpy(), num, den)]

    members = _labelled(cells.select("cell", "set_id"), labels).join(sets.select("set_id", "n_shingles", "bitmap"), "set_id")
    return _searched(members, marked).select("cell", F.col("a").alias("set_id"))


def _exact_links(cells: DataFrame, arrays: DataFrame, num: int, den: int, labels: DataFrame) -> DataFrame:
    """(a, b): a forest of the links of each cell between the labels it holds."""

    def forest(cell: pa.Table) -> list[tuple[int, int]]:
        return _exact_forest([np.frombuffer(x.as_buffer(), np.uint64) for x in cell["shingles"]], cell["label"].to_numpy(), num, den)

    members = _labelled(cells.select("cell", "set_id"), labels).join(arrays, "set_id")
    return _searched(members, forest).select("a", "b").distinct()


def _blocks(of: Column, load: Column) -> Column:
    """A number below load / CELL, by a hash of ``of``."""
    return F.pmod(F.xxhash64(F.lit(601), of), F.ceil(load / CELL))


def _first_cells(tiles: DataFrame) -> DataFrame:
    """(cell, set_id): each small tile, and large ones in parts by hash."""
    part = F.when(F.col("load") > CELL, F.xxhash64("tile", _blocks(F.col("set_id"), F.col("load")))).otherwise(F.col("tile"))
    return tiles.select(part.alias("cell"), "set_id")


def _cross_cells(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell, set_id): pairs of parts of the large tiles that still hold several components.

    A component that would fill a part has parts of its own; the others share parts.
    """
    members = Stored(_labelled(tiles.filter(F.col("load") > CELL), labels), "shingle-large").read()
    counts = members.groupBy("tile", "label").agg(F.sum("own").alias("n"))
    open_ = counts.groupBy("tile").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("n") <= CELL // 2, F.col("n"))).alias("mixed")).filter("labels > 1")
    own = counts.join(open_, "tile").select("tile", "label", "n", "mixed")
    dealt = members.join(own, ["tile", "label"]).withColumn("pure", F.when(F.col("n") > CELL // 2, F.col("label")))
    dealt = dealt.withColumn("block", F.when(F.col("pure").isNull(), F.xxhash64(F.lit(0), _blocks(F.col("set_id"), F.col("mixed")))).otherwise(F.xxhash64(F.lit(1), "pure", _blocks(F.col("set_id"), F.col("n")))))
    dealt = Stored(dealt.select("tile", "block", "pure", "set_id"), "shingle-blocks").read()
    blocks = dealt.groupBy("tile", "block").agg(F.first("pure").alias("pure"))
    other = blocks.select(F.col("tile").alias("of"), F.col("block").alias("with"), F.col("pure").alias("with_pure"))
    pairs = blocks.join(other, (F.col("tile") == F.col("of")) & (F.col("block") <= F.col("with")) & ~F.coalesce(F.col("pure") == F.col("with_pure"), F.lit(False)))
    pairs = pairs.withColumn("cell", F.xxhash64("tile", "block", "with"))
    sides = pairs.select("tile", "block", "cell").unionByName(pairs.select("tile", F.col("with").alias("block"), "cell")).distinct()
    return dealt.join(sides, ["tile", "block"]).select("cell", "set_id")


def _verified(pairs: DataFrame, arrays: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked) by exact intersection of sorted arrays."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = [linked(*(np.frombuffer(v.as_buffer(), np.uint64) for v in xy), num, den) for xy in zip(batch["x"], batch["y"], strict=True)]
            yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"], "linked": pa.array(passed, pa.bool_())})

    one = arrays.select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
    two = arrays.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(test, "a long, b long, linked boolean")


def _perhaps(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``text_key`` may be one of the wanted ones: all that are, and about one in ``FILTER_BITS`` of the others.

    Few texts are wanted; the others need not be moved to find that out.
    """
    n = wanted.count()
    if n > FILTER_TEXTS:
        return rows
    spot = F.pmod(F.xxhash64(F.lit(602), "text_key"), F.lit((n + 1) * FILTER_BITS))
    bucket, bit = F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot)
    maps = wanted.select(bucket, bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    byte = F.conv(F.hex(F.substring("map", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    asked = rows.select(*rows.columns, bucket, bit.alias("bit")).join(F.broadcast(maps), "bucket")
    return asked.filter(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).select(*rows.columns)


def _arrays(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(set_id, shingles) of the wanted sets (set_id, doc_id, text_key), from one document each."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, raw = [], []
            for name, text in zip(batch["set_id"].to_pylist(), batch["text"], strict=True):
                s = shingle_set(text.as_py() or "", words)
                if len(s) and set_id(s) == name:
                    names.append(name)
                    raw.append(s.tobytes())
            yield pa.RecordBatch.from_pydict({"set_id": pa.array(names, pa.int64()), "shingles": pa.array(raw, pa.binary())})

    # by the text's hash first, so that a null doc_id, or one that repeats, is no hot key
    keyed = _perhaps(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), wanted)
    match = (F.col("text_key") == F.col("wanted_key")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))
    found = keyed.join(wanted.select("set_id", F.col("doc_id").alias("wanted_id"), F.col("text_key").alias("wanted_key")), match)
    return found.select("set_id", "text").mapInArrow(take, "set_id long, shingles binary").dropDuplicates(["set_id"])


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def shingle_groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, text_key, n_shingles, shingle_group) of every row of ``docs``: linked rows share a group, null without shingles.

    Two documents link when den * (size of the intersection) >= num * (size of
    the union) of their sets of ``words``-word shingles; ``text_key`` is xxhash64 of the text.
    """
    bounded_batches(docs.sparkSession)
    described = Stored(_documents(docs, words), "shingle-documents").read()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least")
    grouped = described.filter("set_id is not null").groupBy("set_id").agg(least, F.max("n_shingles").alias("n_shingles"), F.max("bitmap").alias("bitmap"))
    sets = Stored(grouped.select("set_id", "least.doc_id", "least.text_key", "n_shingles", "bitmap"), "shingle-sets").read()
    tiles = Stored(_tiles(docs, words, num, den), "shingle-tiles").read()
    links, labels, arrays = [], None, []

    def fetch(wanted: DataFrame) -> DataFrame:
        """The arrays of the wanted sets, and of those fetched before."""
        if arrays:
            wanted = wanted.join(_union(arrays).select("set_id"), "set_id", "left_anti")
        found = Stored(wanted.join(sets.select("set_id", "doc_id", "text_key"), "set_id"), "shingle-wanted").read()
        arrays.append(Stored(_arrays(docs, found, words), "shingle-arrays").read())
        return _union(arrays)

    def resolve(cells: DataFrame, labels: DataFrame | None) -> DataFrame:
        """The components so far and those of all links within cells."""
        found = Stored(_candidates(cells, sets, num, den, labels), "shingle-pairs").read()
        at_hand = fetch(found.select(F.col("a").alias("set_id")).union(found.select("b")).distinct())
        tested = Stored(_verified(found.select("a", "b").distinct(), at_hand, num, den), "shingle-tested").read()
        links.append(tested.filter("linked").select("a", "b"))
        labels = Stored(connected_components(_union(links)), "shingle-components").read()
        open_ = tested.filter("not linked").select("a", "b")
        open_ = open_.join(labels.toDF("a", "of_a"), "a", "left").join(labels.toDF("b", "of_b"), "b", "left")
        open_ = open_.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
        again = Stored(found.join(open_, ["a", "b"]).select("cell").distinct(), "shingle-open").read()
        if again.isEmpty():
            return labels
        members = Stored(_undecided(cells.join(again, "cell", "left_semi"), sets, num, den, labels), "shingle-again").read()
        links.append(Stored(_exact_links(members, fetch(members.select("set_id").distinct()), num, den, labels), "shingle-links").read())
        return Stored(connected_components(_union(links)), "shingle-components").read()

    labels = resolve(_first_cells(tiles), labels)
    if not tiles.filter(F.col("load") > CELL).isEmpty():
        cross = Stored(_cross_cells(tiles, labels), "shingle-cells").read()
        if not cross.isEmpty():
            labels = resolve(cross, labels)
    by_set = labels.select(F.col("node").alias("set_id"), "component")
    return described.drop("bitmap").join(by_set, "set_id", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("component", "set_id").alias("shingle_group"))


def shingle_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; see ``shingle_groups`` for links.

    ``component_id`` is the least doc_id of the document's group; without shingles, its own.
    """
    rows = Stored(shingle_groups(docs, words, num, den), "shingle-groups").read()
    least = rows.filter("shingle_group is not null").groupBy("shingle_group").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "shingle_group", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
