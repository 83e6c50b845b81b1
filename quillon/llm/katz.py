"""LM scoring: a word bigram model with Katz backoff, learned from and applied to whole tables.

P(w | h) = d_r c(h,w) / c(h) for a bigram seen r = c(h,w) times in training, and
alpha(h) P(w) otherwise; P(w) is the Good-Turing discounted unigram share, and
what the discounts leave belongs to the one unknown word. d_r is Katz's
Good-Turing discount for r up to ``K`` and 1 beyond; where that discount does not
lie between 0.01 and 0.999, or its counts of counts are zero, half a count is
taken off instead. alpha(h) hands exactly the mass that the discounts of h's
followers leave to the words that don't follow h, so each context sums to one. A
context whose followers were all seen more often than ``K`` times reserves
1 / (c(h) + 1).

Tables in the shared folder, none of them ever held by one process:

1. token blocks: documents of a few megabytes, with a vocabulary of their own;
2. word tables, partitioned by word: training counts;
3. bigram tables, partitioned by context: each context's followers and their
   training counts, and what each block asked: the counts of its distinct bigrams;
4. weights, partitioned as the bigram tables: c(h) and alpha(h) of each context,
   from the followers and from the word tables' counts of them; and for each block
   what its bigrams need.

Each block then evaluates its tokens one by one: the bigram's discounted count if
it was seen, else its context's weight and the word's discounted count, else the
unknown word's share.

Blocks send a bigram once, as hashes, and only to partitions that own some of
theirs, so messages are no more than distinct bigrams of blocks. A context with
more than half a partition's share of all tokens is split by its followers, and
its parts' sums are added up; such contexts are words of a frequency above that
share, at most two for each partition, and the only thing sent to all tasks.

Edge cases: null and empty texts are the end token alone; words are told apart
by 64-bit hashes; texts of any length are read whole; rows with equal doc_id are
documents of their own; null doc_ids count as training documents; with no
training document every word is unknown (probability 1) and base and score are
those of an empty model; an empty table stays empty; further columns are left
alone, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import BoundedCache, Stored, bounded_batches, parts, release, text_bytes
from quillon.llm.mphf import mixed
from quillon.llm.sampling import fold

#: Counts up to this one are discounted.
K = 5
#: Text bytes for one partition of the tables.
SHARD_BYTES = 16 << 20
#: Text bytes of one block, unless a single text is longer.
BLOCK_BYTES = 10 << 20
#: Bytes that a Python worker's cache of word hashes may hold, and words that are looked up at a time.
WORD_BYTES, RUN = 64 << 20, 1 << 16
#: Stand for the end of a text and for what precedes its first word; no word holds a line feed.
END, START = xxhash.xxh3_64_intdigest(b"\nend"), xxhash.xxh3_64_intdigest(b"\nstart")


class _WordHashes(BoundedCache):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        self.put(word, value)
        return value


_WORDS = _WordHashes(WORD_BYTES)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the text's tokens, the end included."""
    tokens = text.encode().lower().split()
    out = np.empty(len(tokens) + 1, np.uint64)
    for at in range(0, len(tokens), RUN):
        _WORDS.trim()
        run = tokens[at : at + RUN]
        out[at : at + len(run)] = np.fromiter(map(_WORDS.__getitem__, run), np.uint64, len(run))
    out[-1] = END
    return out


def _pack(value: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, 5))


def _unpack(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def discounts(counts: np.ndarray) -> np.ndarray:
    """d_r for r = 0..K+1 from the counts of counts n_0..n_{K+1}: Katz's, or half a count where those are not in (0, 1)."""
    n = counts.astype(float)
    d = np.ones(K + 2)
    for r in range(1, K + 1):
        d[r] = (r - 0.5) / r
        if n[1] > 0 and n[r] > 0:
            cut = (K + 1) * n[K + 1] / n[1]
            good = ((r + 1) * n[r + 1] / (n[r] * r) - cut) / (1 - cut) if cut != 1 else -1.0
            if 0.01 < good < 0.999:
                d[r] = good
    d[0] = 0
    return d


@dataclass
class Unigrams:
    """``tokens``: N; ``types``: V; ``d``: the discounts by count; ``unknown``: the unknown word's probability."""

    tokens: int
    types: int
    d: np.ndarray
    unknown: float

    def p(self, count: np.ndarray) -> np.ndarray:
        count = count.astype(np.int64)
        return np.where(count > 0, self.d[np.minimum(count, K + 1)] * count / max(1, self.tokens), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count.astype(float) + 1) / (self.tokens + 1 * (self.types + 1)))


def _blocks(docs: DataFrame, held_out) -> DataFrame:
    def block(name: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(batches)
        texts = [word_hashes(t.as_py() or "") for t in batch["text"]]
        vocabulary, local, counts = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        local = rank[local]
        row = {"block": [name], "doc_ids": [batch["doc_id"].to_pylist()], "held": [batch["held_out"].to_numpy().tobytes()]}
        row |= {"sizes": [np.array(list(map(len, texts)), np.uint32).tobytes()], "vocabulary": [vocabulary[order].tobytes()], "low": [_pack((local & np.uint32(0xFFFF)).astype(np.uint16))], "high": [_pack(small(local >> np.uint32(16)))]}
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("held", "sizes", "vocabulary", "low", "high"))]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, waiting, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                past = int(ends[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(ends, past + BLOCK_BYTES - held, side="right")))
                waiting.append(batch.slice(at, end - at))
                held += int(ends[end - 1]) - past
                at = end
                if held >= BLOCK_BYTES or at < batch.num_rows:
                    yield block((part << 32) + k, waiting)
                    k, waiting, held = k + 1, [], 0
        if waiting:
            yield block((part << 32) + k, waiting)
        _WORDS.clear()
        release()

    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return rows.mapInArrow(pack, "block long, doc_ids array<bigint>, held binary, sizes binary, vocabulary binary, low binary, high binary")


def small(x: np.ndarray) -> np.ndarray:
    """``x`` in the smallest type of unsigned integers that holds it."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


class Block:
    """A row of the block table. ``words``: sorted hashes, what precedes a text included; ``token``, ``before``: places in it."""

    def __init__(self, row: dict):
        self.id, self.doc_ids = row["block"], row["doc_ids"]
        self.held = np.frombuffer(row["held"], bool)
        self.sizes = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
        vocabulary = np.append(np.frombuffer(row["vocabulary"], np.uint64), np.uint64(START))
        order = np.argsort(vocabulary)
        self.words = vocabulary[order]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        local = _unpack(row["high"]).astype(np.int32) << 16
        local += _unpack(row["low"])
        self.token = rank[local]
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        self.before[np.concatenate(([0], np.cumsum(self.sizes)[:-1]))] = rank[-1]

    def doc(self) -> np.ndarray:
        """The number of each token's document."""
        return np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct bigrams, as context * words + word, in order; and the number of each token's."""
        keys = self.before.astype(np.int64)
        keys *= len(self.words)
        keys += self.token
        order = np.argsort(keys).astype(np.int32)
        keys = keys[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        of = np.empty(len(order), np.int32)
        of[order] = np.cumsum(new, dtype=np.int32) - 1
        return keys[new], of


class Owners:
    """Which partition owns a bigram: its context's, or one of several for a frequent context."""

    def __init__(self, shards: int, frequent: dict[int, int]):
        self.shards = shards
        self.frequent = np.array(sorted(frequent), np.uint64)
        self.pieces = np.array([frequent[h] for h in sorted(frequent)], np.uint64)

    def split(self, contexts: np.ndarray) -> np.ndarray:
        """Into how many parts each context is split."""
        out = np.ones(len(contexts), np.uint64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, contexts), len(self.frequent) - 1)
            out = np.where(self.frequent[at] == contexts, self.pieces[at], out)
        return out

    def __call__(self, words: np.ndarray, h: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each partition that owns some of the bigrams, their places, in order."""
        piece = mixed(words, 9)[w] % self.split(words)[h]
        owner = ((mixed(words, 8)[h] + piece) % np.uint64(self.shards)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(owner[order])) + 1, [len(order)]))
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield int(owner[order[i]]), order[i:j]


_TABLE = "shard int, block long, data binary"
_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])


def _rows(rows: list[tuple[int, int, object]]) -> pa.RecordBatch:
    columns = list(zip(*((s, b, _pack(x)) for s, b, x in rows), strict=True)) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _steps(rising: np.ndarray) -> np.ndarray:
    """Rising numbers as their differences; ``cumsum`` gives them back."""
    return small(np.diff(rising, prepend=0))


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, int, object]]:
    for shard, block, data in zip(batch["shard"].to_pylist(), batch["block"].to_pylist(), batch["data"], strict=True):
        yield shard, block, _unpack(data.as_py())


def _by_shard(words: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each shard that owns some of the words, their places, in order."""
    owner = (words % np.uint64(shards)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(owner[order])) + 1, [len(order)]))
    for i, j in zip(cuts, cuts[1:], strict=False):
        if j > i:
            yield int(owner[order[i]]), order[i:j]


def _word_tables(blocks: DataFrame, shards: int) -> DataFrame:
    """A row for each shard of words: sorted hashes and their training counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                counts = np.bincount(b.token[~np.repeat(b.held, b.sizes)], minlength=len(b.words))
                has = np.flatnonzero(counts)
                yield _rows([(s, b.id, (b.words[has[mine]], small(counts[has[mine]]))) for s, mine in _by_shard(b.words[has], shards)])

    def count(table: pa.Table) -> pa.Table:
        got = [x for batch in table.to_batches() for _, _, x in _each(batch)]
        words, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        counts = np.zeros(len(words), np.int64)
        start = 0
        for g in got:  # no sum of floats: counts stay exact
            np.add.at(counts, at[start : start + len(g[0])], g[1])
            start += len(g[0])
        return pa.Table.from_batches([_rows([(table["shard"][0].as_py(), -1, (words, small(counts)))])])

    return blocks.mapInArrow(send, _TABLE).groupBy("shard").applyInArrow(count, _TABLE)


def _unigrams(words: DataFrame) -> Unigrams:
    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, tokens = np.zeros(K + 2, np.int64), 0
        for batch in batches:
            for _, _, (_, counts) in _each(batch):
                n += np.bincount(np.minimum(counts, K + 2).astype(np.int64), minlength=K + 3)[: K + 2]
                n[0] += len(counts)
                tokens += int(counts.sum(dtype=np.int64))
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(K + 3), pa.int32()), "n": pa.array([*n.tolist(), tokens], pa.int64())})

    sums = {r["k"]: r["n"] for r in words.mapInArrow(stats, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    tokens = sums.get(K + 2, 0)
    counts = np.array([0, *(sums.get(r, 0) for r in range(1, K + 2))])
    d = discounts(counts)
    left = sum((1 - d[r]) * r * counts[r] for r in range(1, K + 1)) / max(1, tokens)
    # where every word was seen often, the unknown word gets one more token's share
    return Unigrams(tokens, sums.get(0, 0), d, float(left) if left else 1 / (tokens + 1))


def _frequent(words: DataFrame, share: float) -> dict[int, int]:
    """The words that count more than ``share`` tokens, and into how many parts their bigrams are split."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, (hashes, counts) in _each(batch):
                many = counts > share
                yield pa.RecordBatch.from_pydict({"word": pa.array(hashes[many].view(np.int64)), "n": pa.array(counts[many].astype(np.int64))})

    return {r["word"] % (1 << 64): int(np.ceil(r["n"] / share)) for r in words.mapInArrow(pick, "word long, n long").collect()}


def _bigram_tables(blocks: DataFrame, owners: Owners) -> DataFrame:
    """For each partition its ``kind`` table and the counts that each block asked for; ``counts``: how many bigrams were seen 0 to K+1 times."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                pairs, of = b.pairs()
                n = np.bincount(of[~np.repeat(b.held, b.sizes)], minlength=len(pairs))
                del of
                h, w = np.divmod(pairs, len(b.words))
                for shard, mine in owners(b.words, h, w):
                    hs, runs = np.unique(h[mine], return_counts=True)
                    ws, w_at = np.unique(w[mine], return_inverse=True)
                    yield _rows([(shard, b.id, (b.words[hs], small(runs), b.words[ws], small(w_at), small(n[mine])))])
                del b, pairs, n, h, w, mine
                release()

    schema = pa.schema([*_SCHEMA, ("counts", pa.list_(pa.int64())), ("kind", pa.string())])

    def count(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        got = sorted(((block, x) for batch in table.to_batches() for _, block, x in _each(batch)), key=lambda g: g[0])
        del table
        contexts, h_of = np.unique(np.concatenate([x[0] for _, x in got]), return_inverse=True)
        words, w_of = np.unique(np.concatenate([x[2] for _, x in got]), return_inverse=True)
        sizes = [len(x[3]) for _, x in got]
        keys, n = np.empty(sum(sizes), np.int64), np.empty(sum(sizes), np.uint32)
        asked, i, j, at = [], 0, 0, 0
        for (block, x), size in zip(got, sizes, strict=True):
            hs, ws = h_of[i : i + len(x[0])], w_of[j : j + len(x[2])]
            i, j = i + len(x[0]), j + len(x[2])
            keys[at : at + size] = np.repeat(hs, x[1]) * len(words) + ws[x[3]]
            n[at : at + size] = x[4]
            at += size
            asked.append((block, _steps(hs), x[1], _steps(ws)))
        del got, h_of, w_of
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        c = np.add.reduceat(n[order].astype(np.int64), first)
        of = np.empty(len(order), np.uint32)
        of[order] = np.repeat(np.arange(len(first), dtype=np.uint32), np.diff(np.append(first, len(order))))
        del order, n
        seen = np.flatnonzero(c)
        h, w = np.divmod(keys[first[seen]], len(words))
        del keys
        n_r = np.bincount(np.minimum(c[seen], K + 2), minlength=K + 3)[: K + 2]
        rows, at = [(shard, -1, (contexts, words, small(np.bincount(h, minlength=len(contexts))), small(w), small(c[seen])))], 0
        c = small(c)
        for (block, hs, runs, ws), size in zip(asked, sizes, strict=True):
            mine = c[of[at : at + size]]
            runs = runs.astype(np.int64)
            missed = np.add.reduceat((mine == 0).astype(np.int64), np.cumsum(runs) - runs) > 0  # contexts that back off somewhere in the block
            rows.append((shard, block, (hs, np.packbits(missed), ws, mine)))
            at += size
        out = _rows(rows)
        del rows, c, of, asked
        release()
        others = out.num_rows - 1
        counts = pa.array([n_r.tolist()] + [None] * others, schema.field("counts").type)
        kinds = pa.array(["table"] + ["asked"] * others)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([*out.columns, counts, kinds], schema=schema)])

    return blocks.mapInArrow(send, _TABLE).groupBy("shard").applyInArrow(count, f"{_TABLE}, counts array<bigint>, kind string")


def _asked_words(tables: DataFrame, words: DataFrame, shards: int) -> DataFrame:
    """For each partition of bigrams (``block``) the training counts of its words, by the ``shard`` of words that has them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, _, table in _each(batch):
                yield _rows([(s, shard, table[1][mine]) for s, mine in _by_shard(table[1], shards)])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        hashes, counts = next((x for batch in known.to_batches() for _, _, x in _each(batch)), (np.zeros(0, np.uint64), np.zeros(0, np.uint8)))
        out = []
        for batch in asked.to_batches():
            for shard, of, mine in _each(batch):
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
                    out.append((shard, of, small(np.where(hashes[at] == mine, counts[at], 0))))
                else:
                    out.append((shard, of, np.zeros(len(mine), np.uint8)))
        return pa.Table.from_batches([_rows(out)])

    asked = tables.filter("kind = 'table'").select("shard", "block", "data").mapInArrow(ask, _TABLE)
    return asked.groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(answer, _TABLE)


def alpha(c_h, followers, followed, d) -> np.ndarray:
    """log10 of the backoff weights, from c(h), how many followers were seen 1 to K times, and their unigram mass."""
    r = np.arange(1, K + 1)
    bare = followers.sum(axis=1) == 0
    left = np.where(bare, 1 / (c_h + 1.0), (followers * r * (1 - d[1 : K + 1])).sum(axis=1) / np.maximum(c_h, 1))
    return np.log10(left / (1 - followed))


def _weights(tables: DataFrame, counted: DataFrame, unigrams: Unigrams, d: np.ndarray, owners: Owners, shards: int) -> DataFrame:
    """For each partition its contexts' ``kind`` weights, and what each block needs; ``split``: the sums of parts of split contexts."""
    schema = pa.schema([*_SCHEMA, ("split", pa.binary()), ("kind", pa.string())])

    def weigh(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        shard = table["shard"][0].as_py()
        got = {block: data for block, data in zip(table["block"].to_pylist(), table["data"], strict=True)}
        contexts, words, runs, w, c = _unpack(got.pop(-1).as_py())
        c_w = np.zeros(len(words), np.int64)
        by_shard = {s: x for batch in answers.to_batches() for s, _, x in _each(batch)}
        for s, mine in _by_shard(words, shards):
            c_w[mine] = by_shard[s]
        h = np.repeat(np.arange(len(contexts)), runs)
        c = c.astype(np.int64)
        c_h = np.zeros(len(contexts), np.int64)
        np.add.at(c_h, h, c)
        followers = np.bincount(h * (K + 2) + np.minimum(c, K + 1), minlength=len(contexts) * (K + 2)).reshape(-1, K + 2)[:, 1 : K + 1]
        followed = np.bincount(h, unigrams.p(c_w)[w], len(contexts))
        weight = np.where(c_h > 0, alpha(c_h, followers, followed, d), 0.0)
        parted = owners.split(contexts) > 1
        bare = followers.sum(axis=1) == 0
        rows = [(shard, -1, (contexts, c_h, bare, weight))]
        c_w, c_h = small(c_w), small(c_h)
        for block, data in got.items():
            hs, missed, ws, seen = _unpack(data.as_py())
            hs, ws = np.cumsum(hs, dtype=np.int64), np.cumsum(ws, dtype=np.int64)
            rows.append((shard, block, (c_h[hs], np.packbits(bare[hs]), missed, weight[hs][np.unpackbits(missed, count=len(hs)) > 0], c_w[ws], seen)))
        out = _rows(rows)
        del got, by_shard, h, c, w
        release()
        split = _pack((contexts[parted], c_h[parted].astype(np.int64), followers[parted], followed[parted]))
        others = len(rows) - 1
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([*out.columns, pa.array([split] + [None] * others, pa.binary()), pa.array(["weights"] + ["reply"] * others)], schema=schema)])

    mine = tables.select("shard", "block", "data").groupBy("shard")
    return mine.cogroup(counted.select(F.col("block").cast("int").alias("of"), "shard", "block", "data").groupBy("of")).applyInArrow(weigh, f"{_TABLE}, split binary, kind string")


def _split_weights(weights: DataFrame, d: np.ndarray) -> dict[int, tuple[int, bool, float]]:
    """c(h), whether it is bare, and the weight of each split context: a few numbers for at most two contexts a partition."""

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["split"].to_pylist():
                contexts, c_h, followers, followed = _unpack(data)
                sums = np.concatenate((c_h[:, None], followers, followed[:, None]), axis=1) if len(contexts) else np.zeros((0, K + 2))
                yield pa.RecordBatch.from_pydict({"context": pa.array(contexts.view(np.int64)), "sums": pa.array(sums.tolist(), pa.list_(pa.float64()))})

    rows = weights.filter("kind = 'weights'").select("split").mapInArrow(parted, "context long, sums array<double>")
    sums = rows.groupBy("context").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(K + 2))).collect()
    out = {}
    for row in sums:
        c_h, followers, followed = row["s0"], np.array([[row[f"s{r}"] for r in range(1, K + 1)]]), row[f"s{K + 1}"]
        out[row["context"] % (1 << 64)] = (int(c_h), not followers.any(), float(alpha(np.array([c_h]), followers, np.array([followed]), d)[0]))
    return out


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    The model learns from rows that are not ``held_out``: by default those whose
    crc32(doc_id as text) mod ``folds`` is not ``held``. To score one table by
    another's model, give both in one table and mark the first as held out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held_out = F.coalesce(fold("doc_id", folds) == held if held_out is None else held_out, F.lit(False))
    shards = parts(text_bytes(docs), SHARD_BYTES, 8)
    blocks = Stored(_blocks(docs, held_out), "token-blocks")
    words = Stored(_word_tables(blocks.read(), shards), "word-tables")
    unigrams = _unigrams(words.read())
    share = max(1.0, 0.5 * unigrams.tokens / shards)
    frequent = _frequent(words.read(), share)
    frequent[START] = int(np.ceil(max(1, docs.filter(~held_out).count()) / share))
    owners = Owners(shards, {h: pieces for h, pieces in frequent.items() if pieces > 1})
    tables = Stored(_bigram_tables(blocks.read(), owners), "bigram-tables", apart="kind")
    n_r = tables.read().filter("kind = 'table'").agg(*(F.coalesce(F.sum(F.col("counts")[r]), F.lit(0)) for r in range(K + 2))).first()
    d = discounts(np.array(n_r))
    counted = Stored(_asked_words(tables.read(), words.read(), shards), "word-counts")
    weights = Stored(_weights(tables.read(), counted.read(), unigrams, d, owners, shards), "backoff-weights", apart="kind")
    # what was asked is answered
    tables.drop("kind=asked")
    counted.drop()
    split = _split_weights(weights.read(), d)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def evaluate(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        b = Block(rows.to_pylist()[0])
        by_shard = {s: data for s, data in zip(replies["shard"].to_pylist(), replies["data"], strict=True)}
        pairs, of = b.pairs()
        h, w = np.divmod(pairs, len(b.words))
        del pairs
        count, value = np.zeros(len(b.words), np.int64), np.empty(len(h))
        for shard, mine in owners(b.words, h, w):
            c_h, bare, missed, weights_, c_w, c = _unpack(by_shard.pop(shard).as_py())
            hs, at = np.unique(h[mine], return_inverse=True)
            ws, w_at = np.unique(w[mine], return_inverse=True)
            c_h, bare, weight = c_h.astype(np.int64), np.unpackbits(bare, count=len(hs)) > 0, np.zeros(len(hs))
            weight[np.unpackbits(missed, count=len(hs)) > 0] = weights_
            for k in np.flatnonzero(owners.split(b.words[hs]) > 1).tolist():
                c_h[k], bare[k], weight[k] = split.get(int(b.words[hs[k]]), (0, True, 0.0))
            count[ws] = c_w
            c = c.astype(np.int64)
            seen = np.log10(np.maximum(d[np.minimum(c, K + 1)] * c, 1e-300)) - np.log10(np.maximum(c_h + bare, 1))[at]
            unseen = np.where(c_h > 0, weight, 0.0)[at] + np.log10(unigrams.p(c_w))[w_at]
            value[mine] = np.where(c > 0, seen, unseen)
        del h, w, by_shard
        release()
        doc, n = b.doc(), len(b.sizes)
        c = count[b.token]
        columns = (b.doc_ids, b.held, b.sizes, np.bincount(doc, c > 0, n).astype(np.int64), np.full(n, unigrams.tokens), np.bincount(doc, unigrams.base(c), n), np.bincount(doc, value[of], n))
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

    replies = weights.read().filter("kind = 'reply'").select("shard", "block", "data")
    return blocks.read().groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
