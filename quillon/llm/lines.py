"""Line dedup: drop the lines that many documents share.

A sharded minimal perfect hash over all distinct line hashes indexes compact
fingerprint and count arrays (``line_index``). Documents then probe the arrays:
each bucket of documents sends every distinct line hash once to the shard that
owns it, and gets back those that are too frequent (``frequent_lines``). Lines
themselves are never joined, and no text is shuffled but once, to its bucket.

A line is one row for each batch and bucket of documents that hold it, one row
for each bucket once those are added up, and a single row where the index is
built. A shard's questions stream past its arrays, so a line that a third of all
documents hold fills no task's memory. Lines are told apart by 128 bits: the
hash is built over 64 of them, the fingerprints hold the others, and lines that
agree in the first 64 are kept beside it.

Edge cases: a null or empty text is one empty line; lines whose key is shorter
than ``min_chars`` are never dropped; a key that repeats within a document
counts once for it; repeated rows (equal doc_id) count as documents of their own
and lose the same lines; null doc_ids are kept, and spread over the buckets by
their texts; texts and lines of any length are read whole; an empty table stays
empty; columns named n_lines or n_dropped are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import Stored, bounded_batches, fresh, parts, text_bytes
from quillon.llm.mphf import MinimalPerfectHash

_SPACE = b" \t\n\v\f\r"
#: Text bytes whose line hashes one shard of the index holds.
SHARD_BYTES = 32 << 20
#: Text bytes of one bucket of documents.
BUCKET_BYTES = 16 << 20


def line_keys(text: str) -> list[bytes]:
    """The key of every line: stripped of ASCII space, A-Z lower-cased."""
    return [line.strip(_SPACE) for line in text.encode().lower().split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _entries(docs: DataFrame, shards: int, buckets: int, min_chars: int) -> DataFrame:
    """(shard, hi, lo, bucket, n): a line hash, and in how many documents of a bucket a batch has it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, int] = {}
            for text, bucket in zip(batch["text"].to_pylist(), batch["bucket"].to_pylist(), strict=True):
                tail = bucket.to_bytes(4, "little")
                for key in set(line_keys(text or "")):
                    if _long_enough(key, min_chars):
                        entry = _hash(key) + tail
                        found[entry] = found.get(entry, 0) + 1
            raw = np.frombuffer(b"".join(found), dtype=np.dtype([("hi", ">u8"), ("lo", ">u8"), ("bucket", "<i4")]))
            hi = raw["hi"].astype(np.uint64)
            yield pa.RecordBatch.from_pydict({"shard": (hi % np.uint64(shards)).astype(np.int32), "hi": hi.view(np.int64), "lo": raw["lo"].astype(np.uint64).view(np.int64), "bucket": raw["bucket"].copy(), "n": np.fromiter(found.values(), np.int64, len(found))})

    rows = docs.select("text", _bucket(docs, buckets)).mapInArrow(count, "shard int, hi long, lo long, bucket int, n long")
    return rows.groupBy("shard", "hi", "lo", "bucket").agg(F.sum("n").alias("n"))


def _bucket(docs: DataFrame, buckets: int):
    """By id and text, so that rows that share an id, or have none, lie apart."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")), F.lit(buckets)).cast("int").alias("bucket")


_ARRAYS = ("sizes", "bits", "fingerprints", "counts", "more")
_INDEX = "shard int, " + ", ".join(f"{k} binary" for k in _ARRAYS)
#: Lines that agree in the first 64 bits with another one.
_MORE = np.dtype([("hi", "<i8"), ("lo", "<i8"), ("n", "<i8")])


def line_index(entries: DataFrame) -> DataFrame:
    """One row for each shard: the minimal perfect hash, and by its index the other 64 hash bits and the number of documents."""

    def build(table: pa.Table) -> pa.Table:
        keys, lows, counts = table["hi"].to_numpy().view(np.uint64), table["lo"].to_numpy(), table["n"].to_numpy()
        order = np.lexsort((lows, keys))
        keys, lows, counts = keys[order], lows[order], counts[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        more = np.empty(int((~first).sum()), _MORE)
        more["hi"], more["lo"], more["n"] = keys[~first].view(np.int64), lows[~first], counts[~first]
        keys, lows, counts = keys[first], lows[first], counts[first]
        mph = MinimalPerfectHash.build(keys)
        at = mph.lookup(keys)
        fingerprints, by_index = np.empty_like(lows), np.empty(len(keys), np.uint32)
        fingerprints[at], by_index[at] = lows, np.minimum(counts, 2**32 - 1)
        arrays = (mph.sizes, mph.bits, fingerprints, by_index, more)
        row = {"shard": [table["shard"][0].as_py()]} | {k: [v.tobytes()] for k, v in zip(_ARRAYS, arrays, strict=True)}
        return pa.table(row, schema=pa.schema([("shard", pa.int32()), *((k, pa.binary()) for k in _ARRAYS)]))

    lines = entries.groupBy("shard", "hi", "lo").agg(F.sum("n").alias("n"))
    return lines.groupBy("shard").applyInArrow(build, _INDEX)


class LineIndex:
    """A shard of the index, ready to be probed."""

    def __init__(self, row: dict):
        self.mph = MinimalPerfectHash(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["bits"], np.uint8))
        self.fingerprints, self.counts = np.frombuffer(row["fingerprints"], np.int64), np.frombuffer(row["counts"], np.uint32)
        self.more = {(r["hi"], r["lo"]): r["n"] for r in np.frombuffer(row["more"], _MORE)}

    def documents(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """How many documents hold each line; 0 for lines that aren't known."""
        at = self.mph.lookup(hi.view(np.uint64))
        found = np.where((at >= 0) & (self.fingerprints[at] == lo), self.counts[at], 0).astype(np.int64)
        if self.more:
            for k in np.flatnonzero(found == 0).tolist():
                found[k] = self.more.get((hi[k], lo[k]), 0)
        return found


def frequent_lines(entries: DataFrame, index: DataFrame, min_docs: int) -> DataFrame:
    """(bucket, hi, lo): the line hashes of each bucket that at least ``min_docs`` documents hold."""
    out = pa.schema([("bucket", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, arrays = None, None
        for batch in batches:
            owners = batch["shard"].to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(owners)) + 1, [len(owners)]))
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if owners[i] != shard:  # a shard's first row is its index
                    shard, arrays = owners[i], LineIndex(batch.slice(i, 1).to_pylist()[0])
                    i += 1
                asked = batch.slice(i, j - i)
                hit = arrays.documents(asked["hi"].to_numpy(), asked["lo"].to_numpy()) >= min_docs
                yield asked.select(["bucket", "hi", "lo"]).cast(out).filter(pa.array(hit))

    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    asked = entries.select("shard", F.lit(1).alias("kind"), F.coalesce("bucket", F.lit(0)).alias("bucket"), F.coalesce("hi", F.lit(0)).alias("hi"), F.coalesce("lo", F.lit(0)).alias("lo"), *none("binary", *_ARRAYS))
    first = index.select("shard", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), *_ARRAYS)
    return first.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(probe, "bucket int, hi long, lo long")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with the frequent lines taken out of ``text``, and ``n_lines`` and ``n_dropped`` besides.

    ``docs`` has doc_id and text; its other columns are kept as they are.
    """
    docs = docs.drop("n_lines", "n_dropped")
    bounded_batches(docs.sparkSession)
    size = text_bytes(docs)
    shards, buckets = parts(size, SHARD_BYTES, 8), parts(size, BUCKET_BYTES, 8)
    entries = Stored(_entries(docs, shards, buckets, min_chars), "line-entries")
    index = Stored(line_index(entries.read()), "line-index")
    frequent = frequent_lines(entries.read(), index.read(), min_docs)
    fields = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def strip(rows: pa.Table, hits: pa.Table) -> pa.Table:
        pairs = np.stack([hits[k].to_numpy().view(np.uint64) for k in ("hi", "lo")], axis=1).astype(">u8").tobytes()
        bad = {pairs[i : i + 16] for i in range(0, len(pairs), 16)}
        kept, lines, dropped = [], [], []
        for text in rows["text"].to_pylist():
            text = text or ""
            every = text.split("\n")
            good = every
            if bad:
                good = [line for line, key in zip(every, line_keys(text), strict=True) if not (_long_enough(key, min_chars) and _hash(key) in bad)]
            kept.append(text if len(good) == len(every) else "\n".join(good))
            lines.append(len(every))
            dropped.append(len(every) - len(good))
        out = rows.select(names)
        for name, values, kind in (("text", kept, pa.string()), ("n_lines", lines, pa.int64()), ("n_dropped", dropped, pa.int64())):
            out = out.append_column(name, pa.array(values, kind))
        return out

    name = fresh(docs, "bucket")
    result = docs.withColumn(name, _bucket(docs, buckets)).groupBy(name).cogroup(frequent.groupBy("bucket")).applyInArrow(strip, schema)
    return result.select(*docs.columns, "n_lines", "n_dropped")
