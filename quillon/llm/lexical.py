"""Ranked lexical search by Fagin's threshold algorithm.

The documents become a forward index in the shared folder: a row a document,
with its length and the counts of those of its terms that any item asks for.
Counts over the corpus (documents, terms, documents of a term) are aggregates of
it. A task then reads documents until they hold ``POSTINGS`` terms, sorts them
into one list a term by impact, and runs the threshold algorithm for each item:
it reads the item's lists in turn, from the highest impact on; every document met
is looked up in the forward index for its whole score; and once the impacts
that the lists have come down to add up to strictly less than the k-th score, no
document not yet met can enter (one of equal score could, by its id, so equality
goes on). The best found so far are taken along to the task's next documents.
Each task gives the best k for each item, and the least of them fall away in two
rounds, so neither a frequent term nor a frequent document goes through one task.

Items are taken in blocks of ``ITEM_BYTES`` of text, and only what a block's items
ask for goes to the tasks with the function. Scores are integers, as in
``weights`` and ``impacts``.

Null and empty texts have no terms: such items have no rows, such documents do
not count. Items that agree in id and text are one; items of one id with other
texts are ranked apart. Repeated documents are documents of their own; of equal
scores the least doc_id goes first, null ids last. Terms are whole texts' terms,
however long; an empty table on either side gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import Stored, bounded_batches

#: Postings that a task sorts at a time; bytes of the items of a block.
POSTINGS, ITEM_BYTES = 1_000_000, 4 << 20
#: Depths that a first round reads of each list; later rounds read more.
DEPTHS = 16
#: Groups of tasks whose best are put together first.
SALTS = 64

#: In UTF-8 a term's bytes are ASCII letters and digits and all bytes of other characters; the rest becomes spaces.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included."""
    return text.translate(_FOLD).split() if text else []


class Item(NamedTuple):
    """An item of a block: its id, the numbers of its terms, and how often it holds each."""

    item_id: int | None
    terms: np.ndarray
    repeats: np.ndarray


def blocks(items: DataFrame) -> Iterator[tuple[list[Item], dict[bytes, int]]]:
    """Items of up to ``ITEM_BYTES`` of text at a time, and the numbers of their terms."""
    block, numbers, size = [], {}, 0
    rows = items.select("item_id", F.encode("text", "UTF-8").alias("text")).filter("octet_length(text) > 0").distinct()
    for row in Stored(rows, "items").read().toLocalIterator():
        counts = Counter(terms_of(bytes(row.text)))
        if not counts:
            continue
        if block and size + len(row.text) > ITEM_BYTES:
            yield block, numbers
            block, numbers, size = [], {}, 0
        own = np.array([numbers.setdefault(t, len(numbers)) for t in counts], "int32")
        block.append(Item(row.item_id, own, np.array(list(counts.values()), "int64")))
        size += len(row.text)
    if block:
        yield block, numbers


def forward_index(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """A row for each document with terms: doc_id, n, and the numbers and counts of its terms among ``numbers``."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.get
        for batch in batches:
            ids, lengths, ends, terms, counts = [], [], [0], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms_of(text)
                if not found:
                    continue
                known = Counter(map(number, found))
                known.pop(None, None)
                ids.append(doc_id)
                lengths.append(len(found))
                terms.extend(known.keys())
                counts.extend(known.values())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, counts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"]
            )

    texts = docs.select("doc_id", F.encode("text", "UTF-8").alias("text")).filter("octet_length(text) > 0")
    return texts.mapInArrow(index, "doc_id long, n long, terms array<int>, counts array<int>")


def weights(n_docs: int, holding: np.ndarray) -> np.ndarray:
    """A term's weight, by the number of documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in holding], "int64")


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one term adds to a document's score, in 64-bit integers."""
    m = 100 - 75 + (75 * n * n_docs) // n_terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Shard:
    """Documents in memory: a forward index, and lists by term, each from its highest impact on."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids, self.ends, self.terms, self.impact = ids, ends, terms, impact
        docs = np.repeat(np.arange(len(ids), dtype="int32"), np.diff(ends))
        order = np.lexsort((-impact, terms))
        self.listed, self.highest = docs[order], impact[order]
        self.lists = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.weight = np.zeros(n_terms, "int64")

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of documents, by random access to the forward index."""
        begin, size = self.ends[docs], self.ends[docs + 1] - self.ends[docs]
        upto = np.cumsum(size)
        at = np.arange(upto[-1]) + np.repeat(begin - upto + size, size)
        gained = np.append(0, np.cumsum(self.weight[self.terms[at]] * self.impact[at]))
        return gained[upto] - gained[upto - size]

    def search(self, item: Item, k: int, best: np.ndarray) -> tuple[np.ndarray, int]:
        """The best k of ``best`` and of these documents, and the depth that the lists were read to.

        ``best`` has a row for each result: score and id, the largest scores first,
        then the least ids.
        """
        begin, end = self.lists[item.terms], self.lists[item.terms + 1]
        self.weight[item.terms] = item.repeats
        met = np.zeros(len(self.ids), bool)
        depth, step = 0, DEPTHS
        longest = int((end - begin).max(initial=0))
        while depth < longest:
            upto = min(depth + step, longest)
            first, last = np.minimum(begin + depth, end), np.minimum(begin + upto, end)
            found = np.unique(np.concatenate([self.listed[a:b] for a, b in zip(first, last, strict=True)]))
            found = found[~met[found]]
            met[found] = True
            if len(found):
                best = best_of(np.concatenate([best, np.stack([self.scores(found), self.ids[found]], 1)]), k)
            depth, step = upto, step * 2
            at = begin + depth - 1
            left = at < end - 1  # a list that has ended adds nothing
            threshold = int((item.repeats[left] * self.highest[at[left]]).sum())
            if len(best) == k and threshold < best[-1, 0]:
                break
        self.weight[item.terms] = 0
        return best, depth


def best_of(rows: np.ndarray, k: int) -> np.ndarray:
    """The k best rows of score and id; scores of 0 are none."""
    rows = rows[rows[:, 0] > 0]
    return rows[np.lexsort((rows[:, 1], -rows[:, 0]))[:k]]


#: Stands for a null id, behind all others.
_NO_ID = np.iinfo("int64").max


def _searched(index: DataFrame, items: list[Item], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Each task's best k documents for each item."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        held, size = [], 0

        def made() -> Shard:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, n = (table[c].combine_chunks() for c in ("doc_id", "n"))
            ids = ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            lists = [table[c].combine_chunks() for c in ("terms", "counts")]
            sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False)
            terms, counts = (x.flatten().to_numpy(zero_copy_only=False).astype("int64") for x in lists)
            impact = impacts(weight[terms], counts, np.repeat(n.to_numpy(zero_copy_only=False), sizes), n_docs, n_terms)
            return Shard(ids, np.append(0, np.cumsum(sizes)), terms, impact, len(weight))

        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= POSTINGS:
                yield made()
                held, size = [], 0
        if held:
            yield made()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros((0, 2), "int64") for _ in items]
        for shard in shards(batches):
            for i, item in enumerate(items):
                best[i], _ = shard.search(item, k, best[i])
        number = np.repeat(np.arange(len(items), dtype="int32"), [len(b) for b in best])
        rows = np.concatenate(best)
        ids = pa.array(rows[:, 1], mask=rows[:, 1] == _NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(number), ids, pa.array(rows[:, 0])], ["item", "doc_id", "score"])

    return index.mapInArrow(search, "item int, doc_id long, score long")


def _kept(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score.

    A document's score sums, over the item's terms with repeats, the term's weight
    times its saturated count; a document of score 0 is no result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block, numbers in blocks(items):
        stored = Stored(forward_index(docs, numbers), "forward-index")
        index = stored.read()
        n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            return out
        holding = np.zeros(len(numbers), "int64")
        for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a block's terms
            holding[row["term"]] = row["count"]
        found = _searched(index, block, weights(n_docs, holding), n_docs, n_terms, k)
        salted = found.withColumn("salt", F.spark_partition_id() % F.lit(SALTS))
        best = _kept(_kept(salted, ["item", "salt"], k).drop("rank"), ["item"], k)
        ids = spark.createDataFrame([(i, x.item_id) for i, x in enumerate(block)], "item int, item_id long")
        best = best.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
        written = Stored(best, "ranked")
        stored.drop()
        out = out.unionByName(written.read())
    return out
