"""An inverted index with block maxima, and BM25 over stems that reads only the blocks it must.

Chunks are dealt into windows of about ``WINDOW`` by a hash of their ids. A block
holds the postings of one stem in one window, and the largest of what the stem adds
to any chunk's score there. A search sums up these maxima by window, without
reading a posting; scores the windows of the highest sums; and then only those
further windows whose sum reaches the score of the last chunk that would be kept.
All postings of a chunk lie in its window, so a window's scores are whole.

The index is four tables below a folder: blocks by bucket of stems (a search reads
its stems' buckets), stems with their numbers of chunks, chunks with their windows,
and one row of statistics.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.stems import stem, stemmed
from quillon.operators.retrieval import K1, B
from quillon.plans import views as V
from quillon.plans.cases import cases, cases_sql
from quillon.registry import query
from quillon.sources.tables import new_folder, stored

#: Chunks of a window, folders of blocks, and windows that are scored first.
WINDOW, BUCKETS, FIRST = 1024, 64, 8
#: Windows of a bucket that one task turns into blocks, and texts that a worker counts before it passes them on.
RANGE, ROWS = 64, 1000


BLOCKS = "term string, window int, highest double, size long, postings array<struct<chunk_id:long,gain:double>>, bucket int"


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits; other characters, underscores too, separate them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _counted(chunks: DataFrame) -> DataFrame:
    """(chunk_id, len, counts) of ``chunks`` (chunk_id, text): the words of each, and its stems with how often they occur.

    A text is read once, and its words are counted where it lies, so that no word is shuffled by itself.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sizes, ends, names, times = [], [0], [], []
                for text in part["words"].to_pylist():
                    words = (text or "").split()
                    tf = Counter(map(stemmed, words))
                    names += tf.keys()
                    times += tf.values()
                    sizes.append(len(words))
                    ends.append(len(names))
                pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(times, pa.int64())], ["term", "tf"])
                counts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
                yield pa.RecordBatch.from_pydict({"chunk_id": part["chunk_id"], "len": pa.array(sizes, pa.int64()), "counts": counts})

    # Spark says what a word is, here as in ``terms``
    words = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ").alias("words")
    return chunks.select(F.col("chunk_id").cast("long"), words).mapInArrow(count, "chunk_id long, len long, counts array<struct<term:string,tf:long>>")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from postings, those of one stem and window behind each other; the last block of a batch may go on in the next one."""
    open_: list[pa.RecordBatch] = []

    def done(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        gain, ends = table["gain"].combine_chunks(), np.append(starts[1:], len(table))
        pairs = pa.StructArray.from_arrays([table["chunk_id"].combine_chunks(), gain], ["chunk_id", "gain"])
        first = {c: table[c].take(pa.array(starts)).combine_chunks() for c in ("term", "window", "bucket")}
        postings = pa.ListArray.from_arrays(pa.array(np.append(starts, len(table)), pa.int32()), pairs)
        return pa.RecordBatch.from_pydict({
            "term": first["term"], "window": first["window"], "highest": np.maximum.reduceat(gain.to_numpy(), starts), "size": pa.array(ends - starts, pa.int64()),
            "postings": postings, "bucket": first["bucket"],
        })

    for batch in batches:
        if not batch.num_rows:
            continue
        if open_ and (batch["term"][-1], batch["window"][-1]) == (open_[0]["term"][0], open_[0]["window"][0]):
            open_.append(batch)
            continue
        table = pa.Table.from_batches([*open_, batch]).combine_chunks()
        term, window = table["term"], table["window"].to_numpy()
        other = pc.not_equal(term[1:], term[:-1]).to_numpy() | (window[1:] != window[:-1])
        starts = np.append(0, np.flatnonzero(other) + 1)
        if len(starts) > 1:
            yield done(table.slice(0, starts[-1]), starts[:-1])
        open_ = table.slice(starts[-1]).to_batches()
    if open_:
        yield done(pa.Table.from_batches(open_).combine_chunks(), np.zeros(1, np.int64))


def write_inverted(chunks: DataFrame, folder: str) -> None:
    """Index ``chunks`` (chunk_id long, text) below a folder. Chunks without words count, and are found by no search."""
    counted = stored(_counted(chunks))
    stats = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))
    stats.write.mode("overwrite").parquet(f"{folder}/stats")
    spark = chunks.sparkSession
    n, total = spark.read.parquet(f"{folder}/stats").first()
    windows = max(1, -(-n // WINDOW))
    place = F.pmod(F.xxhash64("chunk_id"), F.lit(windows)).cast("int")
    counted.select("chunk_id", "len", place.alias("window")).write.mode("overwrite").parquet(f"{folder}/chunks")
    postings = counted.select("chunk_id", "len", F.inline("counts"))
    if not counted.groupBy("chunk_id", "len").count().filter("count > 1").isEmpty():  # texts of one chunk add up
        postings = postings.groupBy("chunk_id", "len", "term").agg(F.sum("tf").alias("tf"))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") * F.lit(n) / F.lit(max(total, 1))))
    placed = postings.select(_bucket(F.col("term")).alias("bucket"), "term", place.alias("window"), "chunk_id", gain.alias("gain"))
    # the one exchange of postings: a task has whole blocks, and writes files of few buckets
    dealt = placed.repartition("bucket", F.floor(F.col("window") / RANGE))
    # one number is sorted far faster than names; two blocks that share it come in parts, which search sums up as well
    together = F.xxhash64("term").bitwiseAND(F.lit(-1 << 24)).bitwiseOR(F.col("window").cast("long"))
    blocks = dealt.sortWithinPartitions(together).mapInArrow(_blocks, BLOCKS)
    blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/blocks")
    sums = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").groupBy("bucket", "term").agg(F.sum("size").alias("df"))
    sums.write.mode("overwrite").parquet(f"{folder}/stems")


@dataclass(frozen=True)
class Inverted:
    """An index below a folder."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(BLOCKS) if name == "blocks" else self.spark.read
        return reader.parquet(f"{self.folder}/{name}")

    def wanted(self, text: str) -> DataFrame:
        """(bucket, term, weight) of the stems of a query that any chunk holds; a repeated stem counts once."""
        n = self.table("stats").first()["n"]
        words = self.spark.range(1).select(terms(F.lit(text))).first()[0]
        names = sorted(set(map(stemmed, words)))  # of one query
        df = F.col("df")
        weight = F.log((F.lit(n) - df + 0.5) / (df + 0.5) + 1)
        known = self.table("stems").filter(F.col("term").isin(*names)) if names else self.table("stems").limit(0)
        return known.select("bucket", "term", weight.alias("weight"))

    def search(self, text: str, top: int) -> DataFrame:
        """(chunk_id, score) of the ``top`` best chunks for any of a query's words, in millionths; equal scores by id."""
        return _found(self.scored(text, top)[0], top)

    def scored(self, text: str, top: int) -> tuple[DataFrame, int]:
        """The scores of the windows that may hold one of the ``top`` best chunks, and how many windows were passed over."""
        wanted = [tuple(r) for r in self.wanted(text).collect()]  # a row a word of the query
        if not wanted:
            empty = self.spark.createDataFrame([], "chunk_id long, score long")
            return empty, 0
        buckets, names = sorted({b for b, *_ in wanted}), [t for _, t, _ in wanted]
        blocks = self.table("blocks").filter(F.col("bucket").isin(*buckets) & F.col("term").isin(*names))
        weight = F.element_at(F.create_map(*[x for _, t, w in wanted for x in (F.lit(t), F.lit(w))]), F.col("term"))
        bounds = blocks.groupBy("window").agg(F.floor(F.sum(weight * F.col("highest")) * 1000000 + 1.5).cast("long").alias("most"))

        def scores(windows: DataFrame) -> DataFrame:
            inside = blocks.join(windows, "window").select((weight).alias("weight"), F.inline("postings"))
            total = F.sum(F.col("weight") * F.col("gain"))
            return inside.groupBy("chunk_id").agg(F.floor(total * 1000000 + 0.5).cast("long").alias("score"))

        bounds = bounds.orderBy(F.desc("most"), "window")
        first = scores(F.broadcast(bounds.limit(FIRST).select("window")))
        best = _found(first, top).agg(F.count("*"), F.min("score")).first()
        least = best[1] if best[0] == top else 0
        reached = bounds.filter(F.col("most") >= least)
        passed = bounds.filter(F.col("most") < least).count()
        return scores(reached.select("window")), passed


def _found(scores: DataFrame, top: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "chunk_id").limit(top)


_ASKED = "tokens_LICENSES, token: Apache?"
_FORMS = {"token": ("token", "tokens", "tokened", "tokening"), "licens": ("license", "licenses", "licensed", "licensing"), "apach": ("apache", "apaches", "apached", "apaching")}
_FORMS_SQL = " ".join(f"WHEN w IN ({', '.join(f"'{w}'" for w in words)}) THEN '{t}'" for t, words in _FORMS.items())


@query("ret_inverted", "", f"""WITH c AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}]+)', 1) AS ws FROM documents),
s AS (SELECT count(*) AS n, sum(len(ws)) AS total FROM c),
w AS (SELECT chunk_id, size, CASE {_FORMS_SQL} END AS term FROM (SELECT chunk_id, len(ws) AS size, unnest(ws) AS w FROM c)),
p AS (SELECT chunk_id, size, term, count(*) AS tf FROM w WHERE term IS NOT NULL GROUP BY chunk_id, size, term),
d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
r AS (SELECT chunk_id, floor(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size * n / total)))) * 1000000 + 0.5)::BIGINT AS score FROM p JOIN d USING (term), s GROUP BY chunk_id)
SELECT chunk_id, score FROM r ORDER BY score DESC, chunk_id LIMIT 40""")
def ret_inverted(spark, sf_dir):
    """BM25 over stems, from an index of the whole table."""
    folder = new_folder(spark, "inverted")
    write_inverted(V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), folder)
    return Inverted(spark, folder).search(_ASKED, 40)


# Words and stems that the algorithm's author gives as examples of its steps.
_PAIRS = [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("caress", "caress"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"),
    ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("tanned", "tan"),
    ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"),
    ("conditional", "condit"), ("rational", "ration"), ("valenci", "valenc"), ("hesitanci", "hesit"), ("digitizer", "digit"), ("radicalli", "radic"), ("differentli", "differ"),
    ("vileli", "vile"), ("analogousli", "analog"), ("vietnamization", "vietnam"), ("predication", "predic"), ("operator", "oper"), ("feudalism", "feudal"), ("decisiveness", "decis"),
    ("hopefulness", "hope"), ("callousness", "callous"), ("formaliti", "formal"), ("sensitiviti", "sensit"), ("sensibiliti", "sensibl"), ("triplicate", "triplic"), ("formative", "form"),
    ("formalize", "formal"), ("electriciti", "electr"), ("electrical", "electr"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"),
    ("inference", "infer"), ("airliner", "airlin"), ("gyroscopic", "gyroscop"), ("adjustable", "adjust"), ("defensible", "defens"), ("irritant", "irrit"), ("replacement", "replac"),
    ("adjustment", "adjust"), ("dependent", "depend"), ("adoption", "adopt"), ("homologou", "homolog"), ("communism", "commun"), ("activate", "activ"), ("angulariti", "angular"),
    ("homologous", "homolog"), ("effective", "effect"), ("bowdlerize", "bowdler"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
    ("is", "is"), ("café", "café"), ("v2s", "v2s"), ("yes", "ye"), ("saying", "sai"), ("generalizations", "gener"), ("oscillators", "oscil"),
]


@query("fn_stem", "", cases_sql(len(_PAIRS), "VARCHAR word, VARCHAR stem", [(k, *pair) for k, pair in enumerate(_PAIRS)]))
def fn_stem(spark, sf_dir):
    return cases(spark, sf_dir, [(w,) for w, _ in _PAIRS], "word string").select("id", "word", stem(F.col("word")).alias("stem"))
