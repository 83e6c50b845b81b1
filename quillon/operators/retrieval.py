"""Retrieval: Okapi BM25 (unstemmed), exact nearest neighbours, rank fusion, symbols, regex search with context, chunk windows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import exprs as E
from quillon.plans import views as V
from quillon.registry import query
from quillon.sources.tables import checkpointed

K1, B, RRF = 1.2, 0.75, 60


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]{2,})"), 1)


def bm25(chunks: DataFrame, terms: list[str], top: int) -> DataFrame:
    """(chunk_id, score) of the best ``top`` chunks for any of the terms, in millionths.

    Only the query's terms leave the scan: their counts are columns, so nothing is
    exploded and document frequencies are one aggregate row that is broadcast.
    """
    text = F.lower("text")
    counts = [F.regexp_count(text, F.lit(rf"(?<![a-z0-9_]){re.escape(t)}(?![a-z0-9_])")).alias(f"tf{i}") for i, t in enumerate(terms)]
    # one pass over the texts; what follows reads a few numbers a chunk
    counted = checkpointed(chunks.select("chunk_id", F.regexp_count(text, F.lit("[a-z0-9_]{2,}")).alias("len"), *counts))
    stats = counted.agg(F.count("*").alias("n"), F.sum("len").alias("total"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    rows = counted.filter(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))
    norm = K1 * (1 - B + B * F.col("len") * F.col("n") / F.col("total"))
    score = sum((F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + norm) for i in range(len(terms))), F.lit(0.0))
    return rows.select("chunk_id", F.floor(score * 1000000 + 0.5).cast("long").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(top)


_BM25 = """WITH w AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '([a-z0-9_]{2,})', 1) AS w FROM documents),
c AS (SELECT chunk_id, len(w) AS len, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'token')) AS b, len(list_filter(w, lambda x: x = 'license')) AS c FROM w),
s AS (SELECT count(*) AS n, sum(len) AS total, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db, count(*) FILTER (WHERE c > 0) AS dc FROM c),
scored AS (SELECT chunk_id, floor((ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len * n / total)) + ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len * n / total))
    + ln((n - dc + 0.5) / (dc + 0.5) + 1) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len * n / total))) * 1000000 + 0.5)::BIGINT AS score FROM c, s WHERE a > 0 OR b > 0 OR c > 0)
"""


def _chunks(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


@query("ret_bm25", "", _BM25 + "SELECT chunk_id, score FROM scored ORDER BY score DESC, chunk_id LIMIT 40")
def ret_bm25(spark, sf_dir):
    return bm25(_chunks(spark, sf_dir), ["the", "token", "license"], 40)


def knn(vectors: DataFrame, target: DataFrame, top: int) -> DataFrame:
    """(chunk_id, dist) of the ``top`` nearest vectors to the one target row, in millionths of squared distance."""
    rows = vectors.crossJoin(F.broadcast(target))
    dist = F.aggregate(F.zip_with("embedding", "target", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)
    return rows.select("chunk_id", F.floor(dist * 1000000 + 0.5).cast("long").alias("dist")).orderBy("dist", "chunk_id").limit(top)


_KNN = """knn AS (SELECT vec_id AS chunk_id, floor(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 3)), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) * 1000000 + 0.5)::BIGINT AS dist FROM embeddings)"""


def _knn(spark, sf_dir, top):
    v = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return knn(v, v.filter("chunk_id = 3").select(F.col("embedding").alias("target")), top)


@query("ret_knn", "", f"WITH {_KNN} SELECT chunk_id, dist FROM knn ORDER BY dist, chunk_id LIMIT 20")
def ret_knn(spark, sf_dir):
    return _knn(spark, sf_dir, 20)


def fuse(ranked: list[tuple[str, DataFrame]], top: int) -> DataFrame:
    """Reciprocal rank fusion of (chunk_id, rank) lists: (chunk_id, score in billionths, sources)."""
    rows = None
    for name, df in ranked:
        one = df.select("chunk_id", F.lit(name).alias("source"), F.floor(F.lit(1000000000) / (F.col("rank") + RRF)).cast("long").alias("s"))
        rows = one if rows is None else rows.unionByName(one)
    fused = rows.groupBy("chunk_id").agg(F.sum("s").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))
    return fused.orderBy(F.desc("score"), "chunk_id").limit(top)


def _ranked(df: DataFrame, *order) -> DataFrame:
    return df.select("chunk_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("rank"))  # over at most the limit's rows


@query("ret_rrf", "", _BM25.rstrip() + f""", {_KNN}, b AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 50), k AS (SELECT chunk_id, row_number() OVER (ORDER BY dist, chunk_id) AS rank FROM knn QUALIFY rank <= 50)
SELECT chunk_id, sum(floor(1000000000 / (rank + 60)))::BIGINT AS score, string_agg(source, '+' ORDER BY source) AS sources FROM (SELECT *, 'text' AS source FROM b UNION ALL SELECT *, 'vector' FROM k) GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 20""")
def ret_rrf(spark, sf_dir):
    text = _ranked(bm25(_chunks(spark, sf_dir), ["the", "token", "license"], 50), F.desc("score"), "chunk_id")
    return fuse([("text", text), ("vector", _ranked(_knn(spark, sf_dir, 50), "dist", "chunk_id"))], 20)


def find_symbols(symbols: DataFrame, glob: str, top: int) -> DataFrame:
    """Symbols whose name or qualified name matches, with the total before the limit."""
    pattern = "(?i)^" + glob.replace("*", ".*").replace("?", ".") + "$"
    hit = symbols.filter(F.col("name").rlike(pattern) | F.col("qualified").rlike(pattern))
    return hit.orderBy("qualified").limit(top).crossJoin(F.broadcast(hit.agg(F.count("*").alias("total"))))


@query("ret_symbols", "files", r"""WITH s AS (SELECT path AS qualified, regexp_extract(path, '[^/]*$') AS name FROM files), h AS (SELECT * FROM s WHERE regexp_matches(name, '(?i)^MOD1.*\.py$') OR regexp_matches(qualified, '(?i)^MOD1.*\.py$'))
SELECT name, qualified, (SELECT count(*) FROM h) AS total FROM h ORDER BY qualified LIMIT 20""")
def ret_symbols(spark, sf_dir):
    s = V.files(spark, sf_dir).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("qualified"))
    return find_symbols(s, r"MOD1*\.py", 20)


def regex_context(lines: DataFrame, pattern: str, around: int = 1) -> DataFrame:
    """(path, line_no, line): matching lines and their neighbours, each once. Neighbours are looked up by number, not by sorting files."""
    hits = lines.filter(F.col("line").rlike(pattern)).select("path", F.explode(F.sequence(F.col("line_no") - around, F.col("line_no") + around)).alias("line_no")).distinct()
    return lines.join(hits, ["path", "line_no"], "left_semi").select("path", "line_no", "line")


@query("ret_regex_context", "lines", "SELECT path, line_no, line FROM lines l WHERE EXISTS (SELECT 1 FROM lines h WHERE h.path = l.path AND abs(h.line_no - l.line_no) <= 1 AND regexp_matches(h.line, 'MIT|Apache'))")
def ret_regex_context(spark, sf_dir):
    return regex_context(V.lines(spark, sf_dir), "MIT|Apache")


def chunk_windows(files: DataFrame, size: int = 60, step: int = 50) -> DataFrame:
    """(path, start, end): windows of ``size`` lines each ``step``; the last is clipped, and none lies within the one before."""
    n = F.size(E.split_lines(F.col("text")))
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    return files.select("path", n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("k")).select("path", (F.col("k") * step + 1).alias("start"), F.least(F.col("k") * step + size, F.col("n")).alias("end"))


@query("chunk_windows", "files", r"""WITH f AS (SELECT path, len(string_split_regex(text, '\r\n|\n|\r')) AS n FROM files)
SELECT path, (k * 20 + 1)::INTEGER AS start, least(k * 20 + 25, n)::INTEGER AS "end" FROM (SELECT path, n, unnest(range(0, greatest(0, ceil((n - 25) / 20.0)::INTEGER) + 1)) AS k FROM f)""")
def chunk_windows_query(spark, sf_dir):
    return chunk_windows(V.files(spark, sf_dir), 25, 20)


def pooled(ranked: DataFrame, top: int, keep: Column) -> DataFrame:
    """The best ``top`` of a ranked list (chunk_id, score) that pass a filter, from a pool that is cut before the filter: 500, or more than six times ``top``."""
    pool = ranked.orderBy(F.desc("score"), "chunk_id").limit(max(6 * top, 500))
    return pool.filter(keep).orderBy(F.desc("score"), "chunk_id").limit(top)


@query("ret_pool", "", _BM25.rstrip() + """, pool AS (SELECT chunk_id, score FROM scored ORDER BY score DESC, chunk_id LIMIT 500) SELECT chunk_id, score FROM pool WHERE chunk_id % 3 = 0 ORDER BY score DESC, chunk_id LIMIT 20""")
def ret_pool(spark, sf_dir):
    """A search below a path: the filter comes after the ranking."""
    return pooled(bm25(_chunks(spark, sf_dir), ["the", "token", "license"], 500), 20, F.col("chunk_id") % 3 == 0)


def with_preview(hits: DataFrame, chunks: DataFrame, lines: int = 3) -> DataFrame:
    """Hits with the first lines of their chunks that aren't blank."""
    first = F.slice(F.filter(E.split_lines(F.col("text")), lambda x: F.trim(x) != ""), 1, lines)
    return hits.join(chunks, "chunk_id").select(*hits.columns, F.array_join(first, "\n").alias("preview"))


@query("ret_preview", "", _BM25.rstrip() + r""", top AS (SELECT chunk_id, score FROM scored ORDER BY score DESC, chunk_id LIMIT 40)
SELECT chunk_id, score, array_to_string(list_filter(string_split_regex(text, '\r\n|\n|\r'), lambda x: trim(x) <> '')[1:3], chr(10)) AS preview FROM top JOIN documents ON doc_id = chunk_id""")
def ret_preview(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return with_preview(bm25(chunks, ["the", "token", "license"], 40), chunks)


INDEX_TABLES = ("chunks", "vectors", "symbols", "meta")


def write_index(folder: str, **tables: DataFrame) -> None:
    """The four tables of an index as Parquet below a folder."""
    for name in INDEX_TABLES:
        tables[name].write.mode("overwrite").parquet(f"{folder}/{name}")


def read_index(spark, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in INDEX_TABLES}
