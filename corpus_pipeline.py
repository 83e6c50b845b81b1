"""The corpus pipeline: raw documents to a clean, mixed and encoded corpus.

Each stage takes all documents that the one before it kept and returns
documents with the same columns, but for the last, which adds the encoding.
Null and empty texts leave with the first stage, as they have no language;
every stage's operator says what it does with ties, repeats and long texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import language
from quillon.llm.bpe import bpe_encode
from quillon.llm.common import Stored
from quillon.llm.jaccard import shingle_groups
from quillon.llm.lines import dedup_lines
from quillon.llm.mixing import mix

#: Target weights by domain (the first four letters of a source) and language; what isn't named weighs 1.
WEIGHTS = {"domain": {}, "language": {"en": 2.0}, "source": {}}
#: The mix's budget as a share of the words it is given; a document is taken up to MAX_EPOCHS times.
BUDGET_SHARE, MAX_EPOCHS, SEED = 0.9, 2, 17


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification; documents that it rejects go."""
    model = language.train(docs)
    return language.identify(docs, model).filter("NOT rejected").select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup; a document that is left without text stays, with an empty one."""
    out = dedup_lines(docs, min_docs=10, min_chars=1).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five words at 0.8; one row of each group stays.

    The row of the least doc_id (null ids come last; then the least hash of the
    text, then the least row), whatever repeats. Rows without words have no group
    and all stay.
    """
    groups = shingle_groups(docs, words=5, num=80, den=100)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    least = groups.filter("shingle_group is not null").groupBy("shingle_group").agg(F.min(order).alias("least"))
    kept = least.select(F.col("least.doc_id").alias("kept_id"), F.col("least.text_key").alias("kept_key"), F.lit(True).alias("one"))
    alone = groups.filter("shingle_group is null").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"), F.lit(False).alias("one")).distinct()
    # one number for id and text, so that rows lie by group after the join and their texts move once; the ids themselves
    # are compared so that Spark doesn't deal rows by them as well
    wanted = Stored(kept.unionByName(alone).withColumn("kept_pair", F.xxhash64("kept_key", "kept_id")), "kept-documents").read()
    same_id = F.coalesce(F.col("doc_id") == F.col("kept_id"), F.col("doc_id").isNull() & F.col("kept_id").isNull())
    match = (F.xxhash64(F.xxhash64("text"), "doc_id") == F.col("kept_pair")) & (F.xxhash64("text") == F.col("kept_key")) & same_id
    found = docs.join(wanted, match)
    # rows that agree in doc_id and text are one group: the least of them by its other columns
    first = found.filter("one").groupBy("kept_pair", "kept_key", "kept_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return first.unionByName(found.filter("NOT one").select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Hierarchical budgeting; a document taken twice is two rows."""
    taken = mix(docs, F.substring("source", 1, 4), BUDGET_SHARE, WEIGHTS, MAX_EPOCHS, SEED)
    return taken.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("mix_epochs")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of the word vocabulary."""
    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", keep_known_languages),
    ("lines", drop_common_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("mix", mix_sources),
    ("encode", encode),
]

#: The first stage is a fitted model, which SQL cannot express; tests/llm hold every stage against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each one's result written as Parquet and read back."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        written = Stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            before.drop()
        docs, before = written.read(), written
    return docs
