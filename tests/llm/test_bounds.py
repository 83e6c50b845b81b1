"""Every code point, bounds of samples, and rows that share an id or have none."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import language, sampling, toxicity
from quillon.llm.bpe import WordBPE, bpe_encode
from quillon.llm.jaccard import shingle_components
from quillon.llm.lines import dedup_lines
from quillon.llm.tokenfiles import PieceEncoder

DOCS = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name, coder", [("word_bpe_49k.json", WordBPE), ("byte_bpe_50k.json", PieceEncoder)])
def test_every_code_point_is_encoded_as_the_library_does(name, coder):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(P.path(name)), coder(P.path(name))
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{c}b {c}1{c} " for c in every[i : i + 500]) for i in range(0, len(every), 500)]
    wanted = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    if coder is WordBPE:
        assert [i for i, (t, ids) in enumerate(zip(texts, wanted, strict=True)) if own.encode(t) != ids] == []
    else:
        import numpy as np

        got = [np.frombuffer(b, own.type).tolist() for b in own.encode_all(texts)]
        assert [i for i, (a, b) in enumerate(zip(got, wanted, strict=True)) if a != b] == []


@pytest.fixture(scope="module")
def many(spark):
    """20,000 rows: three ids, none, and an id of its own; a third of all is one row."""
    rows = spark.range(20_000).select(F.col("id").alias("n"))
    text = F.when(F.col("n") % 3 == 0, F.lit("the same text again")).otherwise(F.concat(F.lit("some words of text "), "n"))
    ids = F.when(F.col("n") % 3 == 0, 1).when(F.col("n") % 4 == 1, None).when(F.col("n") % 4 == 2, F.col("n") % 3).otherwise(F.col("n"))
    return rows.select(ids.cast("long").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")).cache()


@pytest.mark.parametrize("only", ["true", "doc_id IS NULL", "doc_id < 3"])
def test_a_sample_keeps_its_bound_whatever_the_ids(spark, many, only):
    rows = many.filter(only)
    n = rows.agg(sampling.distinct_rows("doc_id", "text")).first()[0]
    exact = rows.select("doc_id", "text").distinct().count()
    assert abs(n - exact) <= 0.06 * exact
    drawn = rows.filter(sampling.sample_condition("doc_id", 1000, n, 3, "text")).dropDuplicates(["doc_id", "text"]).count()
    assert 880 <= drawn <= 1120


def test_the_language_sample_is_bounded(spark, many, monkeypatch):
    sizes = []
    monkeypatch.setattr(language, "fit", lambda rows, seed: sizes.append(len(rows)) or language.LanguageModel(["en"], None, None, 1.0, 0.0))
    for only in ("true", "doc_id IS NULL", "doc_id < 3"):
        language.train(many.filter(only), most=1000)
    assert all(700 <= n <= 1120 for n in sizes), sizes


def test_an_id_of_many_rows_is_one_row_of_the_toxicity_sample(spark, many, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "learn_lexicons", lambda rows: seen.append(rows.count()) or [toxicity.Lexicon()] * (toxicity.PARTS + 1))
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 0), (None, 1)], "doc_id long, toxic int")
    toxicity.train(many, labels, folds=1_000_000, held=0)
    assert seen == [3]


def test_null_and_shared_ids_pass_through(spark):
    rows = [(None, "one two three four five\nshared line"), (None, "one two three four five\nshared line"), (5, "x\nshared line"), (5, "Y\nshared line"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], DOCS)
    import public_tokenizers as P

    coded = bpe_encode(docs, P.path("word_bpe_49k.json"))
    assert Counter((r.doc_id, r.text) for r in coded.collect()) == Counter(rows)
    lines = dedup_lines(docs, min_docs=4)
    assert Counter((r.doc_id, r.text, r.n_dropped) for r in lines.collect()) == Counter([(None, "one two three four five", 1)] * 2 + [(5, "x", 1), (5, "Y", 1)] + [(None, "", 0)] * 2)
    groups = shingle_components(docs, words=2, num=80, den=100)
    assert Counter((r.doc_id, r.n_shingles) for r in groups.collect()) == Counter([(None, 6)] * 2 + [(5, 2)] * 2 + [(None, 0)] * 2)


def test_a_row_repeated_very_often_lies_in_one_bucket_and_others_of_its_id_apart(spark, many):
    got = dedup_lines(many.select("doc_id", "text"), min_docs=10)
    assert got.count() == 20_000
    assert got.filter("n_dropped > 0").count() == many.filter("text = 'the same text again'").count()
