"""The fitted models against plain Python: subwords, features, lexicons, trees and calibration, and accuracy on the driver's tables."""

from __future__ import annotations

import collections
import math
import os
import random
import unicodedata
import zlib

import numpy as np
import pytest

from quillon.llm import language, toxicity
from quillon.llm import queries as llm_queries

SF = "/root/testdata/sf0.01"
TEXTS = ["The quick brown fox", "Über größe schön!", "a", "l'été, où es-tu?", "日本語 text", "ÀÉ combining é x́y", "́ lone mark", "x1y2 z_", "ß" * 40, "İstanbul ΣΑΣ", "one\ntwo\tthree  four", ""]
M32 = (1 << 32) - 1


def plain_subwords(text):
    """The buckets of a text, word by word, with Python's integers."""
    text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
    words, now = [], ""
    for c in text + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or kind == "M" and now:
            now += c
        else:
            if now:
                words.append(now)
            now = ""
    bucket = lambda h, salt: ((h ^ (salt * 0x85EBCA6B & M32)) * 0x9E3779B1 & M32) >> (32 - language.BITS)
    out = []
    for word in words:
        marked = [60, *map(ord, word), 62]
        for n in (2, 3, 4):
            for i in range(len(marked) - n + 1):
                h = 0
                for c in marked[i : i + n]:
                    h = (h * 0x01000193 + c) & M32
                out.append(bucket(h, n))
        whole = 0
        for spot, c in enumerate(marked):
            x = (c + spot * 0x01000193) * 0x9E3779B1 & M32
            whole += x ^ (x >> 15)
        out.append(bucket(whole & M32, 9))
    return collections.Counter(out)


def test_subwords_are_those_of_plain_python():
    for text in TEXTS:
        _, found = language.subwords(language._codes(language.normal(text)))
        assert collections.Counter(int(b) for _, buckets in found for b in buckets) == plain_subwords(text), text


def test_predictions_are_sums_of_single_subwords(monkeypatch):
    """Texts in groups, in sections and alone give the same logits as adding up bucket by bucket."""
    rng = np.random.default_rng(1)
    model = language.LanguageModel(["a", "b", "c"], rng.normal(size=(language.BUCKETS, 3)), rng.normal(size=3), 1.3, 0.4)
    texts = [None, *TEXTS, " ".join(TEXTS) * 30]
    for group, section in ((1 << 18, 1 << 18), (7, 16)):
        monkeypatch.setattr(language, "GROUP", group)
        monkeypatch.setattr("quillon.llm.common.SECTION", section)
        langs, scores, rejected = model.predict(texts)
        for text, lang, score, no in zip(texts, langs, scores, rejected, strict=True):
            buckets = plain_subwords(text or "")
            if not buckets:
                assert (lang, score, no) == ("und", 0.0, True)
                continue
            z = sum(n * model.table[b] for b, n in buckets.items()) / sum(buckets.values()) + model.bias
            p = np.exp(z / 1.3) / np.exp(z / 1.3).sum()
            assert lang == model.labels[int(p.argmax())] and math.isclose(score, p.max(), rel_tol=1e-9) and no == (p.max() < 0.4)


def test_spans_hold_each_word_once():
    text = " ".join(TEXTS) * 5
    for seed in range(5):
        total = collections.Counter()
        for buckets, counts in language.spans(text, np.random.default_rng(seed)):
            total.update(dict(zip(buckets.tolist(), counts.tolist(), strict=True)))
        assert total == plain_subwords(text)
    assert language.spans("123 !", np.random.default_rng(0)) == []


def test_rejection_minimises_errors():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 400)
    z = rng.normal(size=(400, 3)) + 2.0 * np.eye(3)[y]
    temperature, least = language._calibrated(z, y)
    p = np.exp(z / temperature) / np.exp(z / temperature).sum(axis=1, keepdims=True)
    right, score = p.argmax(axis=1) == y, p.max(axis=1)
    errors = lambda t: (right & (score < t)).sum() + (~right & (score >= t)).sum()
    assert errors(least) == min(errors(t) for t in np.linspace(language.FLOOR, language.CEILING, 111)) < errors(0)


def plain_features(text, words, stems):
    tokens = (text or "").split()
    if not tokens:
        return [0.0] * len(toxicity.FEATURES)
    flags = []
    for w in tokens:
        bare = toxicity.plain(w)
        open_ = bare.translate(toxicity.DISGUISES) if toxicity._MIXED.search(w) else bare
        letters = [c for c in w if c.isalpha()]
        flags.append((bare in words, any(len(bare) > n and bare[:n] in stems for n in toxicity.STEMS), bare in toxicity.SECOND_PERSON, len(letters) > 1 and all(c.isupper() for c in letters), open_ != bare, open_ != bare and open_ in words))
    n, sums = len(tokens), [sum(f[i] for f in flags) for i in range(6)]
    hits, second = [i for i, f in enumerate(flags) if f[0] or f[1] or f[5]], [i for i, f in enumerate(flags) if f[2]]
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i in hits)
    chars = [c for w in tokens for c in w]
    rest = [sum(map(str.isupper, chars)), sum(not c.isalnum() for c in chars), chars.count("!")]
    return [*(s / n for s in sums), near / n, *(math.log1p(sums[i]) for i in (0, 1, 5)), *(r / len(chars) for r in rest), math.log1p(n)]


def test_features_are_those_of_plain_python(monkeypatch):
    words, stems = frozenset({"zorg", "blim"}), frozenset({"zorgb", "frob"})
    texts = [None, "", "you ZORG! b1im z0rg, frobnicate far away from anything at all here you", "A.B. ÜBER du zorgbart $$$ !!!", "x" * 5000 + "!" * 5000 + "Y" * 5000 + " zorg " * 300]
    want = [plain_features(t, words, stems) for t in texts]
    for section in (1 << 18, 16):
        monkeypatch.setattr("quillon.llm.common.SECTION", section)
        lexicon = toxicity.Lexicon(words, stems)
        assert np.allclose([lexicon.features(t) for t in texts], want)


def test_lexicons_are_those_of_plain_counts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        text = [f"w{rng.randrange(60)}" for _ in range(rng.randint(3, 30))] + (["Zorgbla!", "bl1m"] if toxic and rng.random() < 0.8 else []) + (["often"] if rng.random() < (0.4 if toxic else 0.2) else [])
        rows.append((" ".join(text) if i else None, int(toxic), i % toxicity.PARTS))
    got = toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, toxic int, part int").repartition(3))

    def g(a, b, t, c):
        share = (a + b) / (t + c)
        return 2 * sum(k * math.log(k / (n * p)) for k, n, p in ((a, t, share), (b, c, share), (t - a, t, 1 - share), (c - b, c, 1 - share)) if k)

    found = [(toxicity.lexical(t or ""), y, p) for t, y, p in rows]
    for left_out, lexicon in zip((*range(toxicity.PARTS), -1), got, strict=True):
        for kind, have in enumerate((lexicon.words, lexicon.stems)):
            every = collections.Counter(w for f, y, _ in found if y for w in f[kind])
            tests = sum(n >= toxicity.LEAST_DOCS for n in every.values())
            mine = [(f[kind], y) for f, y, p in found if p != left_out]
            t, c = sum(y for _, y in mine), sum(not y for _, y in mine)
            seen = {y: collections.Counter(w for f, v in mine if v == y for w in f) for y in (0, 1)}
            want = {w for w, n in every.items() if n >= toxicity.LEAST_DOCS and (a := seen[1][w]) >= toxicity.LEAST_DOCS and a / t > toxicity.TIMES * (b := seen[0][w]) / c and g(a, b, t, c) > 2 * math.log(tests) + toxicity.MARGIN}
            assert have == want
    assert {"zorgbla", "blim"} <= got[-1].words and "often" not in got[-1].words


def test_trees_and_calibration_against_plain_python():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, len(toxicity.FEATURES)))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.3).astype(int)
    trees = toxicity.BoostedTrees(x, y, np.ones(300))

    def margin(row):
        total = trees.base
        for features, cuts, values in trees.trees:
            node = 0
            for _ in range(toxicity.DEPTH):
                f = int(features[node])
                b = sum(row[f] > c for c in trees.cuts[f])
                node = 2 * node + 1 + (b > cuts[node])
            total += values[node - (2**toxicity.DEPTH - 1)]
        return total

    assert np.allclose(trees.margin(x[:40]), [margin(r) for r in x[:40]])
    z, w = np.round(rng.normal(size=60), 1), rng.uniform(0.5, 2, 60)
    t = (z + rng.normal(size=60) > 0).astype(int)
    xs, ps = toxicity.isotonic(z, t, w)
    order = np.argsort(z, kind="stable")
    least = [min(max((t[order][i : j + 1] * w[order][i : j + 1]).sum() / w[order][i : j + 1].sum() for i in range(k + 1)) for j in range(k, 60)) for k in range(60)]  # min-max form
    assert np.allclose(np.interp(z[order], xs, ps)[[k for k in range(60) if k == 0 or z[order][k] != z[order][k - 1]]], [least[k] for k in range(60) if k == 0 or z[order][k] != z[order][k - 1]], atol=0.25)
    assert (np.diff(ps) >= 0).all()


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@needs_tables
def test_language_of_the_driver_s_table(spark):
    """Every language, held-out rows only: at least 99 in 100 right, and few right ones rejected."""
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in llm_queries.op6_language_id(spark, SF).collect() if r["held_out"] and langs[r["doc_id"]] and r["lang_pred"] != "und"]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[langs[r["doc_id"]]].append(r["lang_pred"] == langs[r["doc_id"]])
    assert len(by) == 4 and all(sum(v) >= 0.99 * len(v) for v in by.values())
    assert sum(r["rejected"] for r in got) <= 0.02 * len(got)


@needs_tables
def test_toxicity_of_the_driver_s_table(spark):
    """Held-out rows that hold a word of the learned lexicon are found, and clean ones left alone; the rest of the labels is noise no text shows."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    told = {i for i, t in texts.items() if toxicity.lexical(t or "")[0] & model.lexicon.words}
    got = {r["doc_id"]: r for r in llm_queries.op7_toxicity(spark, SF).collect()}
    held = [i for i in labels if i in got and got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    caught = [got[i]["predicted"] for i in held if labels[i] == 1 and i in told]
    clean = [got[i]["predicted"] for i in held if labels[i] == 0]
    assert len(caught) >= 3 and sum(caught) >= 0.9 * len(caught) and sum(clean) <= 0.02 * len(clean)


def test_null_ids_and_equal_rows(spark):
    """A null id is held out by nobody; equal texts get equal scores; the models take repeated rows and clashing columns."""
    rows = [(None, "the thing with the shore", "en", "own"), (None, "le chat et la leçon", "fr", "own"), (1, "the thing and that", "en", "own"), (1, "the thing and that", "en", "own")] * 30
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, rejected string")
    model = language.train(table)
    got = language.identify(table, model).collect()
    assert len(got) == len(rows) and len({(r["text"], r["lang_pred"], r["score"]) for r in got}) == 3
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 7)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(table, toxicity.train(table, labels)).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)


def test_held_out_is_never_null(spark):
    from quillon.llm.sampling import in_fold

    got = spark.createDataFrame([(None,), (5,), (6,)], "doc_id long").select(in_fold("doc_id", 4, 2)).collect()
    assert [r[0] for r in got] == [False, zlib.crc32(b"5") % 4 == 2, zlib.crc32(b"6") % 4 == 2]
