from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import lexical
from quillon.llm.lexical import Item, Shard, best_of, ranked_search, terms_of

DOCS = "doc_id long, text string, n string, terms int, score string, rank string, item int"
ITEMS = "item_id long, text string, rank int, score string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k):
    words = [(d, TERM.findall((t or "").translate(LOWER))) for d, t, *_ in docs]
    words = [(d, w, Counter(w)) for d, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w, _ in words)
    df = Counter(t for *_, c in words for t in c)
    out = []
    for item_id, text in {(i, t) for i, t, *_ in items if t}:
        scored = []
        for doc_id, w, c in words:
            m = 100 - 75 + (75 * len(w) * n_docs) // n_terms
            score = 0
            for t in TERM.findall(text.translate(LOWER)):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(13)
    common, rare = ["the", "of", "Éa", "été"], [f"w{i}" for i in range(300)]
    text = lambda n: rng.choice([" ", "\n", "-", "\x00"]).join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n))
    docs = [(rng.randrange(10**12), text(rng.randint(1, 60))) for _ in range(600)]
    docs += [(10**13 + i, docs[0][1]) for i in range(40)] + docs[5:9]  # ties and repeated rows
    docs += [(None, docs[0][1]), (None, text(9)), (1, None), (2, ""), (3, " \x7f-_`{ "), (4, text(50_000)), (5, "THE The tHe İ ſ K")]
    items = [(i, docs[i * 7][1]) for i in range(30)]
    items += [items[0], (0, "another the"), (None, "w1 w2"), (90, None), (91, ""), (92, "-- "), (93, "never seen"), (94, "the the THE of"), (95, text(4000))]
    return [(d, t, "own", 1, "own", "own", 2) for d, t in docs], [(i, t, 7, "own") for i, t in items]


@pytest.mark.parametrize("postings, depths", [(1_000_000, 16), (60, 1)])
def test_equals_scoring_every_document(spark, corpus, monkeypatch, postings, depths):
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    monkeypatch.setattr(lexical, "DEPTHS", depths)
    docs, items = spark.createDataFrame(corpus[0], DOCS).repartition(3), spark.createDataFrame(corpus[1], ITEMS)
    got = ranked_search(docs, items, k=5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(*corpus, 5)


def test_blocks_of_items_give_the_same(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 3000)
    docs, items = spark.createDataFrame(corpus[0][:200], DOCS), spark.createDataFrame(corpus[1], ITEMS)
    assert len(list(lexical.blocks(items))) > 2
    assert sorted((tuple(r) for r in ranked_search(docs, items).collect()), key=str) == brute(corpus[0][:200], corpus[1], 10)


def shard(rng, n_docs, n_terms, spread):
    sizes = rng.integers(1, 12, n_docs)
    terms = np.concatenate([rng.choice(n_terms, s, replace=False) for s in sizes])
    impact = rng.integers(1, spread, len(terms))
    return Shard(rng.permutation(n_docs).astype("int64"), np.append(0, np.cumsum(sizes)), terms, impact, n_terms)


def test_lists_are_left_early_and_ties_are_not(monkeypatch):
    """A skewed list ends the search early; equal scores go on to the least id."""
    monkeypatch.setattr(lexical, "DEPTHS", 1)
    n = 5000
    impact = np.full(n, 3, "int64")
    impact[:20] = 100
    one = Shard(np.arange(n)[::-1].copy(), np.arange(n + 1), np.zeros(n, "int64"), impact, 1)
    item = Item(0, np.array([0], "int32"), np.array([2], "int64"))
    best, depth = one.search(item, 3, np.zeros((0, 2), "int64"))
    assert best.tolist() == [[200, n - 20], [200, n - 19], [200, n - 18]] and depth < 40
    impact[:] = 3
    best, depth = Shard(np.arange(n)[::-1].copy(), np.arange(n + 1), np.zeros(n, "int64"), impact, 1).search(item, 3, np.zeros((0, 2), "int64"))
    assert best.tolist() == [[6, 0], [6, 1], [6, 2]] and depth == n


def test_random_shards_against_full_scores():
    rng = np.random.default_rng(1)
    for spread in (2, 5, 10**6):
        of = shard(rng, 400, 30, spread)
        for _ in range(20):
            terms = rng.choice(30, rng.integers(1, 6), replace=False).astype("int32")
            item = Item(0, terms, rng.integers(1, 4, len(terms)).astype("int64"))
            before = np.array([[spread * 2, -1]], "int64")
            got, _ = of.search(item, 7, before)
            full = [before[0].tolist()]
            for i in range(400):
                at = slice(of.ends[i], of.ends[i + 1])
                by = dict(zip(of.terms[at].tolist(), of.impact[at].tolist(), strict=True))
                full.append([sum(by.get(t, 0) * r for t, r in zip(terms.tolist(), item.repeats.tolist(), strict=True)), int(of.ids[i])])
            assert got.tolist() == best_of(np.array(full), 7).tolist()
            assert not of.weight.any()


def test_terms_by_bytes_equal_terms_by_letters():
    every = "".join(map(chr, [*range(0x3000), *range(0xD7A0, 0xD800), *range(0xE000, 0xE010), 0x1F600, 0x10FFFF]))
    for text in (every, "aÀZ_b", "", "\x80x\x7fy", "ABCxyz"):
        assert [t.decode() for t in terms_of(text.encode())] == TERM.findall(text.translate(LOWER))


def test_nothing_gives_nothing(spark, corpus):
    docs, items = spark.createDataFrame(corpus[0][:9], DOCS), spark.createDataFrame(corpus[1], ITEMS)
    assert ranked_search(docs.limit(0), items).collect() == []
    assert ranked_search(docs, items.limit(0)).collect() == []
    assert ranked_search(docs.filter("doc_id < 4"), items).collect() == []
