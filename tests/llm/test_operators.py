"""The training-data operators against brute force, and at their edges."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import imatch, jaccard, katz, language, lines, mixing, mphf, tokenfiles, toxicity, vectors
from quillon.llm.bpe import WordBPE, bpe_encode
from quillon.llm.components import connected_components

P = pytest.importorskip("public_tokenizers")


def by_id(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    h = mphf.MinimalPerfectHash.build(keys)
    assert sorted(h.lookup(keys).tolist()) == list(range(len(keys)))
    assert mphf.MinimalPerfectHash.build(keys[:0]).lookup(keys[:5]).tolist() == [-1] * 5
    with pytest.raises(ValueError):
        mphf.MinimalPerfectHash.build(np.array([5, 5], np.uint64))


def test_line_dedup(docs, nothing):
    rows = docs.select("doc_id", "text").collect()
    key = lambda s: re.sub(r"[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\v\f\r"))
    seen = collections.Counter(k for r in rows for k in {key(x) for x in (r["text"] or "").split("\n")})
    want = []
    for r in rows:
        every = (r["text"] or "").split("\n")
        good = [x for x in every if not (key(x) and seen[key(x)] >= 10)]
        want.append((r["doc_id"], len(every), len(every) - len(good), "\n".join(good)))
    out = lines.dedup_lines(docs, 10, 1)
    assert sorted(tuple(x) for x in out.select("doc_id", "n_lines", "n_dropped", "text").collect()) == sorted(want)
    assert any(w[2] for w in want)
    assert set(docs.columns) <= set(out.columns)
    assert lines.dedup_lines(nothing).count() == 0


def test_token_files(spark, docs, nothing):
    """Rows of null and equal ids follow each other by text hash; the files are read alone."""
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "no id here"), (None, None), (5, "five again"), (-(1 << 63), "least")], "doc_id long, text string"))
    rows = table.withColumn("key", F.xxhash64("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["key"], r["text"] or ""))
    want, at = [], 0
    for r in rows:
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = tokenfiles.token_output(table, path, length=64)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert tokenfiles.token_output(nothing, path).count() == 0


def test_sequences_are_read_in_place(tmp_path):
    import pyarrow.fs as pafs

    fs, path, documents = pafs.LocalFileSystem(), f"{tmp_path}/t.arrow", f"{tmp_path}/d.arrow"
    writer = tokenfiles.SequenceWriter(fs, path, documents, 8, np.dtype("<u2"))
    ids = np.arange(8 * 1000 + 3).astype("<u2")
    assert [writer.add(x.tobytes(), i) for i, x in enumerate(np.split(ids, [5, 5, 4000]))] == [0, 5, 5, 4000]
    writer.close()
    file = tokenfiles.SequenceFile(fs, path)
    assert np.concatenate(list(file.pieces(3, 7000))).tolist() == ids[3:7003].tolist()
    last, mask = file.sequence(1000)
    assert last[:3].tolist() == ids[-3:].tolist() and mask.tolist() == [True] * 3 + [False] * 5
    assert not file.sequence(0)[0].flags.owndata
    import pyarrow as pa

    rows = pa.ipc.open_file(documents).read_all().to_pylist()
    assert [(r["doc_id"], r["at"], r["n_tokens"]) for r in rows] == [(0, 0, 5), (1, 5, 0), (2, 5, 3995), (3, 4000, 4003)]


ODD = ["don't .'s a'b 12abc. x1y2 ...a '' s", "a \nb\n c \n\n d", "a\n", "é́ x", "tab\t\tx \x85 y", " \n x", "x 's 'twas  <|endoftext|> b", "日本語 １２３ ½ 😀a", "İstanbul ΣΑΣ ΌΔΟΣ", "ﬁ Å ẞ", "a" * 3000, "<|startoftext|>Hi", "a\x1cb\x1d c"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoders_equal_the_library(texts, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    own = WordBPE(P.path(name)) if name.startswith("word") else tokenfiles.PieceEncoder(P.path(name))
    for s in [x or "" for x in texts if len(x or "") < 5000] + ODD:
        ids = t.encode(s, add_special_tokens=False).ids
        if name.startswith("word"):
            assert own.encode(s) == ids, s
            assert own.decode(ids) == t.decode(ids, skip_special_tokens=False), s
        else:
            assert np.frombuffer(own.encode(s), own.type).tolist() == ids, s


def test_bpe_operator(docs, nothing, monkeypatch):
    """Every row against the library, with sections, groups and caches of a few letters."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = docs.collect()
    want = []
    for r in rows:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], ids, t.decode(ids, skip_special_tokens=False)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = bpe_encode(docs, path)
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert set(docs.columns) - {"n_tokens"} <= set(got.columns) and dict(got.dtypes)["n_tokens"] == "bigint"
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    hashed = [(i, len(ids), digest(" ".join(map(str, ids))), digest(plain)) for i, ids, plain in want]
    got = bpe_encode(docs, path, texts_too=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted(hashed, key=key)
    assert bpe_encode(nothing, path).count() == 0


def test_long_words_are_merged_as_short_ones():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, own = Tokenizer.from_file(path), WordBPE(path)
    rng = random.Random(5)
    for n in (2, 30, 65, 700, 20_000):
        for letters in ("ab", "etaoinshrdlu", "eéstàüß", "日本語x"):
            word = "".join(rng.choice(letters) for _ in range(n))
            ids = t.encode(word, add_special_tokens=False).ids
            assert own.encode(word) == ids
            parts = [own.inner[b] for b in word.encode()[:-1]] + [own.final[word.encode()[-1]]]
            assert len(own.words.findall(own.normalized(word))) > 1 or own._merge_linked([p for p in parts if p is not None]) == ids
    start = time.monotonic()
    own.encode("".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000)))
    assert time.monotonic() - start < 20  # about one second on an idle machine; hours if quadratic


def test_sections_and_caches_do_not_change_ids(texts, monkeypatch):
    import quillon.llm.bpe as bpe_module
    from quillon.llm import common

    path = P.path("word_bpe_49k.json")
    whole = WordBPE(path)
    want = [whole.encode(t or "") for t in texts]
    monkeypatch.setattr(common, "SECTION", 16)
    monkeypatch.setattr(bpe_module, "CHUNK_BYTES", 500)
    monkeypatch.setattr(bpe_module, "WORD_BYTES", 500)
    small = WordBPE(path)
    assert [small.encode(t or "") for t in texts] == want
    whole = tokenfiles.PieceEncoder(P.path("byte_bpe_50k.json"))
    monkeypatch.setattr(tokenfiles, "PIECE_BYTES", 500)
    small = tokenfiles.PieceEncoder(P.path("byte_bpe_50k.json"))
    odd = [t or "" for t in texts] + ["a  b   c\n\n  d " * 9, " x  " * 30, "\n \n x\t\ty " * 9, "μg/ml 5 " * 20]
    assert [small.encode(t) for t in odd] == [np.array(whole.tokenizer.encode(t, add_special_tokens=False).ids, whole.type).tobytes() for t in odd]
    assert list("".join(common.sections(t or "")) for t in texts) == [t or "" for t in texts]


def brute_components(rows, k, num):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard_join(spark, docs, k, num):
    rng = np.random.default_rng(4)
    base = [f"v{i}" for i in rng.integers(0, 5000, 120)]
    near = []
    for _ in range(40):  # chains of copies about the threshold
        copy = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            copy[at] = f"x{rng.integers(0, 10**6)}"
        near.append(" ".join(copy))
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(near)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    want = brute_components([tuple(r) for r in every.collect()], k, num)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.shingle_components(every, k, num).collect()}
    assert got == want


def test_jaccard_large_groups(spark, monkeypatch):
    """Cells smaller than the groups: 400 near copies of one text, of two more, and chains about the threshold."""
    monkeypatch.setattr(jaccard, "CELL", 16)
    rng = random.Random(11)
    rows = []
    for group, (n, edits) in enumerate([(400, 3), (60, 9), (60, 14)]):
        base = [f"g{group}w{rng.randrange(900)}" for _ in range(150)]
        for _ in range(n):
            copy = list(base)
            for at in rng.sample(range(150), rng.randrange(edits + 1)):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows += [" ".join(f"v{rng.randrange(10**5)}" for _ in range(80)) for _ in range(50)]
    every = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.shingle_components(every, 4, 85).collect()}
    assert got == brute_components(list(enumerate(rows)), 4, 85)


def test_jaccard_null_ids(spark):
    """Null ids are rows like any other, and name a component only if it has no other id."""
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (None, "one two three four five"), (None, ""), (None, None), (3, "a b"), (3, "x y z")]
    got = jaccard.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted([(None, 3, 7), (None, 3, 7), (7, 3, 7), (None, 2, None), (None, 0, None), (None, 0, None), (3, 1, 3), (3, 1, 3)], key=str)


def test_jaccard_empty(nothing):
    assert jaccard.shingle_components(nothing).count() == 0


def test_bitmap_bound_never_excludes_a_link():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(7, 200)).astype(np.uint64))
        b = np.unique(np.concatenate((a[: int(len(a) * rng.uniform(0.8, 1))], rng.integers(0, 2**63, rng.integers(0, 20)).astype(np.uint64))))
        common = len(np.intersect1d(a, b))
        if 100 * common < 85 * (len(a) + len(b) - common):
            continue
        assert set(jaccard.signatures(a, jaccard.Bands(85, 100)).tolist()) & set(jaccard.signatures(b, jaccard.Bands(85, 100)).tolist())
        if a.tobytes() != b.tobytes():
            edges = jaccard._forest(np.array([len(a), len(b)]), [jaccard.bitmap(a), jaccard.bitmap(b)], np.array([1, 2]), 85, 100)
            assert edges


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7), (20, 2), (100, 99), (99, 98), (98, 100)] + [(200 + i, 201 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 2, 4: 2, 3: 2, 2: 2, 20: 2, 9: 8, 8: 8, 100: 98, 99: 98, 98: 98} | {i: 200 for i in range(200, 231)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 64)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 24))
    x = [(centres[i % 12] + rng.normal(scale=0.22, size=24)).astype(np.float32).tolist() for i in range(300)]
    x += [x[0]] * 20 + [[2 * v for v in x[1]], None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [1e30] * 24, [1e-30] * 24]
    rows = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(5)
    good = [i for i, v in enumerate(x) if vectors._usable(v) is not None]
    m = np.array([x[i] for i in good])
    m = m / np.abs(m).max(axis=1, keepdims=True)
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    close = m @ m.T >= 0.95
    np.fill_diagonal(close, False)
    label = np.arange(len(good))
    for _ in range(40):
        label = np.minimum(label, np.where(close, label[None, :], 10**9).min(axis=1))
    want = {i: (0, i, True) for i in range(len(x))} | {g: (int(close[k].sum()), good[label[k]], good[label[k]] == g) for k, g in enumerate(good)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.embedding_links(rows).collect()}
    assert got == want and close.sum() > 500
    assert vectors.embedding_links(rows.limit(0)).count() == 0


def test_language(spark, docs, nothing):
    rng = np.random.default_rng(7)
    pools = {"en": ["the", "and", "thing", "shore", "with"], "fr": ["être", "que", "aux", "leçon", "vient"], "de": ["und", "schön", "keit", "über", "nicht"]}
    rows = [(i, " ".join(rng.choice(pools[lang], rng.integers(4, 60))), lang) for i, lang in enumerate(list(pools) * 150)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(table)
    got = {r["doc_id"]: r for r in language.identify(table, model).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.99 * len(held)
    edge = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert all(edge[i]["lang_pred"] == "und" and edge[i]["score"] == 0 and edge[i]["rejected"] for i in (0, 1, 2))
    assert all(0 <= r["score"] <= 1 for r in edge.values())
    none = language.train(nothing)
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}


def test_toxicity(spark, docs, nothing):
    rng = np.random.default_rng(8)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        w = rng.choice(plain, rng.integers(10, 80)).tolist()
        toxic = i % 5 == 0
        if toxic:
            for at in rng.integers(0, len(w), 3):
                w[at] = str(rng.choice(["idiot", "moron", "Zorgbla", "zorgblim", "1diot"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(table, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i] == y for i, y in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(docs, model).collect())
    none = toxicity.train(nothing, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}


def test_isotonic_rises():
    rng = np.random.default_rng(9)
    z = rng.normal(size=300)
    xs, ps = toxicity.isotonic(z, (z + rng.normal(size=300) > 0).astype(int), np.ones(300))
    assert (np.diff(ps) >= 0).all() and (np.diff(xs) >= 0).all()


def test_mixing(docs, nothing):
    taken = mixing.mix(docs, F.lit("d"), 0.5, {"language": {"fr": 3.0, "en": 1.0}}, max_epochs=2, seed=1)
    rows = taken.collect()
    assert set(docs.columns) <= set(taken.columns) and all(1 <= r["mix_epochs"] <= 2 for r in rows)
    spent = collections.Counter()
    for r in rows:
        spent[r["lang"], r["source"]] += r["mix_tokens"] * r["mix_epochs"]
    assert all(spent[r["lang"], r["source"]] <= r["mix_target"] for r in rows)
    again = mixing.mix(docs.repartition(7), F.lit("d"), 0.5, {"language": {"fr": 3.0, "en": 1.0}}, max_epochs=2, seed=1)
    assert by_id(again, "doc_id", "mix_epochs") == by_id(taken, "doc_id", "mix_epochs")
    assert mixing.mix(nothing, F.lit("d"), 0.5).count() == 0


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s3", 1000), ("b", "x", "s4", 1000)], "domain string, language string, source string, supply long")
    got = {r["source"]: r["target"] for r in mixing.leaf_budgets(leaves, 400, {}).collect()}
    assert got == {"s1": 10, "s2": 90, "s3": 100, "s4": 200}
    got = {r["source"]: r["target"] for r in mixing.leaf_budgets(leaves, 400, {"domain": {"b": 0.0}}).collect()}
    assert got["s4"] == 0 and got["s1"] == 10 and got["s2"] == 190 and got["s3"] == 200


@pytest.mark.parametrize("shard", [48 << 20, 600])
def test_katz(spark, docs, monkeypatch, shard):
    """Small shards split the frequent contexts."""
    monkeypatch.setattr(katz, "SHARD_BYTES", shard if shard > 10_000 else 6_000)
    every = docs.select("doc_id", "text").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] or "" for r in every.collect()}
    tokens = {d: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), b"\n"] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    one, two, contexts = collections.Counter(), collections.Counter(), collections.Counter()
    for d, t in tokens.items():
        if not held[d]:
            before = [b"\ns", *t[:-1]]
            one.update(t)
            two.update(zip(before, t, strict=True))
            contexts.update(before)
    n, v, k = sum(one.values()), len(one), katz.K
    counts = lambda c: np.array([0, *(sum(x == r for x in c.values()) for r in range(1, k + 2))])
    d1, d2 = katz.discounts(counts(one)), katz.discounts(counts(two))
    unknown = 1 - sum(d1[min(c, k + 1)] * c for c in one.values()) / n
    p1 = lambda w: d1[min(one[w], k + 1)] * one[w] / n if one[w] else unknown
    followers = collections.defaultdict(dict)
    for (h, w), c in two.items():
        followers[h][w] = c

    def p2(h, w):
        seen = followers.get(h)
        if not seen:
            return p1(w)
        bare = all(c > k for c in seen.values())
        if w in seen:
            return d2[min(seen[w], k + 1)] * seen[w] / (contexts[h] + bare)
        left = 1 / (contexts[h] + 1) if bare else 1 - sum(d2[min(c, k + 1)] * c for c in seen.values()) / contexts[h]
        return left / (1 - sum(map(p1, seen))) * p1(w)

    assert math.isclose(sum(map(p1, one)) + p1(b"unseen"), 1, rel_tol=1e-9)
    mass = 1 - unknown
    for h, seen in followers.items():  # every context: its followers, all other words by the backoff, and the unknown one
        rest = p2(h, b"unseen") / unknown
        assert math.isclose(sum(p2(h, w) for w in seen) + rest * (mass - sum(map(p1, seen)) + unknown), 1, rel_tol=1e-9)
    for r in katz.score_documents(every).collect():
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(one[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p2(h, w)) for h, w in zip([b"\ns", *t[:-1]], t, strict=True)), rel_tol=1e-6)


def test_katz_edges(docs, nothing):
    assert katz.score_documents(nothing).count() == 0
    assert katz.score_documents(docs).count() == docs.count()


def brute_imatch(texts, least, most):
    """Fingerprints as sets of terms for each subset, by plain Python over the terms' hashes (xxhash with Spark's seed)."""
    import xxhash

    term = lambda w: xxhash.xxh64(w.encode(), 42).intdigest()
    words = {t: {term(w) for w in re.split(r"[^\p{L}\p{N}]+".replace("\\p{L}\\p{N}", "\\w"), t.lower().replace("_", " ")) if w} for t in set(texts)}
    seen = collections.Counter(w for t in texts for w in words[t])
    n = len(texts)
    lexicon = {w for w, c in seen.items() if max(2, least * n) <= c <= most * n}

    def printed(text):
        own = {term(w) for w in re.split(r"[\W_]+", text.lower()) if w} & lexicon
        signed = [w - (1 << 64) if w >> 63 else w for w in own]
        return text if not own else [frozenset(t for t in signed if t % m < b) for m, b in imatch.subsets()]

    def alike(a, b):
        if isinstance(a, str) or isinstance(b, str):
            return float(a == b)
        some = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
        return sum(x == y for x, y in some) / len(some) if some else 1.0

    return printed, alike


def test_imatch(spark, docs, nothing):
    """Edited texts, fingerprints (equal exactly where all subsets' terms are) and both likenesses against plain Python."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(-(1 << 63), "w1 w2 w3 own id"), ((1 << 63) - 1, "the highest w5 w6 id"), (None, "w7 w8 w9 null id"), (None, "another null id w3")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    least, most = 0.05, 0.6
    printed, alike = brute_imatch([t or "" for _, t in rows], least, most)
    got = imatch.edited_fingerprints(table, least, most).collect()
    assert len(got) == len(rows)
    by_id = collections.defaultdict(list)
    for i, t in rows:
        by_id[i].append(t or "")
    order = sorted((i for i in by_id if i is not None), reverse=True) + [None]
    want = collections.Counter()
    for i, t in rows:
        t = t or ""
        following = min(by_id[order[(order.index(i) + 1) % len(order)]])
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        mine, other = printed(t), printed(edited)
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(alike(mine, other), 9), round(alike(mine, printed(following)), 9)] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    prints = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(docs, least, most).collect()}
    again, _ = brute_imatch([t or "" for i, t in rows[: docs.count()]], least, most)
    plain = {i: str(again(t or "")) for i, t in rows[: docs.count()]}
    for i, a in prints.items():
        for j, b in prints.items():
            assert (a == b) == (plain[i] == plain[j])
    assert all(len(p) == 16 * imatch.SUBSETS or p.startswith("text:") for p in prints.values()) and len(set(prints.values())) > 20
    assert imatch.edited_fingerprints(nothing).count() == 0 and imatch.fingerprints(nothing).count() == 0


