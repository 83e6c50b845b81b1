"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of lexicon words, of words that begin like them, of words
that read like them once signs and digits are taken for letters, and of
second-person words; how often a lexicon word stands near a second-person word;
rates of capitals, signs and obfuscated words; length. The lexicon is learned:
words, and word beginnings, that labelled toxic documents hold so much more often
than others that chance doesn't explain it for any of the words counted.

Training reads at most about ``SAMPLE_TOXIC`` toxic and ``SAMPLE_CLEAN`` other
labelled training documents, each of them whole. It is cross-fitted in ``PARTS``
parts: a document's features come from a lexicon learned without its part, the
margins that are calibrated from trees grown without its part. The lexicon and
the trees that are kept are those of all parts. Words are counted and features
computed on the executors; the driver gets the lexicon and a row of features for
each sampled document.

Every word of every text is read when scoring.

Edge cases: null and empty texts have features of zero and a score like any
other text; without both labels in the training rows the score is the share of
toxic ones (0 without rows); labels that are neither 0 nor 1 are left out; of
repeated labels of a document the toxic one holds; repeated documents are rows of
their own, when training too; a null doc_id has no label and is not in the
held-out fold; equal scores stay equal; an empty table stays empty; columns named
score or predicted are replaced, all other columns play no part and pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import BoundedCache, Stored, bounded_batches, sections
from quillon.llm.sampling import fold, hashed, sample

#: The bounds on the labelled documents that are fitted.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2500, 5000
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine tu te toi ton ta tes vous votre vos tú ti usted su tus".split())
#: Signs and digits read as letters.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})
NEAR, STEMS, PARTS = 5, (4, 5), 5
#: Documents that must hold a lexicon word, how many times as often toxic ones must hold it, and what its G statistic must exceed beside twice the log of the words tested.
LEAST_DOCS, TIMES, MARGIN = 3, 5.0, 3.0
TREES, DEPTH, RATE, BINS, LEAST = 60, 3, 0.15, 32, 8
#: Bytes that a Python worker's cache of words may hold.
WORD_BYTES = 48 << 20

_EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_MIXED = regex.compile(r"\p{L}[0-9@$!*._-]+\p{L}")
_FLAGS = ("learned", "stem", "second", "capitals", "mixed", "disguised")
FEATURES = (
    "learned rate", "stem rate", "second-person rate", "all-capitals rate", "mixed rate", "disguised rate", "near rate",
    "learned", "stems", "disguised", "capital share", "sign share", "exclamation share", "log words",
)


def plain(word: str) -> str:
    return _EDGES.sub("", word).lower()


def opened(word: str, bare: str) -> str:
    """``bare`` with signs and digits read as letters, if letters stand on both sides of some."""
    return bare.translate(DISGUISES) if _MIXED.search(word) else bare


def stems(word: str) -> set[str]:
    """The beginnings of a longer word."""
    return {word[:n] for n in STEMS if len(word) > n}


@cache
def _classes() -> np.ndarray:
    """For each code point: 1 upper case, 2 neither letter, digit nor space, 4 white space."""
    letters = map(chr, range(0x110000))
    return np.array([c.isupper() | (not c.isalnum() and not c.isspace()) << 1 | c.isspace() << 2 for c in letters], np.uint8)


@dataclass
class Lexicon:
    words: frozenset = frozenset()
    stems: frozenset = frozenset()
    known: BoundedCache = field(default_factory=lambda: BoundedCache(WORD_BYTES), repr=False)

    def _flags(self, word: str) -> int:
        bare = plain(word)
        open_ = opened(word, bare)
        letters = [c for c in word if c.isalpha()]
        flags = (bare in self.words, not self.stems.isdisjoint(stems(bare)), bare in SECOND_PERSON, len(letters) > 1 and all(map(str.isupper, letters)), open_ != bare, open_ != bare and open_ in self.words)
        return sum(f << i for i, f in enumerate(flags))

    def codes(self, text: str) -> np.ndarray:
        """The flags of every word."""
        out = []
        for part in sections(text):
            tokens, known = part.split(), self.known
            known.trim()
            for word in {t for t in tokens if t not in known}:
                known.put(word, self._flags(word))
            out.append(np.fromiter(map(known.__getitem__, tokens), np.uint8, len(tokens)))
        return np.concatenate(out)

    def features(self, text: str | None) -> np.ndarray:
        codes = self.codes(text or "")
        n = len(codes)
        if not n:
            return np.zeros(len(FEATURES))
        flag = codes[None, :] >> np.arange(len(_FLAGS), dtype=np.uint8)[:, None] & 1
        counts = flag.sum(axis=1, dtype=np.int64)
        capitals, signs, marks, chars = 0, 0, 0, 0
        for part in sections(text):
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            kinds = np.bincount(_classes()[points], minlength=8)
            capitals, signs, marks = capitals + kinds[1], signs + kinds[2], marks + part.count("!")
            chars += len(points) - kinds[4]
        hit, second = flag[0] | flag[1] | flag[5], np.flatnonzero(flag[2])
        near = 0
        if len(second) and hit.any():
            at = np.flatnonzero(hit)
            k = np.searchsorted(second, at)
            gap = np.minimum(np.abs(at - second[np.minimum(k, len(second) - 1)]), np.abs(at - second[np.maximum(k - 1, 0)]))
            near = int((gap <= NEAR).sum())
        chars = max(1, chars)
        return np.array([*(counts / n), near / n, *np.log1p(counts[[0, 1, 5]]), capitals / chars, signs / chars, marks / chars, math.log1p(n)])


def lexical(text: str) -> tuple[set[str], set[str]]:
    """The distinct words of a text, as they are and opened, and their stems."""
    words: set[str] = set()
    for part in sections(text):
        for word in set(part.split()):
            bare = plain(word)
            words |= {bare, opened(word, bare)}
    words.discard("")
    return words, {s for w in words for s in stems(w)}


class BoostedTrees:
    """Newton boosting of the logistic loss with binned, level-wise trees."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = self._bins(x)
        rate = float(np.clip((w * y).sum() / w.sum(), 1e-6, 1 - 1e-6))
        self.base, self.trees = math.log(rate / (1 - rate)), []
        z = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(bins, w * (y - p), w * p * (1 - p))
            self.trees.append(tree)
            z += self._leaf(tree, bins)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    def _grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features and cuts of the inner nodes in level order, then the leaves' values."""
        node = np.zeros(len(g), np.int64)
        features, cuts = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
        for level in range(DEPTH):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                at = np.flatnonzero(node == k)
                best = 1e-9
                total_g, total_h = g[at].sum(), h[at].sum()
                for f in range(bins.shape[1] if len(at) >= 2 * LEAST else 0):
                    b = bins[at, f]
                    left_g, left_h, left_n = (np.bincount(b, v, BINS + 1).cumsum() for v in (g[at], h[at], None))
                    right_g, right_h = total_g - left_g, total_h - left_h
                    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - total_g**2 / (total_h + 1)
                    gain[(left_n < LEAST) | (len(at) - left_n < LEAST)] = 0
                    j = int(gain.argmax())
                    if gain[j] > best:
                        best, features[k], cuts[k] = float(gain[j]), f, j
                node[at] = 2 * k + 1 + (bins[at, features[k]] > cuts[k])
        leaf = node - (2**DEPTH - 1)
        values = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        return features, cuts, values

    @staticmethod
    def _leaf(tree: tuple, bins: np.ndarray) -> np.ndarray:
        features, cuts, values = tree
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (bins[rows, features[node]] > cuts[node])
        return values[node - (2**DEPTH - 1)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        return self.base + sum((self._leaf(t, bins) for t in self.trees), np.zeros(len(x)))


def isotonic(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the rising probabilities there."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []
    for at, value, weight in zip(z[order], y[order], w[order], strict=True):
        blocks.append([value * weight, weight, at, at])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], high]
    xs = [v for b in blocks for v in (b[2], b[3])]
    ps = [b[0] / b[1] for b in blocks for _ in (0, 1)]
    return np.array(xs), np.array(ps)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: BoostedTrees | None
    xs: np.ndarray
    ps: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), float(self.ps[0]))
        if not texts:
            return np.zeros(0)
        x = np.stack([self.lexicon.features(t) for t in texts])
        return np.interp(self.trees.margin(x), self.xs, self.ps)


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """From (text, toxic, part): a lexicon without each part, and the last one of all of them.

    A word's documents are counted by part; the table that reaches the driver
    holds only the words that some lexicon takes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, toxic, part in zip(batch["text"], batch["toxic"].to_pylist(), batch["part"].to_pylist(), strict=True):
                for kind, found in enumerate(lexical(text.as_py() or "")):
                    seen.update((kind, w, part, toxic) for w in found)
            columns = list(zip(*seen, strict=True)) if seen else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*columns, list(seen.values())), (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["kind", "word", "part", "toxic", "n"])

    sizes = {(r["part"], r["toxic"]): r["count"] for r in rows.groupBy("part", "toxic").count().collect()}
    counted = rows.select("text", "toxic", "part").mapInArrow(count, "kind int, word string, part int, toxic int, n long")
    with_part = [F.sum(F.when((F.col("part") == p) & (F.col("toxic") == y), F.col("n")).otherwise(0)).alias(f"n{y}_{p}") for p in range(PARTS) for y in (0, 1)]
    words = counted.groupBy("kind", "word").agg(*with_part).filter(sum(F.col(f"n1_{p}") for p in range(PARTS)) >= LEAST_DOCS)
    tested = words.select("kind", "word", *(F.col(f"n{y}_{p}") for y in (0, 1) for p in range(PARTS)), F.count("*").over(Window.partitionBy("kind")).alias("tests"))
    takes = []
    for left_out in (*range(PARTS), -1):
        parts = [p for p in range(PARTS) if p != left_out]
        n = {y: sum(sizes.get((p, y), 0) for p in parts) for y in (0, 1)}
        a, b = (sum(F.col(f"n{y}_{p}") for p in parts) for y in (1, 0))
        takes.append(((a >= LEAST_DOCS) & _telling(a, b, n[1], n[0], F.col("tests"))).alias(f"take{left_out}"))
    found = tested.select("kind", "word", *takes)
    kept = found.filter(" or ".join(f"`{c}`" for c in found.columns[2:])).collect()
    return [Lexicon(*(frozenset(r["word"] for r in kept if r["kind"] == kind and r[f"take{left_out}"]) for kind in (0, 1))) for left_out in (*range(PARTS), -1)]


def _telling(a: Column, b: Column, toxic: int, clean: int, tests: Column) -> Column:
    """Whether a of the toxic and b of the clean documents is far more of the toxic ones than chance explains (G statistic)."""
    if not (toxic and clean):
        return F.lit(False)
    share = (a + b) / F.lit(toxic + clean)

    def term(n: Column, of: int, p: Column) -> Column:
        return F.when(n > 0, n * F.log(n / (of * p))).otherwise(0.0)

    g = 2 * (term(a, toxic, share) + term(b, clean, share) + term(toxic - a, toxic, 1 - share) + term(clean - b, clean, 1 - share))
    return (a / F.lit(toxic) > TIMES * b / F.lit(clean)) & (g > 2 * F.log(tests.cast("double")) + MARGIN)


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, part: np.ndarray) -> tuple[BoostedTrees, np.ndarray, np.ndarray]:
    """Trees of all rows, and a calibration from margins of trees that didn't see the row's part."""
    margins = np.zeros(len(y))
    for p in np.unique(part):
        mine = part == p
        margins[mine] = BoostedTrees(x[~mine], y[~mine], w[~mine]).margin(x[mine]) if (~mine).any() else 0
    return BoostedTrees(x, y, w), *isotonic(margins, y, w)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, seed: int = 11) -> ToxicityModel:
    """Fit on labelled documents for which crc32(doc_id as text) mod ``folds`` is not ``held``."""
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isin(0, 1) & ~fold("doc_id", folds).eqNullSafe(F.lit(held))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = [sample(known.filter(F.col("toxic") == toxic), "doc_id", most, counts.get(toxic, 0), seed).withColumn("weight", F.lit(max(1.0, counts.get(toxic, 0) / most))) for toxic, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    # about SAMPLE_TOXIC + SAMPLE_CLEAN ids at the most, so this side of the join may be broadcast
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    # an id that many rows share stands for one text, so that ids bound the rows
    picked = picked.groupBy("doc_id", "toxic", "weight").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = Stored(picked.withColumn("part", (hashed("doc_id", seed + 1) % PARTS).cast("int")), "toxicity-rows").read()
    lexicons = learn_lexicons(rows)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch["part"].to_pylist()
            own = []
            for text, p in zip(batch["text"], parts, strict=True):
                own.append(lexicons[p].features(text.as_py()).tolist())
            columns = {"toxic": batch["toxic"], "weight": batch["weight"], "part": batch["part"], "doc_id": batch["doc_id"]}
            yield pa.RecordBatch.from_pydict(columns | {"x": pa.array(own, pa.list_(pa.float64()))})

    got = rows.mapInArrow(describe, "toxic int, weight double, part int, doc_id long, x array<double>").collect()
    if len({r["toxic"] for r in got}) < 2:
        share = sum(r["weight"] * r["toxic"] for r in got) / sum(r["weight"] for r in got) if got else 0.0
        return ToxicityModel(Lexicon(), None, np.zeros(1), np.array([share]))
    got = sorted(got, key=lambda r: (r["doc_id"], r["x"]))
    x, y, w, part = (np.array([r[c] for r in got]) for c in ("x", "toxic", "weight", "part"))
    return ToxicityModel(lexicons[-1], *fit(x, y, w, part))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with score and predicted; the score reads ``text`` alone."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    model.lexicon.known.clear()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size that the sample bounds
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.clip(shared.value.scores(batch["text"].to_pylist()), 0, 1)
            new = [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(score, schema)
