"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its words' subwords: the character
2-, 3- and 4-grams between word marks and the word itself, hashed into a table. A
linear softmax over that average gives the language. Table and weights are fitted
by stochastic gradient descent in numpy, on the driver, in class-balanced steps
until the loss on documents held back stops falling.

Training reads a sample of at most about ``SAMPLE_DOCUMENTS`` labelled training
documents, evenly from all languages, each of them whole: every document is cut
into consecutive spans of random lengths, short and long, that together hold each
of its words once. The cutting and hashing runs on the executors; the driver gets
counts of buckets, whose size the sample and the table bound, whatever the texts.

A fifth of the sampled documents is never fitted. It sets the softmax temperature
(least log loss) and the score below which a prediction is rejected: the one with
the fewest errors, where an accepted wrong prediction and a rejected right one
are an error each; the lowest such score, and ``FLOOR`` if nothing is wrong.

Scoring adds up, for each text, the logits that its subwords' buckets stand for,
in numpy over the code points of many texts at once; every word of every text is
counted, and nothing is kept from one batch to the next.

Edge cases: texts that are null or hold no letter are ``und`` with score 0 and
are rejected; without any labelled training row every text is ``und``; words of
any length are hashed whole; equal scores go to the first language by name; a
null doc_id is not in the held-out fold; repeated rows are rows of their own; an
empty table stays empty; columns named lang_pred, score or rejected are replaced,
all other columns play no part and pass through.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import bounded_batches, sections
from quillon.llm.sampling import distinct_rows, fold, hashed, sample_condition

#: The bound on the labelled documents that are fitted.
SAMPLE_DOCUMENTS = 2400
#: The rejection where the documents held back have no wrong prediction, and the highest one.
FLOOR, CEILING = 0.35, 0.9
BITS, DIMS = 15, 16
BUCKETS = 1 << BITS
#: Spans of a training document at most.
SPANS = 6
BATCH, RATE, MOMENTUM, EPOCHS, PATIENCE, LEAST_STEPS, ENOUGH = 64, 4.0, 0.9, 40, 3, 40, 2e-3
#: Letters that are hashed at a time.
GROUP = 1 << 18
UNKNOWN = "und"

_OPEN, _CLOSE = 60, 62
_A, _C = np.uint32(0x01000193), np.uint32(0x9E3779B1)


@cache
def _kinds() -> np.ndarray:
    """For each code point 1 if it is a letter, 2 if a mark, else 0."""
    kinds = {"L": 1, "M": 2}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def normal(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()


def _buckets(h: np.ndarray, salt: int) -> np.ndarray:
    return ((h ^ np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF)) * _C) >> np.uint32(32 - BITS)


def subwords(codes: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For an array of code points: where each word begins; and for each kind of subword the words, in order, and the buckets."""
    kind = _kinds()[codes]
    wordly = kind > 0
    inside = wordly
    if (kind == 2).any():  # marks before a run's first letter are none of its word
        at = np.arange(len(codes))
        first = wordly & ~np.concatenate(([False], wordly[:-1]))
        run = np.maximum.accumulate(np.where(first, at, -1))
        letter = np.maximum.accumulate(np.where(kind == 1, at, -1))
        inside = wordly & (letter >= run) & (run >= 0)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, []
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    sizes = np.flatnonzero(ends) + 1 - starts
    # each word between marks of its beginning and end
    heads = np.cumsum(sizes + 2) - sizes - 2
    number = np.arange(len(starts), dtype=np.int32)
    owner = np.repeat(number, sizes + 2)
    marked = np.empty(len(owner), np.uint32)
    letters = np.ones(len(owner), bool)
    letters[heads] = letters[heads + sizes + 1] = False
    marked[heads], marked[heads + sizes + 1] = _OPEN, _CLOSE
    marked[letters] = codes[inside]
    out = []
    h = marked
    for n in (2, 3, 4):
        h = h[:-1] * _A + marked[n - 1 :]
        whole = owner[: len(h)] == owner[n - 1 :]
        out.append((owner[: len(h)][whole], _buckets(h[whole], n)))
    spot = np.arange(len(marked), dtype=np.uint32) - np.repeat(heads.astype(np.uint32), sizes + 2)
    each = (marked + spot * _A) * _C
    out.append((number, _buckets(np.add.reduceat(each ^ (each >> np.uint32(15)), heads, dtype=np.uint32), 9)))
    return starts, out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    """``table``: logits that each bucket adds; ``least``: the score below which a prediction is rejected."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def _sums(self, texts: list[str]) -> np.ndarray:
        """For each text the sum of its subwords' logits, and in the last column their number."""
        out = np.zeros((len(texts), len(self.labels) + 1))
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts, found = subwords(_codes("\n".join(texts)))
        firsts = np.searchsorted(starts, np.concatenate(([0], ends[:-1])))  # each text's first word
        for word, bucket in found:
            cuts = np.searchsorted(word, firsts)
            n = np.diff(np.append(cuts, len(word)))
            some = n > 0
            if some.any():
                out[some, :-1] += np.add.reduceat(self.table[bucket], cuts[some], axis=0)
                out[:, -1] += n
        return out

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """As ``_sums``, of whole texts, in groups of about ``GROUP`` letters."""
        out = np.zeros((len(texts), len(self.labels) + 1))
        waiting, rows, held = [], [], 0

        def flush() -> None:
            nonlocal waiting, rows, held
            if waiting:
                np.add.at(out, rows, self._sums(waiting))
            waiting, rows, held = [], [], 0

        for row, text in enumerate(texts):
            for part in sections(text or ""):
                part = normal(part)
                waiting.append(part)
                rows.append(row)
                held += len(part) + 1
                if held >= GROUP:
                    flush()
        flush()
        return out

    def logits(self, sums: np.ndarray) -> np.ndarray:
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and which are rejected."""
        if not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        sums = self.sums(texts)
        p = _softmax(self.logits(sums) / self.temperature)
        best, some = p.argmax(axis=1), sums[:, -1] > 0
        score = np.where(some, p.max(axis=1), 0.0)
        return [self.labels[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)], score, ~some | (score < self.least)


def spans(text: str, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and their counts, for consecutive spans of the text that together hold each of its words once."""
    counts: list[np.ndarray] = []
    found = [subwords(_codes(normal(part))) for part in sections(text)]
    n = sum(len(starts) for starts, _ in found)
    if not n:
        return []
    ends = []
    while len(ends) < SPANS - 1 and (ends[-1] if ends else 0) < n:
        ends.append((ends[-1] if ends else 0) + int(np.exp(rng.uniform(np.log(2), np.log(n + 1)))))
    ends = [*(e for e in ends if e < n), n]
    counts = [np.zeros(BUCKETS, np.int64) for _ in ends]
    before = 0
    for starts, kinds in found:
        for word, bucket in kinds:
            cuts = np.searchsorted(word + before, [0, *ends])
            for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                counts[k] += np.bincount(bucket[i:j], minlength=BUCKETS)
        before += len(starts)
    return [(np.flatnonzero(c), c[c > 0]) for c in counts]


class _Rows:
    """Sparse rows of shares of buckets."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.at = [b.astype(np.uint16) for b, _ in rows]
        self.share = [(c / c.sum()).astype(np.float32) for _, c in rows]

    def __len__(self) -> int:
        return len(self.at)

    def dense(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that these rows have, and a matrix of their shares."""
        flat = np.concatenate([self.at[i] for i in rows])
        used = np.zeros(BUCKETS, bool)
        used[flat] = True
        columns = np.flatnonzero(used)
        place = np.cumsum(used) - 1
        x = np.zeros((len(rows), len(columns)), np.float32)
        x[np.repeat(np.arange(len(rows)), [len(self.at[i]) for i in rows]), place[flat]] = np.concatenate([self.share[i] for i in rows])
        return columns, x


def fit(rows: list[tuple[str, list[tuple[np.ndarray, np.ndarray]]]], seed: int = 7) -> LanguageModel:
    """Fit on four fifths of the documents (language, spans), calibrate on the rest."""
    rng = np.random.default_rng(seed)
    rows = [r for r in rows if r[1]]
    labels = sorted({lang for lang, _ in rows})
    if len(rows) < 2:
        return LanguageModel(labels, np.zeros((BUCKETS, len(labels))), np.zeros(len(labels)), 1.0, FLOOR)
    place = {lang: k for k, lang in enumerate(labels)}
    held = np.zeros(len(rows), bool)
    for k in range(len(labels)):  # of every language
        mine = rng.permutation([i for i, (lang, _) in enumerate(rows) if place[lang] == k])
        held[mine[: len(mine) // 5]] = True
    picked = {part: [(place[lang], s) for (lang, every), h in zip(rows, held.tolist(), strict=True) if h == part for s in every] for part in (False, True)}
    x, y = _Rows([s for _, s in picked[False]]), np.array([k for k, _ in picked[False]])
    # whole documents are tested beside their spans
    tests = picked[True] + [(place[lang], _together(every)) for (lang, every), h in zip(rows, held.tolist(), strict=True) if h]
    hx, hy = _Rows([s for _, s in tests]), np.array([k for k, _ in tests], np.int64)
    table = rng.normal(0, 1 / DIMS**0.5, (BUCKETS, DIMS)).astype(np.float32)
    weights, bias = rng.normal(0, 1 / DIMS**0.5, (DIMS, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32)
    speed, weights_speed, bias_speed = np.zeros_like(table), np.zeros_like(weights), np.zeros_like(bias)
    by_class = [np.flatnonzero(y == k) for k in range(len(labels))]
    present = [k for k, mine in enumerate(by_class) if len(mine)]

    def logits(part: _Rows) -> np.ndarray:
        out = [np.zeros((0, len(labels)))]
        for i in range(0, len(part), BATCH):
            columns, dense = part.dense(np.arange(i, min(len(part), i + BATCH)))
            out.append(dense @ table[columns] @ weights + bias)
        return np.concatenate(out)

    best, left, kept = np.inf, PATIENCE, (table.copy(), weights.copy(), bias.copy())
    steps = max(LEAST_STEPS, -(-len(x) // BATCH))
    for _ in range(EPOCHS):
        for _ in range(steps):
            of = rng.choice(present, BATCH)
            batch = np.array([by_class[k][rng.integers(len(by_class[k]))] for k in of.tolist()])
            columns, dense = x.dense(batch)
            mean = dense @ table[columns]
            error = _softmax(mean @ weights + bias)
            error[np.arange(BATCH), y[batch]] -= 1
            error /= BATCH
            back = dense.T @ (error @ weights.T)
            weights_speed = MOMENTUM * weights_speed + mean.T @ error
            bias_speed = MOMENTUM * bias_speed + error.sum(axis=0)
            speed[columns] = MOMENTUM * speed[columns] + back
            table[columns] -= RATE * speed[columns]
            weights -= 0.1 * RATE * weights_speed
            bias -= 0.1 * RATE * bias_speed
        if not len(hx):
            continue
        loss = -np.log(_softmax(logits(hx))[np.arange(len(hy)), hy] + 1e-30).mean()
        if loss < best - 5e-4:
            best, left, kept = loss, PATIENCE, (table.copy(), weights.copy(), bias.copy())
        else:
            left -= 1
        if not left or best < ENOUGH:
            break
    if len(hx):
        table, weights, bias = kept
    model = LanguageModel(labels, (table @ weights).astype(np.float64), bias.astype(np.float64), 1.0, FLOOR)
    if len(hx):
        model.temperature, model.least = _calibrated(logits(hx).astype(np.float64), hy)
    return model


def _together(every: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    c = np.zeros(BUCKETS, np.int64)
    for at, n in every:
        c[at] += n
    return np.flatnonzero(c), c[c > 0]


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature of the least log loss, and the rejection of the fewest errors."""
    scales = np.geomspace(0.5, 20, 80)
    at = np.arange(len(y))
    temperature = float(scales[np.argmin([-np.log(_softmax(z / t)[at, y] + 1e-300).mean() for t in scales])])
    p = _softmax(z / temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    if right.all():
        return temperature, FLOOR
    levels = np.linspace(FLOOR, CEILING, 111)
    errors = [int((right & (score < t)).sum() + (~right & (score >= t)).sum()) for t in levels]
    return temperature, float(levels[int(np.argmin(errors))])


def train(docs: DataFrame, folds: int = 4, held: int = 2, most: int = SAMPLE_DOCUMENTS, seed: int = 7) -> LanguageModel:
    """Fit on training documents: labelled, and crc32(doc_id as text) mod ``folds`` not ``held``."""
    bounded_batches(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~fold("doc_id", folds).eqNullSafe(F.lit(held))).select("doc_id", "text", "lang")
    # a row a language; a row that repeats counts, and is drawn, once
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(distinct_rows("doc_id", "text").alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    each = -(-most // len(counts))
    # of every language about as many, in one pass
    chosen = rows.filter(reduce(or_, (sample_condition("doc_id", each, n, seed, "text") & (F.col("lang") == lang) for lang, n in sorted(counts.items()))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, draw in zip(batch["text"], batch["draw"].to_pylist(), strict=True):
                every = spans(text.as_py(), np.random.default_rng([seed, draw]))
                sizes = np.array([len(b) for b, _ in every], np.int64)
                flat = np.concatenate([np.stack(s).astype(np.uint32).ravel() for s in every]) if every else np.zeros(0, np.uint32)
                found.append((sizes.tobytes(), zlib.compress(flat.tobytes(), 1)))
            columns = list(zip(*found, strict=True)) if found else [(), ()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "lang": batch["lang"], "sizes": pa.array(columns[0], pa.binary()), "flat": pa.array(columns[1], pa.binary())})

    drawn = chosen.dropDuplicates(["doc_id", "text", "lang"]).select("doc_id", "lang", "text", hashed("doc_id", seed + 1, "text").alias("draw"))
    got = drawn.mapInArrow(cut, "doc_id long, lang string, sizes binary, flat binary").collect()
    ready = []
    for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["sizes"], r["flat"])):
        flat, at, every = np.frombuffer(zlib.decompress(r["flat"]), np.uint32), 0, []
        for n in np.frombuffer(r["sizes"], np.int64).tolist():
            every.append((flat[at : at + n].astype(np.uint16), flat[at + n : at + 2 * n].copy()))
            at += 2 * n
        ready.append((r["lang"], every))
    return fit(ready, seed)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; the prediction reads ``text`` alone."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    state = (model.labels, model.table, model.bias, model.temperature, model.least)
    shared = docs.sparkSession.sparkContext.broadcast(state)  # a fixed table, whatever the input
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = LanguageModel(*shared.value)
        for batch in batches:
            lang, score, rejected = mine.predict(batch["text"].to_pylist())
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(predict, schema)
