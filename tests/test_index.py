"""Stems against a plain version of the algorithm, and the inverted index against scoring every chunk."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.functions import stems
from quillon.operators import inverted


class Porter:
    """The algorithm letter by letter."""

    def __init__(self, word: str):
        self.w = word

    @staticmethod
    def vowel(s: str, i: int) -> bool:
        return s[i] in "aeiou" or s[i] == "y" and i > 0 and not Porter.vowel(s, i - 1)

    @classmethod
    def measure(cls, s: str) -> int:
        kinds = [cls.vowel(s, i) for i in range(len(s))]
        return sum(a and not b for a, b in zip(kinds, kinds[1:], strict=False))

    @classmethod
    def short(cls, s: str) -> bool:
        return len(s) > 2 and not cls.vowel(s, len(s) - 3) and cls.vowel(s, len(s) - 2) and not cls.vowel(s, len(s) - 1) and s[-1] not in "wxy"

    def has_vowel(self, s: str) -> bool:
        return any(self.vowel(s, i) for i in range(len(s)))

    def longest(self, suffixes: dict[str, str], least: int) -> None:
        for suffix in sorted(suffixes, key=len, reverse=True):
            if self.w.endswith(suffix):
                s = self.w[: -len(suffix)]
                if self.measure(s) > least:
                    self.w = s + suffixes[suffix]
                return

    def mend(self, s: str) -> None:
        if s[-2:] in ("at", "bl", "iz"):
            s += "e"
        elif len(s) > 1 and s[-1] == s[-2] and not self.vowel(s, len(s) - 1) and s[-1] not in "lsz":
            s = s[:-1]
        elif self.measure(s) == 1 and self.short(s):
            s += "e"
        self.w = s

    def stem(self) -> str:
        w = self.w
        if w.endswith(("sses", "ies")):
            self.w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            self.w = w[:-1]
        w = self.w
        if w.endswith("eed"):
            if self.measure(w[:-3]) > 0:
                self.w = w[:-1]
        elif w.endswith("ed"):
            if self.has_vowel(w[:-2]):
                self.mend(w[:-2])
        elif w.endswith("ing") and self.has_vowel(w[:-3]):
            self.mend(w[:-3])
        if self.w.endswith("y") and self.has_vowel(self.w[:-1]):
            self.w = self.w[:-1] + "i"
        self.longest(stems.SECOND, 0)
        self.longest(stems.THIRD, 0)
        if self.w.endswith(("sion", "tion")):
            if self.measure(self.w[:-3]) > 1:
                self.w = self.w[:-3]
        else:
            self.longest(dict.fromkeys(stems.FOURTH, ""), 1)
        if self.w.endswith("e"):
            s = self.w[:-1]
            if self.measure(s) > 1 or self.measure(s) == 1 and not self.short(s):
                self.w = s
        if self.w.endswith("ll") and self.measure(self.w) > 1:
            self.w = self.w[:-1]
        return self.w


def test_stems_of_made_words(spark):
    rng = random.Random(1980)
    ends = [*stems.SECOND, *stems.THIRD, *stems.FOURTH, "s", "sses", "ies", "ed", "eed", "ing", "y", "e", "ll", "sion", "tion", "edly", ""]
    words = {"".join(rng.choice("aeiouybcdlstzrwx") for _ in range(rng.randint(1, 6))) + "".join(rng.choice(ends) for _ in range(rng.randint(1, 2))) for _ in range(4000)}
    words = sorted(w for w in words if len(w) > 2)
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", stems.stem(F.col("w")).alias("s")).collect()
    assert [(r.w, r.s, Porter(r.w).stem()) for r in got if r.s != Porter(r.w).stem()] == []


def full_scan(chunks, text, top):
    said = {i: Counter(Porter(w).stem() if len(w) > 2 and w.isascii() and w.isalpha() else w for w in re.findall(r"[^\W_]+", (t or "").lower())) for i, t in chunks}
    n, total = len(chunks), sum(c.total() for c in said.values())
    df = Counter(t for c in said.values() for t in c)
    out = []
    for i, c in said.items():
        score = 0.0
        for t in {Porter(w).stem() if len(w) > 2 else w for w in text.lower().split()}:
            if c[t]:
                score += math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() * n / total))
        if score:
            out.append((i, math.floor(score * 1e6 + 0.5)))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:top]


@pytest.fixture(scope="module")
def chunks():
    rng = random.Random(3)
    words = ["running", "runs", "token_value", "tokens", "relational", "relations", "happy", "été", "x1", *(f"filler{chr(97 + i)}" for i in range(20))]
    out = [(i, " ".join(rng.choices(words[9:], k=rng.randint(1, 40)))) for i in range(900)]
    out += [(1000 + i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(100)]
    return out + [(5000, "tokens tokens running"), (5001, None), (5002, ""), (5003, " -- ")]


def test_search_finds_what_a_full_scan_finds(spark, chunks, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "WINDOW", 16)
    folder = f"file://{tmp_path}/index"
    inverted.write_inverted(spark.createDataFrame(chunks, "chunk_id long, text string").repartition(3), folder)
    index = inverted.Inverted(spark, folder)
    for asked, top in (("run token", 5), ("Relation", 3), ("happy fillera runs", 10), ("été x1", 7), ("tokens runs relation happy", 1)):
        got = [tuple(r) for r in index.search(asked, top).collect()]
        assert got == full_scan(chunks, asked, top), asked
    assert index.search("nowhere", 5).count() == 0 and index.search(" - ", 5).count() == 0
    passed = index.scored("tokens runs relation happy", 1)[1]
    assert passed >= 20  # windows whose postings were never read
    plan = index.table("blocks").filter("bucket = 1").groupBy("window").agg(F.max("highest"))._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan.split("ReadSchema")[1] and "PartitionFilters: [isnotnull(bucket" in plan


def test_an_empty_index_finds_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    inverted.write_inverted(spark.createDataFrame([], "chunk_id long, text string"), folder)
    assert inverted.Inverted(spark, folder).search("a token", 5).count() == 0


def test_words_stemmed_in_workers(spark, chunks):
    words = sorted({w for _, t in chunks for w in inverted_words(t)} | {"caresses", "ponies", "agreed", "hopping", "filing", "yes", "saying", "relational", "adoption", "controll", "generalizations", "is", "café", "x1"})
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", stems.stem(F.col("w")).alias("s")).collect()
    assert [(r.w, r.s, stems.stemmed(r.w)) for r in got if r.s != stems.stemmed(r.w)] == []
    rng = random.Random(1)
    for w in {"".join(rng.choice("aeiouybcdlstz") for _ in range(rng.randint(3, 6))) + rng.choice([*stems.SECOND, *stems.THIRD, *stems.FOURTH, "ing", "ed", "s", "e"]) for _ in range(4000)}:
        assert stems.stemmed(w) == Porter(w).stem()


def inverted_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_words_are_counted_where_their_text_lies(spark, chunks):
    counted = inverted._counted(spark.createDataFrame(chunks, "chunk_id long, text string"))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = {r.chunk_id: (r.len, {c.term: c.tf for c in r.counts}) for r in counted.collect()}
    assert got == {i: (len(inverted_words(t)), dict(Counter(map(stems.stemmed, inverted_words(t))))) for i, t in chunks}


def test_blocks_over_several_batches():
    rows = [("a", 0), ("a", 0), ("a", 0), ("a", 0), ("a", 1), ("b", 1), ("b", 1)]
    table = [{"bucket": 1, "term": t, "window": w, "chunk_id": i, "gain": float(i)} for i, (t, w) in enumerate(rows)]
    schema = pa.schema([("bucket", pa.int32()), ("term", pa.string()), ("window", pa.int32()), ("chunk_id", pa.int64()), ("gain", pa.float64())])
    for each in (1, 2, 3, 7):
        batches = (pa.RecordBatch.from_pylist(table[i : i + each], schema) for i in range(0, len(table), each))
        got = [(b["term"], b["window"], b["highest"], b["size"], [p["chunk_id"] for p in b["postings"]]) for out in inverted._blocks(batches) for b in out.to_pylist()]
        assert got == [("a", 0, 3.0, 4, [0, 1, 2, 3]), ("a", 1, 4.0, 1, [4]), ("b", 1, 6.0, 2, [5, 6])]


def test_texts_of_one_chunk_add_up(spark, tmp_path):
    folder = f"file://{tmp_path}/twice"
    rows = [(1, "token here"), (1, "tokens there"), (2, "token token"), (3, "nothing"), (None, "tokens")]
    inverted.write_inverted(spark.createDataFrame(rows, "chunk_id long, text string"), folder)
    got = [tuple(r) for r in inverted.Inverted(spark, folder).search("token", 5).collect()]
    # five rows of eight words; the term is in chunk 1 twice as one of two words, in 2 twice, in the nameless one once
    idf, gain = math.log((5 - 3 + 0.5) / (3 + 0.5) + 1), lambda tf, size: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size * 5 / 8))
    want = {1: gain(2, 2), 2: gain(2, 2), None: gain(1, 1)}
    assert {i: s for i, s in got} == {i: math.floor(idf * g * 1e6 + 0.5) for i, g in want.items()}
