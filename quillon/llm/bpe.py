"""BPE encoding and decoding of lower-casing word vocabularies.

Each short word is encoded over a contiguous rank array: the part boundaries and
the rank of the pair that begins at each part. The array is scanned for the
least rank, the boundary inside that pair is deleted, and the ranks on its two
sides are looked up anew, until no pair has a rank. Scanning a few contiguous
entries beats any heap on words of usual length.

The tokenizer's file states the rest: NFC, lower case, the split pattern, the
byte alphabet and the end-of-word suffix. Added tokens in a text are tokens of
their own. Decoding joins the tokens' strings by a space, as the file names no
decoder.

A word of more than ``SHORT`` parts keeps its parts in a linked list instead and
takes the merges of one rank at a time, from the left; the result is the same,
in about linear time, so a run of a million letters is a word like any other.

Memory: a text is encoded in sections that end at white space, a worker's caches
are bounded by bytes, and a batch of results is given on for every
``GROUP_IDS`` ids; only the ids and the decoded form of a single text are ever
held whole.

Edge cases: null or empty text gives no ids and an empty decoded text; runs of
letters of any length are words and are encoded whole; white space of any kind
separates and is dropped; repeated rows and null doc_ids are rows like any
other; an empty table stays empty; columns of the documents that are named like
a new one are replaced, all others pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.llm.common import WIDE_SPACE, BoundedCache, bounded_batches, sections

_NONE = 1 << 60
#: Parts of a word above which the rank array gives way to a linked list.
SHORT = 64
#: Bytes that a Python worker's caches of chunks and of words may hold.
CHUNK_BYTES, WORD_BYTES = 48 << 20, 24 << 20
#: Ids of one batch of results, unless a single text has more.
GROUP_IDS = 1 << 18
_SPACES = regex.compile(f"[\t\n\x0b\x0c\r {WIDE_SPACE}]+")
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0
    for byte in range(256):
        if byte in plain:
            out[byte] = chr(byte)
        else:
            out[byte] = chr(256 + spare)
            spare += 1
    return out


class Unicode(NamedTuple):
    """What the tokenizers library takes for letters, digits and spaces, and small letters that Python doesn't know of."""

    classes: dict[str, str]
    small: dict[int, str]


@cache
def library_unicode(path: str) -> Unicode:
    """The library's Unicode, by asking the file's own split and normalizer; tables differ from library to library.

    Each character that any table here calls a letter or digit is shown to the split
    between two others: a letter joins the one before it, a digit stands alone, a sign
    joins the one after it. Characters that Python's tables don't hold are normalized.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    every = "".join(map(chr, [*range(128, 0xD800), *range(0xE000, 0x110000)]))
    asked = sorted({*regex.findall(r"[\p{L}\p{N}]", every), *(c for c in every if unicodedata.category(c)[0] in "LN")})
    spans = {s for _, s in library.pre_tokenizer.pre_tokenize_str("".join(f"a{c}_\n" for c in asked))}
    letters = [c for i, c in enumerate(asked) if (4 * i, 4 * i + 2) in spans]
    digits = [c for i, c in enumerate(asked) if (4 * i + 1, 4 * i + 2) in spans]
    unknown = [c for c in every if unicodedata.category(c) == "Cn"]
    normal = library.normalizer.normalize_str("-".join(unknown)).split("-")
    small = {ord(c): n for c, n in zip(unknown, normal, strict=True) if c != n}
    return Unicode({r"\p{L}": "A-Za-z" + ranges(letters), r"\p{N}": "0-9" + ranges(digits), r"\s": "\t-\r " + WIDE_SPACE}, small)


def ranges(letters: list[str]) -> str:
    """Sorted characters as the ranges of a character class."""
    codes = np.array([ord(c) for c in letters])
    if not len(codes):
        return ""
    cuts = np.flatnonzero(np.diff(codes) > 1)
    pairs = zip(codes[np.append(0, cuts + 1)].tolist(), codes[np.append(cuts, len(codes) - 1)].tolist(), strict=True)
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in pairs)


class WordBPE:
    """Encodes and decodes with a word-level BPE file of the tokenizers library."""

    def __init__(self, path: str, known: Unicode | None = None):
        known = known or library_unicode(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.merged = [self.vocab[a + b] for a, b in merges]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (self.vocab | self.added).items()}
        self.type = np.dtype("<u2") if max(names) < 1 << 16 else np.dtype("<u4")
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())
        self.decimals = pa.array(range(len(self.names)), pa.int32()).cast(pa.string())
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        for name, own in known.classes.items():
            pattern = pattern.replace(name, own)
        self.words = re.compile(pattern)
        self.small = known.small
        self.large = re.compile(f"[{''.join(map(chr, self.small))}]") if self.small else None
        added = "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))
        self.cut = regex.compile(f"({added})") if added else None
        alphabet = byte_alphabet()
        self.inner = [self.vocab.get(c) for c in alphabet]
        self.final = [self.vocab.get(c + self.suffix) for c in alphabet]
        self.known, self.known_words = BoundedCache(CHUNK_BYTES), BoundedCache(WORD_BYTES)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, by the contiguous rank array, or by linked parts if there are many."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        parts = [i for i in ids if i is not None]
        if len(parts) > SHORT:
            return self._merge_linked(parts)
        rank, merged = self.ranks.get, self.merged
        ranks = [rank(pair, _NONE) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) != _NONE:
            at = ranks.index(least)
            parts[at] = merged[least]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), _NONE)
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), _NONE)
        return parts

    def _merge_linked(self, parts: list[int]) -> list[int]:
        """The same merges in the same order: the least rank first, and of one rank the leftmost pair."""
        rank, merged, n = self.ranks.get, self.merged, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}  # of each rank; a place whose pair has changed since is passed over
        now = [rank(pair, _NONE) for pair in zip(parts, parts[1:], strict=False)] + [_NONE]
        for at, r in enumerate(now):
            if r != _NONE:
                places.setdefault(r, []).append(at)
        heap = list(places)
        heapq.heapify(heap)

        def put(at: int) -> int:
            """Note the rank of the pair that begins at ``at``."""
            follower = after[at]
            r = now[at] = rank((parts[at], parts[follower]), _NONE) if follower < n else _NONE
            if r != _NONE:
                if r in places:
                    places[r].append(at)
                else:
                    places[r] = [at]
                    heapq.heappush(heap, r)
            return r

        while heap:
            least = heapq.heappop(heap)
            turn = sorted(places.pop(least))
            new = merged[least]
            for k, at in enumerate(turn):
                if now[at] != least:
                    continue
                gone = after[at]
                parts[at] = new
                now[gone] = _NONE
                follower = after[at] = after[gone]
                if follower < n:
                    before[follower] = at
                lowest = put(at)
                if before[at] >= 0:
                    lowest = min(lowest, put(before[at]))
                if lowest <= least:  # it comes first: what is left of this turn waits
                    rest = turn[k + 1 :]
                    if least in places:
                        places[least] += rest
                    elif rest:
                        places[least] = rest
                        heapq.heappush(heap, least)
                    break
        out, at = [], 0
        while at < n:
            out.append(parts[at])
            at = after[at]
        return out

    def _word(self, word: str) -> bytes:
        ids = self.known_words.get(word)
        if ids is None:
            ids = np.array(self.encode_word(word), self.type).tobytes()
            self.known_words.put(word, ids)
        return ids

    def normalized(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if self.large and self.large.search(text):
            text = text.translate(self.small)
        # lower case letter by letter: a capital sigma has one form everywhere
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunks(self, text: str) -> list[str]:
        """The text's runs without white space, in order; added tokens aside."""
        text = self.normalized(text)
        if _ODD_SPACE.search(text):
            return [c for c in _SPACES.split(text) if c]
        return text.split()

    def _section(self, text: str) -> bytes:
        if self.cut and any(a in text for a in self.added):
            pieces = self.cut.split(text)
            added = self.added
            return b"".join([np.array([added[p]], self.type).tobytes() if p in added else self._section(p) for p in pieces])
        chunks, known = self.chunks(text), self.known
        known.trim()
        for chunk in {c for c in chunks if c not in known}:
            known.put(chunk, b"".join([self._word(w) for w in self.words.findall(chunk)]))
            self.known_words.trim()
        return b"".join([known[c] for c in chunks])

    def encode_bytes(self, text: str) -> bytes:
        """The text's ids as little-endian integers of ``type``."""
        return b"".join([self._section(s) for s in sections(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), self.type).tolist()

    def _joined(self, strings: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), strings.take(pa.array(ids)))
        return pc.binary_join(lists, " ")

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """For each run of ids between two offsets the tokens' strings, joined by a space."""
        return self._joined(self.names, ids, offsets)

    def numbers(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """For each run of ids between two offsets the decimal ids, joined by a space."""
        return self._joined(self.decimals, ids, offsets)

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by a space."""
        return self.decoded(np.array(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


_CODERS: dict[str, WordBPE] = {}


def coder(path: str, known: Unicode) -> WordBPE:
    """The coder of this Python worker."""
    if path not in _CODERS:
        _CODERS[path] = WordBPE(path, known)
    return _CODERS[path]


def _digests(strings: pa.Array) -> pa.Array:
    """SHA-256 in hex of each string, read from the array's own buffer."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int32)[: len(strings) + 1].tolist()
    view = memoryview(data) if data else b""
    return pa.array([hashlib.sha256(view[i:j]).hexdigest() for i, j in zip(at, at[1:], strict=False)], pa.string())


def bpe_encode(docs: DataFrame, tokenizer_path: str, texts_too: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids and decoded, or with their SHA-256 instead if not ``texts_too``.

    No shuffle: every document is encoded where it is read.
    """
    bounded_batches(docs.sparkSession)
    known = library_unicode(tokenizer_path)
    new = {"n_tokens": T.LongType()}
    if texts_too:
        new |= {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    else:
        new |= {"ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    docs = docs.drop(*new)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in new.items())])

    def grouped(bpe: WordBPE, batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
        """Rows in order: where each group begins, and its rows' ids."""
        first, found, held = 0, [], 0
        for at, text in enumerate(batch["text"]):
            found.append(bpe.encode_bytes(text.as_py() or ""))
            held += len(found[-1])
            if held >= GROUP_IDS * bpe.type.itemsize:
                yield first, found
                first, found, held = at + 1, [], 0
        if found:
            yield first, found

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer_path, known)
        for batch in batches:
            for first, found in grouped(bpe, batch):
                sizes = np.array(list(map(len, found)), np.int64) // bpe.type.itemsize
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                ids = np.frombuffer(b"".join(found), bpe.type)
                columns = [pa.array(sizes, pa.int64())]
                if texts_too:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))))
                    columns.append(bpe.decoded(ids, offsets))
                else:
                    columns.append(_digests(bpe.numbers(ids, offsets)))
                    columns.append(_digests(bpe.decoded(ids, offsets)))
                rows = batch.slice(first, len(found))
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, *new])

    return docs.mapInArrow(encode, schema)
