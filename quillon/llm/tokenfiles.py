"""Token-ID output: Arrow files of equal-length sequences and masks.

The ids of all documents, each with an end id, form one stream in ascending
doc_id order. It is dealt out to shards by ranges of doc_id; each shard is one
Arrow IPC file whose columns ``ids`` (in the smallest type that holds the
vocabulary) and ``mask`` (bits) are fixed-size lists of ``length`` entries, so
sequence i of a file lies at a computed place and is read from the memory map
without copying. The last sequence of a shard is padded with zeros, and its mask
says so. A second, small Arrow file beside it says where each document lies, so a
folder is read back from its files alone.

Files are written under a temporary name and then renamed, with contents that
depend on the rows alone, so a task that is run again gives the same files.

Edge cases: null or empty text gives the end id alone; texts of any length are
read whole, in sections; rows with equal doc_id follow each other by a hash of
their texts, so that null doc_ids, which come first, spread over shards; an empty
table gives no files; further columns are left alone, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import WIDE_SPACE, BoundedCache, bounded_batches, filesystem, new_folder, parts, sections, text_bytes

#: Text bytes of one shard.
SHARD_BYTES = 32 << 20
#: Sequences, and documents, in one record batch of a file.
BATCH_SEQUENCES, BATCH_DOCUMENTS = 512, 8192
#: Bytes that a Python worker's cache of pieces may hold, and new words that go to the tokenizer together.
PIECE_BYTES, TOGETHER = 176 << 20, 2000

#: Letters of texts that are encoded together.
GROUP = 1 << 16

_S = r"\t\n\x0b\x0c\r " + WIDE_SPACE
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
#: ASCII but for letters, spaces and ', and blocks of other signs without a letter or space; letters of any script are left out, as a pre-token may go on after them.
_SIGN = r"\x00-\x08\x0e-\x1f!-&(-@\[-`{-\x84\x86-\x9f\xa1-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7\u200b-\u2027\u202a-\u202e\u2030-\u205e\u2060-\u2064\u20a0-\u20c0\u2190-\u2bff\u3001-\u3003\u3008-\u301f\uff01-\uff20"
#: Letters before a plain sign, signs and digits before a letter, and whatever is left of a run.
_PIECE = re.compile(rf" ?[{_L}]++(?=[\x00-\x26\x28-\x40\x5b-\x60\x7b-\x7f]|\Z)| ?[{_SIGN}]+(?=[{_L}{_S}]|\Z)| ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def id_type(vocabulary: int) -> np.dtype:
    """The smallest unsigned type that holds every id."""
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


class PieceEncoder:
    """The tokenizer's ids, with those of each piece of text kept.

    A text is cut into pieces where byte-level pre-tokens end in any context, so
    its ids are those of its pieces, one after another; most pieces are a word
    and the space before it. New pieces of letters after a space go to the
    tokenizer as one text, told apart by their bytes. Texts that hold one of the
    added tokens go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(names.values()) + 1, np.int64)  # a byte-level token has a letter for each byte
        self.widths[list(names.values())] = list(map(len, names))
        self.known = BoundedCache(PIECE_BYTES)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.type).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        words = [p for p in new if p[:1] == " " and p[1:].isalpha()]
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            found = self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0]
            ids = np.array(found.ids, dtype=self.type)
            ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in part])
            cuts = ((np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1) * self.type.itemsize).tolist()
            raw = ids.tobytes()
            self.known.put_all(part, [raw[i:j] for i, j in zip([0, *cuts], cuts, strict=False)])
        other = list(new.difference(words))
        self.known.put_all(other, self._ids(other))

    def _group(self, parts: list[str]) -> list[bytes]:
        """The ids of parts of texts; what is new in any of them is learned at once."""
        self.known.trim()
        get, cut, new = self.known.get, [], set()
        for part in parts:
            pieces = _PIECE.findall(part)
            found = list(map(get, pieces))
            if None in found:
                new.update(p for p, ids in zip(pieces, found, strict=True) if ids is None)
                found = None
            cut.append((pieces, found))
        if new:
            self._learn(new)
        known = self.known.__getitem__
        return [b"".join(map(known, pieces) if found is None else found) for pieces, found in cut]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of ``type`` for each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, rows, held = [], [], 0

        def flush() -> None:
            for row, ids in zip(rows, self._group(waiting), strict=True):
                out[row].append(ids)

        for row, text in enumerate(texts):
            if any(t in text for t in self.added):
                out[row].append(self._ids([text])[0])
                continue
            for part in sections(text):
                waiting.append(part)
                rows.append(row)
                held += len(part)
                if held >= GROUP:
                    flush()
                    waiting, rows, held = [], [], 0
        flush()
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def sequence_schema(length: int, ids: np.dtype) -> pa.Schema:
    """Ids of the given type, and one bit of mask each."""
    return pa.schema([(name, pa.list_(pa.field("item", kind, nullable=False), length)) for name, kind in (("ids", pa.from_numpy_dtype(ids)), ("mask", pa.bool_()))])


_DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Writes one shard: ``add`` takes a document's ids as bytes and gives their place in it."""

    def __init__(self, fs: pafs.FileSystem, path: str, documents: str, length: int, ids: np.dtype):
        self.fs, self.length, self.type, self.schema = fs, length, ids, sequence_schema(length, ids)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        self.paths = [(f"{p}.{attempt}.tmp", p) for p in (documents, path)]
        self.sinks = [fs.open_output_stream(temporary) for temporary, _ in self.paths]
        self.documents, self.writer = (pa.ipc.new_file(sink, schema) for sink, schema in zip(self.sinks, (_DOCUMENTS, self.schema), strict=True))
        self.waiting, self.held, self.n, self.rows = [], 0, 0, []

    def add(self, ids: bytes, doc_id: int | None = None) -> int:
        at, n = self.n, len(ids) // self.type.itemsize
        self.n += n
        self.rows.append((doc_id, at, n))
        if len(self.rows) >= BATCH_DOCUMENTS:
            self._flush_rows()
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.type.itemsize * self.length * BATCH_SEQUENCES:
            self._flush(False)
        return at

    def _flush_rows(self) -> None:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), _DOCUMENTS, strict=True)]
            self.documents.write_batch(pa.RecordBatch.from_arrays(columns, schema=_DOCUMENTS))
        self.rows = []

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.waiting), dtype=self.type)
        unit = self.length * BATCH_SEQUENCES
        full = len(flat) // unit * unit
        for i in range(0, full, unit):
            self._write(flat[i : i + unit], unit)
        rest = flat[full:]
        if last and len(rest):
            self._write(rest, -(-len(rest) // self.length) * self.length)
            rest = rest[:0]
        self.waiting, self.held = [rest.tobytes()], rest.nbytes

    def _write(self, ids: np.ndarray, room: int) -> None:
        padded, mask = np.zeros(room, self.type), np.zeros(room, bool)
        padded[: len(ids)], mask[: len(ids)] = ids, 1
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip((padded, mask), self.schema, strict=True)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        self._flush_rows()
        self._flush(True)
        for writer, sink, (temporary, path) in zip((self.documents, self.writer), self.sinks, self.paths, strict=True):
            writer.close()
            sink.close()
            self.fs.move(temporary, path)


class SequenceFile:
    """Random access to a shard; memory-mapped where the file system is local."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self._batch = (-1, None)

    def _flat(self, k: int) -> np.ndarray:
        if self._batch[0] != k:
            self._batch = (k, self.reader.get_batch(k).column("ids").values.to_numpy(zero_copy_only=True))
        return self._batch[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``."""
        batch = self.reader.get_batch(i // BATCH_SEQUENCES)
        at = i % BATCH_SEQUENCES * self.length
        ids, mask = (batch.column(c).values[at : at + self.length] for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def pieces(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of the ids from ``start`` on, ``n`` in all."""
        unit = self.length * BATCH_SEQUENCES
        while n:
            k, at = divmod(start, unit)
            piece = self._flat(k)[at : at + n]
            yield piece
            start, n = start + len(piece), n - len(piece)


def _name(shard: int) -> str:
    return f"tokens-{shard:08d}.arrow"


def _documents_name(shard: int) -> str:
    return f"documents-{shard:08d}.arrow"


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, length: int = 2048) -> int:
    """Write the files of all documents into ``folder``; how many ids they hold."""
    bounded_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        coder, writer = encoder(tokenizer_path), None
        end = np.array([end_id], coder.type).tobytes()
        for batch in batches:
            if writer is None:
                writer = SequenceWriter(fs, f"{root}/{_name(shard)}", f"{root}/{_documents_name(shard)}", length, coder.type)
            found = coder.encode_all([t or "" for t in batch["text"].to_pylist()])
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), found, strict=True):
                writer.add(ids + end, doc_id)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"n": pa.array([writer.n], pa.int64())})

    shards = parts(text_bytes(docs), SHARD_BYTES, 4)
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_key")]
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    return ordered.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def shards_of(spark: SparkSession, folder: str) -> DataFrame:
    """(shard) of each pair of files in the folder, a task each."""
    fs, root = filesystem(folder)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    shards = sorted(int(f.base_name[10:18]) for f in found if re.fullmatch(r"documents-\d{8}\.arrow", f.base_name))
    if not shards:
        return spark.createDataFrame([], "shard long")
    # shards without a row have no file
    return spark.range(0, shards[-1] + 1, 1, shards[-1] + 1).withColumnRenamed("id", "shard")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone.

    ``start`` counts the ids of all documents before. What the driver holds is one
    number a shard, so it stays small beside any input.
    """
    shards = shards_of(spark, folder)

    def documents(fs: pafs.FileSystem, root: str, shard: int) -> pa.Table | None:
        path = f"{root}/{_documents_name(shard)}"
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with fs.open_input_file(path) as source:
            return pa.ipc.open_file(source).read_all()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for shard in batch["shard"].to_pylist():
                if rows := documents(fs, root, shard):
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n": pa.array([pc.sum(rows["n_tokens"]).as_py()], pa.int64())})

    offset, offsets = 0, {}
    for row in sorted(shards.mapInArrow(total, "shard long, n long").collect()):
        offsets[row["shard"]] = offset
        offset += row["n"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for shard in batch["shard"].to_pylist():
                rows = documents(fs, root, shard)
                file = SequenceFile(fs, f"{root}/{_name(shard)}") if rows else None
                for part in rows.to_batches() if rows else ():
                    crcs = []
                    for at, n in zip(part["at"].to_pylist(), part["n_tokens"].to_pylist(), strict=True):
                        crc = 0
                        for piece in file.pieces(at, n):
                            crc = zlib.crc32(piece.astype("<u4"), crc)
                        crcs.append(crc)
                    start = pa.array(part["at"].to_numpy() + offsets[shard], pa.int64())
                    yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "start": start, "n_tokens": part["n_tokens"], "ids_crc32": pa.array(crcs, pa.int64())})

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 0, length: int = 2048, folder: str | None = None) -> DataFrame:
    """Write all documents to the shared folder and read them back."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, folder, end_id, length)
    return read_tokens(docs.sparkSession, folder)
