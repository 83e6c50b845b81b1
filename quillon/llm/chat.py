"""Conversations to training text: a template, a state machine over roles, and loss masks.

A template declares how the turns of each role open and close, which of them are
trained on, and in which order roles may follow each other. A finite-state
machine walks the turns of a conversation, says which of them are out of order,
and emits segments of text, each with a flag whether it is under the loss.

Control strings inside texts and roles are escaped: a backslash is doubled, and
one is put after the first character of a control string, so that an escaped
text never holds one. ``read_turns`` gives roles and texts back exactly.

Long conversations are cut into chunks of turns, and chunks are formatted side
by side. What a chunk does to the machine is a map from states to states; maps
are composed along a conversation, a row for ``1 << CHUNK_BITS`` turns, which
tells each chunk in which state it begins.

Turns are ordered by ``turn`` (nulls last), then role, then text; a repeated row
is a turn of its own, and turns with equal numbers stay in one chunk. Null roles
and texts are empty; rows with a null conversation make up one conversation. A
role that the template doesn't name is written with its name, is out of order
and leaves the state as it is. Very long texts are escaped whole. An empty table
has no rows in the result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Stored, bounded_batches

#: A chunk is this many bits' worth of turn numbers; a piece of output ends after so many code points.
CHUNK_BITS, PIECE_CHARS = 9, 1 << 16
BATCH_CHARS = 1 << 21


@dataclass(frozen=True)
class Turn:
    """How a turn is marked, and whether its text is trained on."""

    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``moves``: from a state, by role, to the next; the machine begins in ``start``.

    After a turn out of order the state is the one that ``after`` names for its role.
    ``lead`` is written before a turn of the roles in ``leads[state]``. ``other`` marks
    turns of unnamed roles; its ``opens`` and ``names_end`` enclose the role's name.
    """

    turns: dict[str, Turn]
    moves: dict[str, dict[str, str]]
    after: dict[str, str]
    control: tuple[str, ...]
    other: Turn
    names_end: str
    lead: str = ""
    leads: dict[str, tuple[str, ...]] = field(default_factory=dict)
    start: str = "start"

    def __post_init__(self) -> None:
        marks = [self.other.closes, self.names_end, *(t.closes for t in self.turns.values())]
        opens = [self.lead, self.other.opens, *(t.opens for t in self.turns.values())]
        for c in self.control:
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"control string {c!r}: two characters at least, and no backslash")
            if any(d != c and c in d or any(c.endswith(d[:n]) for n in range(1, len(d))) for d in self.control):
                raise ValueError(f"control string {c!r} overlaps another")
        has = lambda text: any(c in text for c in self.control)
        for m in marks:
            borders = [s for s in range(1, len(m)) if m[s:] == m[: len(m) - s]]
            if not has(m) or not all(has(m[:s]) for s in borders):
                raise ValueError(f"mark {m!r} may end within a text")
        opens = [o for o in opens if o]
        if any(a != b and a.startswith(b) for a in opens for b in opens) or len(set(opens)) < len(opens):
            raise ValueError("marks that open a turn must tell roles apart")

    @cached_property
    def states(self) -> list[str]:
        named = {self.start, *self.moves, *self.after.values(), *(s for m in self.moves.values() for s in m.values())}
        return [self.start, *sorted(named - {self.start})]

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The state after a turn, and whether the turn is in order."""
        to = self.moves.get(state, {}).get(role)
        return (to, True) if to else (self.after.get(role, state), False)

    @cached_property
    def _escapes(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, ("\\", *self.control))))

    def escape(self, text: str) -> str:
        return self._escapes.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text

    def segments(self, state: str, role: str, text: str) -> tuple[list[tuple[str, bool]], str, bool]:
        """A turn's segments of text and loss flags, the state after it, and whether it is in order."""
        turn = self.turns.get(role)
        opens = turn.opens if turn else f"{self.other.opens}{self.escape(role)}{self.names_end}"
        if self.lead and role in self.leads.get(state, ()):
            opens = self.lead + opens
        turn = turn or self.other
        to, ordered = self.step(state, role)
        return [(opens, False), (self.escape(text), turn.loss), (turn.closes, False)], to, ordered

    @cached_property
    def _turn(self) -> re.Pattern:
        each = [f"{re.escape(t.opens)}(?P<t{i}>.*?){re.escape(t.closes)}" for i, t in enumerate(self.turns.values())]
        each.append(f"{re.escape(self.other.opens)}(?P<role>.*?){re.escape(self.names_end)}(?P<text>.*?){re.escape(self.other.closes)}")
        return re.compile(f"(?:{re.escape(self.lead)})?(?:{'|'.join(each)})", re.DOTALL)

    def read_turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """Roles and texts of formatted turns."""
        at, roles = 0, list(self.turns)
        while at < len(formatted):
            m = self._turn.match(formatted, at)
            if not m:
                raise ValueError(f"no turn of the template at {at}: {formatted[at : at + 40]!r}")
            kind = m.lastgroup
            role = self.unescape(m["role"]) if kind == "text" else roles[int(kind[1:])]
            yield role, self.unescape(m[kind])
            at = m.end()


#: Marks in the manner of Llama 2; a system turn stands by itself.
INSTRUCT = Template(
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn(" ", " </s>", loss=True),
    },
    moves={
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
    after={"system": "system", "user": "user", "assistant": "assistant"},
    control=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<</END>>"),
    other=Turn("<<ROLE>>", "<</END>>"),
    names_end="<</ROLE>>",
    lead="<s>",
    leads={"start": ("system", "user"), "assistant": ("system", "user")},
)

_KEYS = ["conv_id", "chunk"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _chunk_maps(turns: DataFrame, template: Template) -> DataFrame:
    """What each chunk does to each state: conv_id, chunk, to (a state's number for each)."""
    number = {s: i for i, s in enumerate(template.states)}
    moves: dict[str, list[int]] = {}

    def move(role: str) -> list[int]:
        if role not in moves:
            if len(moves) > 10_000:
                moves.clear()
            moves[role] = [number[template.step(s, role)[0]] for s in template.states]
        return moves[role]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, chunk), rows in groupby(_rows(batches), key=lambda r: r[:2]):
            to = list(range(len(number)))
            for row in rows:
                by = move(row[2])
                to = [by[s] for s in to]
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([chunk], pa.int64()), pa.array([to], pa.list_(pa.int32()))], ["conv_id", "chunk", "to"])

    sorted_ = turns.select(*_KEYS, "role", "turn").repartition(*_KEYS).sortWithinPartitions(*_KEYS, F.asc_nulls_last("turn"), "role")
    return sorted_.drop("turn").mapInArrow(_batched(fold), "conv_id long, chunk long, to array<int>")


def _batched(function, rows: int = 5000):
    """Small batches of a function over batches, gathered into larger ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in function(batches):
            held.append(batch)
            if len(held) >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def _beginnings(maps: DataFrame) -> DataFrame:
    """The state in which each chunk of a conversation of several chunks begins, by composing the maps before it."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def ready() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "chunk", "state"])

        for _, rows in groupby(_rows(batches), key=lambda r: r[0]):
            conv, chunk, to = next(rows)
            rest = next(rows, None)
            if not rest:
                continue
            state = 0
            out.append((conv, chunk, state))
            while rest:
                state = to[state]
                conv, chunk, to = rest
                out.append((conv, chunk, state))
                if len(out) >= 10_000:
                    yield ready()
                    out.clear()
                rest = next(rows, None)
        yield ready()

    ordered = maps.repartition("conv_id").sortWithinPartitions(*_KEYS)
    return ordered.mapInArrow(compose, "conv_id long, chunk long, state int")


_PIECE = pa.schema([
    ("conv_id", pa.int64()), ("chunk", pa.int64()), ("piece", pa.int32()), ("whole", pa.bool_()), ("formatted", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("n_turns", pa.int32()), ("out_of_order", pa.list_(pa.int32())),
])
PIECES = (
    "conv_id long, chunk long, piece int, whole boolean, formatted string, loss array<struct<start:int,stop:int>>, "
    "n_turns int, out_of_order array<int>"
)


def format_chats(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as pieces of formatted text.

    A piece holds whole turns of one conversation; its pieces by ``chunk`` and
    ``piece`` make up the conversation, most often a single one (``whole``). ``loss``
    has the code points, from and up to, that are trained on; ``out_of_order`` the
    turns of the piece, counted from 0, that the machine doesn't allow.
    """
    bounded_batches(turns.sparkSession)
    chunk = F.coalesce(F.shiftright("turn", CHUNK_BITS), F.lit((1 << 63) - 1))
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    rows = turns.select("conv_id", chunk.alias("chunk"), "turn", role, text)
    begin = Stored(_beginnings(_chunk_maps(rows, template)), "chat-states").read()
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("text", "string"))]
    both = rows.withColumn("state", F.lit(None).cast("int")).unionByName(begin.select(*_KEYS, *nothing, "state"))
    order = [*_KEYS, F.asc_nulls_last("state"), F.asc_nulls_last("turn"), "role", "text"]
    together = both.repartition(*_KEYS).sortWithinPartitions(*order).select(*_KEYS, "state", "role", "text")
    states = template.states

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        """A row that says in which state a chunk begins comes before the chunk's turns; a chunk without one is a conversation."""
        for (conv, chunk), group in groupby(rows, key=lambda r: r[:2]):
            state, alone, number = template.start, True, 0
            out, loss, bad, n, at = [], [], [], 0, 0
            for _, _, begins, role, text in group:
                if begins is not None:
                    state, alone = states[begins], False
                    continue
                if at >= PIECE_CHARS:
                    yield conv, chunk, number, False, "".join(out), loss, n, bad
                    out, loss, bad, n, at, number = [], [], [], 0, 0, number + 1
                parts, state, ordered = template.segments(state, role, text)
                for part, trained in parts:
                    out.append(part)
                    if trained and part:
                        loss.append({"start": at, "stop": at + len(part)})
                    at += len(part)
                if not ordered:
                    bad.append(n)
                n += 1
            yield conv, chunk, number, alone and not number, "".join(out), loss, n, bad

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        as_batch = lambda: pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in held], f.type) for i, f in enumerate(_PIECE)], schema=_PIECE
        )
        for row in pieces(_rows(batches)):
            held.append(row)
            size += len(row[4])
            if size >= BATCH_CHARS:
                yield as_batch()
                held, size = [], 0
        yield as_batch()

    return together.mapInArrow(write, PIECES)


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_out_of_order long"
)


def _digests(pieces: DataFrame, template: Template) -> DataFrame:
    """A row for each conversation whose pieces follow each other in a partition; holds one piece at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = n_loss = n_chars = n_bad = 0
            for _, formatted, spans, bad in group:
                for role, text in template.read_turns(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for span in spans:
                    text = template.unescape(formatted[span["start"] : span["stop"]])
                    loss.update(text.encode())
                    n_loss += len(text)
                n_chars += len(formatted)
                n_bad += len(bad)
            row = (conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars, n_bad)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            names = [c.split()[0] for c in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return pieces.select("conv_id", "formatted", "loss", "out_of_order").mapInArrow(_batched(read), DIGESTS)


def chat_digests(pieces: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Turns and trained text of formatted conversations, read back from their pieces.

    Conversations of one piece are read where they lie. Only longer ones are brought
    together, and read in one stream each, as a digest of all their text has to be.
    """
    bounded_batches(pieces.sparkSession)
    longer = pieces.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "piece")
    return _digests(pieces.filter("whole"), template).unionByName(_digests(longer, template))


def written_chats(turns: DataFrame, template: Template = INSTRUCT, extra: Iterable[tuple] = ()) -> DataFrame:
    """``format_chats`` written to the shared folder; ``extra`` turns (conv_id, turn, role, text) are added."""
    turns = turns.select("conv_id", "turn", "role", "text")
    if extra:
        more = turns.sparkSession.createDataFrame(list(extra), "conv_id long, turn long, role string, text string")
        turns = turns.unionByName(more)
    return Stored(format_chats(turns, template), "chats").read()
