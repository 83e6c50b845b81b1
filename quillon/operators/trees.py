"""Configuration files as one table: a row for each node of a YAML, JSON or TOML file.

A file is parsed once, in an Arrow batch, into a generic tree; what its entries
mean is then said by columns over key paths, on the JVM, whatever the format.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for the step from a list to one of its items.
ITEM = "[]"
_NODE = pa.struct([
    ("doc", pa.int32()), ("ord", pa.int32()), ("at", pa.list_(pa.string())), ("id", pa.list_(pa.int32())), ("kind", pa.string()), ("value", pa.string()),
])
NODES = "node struct<doc:int,ord:int,at:array<string>,id:array<int>,kind:string,value:string>"


def _yaml(text: str) -> list:
    import yaml

    return [d for d in yaml.load_all(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if d is not None]


#: The documents of a text, by format.
READERS: dict[str, Callable[[str], list]] = {"yaml": _yaml, "json": lambda text: [json.loads(text)], "toml": lambda text: [tomllib.loads(text)]}


def documents(text: str | None, form: str) -> list:
    """The documents of a file; none if it can't be parsed."""
    import yaml

    try:
        found = READERS[form](text or "")
    except (ValueError, RecursionError, yaml.YAMLError):
        return []
    return found if _spelled_out(found, len(text or "")) else []


def _below(value: object) -> list[tuple[str, object]]:
    """The keys and values below a node."""
    if isinstance(value, dict):
        return [(str(k), v) for k, v in value.items()]
    return [(ITEM, v) for v in value] if isinstance(value, list) else []


def _spelled_out(found: list, most: int) -> bool:
    """Whether a tree has no more nodes than its text has letters; only aliases that contain themselves, or each other over and over, have."""
    waiting, n = list(found), 0
    while waiting and n <= most + len(found):
        n += 1
        waiting += [v for _, v in _below(waiting.pop())]
    return not waiting


def _shown(value: object, form: str) -> tuple[str, str | None]:
    """The kind of a node and its value as text; lists and maps as JSON, whose keys are sorted in YAML."""
    if value is None:
        return "null", None
    if isinstance(value, str):
        return "text", value
    kind = {dict: "map", list: "list", bool: "bool", int: "number", float: "number"}.get(type(value), "text")
    return kind, json.dumps(value, sort_keys=form == "yaml", default=str)


def nodes_of(text: str | None, form: str) -> Iterator[tuple]:
    """(doc, ord, at, id, kind, value) of every node, those below the root in the order of the file.

    ``at`` has the keys from the root, ``id`` the places among siblings, which tell
    any two nodes of a document apart.
    """
    for doc, root in enumerate(documents(text, form)):
        n = 0
        waiting = [((), (), root)]
        while waiting:
            at, places, value = waiting.pop()
            if at:
                yield doc, n, at, places, *_shown(value, form)
                n += 1
            waiting += [((*at, k), (*places, i), v) for i, (k, v) in reversed(list(enumerate(_below(value))))]


def nodes(files: DataFrame, form: Column) -> DataFrame:
    """The nodes of ``files`` (…, text), each file in the format that ``form`` says: its other columns, and ``node``."""
    kept = [f for f in files.schema.fields if f.name != "text"]
    names = [f.name for f in kept]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, (text, kind) in enumerate(zip(batch["text"].to_pylist(), batch["form_"].to_pylist(), strict=True)):
                own = list(nodes_of(text, kind))
                rows += [i] * len(own)
                found += own
            columns = list(zip(*found, strict=True)) if found else [()] * _NODE.num_fields
            own = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE, strict=True)], fields=list(_NODE))
            same = batch.select(names).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*same.columns, own], [*names, "node"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return files.withColumn("form_", form).filter("form_ IS NOT NULL").mapInArrow(parse, f"{schema}, {NODES}")


def lies_at(*steps: str | None, deeper: bool = False) -> Column:
    """Whether a node's keys are these (None: any key); with ``deeper``, or begin with them."""
    at = F.col("node.at")
    size = F.size(at)
    ok = size >= len(steps) if deeper else size == len(steps)
    for i, step in enumerate(steps):
        if step is not None:
            ok = ok & (F.get(at, F.lit(i)) == step)
    return ok


def key(place: int) -> Column:
    """The key at a place of the path, from 0."""
    return F.get(F.col("node.at"), F.lit(place))
