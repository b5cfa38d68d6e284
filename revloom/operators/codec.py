"""Canonical encoding of objects: a kind byte, then fields in order; numbers in 7-bit groups, texts and lists with their length first."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similar import put_number, take_number

# The kinds, and the names of tags in order.
BLOB, TREE, CHANGE, SESSION, REVIEW = range(1, 6)
VERIFICATIONS, VERDICTS = ["unverified", "green", "red"], ["approve", "request-changes", "reject", "comment"]
#: The fields of each kind: n number, s text, i id, I list of ids, S list of texts, o optional id, b flag, v verification, d verdict, E entries.
LAYOUT = {
    TREE: [("entries", "E")],
    CHANGE: [("parents", "I"), ("tree", "i"), ("session", "o"), ("intent", "s"), ("author", "s"), ("ts", "n"), ("verification", "v")],
    SESSION: [("task", "s"), ("model", "s"), ("lesson", "s"), ("prompts", "o"), ("context_served", "o"), ("tool_calls", "I"), ("tool_results", "I"), ("verification", "v"), ("tokens_in", "n"), ("tokens_out", "n")],
    REVIEW: [("target", "i"), ("reviewer", "s"), ("by_human", "b"), ("verdict", "d"), ("summary", "s"), ("labels", "S"), ("findings", "I")],
}


class Malformed(ValueError):
    """Its argument is one of: truncated, trailing, bad-kind, bad-tag, bad-text, bad-number."""


@dataclass
class Object:
    kind: int
    fields: dict = field(default_factory=dict)


def encode(obj: Object) -> bytes:
    out = bytearray([obj.kind])
    if obj.kind == BLOB:
        return bytes(out) + obj.fields["content"]

    def text(s: str) -> None:
        raw = s.encode()
        put_number(out, len(raw))
        out.extend(raw)

    for name, form in LAYOUT[obj.kind]:
        v = obj.fields[name]
        if form == "n":
            put_number(out, v)
        elif form == "s":
            text(v)
        elif form == "i":
            out.extend(v)
        elif form == "o":
            out.append(v is not None)
            out.extend(v or b"")
        elif form in "IS":
            put_number(out, len(v))
            for x in v:
                text(x) if form == "S" else out.extend(x)
        elif form == "b":
            out.append(bool(v))
        elif form in "vd":
            out.append((VERIFICATIONS if form == "v" else VERDICTS).index(v))
        else:
            put_number(out, len(v))
            for entry_name, mode, child in sorted(v, key=lambda e: e[0].encode()):
                text(entry_name)
                put_number(out, mode)
                out.extend(child)
    return bytes(out)


def decode(data: bytes) -> Object:
    if not data:
        raise Malformed("truncated")
    if data[0] == BLOB:
        return Object(BLOB, {"content": data[1:]})
    if data[0] not in LAYOUT:
        raise Malformed("bad-kind")
    at = 1

    def raw(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise Malformed("truncated")
        at += n
        return data[at - n : at]

    def number() -> int:
        nonlocal at
        got = take_number(data, at)
        if got is None or got[0] >= 1 << 64:
            raise Malformed("truncated" if got is None and at + 10 > len(data) else "bad-number")
        at = got[1]
        return got[0]

    def text() -> str:
        try:
            return raw(number()).decode()
        except UnicodeDecodeError:
            raise Malformed("bad-text") from None

    def tag(names: list):
        k = raw(1)[0]
        if k >= len(names):
            raise Malformed("bad-tag")
        return names[k]

    def entries():
        for _ in range(number()):
            name = text()
            mode = number()
            yield name, mode, raw(32)

    def optional() -> bytes | None:
        return raw(32) if tag([False, True]) else None

    read = {
        "n": number, "s": text, "i": lambda: raw(32), "o": optional, "I": lambda: [raw(32) for _ in range(number())], "S": lambda: [text() for _ in range(number())],
        "b": lambda: tag([False, True]), "v": lambda: tag(VERIFICATIONS), "d": lambda: tag(VERDICTS), "E": lambda: list(entries()),
    }
    fields = {name: read[form]() for name, form in LAYOUT[data[0]]}
    if at != len(data):
        raise Malformed("trailing")
    return Object(data[0], fields)


def decoded(rows: DataFrame) -> DataFrame:
    """rows(id, data binary) -> (id, kind, error, fields as JSON with ids in hex) (F-36, F-37)."""
    import json

    def run(batches):
        show = lambda v: v.hex() if isinstance(v, bytes) else [show(x) for x in v] if isinstance(v, list | tuple) else v
        for b in batches:
            kinds, errors, fields = [], [], []
            for data in b.column(1).to_pylist():
                try:
                    obj = decode(data or b"")
                    kinds.append(obj.kind)
                    errors.append(None)
                    fields.append(json.dumps({k: show(v) for k, v in obj.fields.items()}, sort_keys=True))
                except Malformed as e:
                    kinds.append(None)
                    errors.append(e.args[0])
                    fields.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.int32()), pa.array(errors, pa.string()), pa.array(fields, pa.string())], names=["id", "kind", "error", "fields"])

    return rows.select(F.col("id").cast("string").alias("id"), F.col("data").cast("binary").alias("data")).mapInArrow(run, "id string, kind int, error string, fields string")
