"""Joint states in CDR (little endian, alignment from the byte after the header)."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

JOINT_STATE = "struct<stamp_ns:bigint,frame_id:string,name:array<string>,position:array<double>,velocity:array<double>,effort:array<double>>"


def joint_state(data: bytes) -> dict:
    """Fields of one message; a header other than little-endian CDR is a ValueError."""
    if data[:2] != b"\x00\x01":
        raise ValueError("only little-endian CDR can be decoded")
    at = 4

    def number(kind: str, width: int):
        nonlocal at
        at += -(at - 4) % width
        (x,) = struct.unpack_from("<" + kind, data, at)
        at += width
        return x

    def text() -> str:
        nonlocal at
        n = number("I", 4)
        at += n
        return data[at - n : at - 1].decode()

    stamp = number("i", 4) * 1_000_000_000 + number("I", 4)
    frame = text()
    names = [text() for _ in range(number("I", 4))]
    vectors = [[number("d", 8) for _ in range(number("I", 4))] for _ in range(3)]
    return {"stamp_ns": stamp, "frame_id": frame, "name": names, "position": vectors[0], "velocity": vectors[1], "effort": vectors[2]}


def decoded(data: Column) -> Column:
    """A struct of a joint state's fields; null stays null."""

    def over(raw: pa.Array) -> pa.Array:
        numbers = pa.list_(pa.float64())
        kind = pa.struct([("stamp_ns", pa.int64()), ("frame_id", pa.string()), ("name", pa.list_(pa.string())), ("position", numbers), ("velocity", numbers), ("effort", numbers)])
        return pa.array([None if x is None else joint_state(x) for x in raw.to_pylist()], kind)

    return F.arrow_udf(over, JOINT_STATE)(data)
