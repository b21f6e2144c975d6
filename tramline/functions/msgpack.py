"""MessagePack: encoding, decoding, and batched column functions."""

from __future__ import annotations

import json
import struct
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .cbor import by_distinct


def _sized(n: int, small: tuple[int, int] | None, forms: list[tuple[int, str]]) -> bytes:
    """The head of a value of size n: in the first byte if it is small, else by the first form that holds it."""
    if small and n < small[1]:
        return bytes([small[0] | n])
    for code, form in forms:
        if n < 1 << 8 * struct.calcsize(form):
            return bytes([code]) + struct.pack(form, n)
    raise ValueError("too large for MessagePack")


def encode(value: Any) -> bytes:
    """The shortest form; numbers with a point as 64 bits."""
    kind = type(value)
    if value is None:
        return b"\xc0"
    if kind is bool:
        return b"\xc3" if value else b"\xc2"
    if kind is int:
        if value >= 0:
            return bytes([value]) if value < 128 else _sized(value, None, [(0xCC, ">B"), (0xCD, ">H"), (0xCE, ">I"), (0xCF, ">Q")])
        if value >= -32:
            return struct.pack("b", value)
        for code, form in ((0xD0, ">b"), (0xD1, ">h"), (0xD2, ">i"), (0xD3, ">q")):
            if value >= -(1 << 8 * struct.calcsize(form) - 1):
                return bytes([code]) + struct.pack(form, value)
        raise ValueError("too large for MessagePack")
    if kind is float:
        return b"\xcb" + struct.pack(">d", value)
    if kind is str:
        raw = value.encode()
        return _sized(len(raw), (0xA0, 32), [(0xD9, ">B"), (0xDA, ">H"), (0xDB, ">I")]) + raw
    if kind is bytes:
        return _sized(len(value), None, [(0xC4, ">B"), (0xC5, ">H"), (0xC6, ">I")]) + value
    if kind in (list, tuple):
        return _sized(len(value), (0x90, 16), [(0xDC, ">H"), (0xDD, ">I")]) + b"".join(map(encode, value))
    if kind is dict:
        return _sized(len(value), (0x80, 16), [(0xDE, ">H"), (0xDF, ">I")]) + b"".join(encode(k) + encode(v) for k, v in value.items())
    raise TypeError(f"{kind.__name__} has no MessagePack form")


# Codes of numbers and of sized values (fixed values).
NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
SIZED = {0xC4: (bytes, ">B"), 0xC5: (bytes, ">H"), 0xC6: (bytes, ">I"), 0xD9: (str, ">B"), 0xDA: (str, ">H"), 0xDB: (str, ">I"), 0xDC: (list, ">H"), 0xDD: (list, ">I"), 0xDE: (dict, ">H"), 0xDF: (dict, ">I")}


def _read(data: bytes, at: int, depth: int = 0) -> tuple[Any, int]:
    if depth > 200:
        raise ValueError("nested too deep")
    if at >= len(data):
        raise ValueError("the data ends early")
    code, at = data[at], at + 1
    if code < 0x80 or code >= 0xE0:
        return (code if code < 0x80 else code - 256), at
    if code in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[code], at
    form = NUMBERS.get(code)
    if form:
        size = struct.calcsize(form)
        if at + size > len(data):
            raise ValueError("the data ends early")
        return struct.unpack_from(form, data, at)[0], at + size
    if code < 0xC0:
        kind, n = (dict, code & 15) if code < 0x90 else (list, code & 15) if code < 0xA0 else (str, code & 31)
    elif code in SIZED:
        kind, form = SIZED[code]
        size = struct.calcsize(form)
        if at + size > len(data):
            raise ValueError("the data ends early")
        n, at = struct.unpack_from(form, data, at)[0], at + size
    else:
        raise ValueError("an extension or a reserved code")
    if kind in (str, bytes):
        if at + n > len(data):
            raise ValueError("the data ends early")
        raw = data[at : at + n]
        return (raw.decode() if kind is str else raw), at + n
    out = []
    for _ in range(n * (2 if kind is dict else 1)):
        x, at = _read(data, at, depth + 1)
        out.append(x)
    return (dict(zip(out[::2], out[1::2], strict=True)) if kind is dict else out), at


def decode(data: bytes) -> Any:
    value, at = _read(data, 0)
    if at != len(data):
        raise ValueError("more data follows")
    return value


def decode_head(data: bytes, n: int) -> tuple[list, bytes]:
    """The first n elements of an array, and the bytes of the others, which stay as they are."""
    if not data or not (0x90 <= data[0] < 0xA0 or data[0] in (0xDC, 0xDD)):
        raise ValueError("not an array")
    size, at = (data[0] & 15, 1) if data[0] < 0xA0 else (int.from_bytes(data[1 : 3 if data[0] == 0xDC else 5], "big"), 3 if data[0] == 0xDC else 5)
    out = []
    for _ in range(min(n, size)):
        x, at = _read(data, at)
        out.append(x)
    return out, data[at:]


@F.pandas_udf(BinaryType())
def from_json_text(text: pd.Series) -> pd.Series:
    """MessagePack of JSON texts; null where the text is null or no JSON."""
    return by_distinct(text, lambda t: encode(json.loads(t)))


@F.pandas_udf(StringType())
def to_json_text(data: pd.Series) -> pd.Series:
    """JSON (sorted keys) of MessagePack values; null where the data is null or broken."""
    return by_distinct(data, lambda b: json.dumps(decode(bytes(b)), sort_keys=True, separators=(",", ":"), ensure_ascii=False))
