"""CBOR (RFC 8949): encoding, deterministic encoding and decoding, and Arrow-batched column functions."""

from __future__ import annotations

import json
import math
import struct
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


@dataclass(frozen=True)
class Tag:
    number: int
    value: Any


@dataclass(frozen=True)
class Simple:
    number: int


UNDEFINED = Simple(23)


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << (8 * size):
            return bytes([major << 5 | code]) + n.to_bytes(size, "big")
    raise ValueError("a length or tag beyond 64 bits")


def _float(x: float, shortest: bool) -> bytes:
    if math.isnan(x):
        return b"\xf9\x7e\x00"
    if shortest:
        for code, form in ((b"\xf9", ">e"), (b"\xfa", ">f")):
            try:
                packed = struct.pack(form, x)
            except OverflowError:
                continue
            if struct.unpack(form, packed)[0] == x:
                return code + packed
    return b"\xfb" + struct.pack(">d", x)


def encode(value: Any, deterministic: bool = False) -> bytes:
    """Encoded value. Deterministic: map keys in the byte order of their encodings, floats in the shortest form that keeps them."""
    again = lambda x: encode(x, deterministic)
    match value:
        case None:
            return b"\xf6"
        case bool():
            return b"\xf5" if value else b"\xf4"
        case int() if -(1 << 64) <= value < 1 << 64:
            return _head(0, value) if value >= 0 else _head(1, -1 - value)
        case int():
            n = value if value >= 0 else -1 - value
            return again(Tag(2 if value >= 0 else 3, n.to_bytes((n.bit_length() + 7) // 8, "big")))
        case float():
            return _float(value, deterministic)
        case bytes():
            return _head(2, len(value)) + value
        case str():
            raw = value.encode()
            return _head(3, len(raw)) + raw
        case list() | tuple():
            return _head(4, len(value)) + b"".join(map(again, value))
        case dict():
            pairs = [(again(k), again(v)) for k, v in value.items()]
            return _head(5, len(pairs)) + b"".join(k + v for k, v in (sorted(pairs) if deterministic else pairs))
        case Tag():
            return _head(6, value.number) + again(value.value)
        case Simple():
            return bytes([0xE0 | value.number]) if value.number < 24 else bytes([0xF8, value.number])
    raise TypeError(f"{type(value).__name__} has no CBOR form")


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the data ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, depth: int = 0) -> Any:
        if depth > 200:
            raise ValueError("nested too deep")
        first = self.take(1)[0]
        major, info = first >> 5, first & 31
        if info in (28, 29, 30) or (info == 31 and major in (0, 1, 6)):
            raise ValueError("a reserved length")
        n = info if info < 24 else int.from_bytes(self.take(1 << (info - 24)), "big") if info < 28 else None
        if major == 7:
            return self.special(info, n)
        if major < 2:
            return n if major == 0 else -1 - n
        if major < 4:
            raw = self.take(n) if n is not None else b"".join(self.parts(depth))
            return raw if major == 2 else raw.decode()
        if major == 4:
            return [self.value(depth + 1) for _ in range(n)] if n is not None else list(self.items(depth))
        if major == 5:
            flat = [self.value(depth + 1) for _ in range(2 * n)] if n is not None else list(self.items(depth))
            return dict(zip(flat[::2], flat[1::2], strict=True))
        inner = self.value(depth + 1)
        if n in (2, 3) and isinstance(inner, bytes):
            big = int.from_bytes(inner, "big")
            return big if n == 2 else -1 - big
        return Tag(n, inner)

    def special(self, info: int, n: int | None) -> Any:
        if info < 20 or info == 24:
            return Simple(n)
        if info in (25, 26, 27):
            size = 1 << (info - 24)
            return struct.unpack({2: ">e", 4: ">f", 8: ">d"}[size], self.data[self.at - size : self.at])[0]
        if info == 31:
            raise ValueError("a break outside an open item")
        return {20: False, 21: True, 22: None, 23: UNDEFINED}[info]

    def items(self, depth: int):
        while self.data[self.at : self.at + 1] != b"\xff":
            yield self.value(depth + 1)
        self.at += 1

    def parts(self, depth: int):
        for x in self.items(depth):
            yield x.encode() if isinstance(x, str) else x


def decode(data: bytes) -> Any:
    reader = _Reader(data)
    out = reader.value()
    if reader.at != len(data):
        raise ValueError("more data follows")
    return out


def decode_head(data: bytes, n: int) -> tuple[list, bytes]:
    """The first n elements of an array, and the bytes of the others, which stay as they are."""
    reader = _Reader(data)
    first = reader.take(1)[0]
    if first >> 5 != 4 or first & 31 > 27:
        raise ValueError("not an array of known length")
    size = first & 31 if first & 31 < 24 else int.from_bytes(reader.take(1 << ((first & 31) - 24)), "big")
    return [reader.value() for _ in range(min(n, size))], data[reader.at :]


def by_distinct(values: pd.Series, f) -> pd.Series:
    """f of each value of a batch, worked out once for equal ones; null for null, and where f finds the value broken."""

    def one(x):
        try:
            return f(x)
        except (ValueError, TypeError):
            return None

    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    out = [*map(one, distinct), None]  # nulls have the code -1
    return pd.Series([out[c] for c in codes.tolist()], dtype=object)


@F.pandas_udf(BinaryType())
def from_json_text(text: pd.Series) -> pd.Series:
    """CBOR (deterministic) of JSON texts; null where the text is null or no JSON."""
    return by_distinct(text, lambda t: encode(json.loads(t), deterministic=True))


@F.pandas_udf(StringType())
def to_json_text(data: pd.Series) -> pd.Series:
    """JSON (sorted keys) of CBOR values; null where the data is null or broken."""
    return by_distinct(data, lambda b: json.dumps(decode(bytes(b)), sort_keys=True, separators=(",", ":"), ensure_ascii=False))
