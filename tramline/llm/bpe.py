"""Byte-level BPE with a local rank file."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Characters of text that go to the library at once; longer texts are split at safe boundaries.
CHUNK = 200_000
#: No match of the pattern spans the place between a character that isn't white space and a space or line feed:
#: white space only starts a match or follows white space, and the look-ahead concerns runs of white space alone.
#: Python's \s holds all that the library's \s holds, so (?<=\S) is the stricter of the two.
SAFE = re.compile(r"(?<=\S)[ \n]")
#: The library's pattern goes back step by step in a run of white space, which overflows its stack in long ones. Runs of
#: this length are found here instead. The characters are those with the property White_Space (fixed values).
RUN = 10_000
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)


@lru_cache(maxsize=4)
def encoding(path: str, special: tuple = ()):
    """The tiktoken encoding of a rank file, one for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


def chunks(text: str, size: int = CHUNK):
    """Consecutive parts of a text whose encodings joined are the encoding of the whole."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode_one(enc, text: str) -> np.ndarray:
    """The ids of a whole text. A long run of white space is one match of the pattern but for its last character, which
    is left to what follows, if something does; it is encoded as one piece."""
    parts, at = [], 0
    for run in LONG_RUN.finditer(text) if len(text) >= RUN else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        parts += [np.array(enc.encode_ordinary(part), np.uint32) for part in chunks(text[at : run.start()])]
        parts.append(np.array(enc._core_bpe.encode_single_piece(text[run.start() : end].encode()), np.uint32))
        at = end
    parts += [np.array(enc.encode_ordinary(part), np.uint32) for part in chunks(text[at:] if at else text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def encode_texts(docs: DataFrame, path: str = RANKS, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Id, `n_tokens` and `ids` (binary: the ids as little-endian unsigned 32-bit integers) of every whole text.

    Null and empty texts have no ids; ids of rows may be null or repeat, a row goes in and a row comes out; other
    columns aren't read. Long texts are split where no match of the pattern can span, in bounded pieces (a run without
    any white space stays whole; a run of white space may be of any length). With `decoded`, also that column of
    `decode_ids`. No shuffle; a lost task is simply run again.
    """

    def run(batches):
        enc = encoding(path)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids = [encode_one(enc, t or "") for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array([x.astype("<u4", copy=False).tobytes() for x in ids], pa.binary())]
            if decoded:
                columns.append(pa.array([enc.decode_bytes(x.tolist()) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "n_tokens", "ids", "decoded"][: 3 + decoded]
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_tokens long, ids binary" + ", decoded binary" * decoded)
    return out.withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """`encoded` with `decoded`, the raw bytes of its `ids`: not always UTF-8 where ids were cut inside a character. Null ids: null."""
    names = encoded.columns

    def run(batches):
        enc = encoding(path)
        for batch in batches:
            raw = [None if x is None else enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in batch.column(names.index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*names, "decoded"])

    from pyspark.sql.types import BinaryType, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add("decoded", BinaryType()))


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    out = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
