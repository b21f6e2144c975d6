"""Order-preserving packing of documents into training sequences."""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encode_one, encoding
from .words import slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WINDOW = 1024
#: Costs of a cut, in tokens of padding: after a document, after a sentence.
DOCUMENT, SENTENCE = 0, 3
#: Cuts elsewhere cost a whole window each, and are tried only in stretches longer than a window without a document's or
#: sentence's end: at every so many tokens of them.
GRID = 32
#: Tokens that one run of the dynamic program takes, and windows at its end that are left to the next one.
BLOCK, LEFT = 1 << 19, 8
#: The vocabulary's special token, found before any other (fixed values).
SPECIAL, END_OF_TEXT = re.compile(re.escape("<|endoftext|>")), np.array([50256], np.uint32)


def cuts(positions: list[int], costs: list[int], window: int) -> list[int]:
    """Places to cut so that padding plus costs are least: indexes into positions, from the first to the last.

    f[j] = min over i with positions[j] - positions[i] <= window of f[i] + window - (positions[j] - positions[i]) +
    costs[j]. With key[i] = f[i] + positions[i] that is a sliding minimum, so key[j] = min key[i] + window + costs[j];
    a queue with rising keys gives it in amortised constant time. Ties go to the longer window.
    """
    n = len(positions)
    before, queue, keys = [0] * n, [0] * n, [0] * n
    head, tail = 0, 1  # queue[head:tail] holds indexes, keys[head:tail] their keys
    keys[0] = positions[0]
    for j in range(1, n):
        low = positions[j] - window
        while positions[queue[head]] < low:
            head += 1
        before[j] = queue[head]
        key = keys[head] + window + costs[j]
        while tail > head and keys[tail - 1] > key:
            tail -= 1
        queue[tail] = j
        keys[tail] = key
        tail += 1
    path = [n - 1]
    while path[-1]:
        path.append(before[path[-1]])
    return path[::-1]


def ends_sentence(path: str) -> np.ndarray:
    """For each id of the vocabulary, whether its text ends a sentence or a line."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    out = np.zeros(max(vocabulary.values()) + 2, bool)
    for token, i in vocabulary.items():
        out[i] = token.endswith((".", "!", "?")) or "Ċ" in token  # that letter stands for a line feed
    return out


class Packer:
    """Takes documents in order, gives pieces; holds a block of ids and no more than one document beyond it."""

    def __init__(self, sentence: np.ndarray, window: int = WINDOW, first: int = 0):
        self.sentence, self.window, self.sequence = sentence, window, first
        self.docs: list[list] = []  # [doc id, ids, ids before what is left, total]
        self.held = 0

    def add(self, doc_id, ids: np.ndarray):
        """ids: a document's own ids; the closing id 0 is added here."""
        ids = np.append(ids, np.uint32(0)).astype("<u4", copy=False)
        self.docs.append([doc_id, ids, 0, len(ids)])
        self.held += len(ids)
        if self.held >= BLOCK:
            yield from self.drain(False)

    def drain(self, last: bool):
        """Pieces (doc id, start, ids, total, sequence, offset) of what is held; a few windows stay unless it is the last call."""
        if not self.held:
            return
        ids = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        cost = np.full(len(ids) + 1, -1, np.int32)
        cost[1:][self.sentence[ids]] = SENTENCE
        cost[ends] = DOCUMENT
        cost[0] = 0
        if last and cost[-1] < 0:
            cost[-1] = 0
        at = np.flatnonzero(cost >= 0)
        for k in np.flatnonzero(np.diff(at) > self.window).tolist():
            cost[at[k] + GRID : at[k + 1] : GRID] = self.window
        at = np.flatnonzero(cost >= 0)
        places = at[cuts(at.tolist(), cost[at].tolist(), self.window)].tolist()
        if not last:
            places = places[: max(2, len(places) - LEFT)]
        elif (rest := places[-1] - places[-2]) & (rest - 1):
            # the last window of all: sequences whose lengths are powers of two aren't padded
            start, places = places[-2], places[:-1]
            for bit in range(rest.bit_length() - 1, -1, -1):
                if rest >> bit & 1:
                    start += 1 << bit
                    places.append(start)
        # pieces end where a window or a document ends
        stop = places[-1]
        marks = np.union1d(np.array(places), ends[ends < stop])
        begin, end = marks[:-1], marks[1:]
        window_of = np.searchsorted(places, begin, "right") - 1
        doc_of = np.searchsorted(ends, begin, "right")
        starts = ends - np.array([len(d[1]) for d in self.docs])
        for a, b, w, k in zip(begin.tolist(), end.tolist(), window_of.tolist(), doc_of.tolist(), strict=True):
            d = self.docs[k]
            yield d[0], d[2] + a - int(starts[k]), ids[a:b].tobytes(), d[3], self.sequence + w, a - places[w]
        self.sequence += len(places) - 1
        keep = int(np.searchsorted(ends, stop, "right"))
        left = self.docs[keep:]
        if left:
            done = stop - int(starts[keep])
            left[0] = [left[0][0], left[0][1][done:].copy(), left[0][2] + done, left[0][3]]
        self.docs, self.held = left, int(ends[-1]) - stop


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents, dealt to sequences of at most `window` ids, in the order of the rows of each partition.

    Each document is its ids by the vocabulary and then id 0. Where sequences end is chosen by dynamic programming over
    document ends and sentence ends, so that padding plus the costs of cuts are least; only a stretch longer than a window
    without either is cut elsewhere, as seldom as can be. The last window of a partition is cut into powers of two. Returns the id, `start` (its ids before the piece), `length`, `ids` (binary,
    little-endian unsigned 32-bit), `doc_tokens`, `sequence_id` (unique; partition number * 2^33 + count) and `offset`.

    Null texts count as empty: one piece with id 0. Null and repeated ids are kept as they are, each row is a document
    of its own; long texts are encoded in bounded parts and may span many sequences; an empty table gives no rows; other
    columns are not read. Nothing is shuffled, so no key can be hot, and a task run again gives the same pieces.
    The ids are those of the tokenizers library, made by tiktoken from the rank file beside `vocabulary`, whose ids are
    the same and which takes a quarter of the time (tested against that library).
    """
    ranks = vocabulary.removesuffix(".json") + ".tiktoken"

    def run(batches):
        enc = encoding(ranks, (("<|endoftext|>", int(END_OF_TEXT[0])),))
        packer = Packer(ends_sentence(vocabulary), window, TaskContext.get().partitionId() << 33)

        def out(pieces):
            cols = list(zip(*pieces, strict=True))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in (part for whole in batches for part in slices(whole, 1)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                ordinary = SPECIAL.split(text)
                ids = encode_one(enc, ordinary[0])
                if len(ordinary) > 1:
                    ids = np.concatenate([ids, *(x for part in ordinary[1:] for x in (END_OF_TEXT, encode_one(enc, part)))])
                yield from out(packer.add(doc_id, ids))
        yield from out(packer.drain(True))

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumn("length", F.expr("cast(octet_length(ids) div 4 as bigint)")).withColumnRenamed("id", id_col)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return digests(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
