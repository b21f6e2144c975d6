"""Word-piece counts by a longest-match automaton."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices, texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Words whose counts a task remembers; the table is emptied at this size.
REMEMBERED = 400_000
#: Marks the piece that begins a word in the vocabulary (fixed value).
FIRST = "▁"


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[str, ...]:
    """The ordinary pieces of a sentencepiece model; those that begin a word carry FIRST."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))


class Automaton:
    """Greedy longest-match counts in one pass over a word.

    Nodes are those of a trie of all pieces: node 0 is the root for a word's first piece (these begin with FIRST), node 1
    the root for the pieces that continue it. A node's failure link leads where matching stands after the longest pieces
    of what the node has read are popped, and `popped` is how many those are, so no piece is ever built and a character
    is read once. A link of -1: no such pieces, the word can't be split.
    """

    def __init__(self, pieces):
        edge, final = {}, [False, False]
        for piece in pieces:
            node = 0 if piece.startswith(FIRST) else 1
            for c in piece:
                if (following := edge.get((node, c))) is None:
                    following = edge[node, c] = len(final)
                    final.append(False)
                node = following
            if piece:
                final[node] = True
        self.edge, self.link, self.popped = edge, [-1] * len(final), [0] * len(final)
        children: dict[int, list] = {}
        for (node, c), following in edge.items():
            children.setdefault(node, []).append((c, following))
        queue = [0, 1]  # breadth first: links of shorter prefixes come first
        for node in queue:
            for c, v in children.get(node, ()):
                queue.append(v)
                if final[v]:
                    self.link[v], self.popped[v] = 1, 1
                    continue
                z, n = self.link[node], self.popped[node]
                while z >= 0 and (z, c) not in edge:
                    n += self.popped[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.popped[v] = edge[z, c], n

    def count(self, word: str) -> int:
        """Pieces of a word; a word that can't be split is one unknown piece; an empty word has none."""
        if not word:
            return 0
        edge, link, popped = self.edge, self.link, self.popped
        node = n = 0
        for c in FIRST + word:
            while (following := edge.get((node, c))) is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 1
            node = following
        while node != 1:  # what is left unpopped at the end of the word
            n += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return n


class Counts(dict):
    """Word (bytes) -> pieces, remembered."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = self.automaton.count(unicodedata.normalize("NFKC", word.decode("utf-8", "replace")))
        return n


@lru_cache(maxsize=4)
def counts(path: str) -> Counts:
    return Counts(Automaton(vocabulary(path)))


def count_tokens(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, `n_words` and `n_tokens` (greedy longest-match word pieces) of every whole text.

    Words are runs between ASCII white space, normalised by NFKC; each is split into its longest first piece, then the
    longest continuing pieces. Null and empty texts have no tokens; a row in gives a row out, also for null or repeated
    ids; a word of any length is read once, in linear time; other columns aren't read. No shuffle.
    """

    def run(batches):
        known = counts(path)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            split = [t.split() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, split), pa.int64()), pa.array([sum(map(known.__getitem__, ws)) for ws in split], pa.int64())], ["id", "n_words", "n_tokens"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "id long, n_words long, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
