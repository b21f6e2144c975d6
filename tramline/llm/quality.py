"""Quality by weak supervision: rules vote or abstain, a label model weighs them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import SPACES, WordHashes, hashes, mixed, slices, texts, windows

#: Characters that count as symbols, and words that running text of four languages can't do without (fixed values).
SYMBOLS = b"#*$%&|<>"
FUNCTION_WORDS = b"the of and to in is that it for la de le les et des un une der die und das ist den el los y que en se del".split()
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = b"0123456789"
MARKS = b"!?"
#: A verdict needs this posterior probability of good quality.
KEEP = 0.5

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_digits long, n_marks long, n_function long, word_bytes long, n_stutter long"
NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def measure(batch_texts: list[bytes], table: WordHashes, width: int = 8) -> list[list[int]]:
    """The features of whole texts, column by column."""
    split = [t.split() for t in batch_texts]
    sizes = np.array([len(w) for w in split], np.int64)
    ends = np.cumsum(sizes)
    flat = [w for ws in split for w in ws]
    h = hashes(flat, table)
    function = np.isin(h, hashes(FUNCTION_WORDS, table)) if len(h) else np.zeros(0, bool)
    # words in windows found twice or more in the text: equal (text, window) keys, then the places they cover
    doc = np.repeat(np.arange(len(split), dtype=np.uint64), sizes)
    g = windows(h, width)
    whole = np.flatnonzero(doc[: len(g)] == doc[width - 1 :]) if len(g) else np.empty(0, np.int64)
    key = mixed(g[whole] ^ mixed(doc[whole] + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(whole), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, whole[twice], 1)
    np.add.at(step, whole[twice] + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    known = np.concatenate([[0], np.cumsum(function)])
    again = np.zeros(len(h), bool)  # a word equal to the one before it
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    stutter = np.concatenate([[0], np.cumsum(again)])
    per = lambda sums: (sums[ends] - sums[ends - sizes]).tolist()
    lines = [[x for x in t.split(b"\n") if x.strip(SPACES)] for t in batch_texts]
    count = lambda chars: [len(t) - len(t.translate(None, chars)) for t in batch_texts]
    continuing = bytes(range(0x80, 0xC0))  # bytes that don't begin a code point
    return [
        sizes.tolist(), [len(t.translate(None, SPACES + continuing)) for t in batch_texts], count(SYMBOLS), [len(x) - len(set(x)) for x in lines], per(covered),
        [len(x) for x in lines], count(UPPER), count(LETTERS), count(DIGITS), count(MARKS), per(known), [len(t.translate(None, SPACES)) for t in batch_texts], per(stutter),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """Id, the columns `keep` and the features of every whole text; no shuffle. Only the text goes to Python, once."""

    @F.arrow_udf(FEATURES)
    def measured(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = WordHashes()
        for x in column:
            parts = [measure(texts(part.column(0)), table) for part in slices(pa.RecordBatch.from_arrays([x], ["text"]), 0)]
            flat = [pa.array([v for part in parts for v in part[i]], pa.int64()) for i in range(len(NAMES))]
            yield pa.StructArray.from_arrays(flat, NAMES)

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), *(F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep)), measured(F.col(text_col).cast("binary")).alias("__features"))
    return rows.select("__id", *(f"__keep{i}" for i in range(len(keep))), "__features.*")


def rules() -> dict[str, Column]:
    """Rule -> vote: 1 for good, 0 for bad, null to abstain."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    letters, lines, size = F.greatest(F.col("n_letters"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1)), F.greatest(F.col("word_bytes"), F.lit(1))

    def vote(good: Column | None, bad: Column | None) -> Column:
        out = F.when(bad, 0) if bad is not None else F.when(F.lit(False), 0)
        return out if good is None else out.when(good, 1)

    return {
        "length": vote(F.col("n_words") >= 50, F.col("n_words") < 20),
        "symbols": vote(F.col("n_symbols") * 100 <= words, F.col("n_symbols") * 10 > words),
        "function_words": vote(F.col("n_function") * 10 >= words, (F.col("n_function") * 50 < words) & (words >= 50)),
        "upper_case": vote(F.col("n_upper") * 10 <= letters, F.col("n_upper") * 10 > letters * 4),
        "marks": vote(F.col("n_marks") * 20 <= words, F.col("n_marks") * 5 > words),
        "repeats": vote(F.col("n_repeat_words") * 20 <= words, F.col("n_repeat_words") * 100 > words * 30),
        "lines": vote(F.col("n_dup_lines") * 20 <= lines, (F.col("n_dup_lines") * 10 > lines * 3) & (F.col("n_dup_lines") >= 3)),
        "letters": vote(F.col("n_letters") * 100 >= size * 85, F.col("n_letters") * 2 < size),
        "stutter": vote(F.col("n_stutter") * 50 <= words, F.col("n_stutter") * 5 > words),
        "word_length": vote(F.col("word_chars").between(words * 3, words * 9), (F.col("word_chars") > words * 14) | (F.col("word_chars") < words * 2)),
    }


def label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern of votes (1, 0, or -1 to abstain), chances[quality, rule] and the share of good.

    Expectation-maximisation over a latent quality: given it, rules that vote do so independently, and chances[quality]
    is how likely such a vote is for bad; to abstain says nothing. A fault shows in few of the rules, so right and wrong
    are estimated apart for good (0) and bad (1) documents; one accuracy a rule would let the many votes for good drown
    the one that sees the fault. A rule may not be worse than chance: a vote for bad stays at least four times as likely
    for bad documents. With that, and the share of good held to 0.5..0.99, the classes can't swap.
    """
    against, voted = (votes == 0).astype(float), (votes >= 0).astype(float)
    chances, share, p = np.array([[0.01] * votes.shape[1], [0.3] * votes.shape[1]]), 0.85, np.zeros(len(votes))
    for _ in range(rounds):
        good, bad = (np.log(prior) + against @ np.log(c) + (voted - against) @ np.log1p(-c) for prior, c in zip((share, 1 - share), chances, strict=True))
        p = 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))
        if not counts.sum():
            break
        for k, w in enumerate((p * counts, (1 - p) * counts)):
            chances[k] = (w @ against + 0.1 + 0.9 * k) / (w @ voted + 10)
        chances = np.clip(chances, 1e-6, 0.95)
        chances[1] = np.clip(np.maximum(chances[1], 4 * chances[0]), 0.02, 0.95)
        share = float(np.clip((p * counts).sum() / counts.sum(), 0.5, 0.99))
    return p, chances, share


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """Features, votes (`votes`: rules' patterns as base-3 digits), `p_good`, `base_failed` and `kept` of every document.

    The chances of the rules' votes are estimated from the counts of vote patterns over all documents. There are 3^10 patterns at
    most, whatever the input, so the counts and the posteriors are small enough to gather and to broadcast.
    base_failed: fewer than 20 words, or over 30 % of them in 8-word windows found twice or more in the text.
    kept: not base_failed, and p_good of KEEP or more.

    Null and empty texts have no words and fail; null or repeated ids are judged row by row; an empty table gives no
    rows; very long texts are measured whole; columns of other names are left alone.
    """
    spark = docs.sparkSession
    named = rules()
    pattern = sum((F.coalesce(v + 1, F.lit(0)).cast("long") * 3**i for i, v in enumerate(named.values())), F.lit(0).cast("long"))
    measured = written(features(docs, id_col, text_col, keep).withColumn("votes", pattern), "features")  # so measured once
    found = measured.groupBy("votes").count().collect()  # 3^10 rows at most
    codes = np.array([r["votes"] for r in found], np.int64)
    votes = codes[:, None] // 3 ** np.arange(len(named)) % 3 - 1
    p, _, _ = label_model(votes, np.array([r["count"] for r in found], float))
    table = spark.createDataFrame([(int(c), float(x)) for c, x in zip(codes, p, strict=True)], "votes long, p_good double")
    out = measured.join(F.broadcast(table), "votes", "left")
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP))
    return out.withColumnsRenamed({"__id": id_col} | {f"__keep{i}": c for i, c in enumerate(keep)})


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", "votes")
