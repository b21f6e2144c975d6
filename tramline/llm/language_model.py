"""A gated recurrent language model in numpy, learned from and applied to whole corpora."""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import slices, texts

#: Words whose counts every task holds (the commonest); counts of all others are joined.
HEAD = 200_000
#: Ids of words with an input and output of their own (all others share some, see `buckets`), sizes of embedding and state, classes of the output.
WORDS, EMBED, STATE, CLASSES = 4096, 16, 16, 48
#: Lanes that are learned from side by side, steps that the gradient goes back, step size, passes over disjoint shares.
LANES, STEPS, RATE, SHARES = 512, 16, 0.08, (1, 3)
#: Tokens in one chunk for learning and for scoring, and in one window of outputs.
LEARN_CHUNK, SCORE_CHUNK, OUTPUTS = 1 << 19, 1 << 22, 8192
#: Outputs stay within this of 0, where their exponentials and the sums of them are finite in single precision.
LARGEST = np.float32(60)
#: Parameters in one row where tasks' models are averaged.
BLOCK = 1 << 12
#: Different words that a task counts before it hands them on.
COUNTED = 300_000
#: Model ids of the end of a text and of the first bucket of words without an output of their own; words with one follow
#: in order of frequency, then the other buckets.
END, OTHER, FIRST = 0, 1, 2


def buckets(distinct: int) -> int:
    """Buckets by hash for so many words without an output of their own: a power of two near twice the root of them."""
    return 1 << round(math.log2(2 * math.sqrt(max(distinct, 1)))) if distinct > 1 else 1


def hashes_of(words) -> np.ndarray:
    """What Spark's xxhash64 gives, as unsigned integers."""
    return np.fromiter((xxhash.xxh64_intdigest(w, seed=42) for w in words), np.uint64)


def class_bounds(weights: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Where classes of outputs start: END and OTHER alone, then words by rank and buckets, so that classes weigh alike.

    A word weighs the root of its frequency, so that common words are in small classes and no class grows long.
    """
    n = len(weights) - FIRST
    share = np.cumsum(np.sqrt(weights[FIRST:]))
    cuts = np.searchsorted(share, share[-1] * np.arange(1, classes - FIRST) / (classes - FIRST)) + 1 if n else np.empty(0, np.int64)
    return np.unique(np.concatenate([[0, 1], [FIRST] if n else [], cuts + FIRST, [len(weights)]]).astype(np.int64).clip(0, len(weights)))


class Model:
    """Embedding -> gated recurrent unit -> softmax over classes and over the words of the class."""

    shapes = staticmethod(lambda v, c: {"e": (v, EMBED), "w": (EMBED, 3 * STATE), "b": (3 * STATE,), "u": (STATE, 2 * STATE), "v": (STATE, STATE), "wc": (STATE, c), "bc": (c,), "wo": (v, STATE), "bo": (v,)})

    def __init__(self, weights: np.ndarray, flat: np.ndarray | None = None):
        """weights: counts of END, OTHER and the words, at least 1 each; the untrained model starts from them."""
        self.bounds = class_bounds(weights)
        self.class_of = (np.searchsorted(self.bounds, np.arange(len(weights)), "right") - 1).astype(np.int16)  # 16 bits: sorted by radix
        shapes = self.shapes(len(weights), len(self.bounds) - 1)
        self.size = sum(math.prod(s) for s in shapes.values())
        if flat is None:
            rng = np.random.default_rng(5)
            flat = rng.normal(0, 0.1, self.size).astype(np.float32)
        self.flat, self.p, at = flat.astype(np.float32), {}, 0
        for name, shape in shapes.items():
            self.p[name] = self.flat[at : (at := at + math.prod(shape))].reshape(shape)

    def start(self, weights: np.ndarray) -> Model:
        """Biases at the log frequencies: the untrained model is close to one without context."""
        mass = np.add.reduceat(weights, self.bounds[:-1])
        self.p["bc"][:] = np.log(mass / mass.sum())
        self.p["bo"][:] = np.log(weights / mass[self.class_of])
        self.p["b"][:] = 0
        self.p["b"][:STATE] = -1  # gates that keep the state, to begin with
        return self

    def states(self, x: np.ndarray, carry: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """x: (steps, lanes, 3 STATE) inputs; carry: 0 where the state starts anew, else 1; h: state before. All states, and the last."""
        u, v = self.p["u"], self.p["v"]
        out = np.empty((*x.shape[:2], STATE), np.float32)
        for t in range(len(x)):
            h = h * carry[t]
            zr = h @ u
            zr += x[t, :, : 2 * STATE]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :STATE], zr[:, STATE:]
            rh = r * h
            c = rh @ v
            c += x[t, :, 2 * STATE :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, z, r, rh, c))
            new = out[t]
            np.subtract(c, h, out=new)
            new *= z
            new += h
            h = new
        return out, h

    def outputs(self, h: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, grad: dict | None = None):
        """Log probability of each target; with `grad`, adds the gradient of the weighted loss and gives that of h."""
        p = self.p
        cls, rows, sums = self.class_of[target], np.arange(len(h)), np.ones(max(len(self.class_of), STATE + 1), np.float32)
        # a column of ones meets the biases
        wc, wo = np.vstack([p["wc"], p["bc"]]), np.column_stack([p["wo"], p["bo"]])
        h = np.column_stack([h, np.ones(len(h), np.float32)])
        # states lie within -1 and 1, so the weights bound the outputs
        bounded = max(np.abs(wc).sum(0).max(), (np.abs(wo) @ sums[: STATE + 1]).max()) <= LARGEST

        def softmax(x, w, own, rows):
            """Log probability of `own`, exponentials and their sums."""
            x = x @ w
            if not bounded:
                np.clip(x, -LARGEST, LARGEST, out=x)
            picked = x[rows, own]
            np.exp(x, out=x)
            total = x @ sums[: x.shape[1]]
            return picked - np.log(total), x, total

        out, x, total = softmax(h, wc, cls, rows)
        dh = None
        if grad is not None:
            # x * scale is the gradient of the outputs
            x[rows, cls] -= total
            scale = (weight / total)[:, None]
            both = (h * scale).T @ x
            grad["wc"] += both[:STATE]
            grad["bc"] += both[STATE]
            dh = x @ p["wc"].T
            dh *= scale
        # targets in classes of several words, sorted by class
        ends = np.cumsum(np.bincount(cls, minlength=len(self.bounds) - 1))
        alone = ends[min(FIRST, len(ends)) - 1]
        order = np.argsort(cls, kind="stable")[alone:]
        hs, own, back, gain = h[order], target[order], None, np.zeros(len(order), out.dtype)
        if grad is not None:
            back, ws = np.zeros((len(order), STATE), np.float32), weight[order]
        for k in range(FIRST, len(self.bounds) - 1):
            a, b = ends[k - 1] - alone, ends[k] - alone
            s, e = self.bounds[k], self.bounds[k + 1]
            if a == b or e - s == 1:
                continue
            inside, n = own[a:b] - s, rows[: b - a]
            gain[a:b], x, total = softmax(hs[a:b], wo[s:e].T, inside, n)
            if grad is not None:
                x[n, inside] -= total
                scale = (ws[a:b] / total)[:, None]
                both = x.T @ (hs[a:b] * scale)
                grad["wo"][s:e] += both[:, :STATE]
                grad["bo"][s:e] += both[:, STATE]
                np.multiply(x @ p["wo"][s:e], scale, out=back[a:b])
        out[order] += gain
        if grad is not None:
            dh[order] += back
        return out, dh

    def learn(self, tokens: np.ndarray, fresh: np.ndarray, squares: np.ndarray) -> None:
        """One pass over a chunk: tokens in lanes, the gradient goes STEPS back, the state on from window to window."""
        lanes = min(LANES, max(8, len(tokens) // 64))
        length = -(-len(tokens) // lanes)
        room = lanes * length
        target, begins, weight = np.zeros(room, np.int32), np.ones(room, bool), np.zeros(room, np.float32)
        target[: len(tokens)], begins[: len(tokens)], weight[: len(tokens)] = tokens, fresh, 1
        before = np.append(END, target[:-1]).astype(np.int32)
        before[begins] = END
        target, begins, weight, before = (np.ascontiguousarray(x.reshape(lanes, length).T) for x in (target, begins, weight, before))
        begins[0] = True
        carry = (~begins).astype(np.float32)[:, :, None]
        h, p = np.zeros((lanes, STATE), np.float32), self.p
        for t in range(0, length, STEPS):
            at = slice(t, t + STEPS)
            gradient = np.zeros(self.size, np.float32)
            g, i = {}, 0
            for name, x in p.items():
                g[name] = gradient[i : (i := i + x.size)].reshape(x.shape)
            kept: list = []
            ids = before[at].ravel()
            embedded = p["e"][ids]
            states, h = self.states((embedded @ p["w"] + p["b"]).reshape(-1, lanes, 3 * STATE), carry[at], h, kept)
            w = (weight[at] / max(1.0, float(weight[at].sum()))).ravel()
            _, dh = self.outputs(states.reshape(-1, STATE), target[at].ravel(), w, g)
            dh = dh.reshape(states.shape)
            dx = np.empty((len(kept), lanes, 3 * STATE), np.float32)
            back = np.zeros((lanes, STATE), np.float32)
            h0s, zs, rs, rhs, cs = (np.stack(x) for x in zip(*kept, strict=True))
            # what doesn't depend on the gradient is worked out for all steps at once
            to_c, to_z, to_r, left = zs * (1 - cs * cs), (cs - h0s) * zs * (1 - zs), h0s * rs * (1 - rs), 1 - zs
            ut, vt = np.ascontiguousarray(p["u"].T), np.ascontiguousarray(p["v"].T)
            for s in range(len(kept) - 1, -1, -1):
                d = dh[s]
                d += back
                dxs = dx[s]
                dc = np.multiply(d, to_c[s], out=dxs[:, 2 * STATE :])
                drh = dc @ vt
                np.multiply(d, to_z[s], out=dxs[:, :STATE])
                np.multiply(drh, to_r[s], out=dxs[:, STATE : 2 * STATE])
                drh *= rs[s]
                d *= left[s]
                back = dxs[:, : 2 * STATE] @ ut
                back += d
                back += drh
                back *= carry[t + s]
            g["v"] += rhs.reshape(-1, STATE).T @ dx[:, :, 2 * STATE :].reshape(-1, STATE)
            g["u"] += h0s.reshape(-1, STATE).T @ dx[:, :, : 2 * STATE].reshape(-1, 2 * STATE)
            flat = dx.reshape(-1, 3 * STATE)
            g["b"] += np.ones(len(flat), np.float32) @ flat
            g["w"] += embedded.T @ flat
            de = flat @ p["w"].T
            order = np.argsort(ids.astype(np.uint16 if len(p["e"]) <= 1 << 16 else np.int32), kind="stable")  # as above, where 16 bits do
            cut = np.flatnonzero(np.append(True, np.diff(ids[order]) > 0))
            g["e"][ids[order][cut]] += np.add.reduceat(de[order], cut, axis=0)
            squares += gradient * gradient
            self.flat -= RATE * gradient / np.sqrt(squares)

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each document (tokens with the end); the state is carried through all of it."""
        lanes = min(LANES, max(1, len(docs)))
        heap, own = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):  # longest first, to the shortest lane
            n, k = heapq.heappop(heap)
            own[k].append(i)
            heapq.heappush(heap, (n + len(docs[i]), k))
        own.sort(key=lambda k: -sum(len(docs[i]) for i in k))
        sizes = [sum(len(docs[i]) for i in k) for k in own]
        # lanes as columns, where that doesn't take much more room than the tokens; else window by window
        logs = [np.empty(n) for n in sizes]
        target = [np.concatenate([docs[i] for i in k]) if k else np.empty(0, np.int32) for k in own]
        begins = [starts([docs[i] for i in k]) for k in own]
        square = sizes[0] * lanes <= 4 * sum(sizes) + 10**6

        def columns(t: int, steps: int, active: int) -> tuple[np.ndarray, np.ndarray]:
            ids, fresh = np.zeros((active, steps), np.int32), np.zeros((active, steps), bool)
            for k in range(active):
                part = target[k][t : t + steps]
                ids[k, : len(part)], fresh[k, : len(part)] = part, begins[k][t : t + steps]
            return np.ascontiguousarray(ids.T), np.ascontiguousarray(fresh.T)

        if square:
            all_ids, all_fresh = columns(0, sizes[0], lanes)
            all_logs = np.empty(all_ids.shape, np.float32)
        h, t, inputs = np.zeros((lanes, STATE), np.float32), 0, self.p["e"] @ self.p["w"] + self.p["b"]
        last = np.full(lanes, END, np.int32)
        while t < sizes[0]:
            active = int(np.searchsorted(-np.array(sizes), -t, "left"))  # lanes are sorted by length
            steps = min(max(2 * STEPS, OUTPUTS // active), sizes[0] - t)
            ids, fresh = (all_ids[t : t + steps, :active], all_fresh[t : t + steps, :active]) if square else columns(t, steps, active)
            before = np.concatenate([last[None, :active], ids[:-1]])
            last = ids[-1]
            before[fresh] = END
            states, h = self.states(inputs[before], (~fresh).astype(np.float32)[:, :, None], h[:active])
            got = self.outputs(states.reshape(-1, STATE), ids.ravel())[0].reshape(ids.shape)
            if square:
                all_logs[t : t + steps, :active] = got
            else:
                for k in range(active):
                    logs[k][t : t + steps] = got[: max(0, sizes[k] - t), k]
            t += steps
        if square:
            logs = [np.ascontiguousarray(x[:n], np.float64) for x, n in zip(np.ascontiguousarray(all_logs.T), sizes, strict=True)]
        out = np.zeros(len(docs))
        for k, lane in zip(own, logs, strict=True):
            if k:
                out[k] = np.add.reduceat(lane, np.cumsum([0, *(len(docs[i]) for i in k)])[:-1])
        return out


#: The words that a Python worker last looked up, by broadcast.
_table: dict[int, dict[bytes, int]] = {}


def places(broadcast, key: int) -> dict[bytes, int]:
    """Word -> place among the commonest; made once in each Python worker."""
    if key not in _table:
        _table.clear()
        joined, logs, _ = broadcast.value
        _table[key] = {w: i for i, w in enumerate(joined.split(b" ") if len(logs) > 1 else ())}
    return _table[key]


def held_out(id_col: str):
    """Documents that the model doesn't learn from: crc32 of the id as text leaves 2 when divided by 7. A null id: no text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score` (log10) of every whole text.

    Words are lower-cased (A-Z) and counted over all documents to learn from. The model learns from all of them too: each
    task passes once over its documents, and the tasks' parameters are averaged by tokens, once for each entry of SHARES
    (parts of the documents, so each is learned from once). Scores are the model's probability of the class and the word;
    words without an output of their own share inputs and outputs by hash, in `buckets` whose number grows with the corpus,
    times their smoothed frequency among the words of the bucket. base_score is the
    smoothed frequency of each token.

    Texts become model ids once, in a written table that learning and scoring read. Tasks hold the counts of the HEAD commonest words; what other words a document has is joined with their counts by
    64-bit hash, so the vocabulary may be of any size. Null and empty texts are one end; each row is scored alone, also
    with null or repeated ids; a document of any length keeps its state throughout; an empty table gives no rows; with
    nothing to learn from all counts are zero. Other columns aren't read.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    read = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    read = read.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(sum(SHARES))).cast("int"))
    lessons = read.where(~F.col("held_out"))

    def count(batches):
        held: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()

        for batch in batches:
            for text in texts(batch.column(0)):
                held.update(text.lower().split())
            held[b" "] += batch.num_rows  # no word is a space: it stands for the end
            if len(held) > COUNTED:
                yield from out()
        yield from out()

    counts = written(lessons.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word") == F.lit(b" "), F.col("n"))).alias("ends")).first()
    n_all, n_distinct, ends = total["n"] or 0, total["v"], total["ends"] or 0
    # the commonest words are those above a frequency; frequencies are told apart in 64 steps an octave, 4,096 in all. Of
    # the step that doesn't fit as a whole, words go in by the rank of their hash in 65,536 parts, as far as they fit.
    part = F.pmod(F.xxhash64("word", F.lit(1)), F.lit(1 << 16)).cast("int")
    counts = counts.where(F.col("word") != F.lit(b" ")).withColumn("step", F.expr("cast(floor(log2(n) * 64) as int)")).withColumn("part", part)
    steps = sorted(((r["step"], r["count"]) for r in counts.groupBy("step").count().collect()), reverse=True)
    sums = np.cumsum([c for _, c in steps])
    fitting = int((sums <= HEAD).sum())
    last, room = (steps[fitting][0], HEAD - int(sums[fitting - 1] if fitting else 0)) if fitting < len(steps) else (-1, 0)
    parts = sorted((r["part"], r["count"]) for r in counts.where(F.col("step") == last).groupBy("part").count().collect())
    below = parts[int((np.cumsum([c for _, c in parts]) <= room).sum())][0] if parts else 0
    common = (F.col("step") > last) | ((F.col("step") == last) & (F.col("part") < below))
    top = counts.where(common).select("word", "n").toArrow()
    words, n = top.column("word").to_pylist(), top.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words, n = [words[i] for i in order], n[order]
    modelled = min(len(words), WORDS - FIRST)
    # tokens and different words of each bucket: those of all words, less the modelled
    n_buckets = buckets(n_distinct - (ends > 0) - modelled)

    def bucket_ids(hashed: np.ndarray) -> np.ndarray:
        bucket = (hashed & np.uint64(n_buckets - 1)).astype(np.int32)
        return np.where(bucket == 0, OTHER, bucket + (FIRST + modelled - 1)).astype(np.int32)

    hashed = hashes_of(words)
    own = (hashed[:modelled] & np.uint64(n_buckets - 1)).astype(np.int64)
    mass, different = -np.bincount(own, n[:modelled], n_buckets), -np.bincount(own, minlength=n_buckets)
    for r in counts.groupBy(F.xxhash64("word").bitwiseAND(F.lit(n_buckets - 1)).alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        mass[r["bucket"]] += r["n"]
        different[r["bucket"]] += r["v"]
    weights = np.concatenate([[ends, mass[0]], n[:modelled], mass[1:]]).astype(np.float64).clip(1)
    within = np.log10(mass + different + 1)  # what a word's count in its bucket is divided by, by model id
    within = np.concatenate([[0, within[0]], np.zeros(modelled), within[1:]])
    ids = np.concatenate([np.arange(FIRST, FIRST + modelled), bucket_ids(hashed[modelled:]), [OTHER]]).astype(np.int32)
    head = sc.broadcast((b" ".join(words), np.log10(np.append(n, 0.0) + 1), ids))
    more = n_distinct - (ends > 0) > len(words)

    def read_ids(text: bytes, ranks: dict):
        """Words' places among the commonest (one behind the last for all others), hashes of these others, and model ids."""
        w, own_ids = text.lower().split(), head.value[2]
        none = len(own_ids) - 1
        rank = np.fromiter(map(ranks.get, w, repeat(none)), np.int32, len(w))
        unknown = np.flatnonzero(rank == none)
        hashed, model_ids = hashes_of([w[k] for k in unknown.tolist()]), own_ids[rank]
        model_ids[unknown] = bucket_ids(hashed)
        return rank, hashed, np.append(model_ids, np.int32(END))

    key = hash((sc.applicationId, id(head), uuid.uuid4().hex))
    base_total, ends_log, kind = math.log10(n_all + n_distinct + 1), math.log10(ends + 1), np.uint16 if len(weights) <= 1 << 16 else np.int32

    def encode(batches):
        ranks, row, log_count = places(head, key), TaskContext.get().partitionId() << 33, head.value[1]
        for batch in (part for whole in batches for part in slices(whole, 2)):
            rows = []
            for text in texts(batch.column(2)):
                rank, hashed, model_ids = read_ids(text, ranks)
                logs, size = log_count[rank], len(rank) + 1
                rows.append((size, len(rank) - len(hashed) + (ends > 0), float(logs.sum()) + ends_log - size * base_total, float(logs[rank >= modelled].sum() - within[model_ids].sum()), model_ids.astype(kind).tobytes(), hashed.tobytes() if more else b""))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(rows)), pa.int64()), *(batch.column(k) for k in (0, 1, 3)), *cols], ["row", "id", "held_out", "part", "n_tokens", "n_known", "base_score", "score", "ids", "others"])
            row += len(rows)

    told = "row long, id long, held_out boolean, {}n_tokens long, n_known long, base_score double, score double"
    encoded = written(read.mapInArrow(encode, told.format("part int, ") + ", ids binary, others binary"), "encoded")

    def taught(flat: np.ndarray):
        shared = sc.broadcast(flat)

        def run(batches):
            model = Model(weights, shared.value.copy())
            squares, held, n, seen = np.full(model.size, 1e-4, np.float32), [], 0, 0
            for batch in batches:
                for ids in batch.column(0).to_pylist():
                    held.append(np.frombuffer(ids, kind))
                    n += len(held[-1])
                    if n >= LEARN_CHUNK:
                        model.learn(np.concatenate(held), starts(held), squares)
                        held, n, seen = [], 0, seen + n
            if held:
                model.learn(np.concatenate(held), starts(held), squares)
            if seen + n:
                x = model.flat.astype(np.float64) * (seen + n)
                blocks = range(0, model.size, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([x[k : k + BLOCK].tobytes() for k in blocks], pa.binary()), pa.array([float(seen + n)] * len(blocks))], ["at", "x", "w"])

        return run

    def averaged(batches):
        """Blocks of parameters, weighted by tokens: sums of all tasks that sent one, over their weights."""
        sums: dict[int, list] = {}
        for batch in batches:
            for at, x, w in zip(*(batch.column(c).to_pylist() for c in ("at", "x", "w")), strict=True):
                held = sums.setdefault(at, [0.0, 0.0])
                held[0] = held[0] + np.frombuffer(x)
                held[1] += w
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([(x / w).astype(np.float32).tobytes() for x, w in sums.values()], pa.binary())], ["at", "x"])

    flat = Model(weights).start(weights).flat
    low = 0
    for share in SHARES if n_all else ():
        own = encoded.where(~F.col("held_out") & (F.col("part") >= low) & (F.col("part") < low + share)).select("ids")
        low += share
        mean = own.mapInArrow(taught(flat), "at int, x binary, w double").repartition("at").mapInArrow(averaged, "at int, x binary").toArrow()
        if mean.num_rows:
            flat = flat.copy()
            for at, x in zip(mean.column("at").to_pylist(), mean.column("x").to_pylist(), strict=True):
                flat[at : at + BLOCK] = np.frombuffer(x, np.float32)
    shared = sc.broadcast(flat)

    def score(batches):
        model = Model(weights, shared.value)

        def out(held, tokens):
            scores, at = model.score(tokens) / math.log(10), 0
            for rows in held:
                own = rows.column(rows.num_columns - 1).to_numpy() + scores[at : (at := at + rows.num_rows)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(own)], rows.schema.names)

        held, tokens, n = [], [], 0
        for batch in batches:
            fresh = [np.frombuffer(x, kind) for x in batch.column(batch.num_columns - 1).to_pylist()]
            held.append(batch.select(batch.schema.names[:-1]))
            tokens += fresh
            n += sum(map(len, fresh))
            if n >= SCORE_CHUNK:
                yield from out(held, tokens)
                held, tokens, n = [], [], 0
        if tokens:
            yield from out(held, tokens)

    scored = encoded.drop("part", "others").mapInArrow(score, told.format(""))
    names = [F.col("id").alias(id_col), "held_out", "n_tokens"]
    if not more:
        return scored.select(*names, "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")

    def unpack(batches):
        for batch in batches:
            keys = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))], ["row", "key"])

    # words beyond the commonest have their counts joined
    beyond = counts.where(~common)
    beyond = beyond.select(F.xxhash64("word").alias("key"), F.log10(F.col("n") + 1).alias("log")).groupBy("key").agg(F.max("log").alias("log"))
    found = encoded.select("row", "others").where(F.length("others") > 0).mapInArrow(unpack, "row long, key long")
    added = found.join(beyond, "key").groupBy("row").agg(F.sum("log").alias("log"), F.count(F.lit(1)).alias("known"))
    out = scored.join(added, "row", "left")
    log = F.coalesce("log", F.lit(0.0))
    return out.select(*names, (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base_score") + log).alias("base_score"), (F.col("score") + log).alias("score"))


def starts(docs: list[np.ndarray]) -> np.ndarray:
    """Marks the first token of each document."""
    out = np.zeros(sum(map(len, docs)), bool)
    out[np.cumsum([0, *map(len, docs)])[:-1]] = True
    return out


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
