"""Streaming forms of the stateful operators, on Structured Streaming."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Deliveries of a stream of events (realm, topic, ...) to a snapshot of subscriptions: the batch operator's stream-static joins."""
    from ..operators.patterns import match_patterns

    return match_patterns(events, subscriptions)


def retained(events: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """The last value of each key; write it in update mode."""
    return events.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("last")).select(*key, "last.*")


def call_outcomes(calls: DataFrame, responses: DataFrame, timeout: str, delay: str) -> DataFrame:
    """Calls (realm, call_id, sent) joined with responses (realm, call_id, at, failed) in time; an outer row, given when
    the watermark passes, is a timeout. State of either side is dropped by the bounds."""
    c = calls.withWatermark("sent", delay)
    r = responses.withWatermark("at", delay).select(F.col("realm").alias("r_realm"), F.col("call_id").alias("r_call"), "at", "failed")
    hit = (F.col("realm") == F.col("r_realm")) & (F.col("call_id") == F.col("r_call")) & (F.col("at") >= F.col("sent")) & (F.col("at") <= F.col("sent") + F.expr(f"interval {timeout}"))
    outcome = F.when(F.col("at").isNull(), "timeout").when(F.col("failed"), "error").otherwise("result")
    return c.join(r, hit, "left").select("realm", "call_id", "sent", "at", outcome.alias("outcome"))


def token_bucket(requests: DataFrame, key: str, capacity: int, rate: float) -> DataFrame:
    """Requests (key, ts_ms) with `allowed` and `remaining`; a key's state is two numbers: its tokens and the time of its refill.

    A key's requests of one micro-batch are taken in order of time, in memory (8 bytes each)."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, since = state.get if state.exists else (capacity, None)
        # a key's rows come in as many frames as the exchange with Python cuts, in no order: all are sorted, as plain numbers
        times = np.sort(np.concatenate([pdf["ts_ms"].to_numpy() for pdf in frames]))
        for first in range(0, len(times), 10_000):
            out = []
            for t in times[first : first + 10_000].tolist():
                since = t if since is None else since
                full = math.trunc(min(capacity, tokens + max(0, t - since) * rate))
                if full >= 1:
                    tokens, since = full - 1, t
                out.append((k[0], t, full >= 1, tokens if full >= 1 else 0))
            yield pd.DataFrame(out, columns=[key, "ts_ms", "allowed", "remaining"])
        state.update((int(tokens), int(since)))

    kind = dict(requests.dtypes)[key]
    return requests.select(key, "ts_ms").groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, ts_ms long, allowed boolean, remaining long", "tokens long, since long", "append", GroupStateTimeout.NoTimeout)


def bounded_queue(messages: DataFrame, queue: str, most: int, most_bytes: int) -> DataFrame:
    """What a queue holds after each batch (seq, size, message), oldest dropped first beyond a count or bytes; the state is one queue, so it is bounded."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        dropped = 0
        for pdf in frames:
            held += [[int(s), int(n), m] for s, n, m in zip(pdf["seq"], pdf["size"], pdf["message"], strict=True)]
            held.sort()
            total = sum(n for _, n, _ in held)
            cut = 0
            while len(held) - cut > most or (total > most_bytes and cut < len(held)):
                total -= held[cut][1]
                cut += 1
            held, dropped = held[cut:], dropped + cut
        state.update((json.dumps(held),))
        yield pd.DataFrame([(k[0], len(held), held[0][0] if held else None, dropped)], columns=[queue, "held", "oldest", "dropped"])

    kind = dict(messages.dtypes)[queue]
    return messages.select(queue, "seq", "size", "message").groupBy(queue).applyInPandasWithState(step, f"`{queue}` {kind}, held long, oldest long, dropped long", "held string", "update", GroupStateTimeout.NoTimeout)


def first_and_last(changes: DataFrame, key: list[str]) -> DataFrame:
    """Created and deleted events of a stream of (key, order, delta): a running count in the state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        out = []
        for pdf in frames:
            for o, d in sorted(zip(pdf["order"].tolist(), pdf["delta"].tolist(), strict=True)):
                before, n = n, max(0, n + d)
                if before == 0 and n > 0:
                    out.append((*k, o, "created"))
                elif before > 0 and n == 0:
                    out.append((*k, o, "deleted"))
        state.update((int(n),))
        if out:
            yield pd.DataFrame(out, columns=[*key, "order", "event"])

    kinds = dict(changes.dtypes)
    return changes.groupBy(*key).applyInPandasWithState(step, ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", `order` long, event string", "n long", "append", GroupStateTimeout.NoTimeout)


def forwarded_once(deliveries: DataFrame, delay: str) -> DataFrame:
    """One copy of a publication for each node."""
    return deliveries.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["publication", "node"])


def windowed_counts(events: DataFrame, labels: list[str], size: str, delay: str) -> DataFrame:
    """Extension: counts by label in event-time windows."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), *labels).agg(F.count(F.lit(1)).alias("n"))


def _rows(held: dict | list, state: GroupState) -> None:
    """Keeps a small state as JSON, or drops it when nothing is left."""
    if held:
        state.update((json.dumps(held),))
    elif state.exists:
        state.remove()


def retained_until(events: DataFrame, key: list[str], now: str, valid_to: str, value: str, delay: str) -> DataFrame:
    """Retained values with a time to live: what each key holds after each batch, and `evicted` when its time has passed.

    `now` and `valid_to` are timestamps; a value without `valid_to` never goes. An event-time timer fires when the
    watermark passes the latest value's end, and the key's state is dropped. Within a batch the latest event counts; an
    event that is later than the one held replaces it, whatever the order in which they came.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, _, held = state.get
            state.remove()
            yield pd.DataFrame([(*k, held, True)], columns=[*key, "value", "evicted"])
            return
        best = state.get if state.exists else None
        for pdf in frames:
            for at, end, v in zip(pdf["__at"].tolist(), pdf["__end"].tolist(), pdf["__value"].tolist(), strict=True):
                if best is None or at >= best[0]:
                    best = (int(at), None if end is None or end != end else int(end), v)
        state.update(best)
        if best[1] is not None:
            state.setTimeoutTimestamp(max(best[1], state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*k, best[2], False)], columns=[*key, "value", "evicted"])

    kinds = dict(events.dtypes)
    laid = events.withWatermark(now, delay).select(*key, now, F.unix_millis(now).alias("__at"), F.unix_millis(valid_to).alias("__end"), F.col(value).cast("string").alias("__value"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", value string, evicted boolean"
    return laid.groupBy(*key).applyInPandasWithState(step, schema, "at long, until long, value string", "update", GroupStateTimeout.EventTimeTimeout)


def pending_calls(log: DataFrame, delay: str) -> DataFrame:
    """Calls from their start to their end, in one stream of (realm, callee, call_id, at, kind, until).

    `kind`: call (pending until the time `until`), result, error, skip, kill, killnowait, or gone (the callee went: call_id
    is null). The state of a (realm, callee) is what is pending there. Out come (call_id, outcome): the first answer in
    time; canceled at once for skip and killnowait, after the callee's answer or at expiry for kill; callee_gone for all
    that is pending when the callee goes; timeout by an event-time timer. Rows of a micro-batch are taken in order of time;
    those that come after the watermark are dropped, and those late within it count from when they come.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        out = []

        def expire(now: float) -> None:
            for c in [c for c, (until, _) in held.items() if until < now]:
                out.append((*k, int(c), "canceled" if held.pop(c)[1] else "timeout"))

        rows = sorted((r for pdf in frames for r in zip(pdf["__at"].tolist(), pdf["kind"].tolist(), pdf["call_id"].tolist(), pdf["__until"].tolist(), strict=True)), key=lambda r: (r[0], r[1] != "call"))
        for at, kind, c, until in rows:
            expire(at)
            if kind == "gone":
                out += [(*k, int(x), "callee_gone") for x in held]
                held.clear()
                continue
            c = str(int(c))
            if kind == "call":
                held[c] = [int(until), False]
            elif c in held:
                if kind == "kill":
                    held[c][1] = True
                else:
                    out.append((*k, int(c), "canceled" if kind in ("skip", "killnowait") or held[c][1] else kind))
                    held.pop(c)
        if state.hasTimedOut:
            expire(state.getCurrentWatermarkMs() + 1)
        _rows(held, state)
        if held:
            state.setTimeoutTimestamp(max(min(u for u, _ in held.values()) + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["realm", "callee", "call_id", "outcome"])

    laid = log.withWatermark("at", delay).select("realm", "callee", "call_id", "at", "kind", F.unix_millis("at").alias("__at"), F.unix_millis("until").alias("__until"))
    kinds = dict(log.dtypes)
    schema = f"realm {kinds['realm']}, callee {kinds['callee']}, call_id long, outcome string"
    return laid.groupBy("realm", "callee").applyInPandasWithState(step, schema, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def queue_with_expiry(messages: DataFrame, queue: str, ttl_ms: int, most: int, take: int, delay: str) -> DataFrame:
    """A queue whose messages (seq, at, kind) expire: `kind` is put or drain. A drain gives the `take` oldest live messages;
    beyond `most` the oldest go; a timer drops what has expired, so the state of an idle queue goes too."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        out = []

        def expire(now: float) -> None:
            while held and held[0][1] + ttl_ms <= now:
                out.append((k[0], held.pop(0)[0], "expired"))

        for at, seq, kind in sorted(r for pdf in frames for r in zip(pdf["__at"].tolist(), pdf["seq"].tolist(), pdf["kind"].tolist(), strict=True)):
            expire(at)
            if kind == "drain":
                out += [(k[0], s, "sent") for s, _ in held[:take]]
                del held[:take]
                continue
            held.append([int(seq), int(at)])
            if len(held) > most:
                out.append((k[0], held.pop(0)[0], "dropped"))
        if state.hasTimedOut:
            expire(state.getCurrentWatermarkMs())
        _rows(held, state)
        if held:
            state.setTimeoutTimestamp(max(held[0][1] + ttl_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[queue, "seq", "fate"])

    kind = dict(messages.dtypes)[queue]
    laid = messages.withWatermark("at", delay).select(queue, "seq", "at", "kind", F.unix_millis("at").alias("__at"))
    return laid.groupBy(queue).applyInPandasWithState(step, f"`{queue}` {kind}, seq long, fate string", "held string", "append", GroupStateTimeout.EventTimeTimeout)
