"""Batch forms of stateful operators: retained events, calls and responses, token buckets, bounded queues."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retained(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last event of each key, by a partial aggregate."""
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*key, "row.*")


def live(valid_to: Column, now: int) -> Column:
    """Zero never expires."""
    return ~((valid_to > 0) & (valid_to <= now))


def deliverable(session: Column, eligible: Column, excluded: Column, nobody_if_empty: bool = False) -> Column:
    """Whether a session may receive. An empty list of eligible sessions is no filter for a subscription, but nobody for a retained event; a missing one is no filter either way."""
    open_to_all = eligible.isNull() if nobody_if_empty else eligible.isNull() | (F.size(eligible) == 0)
    return (open_to_all | F.array_contains(eligible, session)) & ~F.coalesce(F.array_contains(excluded, session), F.lit(False))


def correlate(calls: DataFrame, responses: DataFrame) -> DataFrame:
    """Calls with their outcome: the first response in time, else a timeout at the call's expiry. One equi join on (realm, call_id)."""
    first = responses.groupBy("realm", "call_id").agg(F.min(F.struct("at_ms", "failed", "payload")).alias("r"))
    out = calls.withColumn("expiry_ms", F.col("sent_ms") + F.col("timeout_ms")).join(first, ["realm", "call_id"], "left")
    in_time = F.col("r.at_ms") <= F.col("expiry_ms")
    outcome = F.when(in_time & F.col("r.failed"), "error").when(in_time, "result").otherwise("timeout")
    return out.withColumn("outcome", outcome).withColumn("done_ms", F.when(in_time, F.col("r.at_ms")).otherwise(F.col("expiry_ms"))).drop("r")


def cancelled(calls: DataFrame, mode: str, at_ms: Column) -> DataFrame:
    """Calls pending at a time, cancelled: `skip` answers the caller and drops the result, `kill` interrupts the callee and waits, `killnowait` does both."""
    pending = (F.col("sent_ms") <= at_ms) & (F.col("done_ms") > at_ms)
    return calls.where(pending).select("realm", "call_id", F.lit(mode in ("skip", "killnowait")).alias("caller_answered"), F.lit(mode in ("kill", "killnowait")).alias("callee_interrupted"), F.lit(mode == "kill").alias("awaits_callee"))


def token_bucket(requests: DataFrame, key: str, capacity: int, rate: float, order: list[str], increment: int = 1) -> DataFrame:
    """Requests with `allowed`, `remaining` and `resets_in_ms`: refill truncates to whole tokens, and a rejected request doesn't move the time of the refill, so it is a fold over each key's requests in order.

    The fold's state is two numbers. Rows of a key are sorted by Spark and streamed, so a hot key needs time but no memory.
    """
    schema = requests.select(key, *order).schema.add("allowed", "boolean").add("remaining", "long").add("resets_in_ms", "long")

    def run(batches):
        now_key, tokens, since = object(), capacity, None
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key].tolist(), pdf[order[0]].tolist(), strict=True):
                if k != now_key:
                    now_key, tokens, since = k, capacity, t
                full = math.trunc(min(capacity, tokens + (t - since) * rate))
                if full >= increment:
                    tokens, since = full - increment, t
                    out.append((True, tokens, 0 if tokens >= increment else math.ceil((increment - tokens) / rate)))
                else:
                    out.append((False, 0, math.ceil((increment - full) / rate)))
            pdf[["allowed", "remaining", "resets_in_ms"]] = pd.DataFrame(out, index=pdf.index, columns=["allowed", "remaining", "resets_in_ms"])
            yield pdf

    return requests.select(key, *order).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def full(capacity: int) -> Column:
    """A bucket's tokens after a reset."""
    return F.lit(capacity)


def peek(tokens: Column, since: Column, now: Column, capacity: int, rate: float) -> Column:
    """Whole tokens that a bucket holds at a time; nothing is taken."""
    return F.floor(F.least(F.lit(float(capacity)), tokens + (now - since) * rate)).cast("long")


def wait(tokens: Column, since: Column, now: Column, capacity: int, rate: float, increment: int = 1) -> Column:
    """Milliseconds until a request is allowed."""
    held = F.least(F.lit(float(capacity)), tokens + (now - since) * rate)
    return F.greatest(F.lit(0).cast("long"), F.ceil((increment - held) / rate).cast("long"))


def bounded_queue(messages: DataFrame, queue: str, seq: str, size: str, most: int, most_bytes: int) -> DataFrame:
    """What each queue holds after all its messages came: the newest that fit both bounds."""
    newest = Window.partitionBy(queue).orderBy(F.desc(seq)).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("behind", F.count(F.lit(1)).over(newest)).withColumn("bytes_behind", F.sum(size).over(newest)).where((F.col("behind") <= most) & (F.col("bytes_behind") <= most_bytes))


def drained(queued: DataFrame, queue: str, seq: str, enqueued: str, ttl_ms: int, now: int, n: int) -> DataFrame:
    """Up to n messages of each queue that haven't expired, oldest first."""
    fresh = queued.where(F.col(enqueued) + ttl_ms > now)
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy(queue).orderBy(seq))).where(F.col("place") <= n)
