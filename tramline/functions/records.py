"""What others see of records, and checks of maps against specs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def external_session(session: Column, realm: Column, node: Column, opened_ms: Column, agent: Column) -> Column:
    """A session as others see it: ids, and its details nested; what is missing is left out."""
    details = F.struct(agent.alias("agent"), node.alias("node"), opened_ms.alias("opened_ms"))
    return F.struct(session.alias("session"), realm.alias("realm"), details.alias("details"))


def external_realm(realm: Column, prototype: Column, sso: Column) -> Column:
    """Properties of a realm without its keys and passwords."""
    return F.struct(realm.alias("uri"), prototype.alias("prototype_uri"), F.coalesce(sso.isNotNull(), F.lit(False)).alias("is_sso"))


def external_grant(role_type: Column, role: Column, uri: Column, policy: Column, permissions: Column) -> Column:
    """A grant: its role, the resource with its match policy, and the permissions in order."""
    match = F.when(uri == "", "any").otherwise(policy)
    return F.struct(F.concat_ws("/", role_type, role).alias("role"), F.struct(F.when(uri == "", "*").otherwise(uri).alias("uri"), match.alias("match")).alias("resource"), F.array_sort(permissions).alias("permissions"))


@dataclass(frozen=True)
class Field:
    """Spec of a key: its type as Spark names it, whether it must be there, its default, and a check of the typed value."""

    kind: str = "string"
    required: bool = False
    default: str | None = None
    check: object = None


def validated(values: Column, spec: dict[str, Field], extensions: str | None = None) -> Column:
    """A map of texts against a spec: `fields` (typed, defaults put in; unknown keys dropped, unless they match the
    pattern `extensions`, which come back in `extra`), `errors` (key: what is wrong) and `ok`."""
    fields, errors = [], []
    for name, f in spec.items():
        raw = F.try_element_at(values, F.lit(name))
        typed = raw.try_cast(f.kind)
        errors.append(F.when(raw.isNull(), F.lit(f"{name}: missing") if f.required and f.default is None else F.lit(None)).when(typed.isNull(), f"{name}: not a {f.kind}").when(~f.check(typed) if f.check else F.lit(False), f"{name}: out of range"))
        fields.append(F.coalesce(typed, F.lit(f.default).try_cast(f.kind)).alias(name))
    extra = F.map_filter(values, lambda k, _: ~k.isin(*spec) & (F.rlike(k, F.lit(extensions)) if extensions else F.lit(False)))
    wrong = F.array_compact(F.array(*errors))
    return F.struct(F.struct(*fields).alias("fields"), extra.alias("extra"), wrong.alias("errors"), (F.size(wrong) == 0).alias("ok"))


def text_keys(values: Column) -> Column:
    """A map with its keys as texts."""
    return F.transform_keys(values, lambda k, _: k.cast("string"))


def random_id(draw: Column) -> Column:
    """A uniform id from 1 to 2^53 for a uniform draw from 0 to 1."""
    return F.lit(1).cast("long") + F.floor(draw * float(2**53)).cast("long")


def elapsed(since_us: Column, until_us: Column, unit: str) -> Column:
    """Whole units between two times in microseconds."""
    return F.floor((until_us - since_us) / {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "minute": 60_000_000}[unit]).cast("long")


def enabled(mask: Column, flag: int) -> Column:
    return mask.bitwiseAND(F.lit(flag)) == flag


def enable(mask: Column, flag: int) -> Column:
    return mask.bitwiseOR(F.lit(flag))


def disable(mask: Column, flag: int) -> Column:
    return mask.bitwiseAND(F.lit(~flag))


def compatible(mask: Column, other: Column) -> Column:
    """Whether a mask has all flags of another."""
    return mask.bitwiseAND(other) == other


def increment(delay: Column, cap: int | None = None) -> Column:
    """Twice a delay, up to a cap."""
    return delay * 2 if cap is None else F.least(delay * 2, F.lit(cap))


def jittered(delay: Column, draw: Column) -> Column:
    """Between once and three times a delay, for a uniform draw from 0 to 1."""
    return delay + F.floor(draw * (2 * delay + 1)).cast("long")


def index_key(*parts: Column) -> Column:
    """Parts as one text that sorts as they do: joined by NUL."""
    return F.concat_ws("\0", *parts)


def index_parts(key: Column, n: int) -> list[Column]:
    split = F.split(key, "\0", n)
    return [split[i] for i in range(n)]


def table_line(columns: list[Column], widths: list[int]) -> Column:
    """A row of a fixed-width table: cells padded, or cut, to their widths."""
    cells = [F.rpad(F.coalesce(c.cast("string"), F.lit("-")), w, " ") for c, w in zip(columns, widths, strict=True)]
    return reduce(lambda a, b: F.concat(a, F.lit(" | "), b), cells)


def merged_tickets(a: Column, b: Column) -> Column:
    """Two lists of tickets (expiry, id): distinct, in order of expiry; of one id the later expiry stays."""
    both = F.array_union(a, b)
    return F.array_sort(F.filter(both, lambda x: ~F.exists(both, lambda y: (y["id"] == x["id"]) & (y["expiry"] > x["expiry"]))))
