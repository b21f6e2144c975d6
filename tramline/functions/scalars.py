"""Small expressions: ids, times, backoff, flags, statuses, lists and bodies."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Capabilities and their bits, in order.
FLAGS = ("shared_registration", "pattern_based_registration", "call_timeout", "call_canceling", "progressive_results", "caller_identification")


def uuid7(ms: Column, seed: Column) -> Column:
    """Time-ordered UUID: 48 bits of milliseconds, the version, the variant, and bits of a seeded hash (so reruns agree)."""
    a, b = F.lpad(F.lower(F.hex(F.xxhash64(seed))), 16, "0"), F.lpad(F.lower(F.hex(F.xxhash64(seed, F.lit(1)))), 16, "0")
    t = F.lpad(F.lower(F.hex(ms)), 12, "0")
    return F.concat(F.substring(t, 1, 8), F.lit("-"), F.substring(t, 9, 4), F.lit("-7"), F.substring(a, 1, 3), F.lit("-a"), F.substring(a, 4, 3), F.lit("-"), F.substring(b, 1, 12))


def uuid7_ms(u: Column) -> Column:
    return F.conv(F.substring(F.replace(u, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long")


def uuid_bytes(u: Column) -> Column:
    """The 16 bytes of a UUID text in either case, with or without hyphens; null if it isn't one."""
    plain = F.replace(u, F.lit("-"), F.lit(""))
    return F.when(F.rlike(plain, F.lit("^[0-9a-fA-F]{32}$")), F.unhex(plain))


def uuid_text(b: Column) -> Column:
    h = F.lower(F.hex(b))
    return F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def uuid7_valid(u: Column) -> Column:
    return F.rlike(u, F.lit("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"))


def backoff(attempt: Column, base: int, cap: int, floor: int, draw: Column) -> Column:
    """Exponential, capped, jittered by a uniform draw and floored."""
    return F.greatest(F.lit(floor), F.floor(draw * F.least(F.lit(cap).cast("double"), base * F.pow(F.lit(2.0), attempt - 1))).cast("long"))


def mask(flags: Column) -> Column:
    """Bit mask of a map from capability to boolean."""
    return sum((F.when(F.coalesce(F.try_element_at(flags, F.lit(f)), F.lit(False)), 1 << i).otherwise(0) for i, f in enumerate(FLAGS)), F.lit(0))


def unmasked(m: Column) -> Column:
    return F.create_map(*(x for i, f in enumerate(FLAGS) for x in (F.lit(f), F.getbit(m, F.lit(i)) == 1)))


def status_error(status: Column, namespace: str = "tramline") -> Column:
    """Error URI of an HTTP status (fixed values): the protocol's own errors, else those of this engine."""
    return (
        F.when(status.isin(400, 422), "wamp.error.invalid_argument").when(status.isin(401, 403), "wamp.error.not_authorized").when(status == 404, "wamp.error.not_found")
        .when(status.isin(408, 504), "wamp.error.timeout").when(status == 429, f"{namespace}.error.too_many_requests").when(status.between(400, 499), f"{namespace}.error.invalid_argument")
        .otherwise(f"{namespace}.error.bad_gateway")
    )


# HTTP status of an error URI (fixed values); others are 500.
STATUS = {
    "wamp.error.authorization_failed": 403, "wamp.error.canceled": 400, "wamp.error.option_disallowed.disclose_me": 400, "wamp.error.invalid_argument": 400, "wamp.error.invalid_uri": 400,
    "wamp.error.network_failure": 502, "wamp.error.not_authorized": 401, "wamp.error.no_eligible_callee": 502, "wamp.error.no_such_procedure": 501, "wamp.error.no_such_realm": 502,
    "wamp.error.no_such_registration": 502, "wamp.error.no_such_role": 400, "wamp.error.timeout": 504,
    "wamp.error.no_such_subscription": 502, "wamp.error.option_not_allowed": 400, "wamp.error.procedure_already_exists": 400, "tramline.error.bad_gateway": 503, "tramline.error.timeout": 504,
}


def error_status(uri: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair)), uri), F.lit(500))


def joined(items: Column, conjunction: str = "and") -> Column:
    """'a', 'b' and 'c'."""
    quoted = F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    n = F.size(items)
    return F.when(n <= 1, F.array_join(quoted, "")).otherwise(F.concat(F.array_join(F.slice(quoted, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(f" {conjunction} "), F.element_at(quoted, -1)))


def form_body(values: Column) -> Column:
    """application/x-www-form-urlencoded text of a map, keys in order."""
    pairs = F.array_sort(F.transform(F.map_entries(values), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))))
    return F.array_join(pairs, "&")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    digits = F.filter(F.split(F.hex(text.cast("binary")), "(?<=\\G..)"), lambda x: x != "")
    return F.aggregate(digits, F.lit(2166136261).cast("long"), lambda a, x: F.pmod(a.bitwiseXOR(F.conv(x, 16, 10).cast("long")) * 16777619, F.lit(4294967296)))


@F.pandas_udf(StringType())
def normal_name(name: pd.Series) -> pd.Series:
    """NFKD and case folding, more than lower() does."""
    return name.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).casefold())


ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@F.pandas_udf(StringType())
def base62(n: pd.Series) -> pd.Series:
    def one(x):
        x, out = int(x), ""
        while x:
            x, r = divmod(x, 62)
            out = ALPHABET[r] + out
        return out or "0"

    return n.map(one)
