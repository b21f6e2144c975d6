"""Expressions over dotted URIs. A component is what stands between dots; an empty one is a wildcard in a pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules for URIs (fixed values); \\s of the original text is a space.
RULES = {
    "loose": r"^([^ .#]+\.)*([^ .#]+)$",
    "loose_prefix": r"^([^ .#]+\.)*([^ .#]+)[.]?$",
    "loose_allow_empty": r"^(([^ .#]+\.)|\.)*([^ .#]+)?$",
    "strict": r"^([0-9a-z_]+\.)*([0-9a-z_]+)$",
    "strict_prefix": r"^([0-9a-z_]+\.)*([0-9a-z_]+)[.]?$",
    "strict_allow_empty": r"^(([0-9a-z_]+\.)|\.)*([0-9a-z_]+)?$",
}


def components(uri: Column) -> Column:
    return F.split(uri, r"\.", -1)


def shape(uri: Column) -> Column:
    """A 1 for each component that is given and a 0 for each wildcard, as text, so that any number of them will do."""
    return F.array_join(F.transform(components(uri), lambda x: F.when(x == "", "0").otherwise("1")), "")


def degree(uri: Column) -> Column:
    """The shape as a number, the first component most significant; null beyond 62 components, which `degree_keys` can order."""
    number = F.aggregate(components(uri), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x == "", 0).otherwise(1))
    return F.when(F.size(components(uri)) <= 62, number)


def degree_keys(uri: Column) -> list[Column]:
    """Two columns that sort as the degree does, for any number of components."""
    bits = F.regexp_replace(shape(uri), "^0+", "")
    return [F.char_length(bits), bits]


def matches(target: Column, pattern: Column, policy: Column) -> Column:
    """Whether a pattern matches a ground URI: equality, raw byte prefix, or component by component; a wildcard needs a component that isn't empty."""
    t, p = components(target), components(pattern)
    wild = (F.size(t) == F.size(p)) & F.forall(F.arrays_zip(t.alias("t"), p.alias("p")), lambda x: ((x["p"] == "") & (x["t"] != "")) | ((x["p"] != "") & (x["p"] == x["t"])))
    return F.when(policy == "exact", target == pattern).when(policy == "prefix", F.startswith(target, pattern)).otherwise(wild)


def subsumes(pattern: Column, other: Column) -> Column:
    """As a wildcard match, but an empty component of the other URI is accepted."""
    p, o = components(pattern), components(other)
    return (F.size(p) == F.size(o)) & F.forall(F.arrays_zip(p.alias("p"), o.alias("o")), lambda x: (x["p"] == "") | (x["p"] == x["o"]))


def valid(uri: Column, rule: str) -> Column:
    return F.rlike(uri, F.lit(RULES[rule]))


def derived_policy(uri: Column) -> Column:
    """The first of exact, wildcard and prefix whose rule accepts the text."""
    return F.when(valid(uri, "strict"), "exact").when(valid(uri, "strict_allow_empty"), "wildcard").when(valid(uri, "strict_prefix"), "prefix")


def domain_and_rest(uri: Column) -> Column:
    """The first two labels joined, then the others; null below three labels."""
    c = components(uri)
    return F.when(F.size(c) >= 3, F.concat(F.array(F.array_join(F.slice(c, 1, 2), ".")), F.slice(c, 3, F.size(c) - 2)))


def encoded(uri: Column) -> Column:
    """Empty components as a NUL, so that they sort before all others."""
    return F.array_join(F.transform(components(uri), lambda x: F.when(x == "", "\0").otherwise(x)), ".")


def decoded(text: Column) -> Column:
    return F.replace(text, F.lit("\0"), F.lit(""))
