"""Joins of ground URIs with stored patterns, as equi joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import uri as U

POLICIES = ("exact", "prefix", "wildcard")
#: So many keys of the ranking come from the policy and the URI; the others all rise.
FIXED = 5


def match_patterns(targets: DataFrame, patterns: DataFrame, target: str = "topic", policies=POLICIES) -> DataFrame:
    """Rows of `targets` with each row of `patterns` (realm, uri, policy, ...) whose pattern matches in the same realm.

    A theta join would be a nested loop. Instead a target is looked up once for each length that prefixes of its realm
    have (bytes, no longer than itself) and once for each shape (components, mask) that wildcards have, so every join has
    an equality on (realm, key): it shuffles, spills and splits skew like any other. Lengths and shapes are joined as
    small tables of their own, which Spark broadcasts only below its threshold.
    """
    patterns = patterns.withColumnRenamed("realm", "__p_realm")
    parts = []
    if "exact" in policies:
        p = patterns.where("policy = 'exact'")
        parts.append(targets.join(p, (F.col("realm") == F.col("__p_realm")) & (F.col(target) == F.col("uri"))))
    if "prefix" in policies:
        p = patterns.where("policy = 'prefix'").withColumn("__p_key", F.col("uri").cast("binary"))
        lengths = p.select(F.col("__p_realm").alias("__l_realm"), F.octet_length("uri").alias("__l")).distinct().groupBy("__l_realm").agg(F.sort_array(F.collect_list("__l")).alias("__lengths"))
        t = targets.join(lengths, F.col("realm") == F.col("__l_realm"))
        t = t.withColumn("__l", F.explode(F.filter("__lengths", lambda n: n <= F.octet_length(target)))).withColumn("__t_key", F.substring(F.col(target).cast("binary"), F.lit(1), F.col("__l")))
        parts.append(t.join(p, (F.col("realm") == F.col("__p_realm")) & (F.col("__t_key") == F.col("__p_key"))))
    if "wildcard" in policies:
        p = patterns.where("policy = 'wildcard'").withColumn("__p_size", F.size(U.components(F.col("uri")))).withColumn("__p_degree", U.shape(F.col("uri")))
        shapes = p.select(F.col("__p_realm").alias("__s_realm"), F.col("__p_size").alias("__s_size"), F.col("__p_degree").alias("__mask")).distinct()
        t = targets.withColumn("__c", U.components(F.col(target))).withColumn("__n", F.size("__c"))
        t = t.join(shapes, (F.col("realm") == F.col("__s_realm")) & (F.col("__n") == F.col("__s_size")))
        t = t.where(F.expr("forall(transform(__c, (x, i) -> x <> '' or substring(__mask, i + 1, 1) = '1'), x -> x)"))
        t = t.withColumn("__t_key", F.expr("array_join(transform(__c, (x, i) -> if(substring(__mask, i + 1, 1) = '1', x, '')), '.')"))
        parts.append(t.join(p, (F.col("realm") == F.col("__p_realm")) & (F.col("__t_key") == F.col("uri")) & (F.col("__mask") == F.col("__p_degree"))))
    keep = [*targets.columns, *(c for c in patterns.columns if c != "__p_realm" and c not in targets.columns)]
    return reduce(DataFrame.unionByName, [x.select(*keep) for x in parts])


def best_match(matched: DataFrame, call: list[str], local_node: str | None = None) -> DataFrame:
    """One row of each call: exact before prefix before wildcard, longer prefixes and greater masks first; then the
    invocation policy (single first), this node, and the time of registration."""
    from pyspark.sql import Window

    order = ranking(local_node)
    return matched.withColumn("place", F.row_number().over(Window.partitionBy(*call).orderBy(*order))).where("place = 1").drop("place")


def best_entries(patterns: DataFrame, local_node: str | None = None) -> DataFrame:
    """The best of the entries that share a realm, a URI and a policy. All of them match the same calls, so the others are
    never a call's best match: found by a partial aggregate before the pattern join, that is a row of each pattern, however
    many entries it has."""
    key = ["realm", "uri", "policy"]
    rest = [c for c in patterns.columns if c not in key]
    order = [c.alias(f"k{i}") for i, (c, _) in enumerate(ranking_pairs(local_node)[FIXED:])]
    return patterns.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*key, "__row.*").select(*patterns.columns)


def ranking_pairs(local_node: str | None = None) -> list[tuple]:
    """The keys of `ranking` as (column, falling)."""
    wild = F.col("policy") == "wildcard"
    keys = [
        (F.when(F.col("policy") == "exact", 0).when(F.col("policy") == "prefix", 1).otherwise(2), False), (F.when(F.col("policy") == "prefix", F.col("uri")), True),
        *((F.when(wild, x), True) for x in U.degree_keys(F.col("uri"))), (F.when(wild, F.col("uri")), False),
        (F.when(F.col("invoke") == "single", 0).otherwise(1), False), (F.col("invoke"), False),
    ]
    return [*keys, *([(F.when(F.col("node") == local_node, 0).otherwise(1), False)] if local_node else []), (F.col("created_ms"), False), (F.col("entry_id"), False)]


def ranking(local_node: str | None = None) -> list:
    """Sort keys, most general order: see best_match."""
    return [c.desc() if falls else c.asc() for c, falls in ranking_pairs(local_node)]
