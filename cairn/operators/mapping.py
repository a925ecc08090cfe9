"""Routing rules: prefix, digest, nest and template mappers over references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule table of up to so many rows is sent to every executor; longer ones are joined by their key's hash.
BROADCAST_RULES = 100_000


def _prefixed(refs: DataFrame, col: str, rules: DataFrame) -> DataFrame:
    """refs by every rule (rule_no, src, dst) whose src is a prefix of the reference.

    The rules' distinct lengths turn the prefix test into an equality, so this is a hash join on the
    prefix, not a nested loop; the lengths are a bounded list (that of a key's length).
    """
    rules = rules.where("src <> ''")
    lengths = sorted(r[0] for r in rules.select(F.length("src")).distinct().collect())
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    cut = refs.withColumn("n__", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"))).where(F.length(col) >= F.col("n__")).withColumn("key__", F.substring(F.col(col), F.lit(1), F.col("n__")))
    return cut.join(F.broadcast(rules) if few else rules, (cut["key__"] == rules["src"])).drop("n__", "key__")


def _dest(col: str) -> Column:
    return F.concat("dst", F.expr(f"substring({col}, length(src) + 1)"))


def all_prefix(refs: DataFrame, rules: DataFrame, col: str = "ref") -> DataFrame:
    """A row for each matching rule: dest is dst and what follows the prefix."""
    return _prefixed(refs, col, rules).withColumn("dest", _dest(col)).drop("src", "dst")


def first_prefix(refs: DataFrame, rules: DataFrame, key: str, col: str = "ref") -> DataFrame:
    """(key, dest) by the first matching rule in file order; no match, no row."""
    return _prefixed(refs, col, rules).groupBy(key).agg(F.min_by(_dest(col), "rule_no").alias("dest"))


def longest_prefix(refs: DataFrame, rules: DataFrame, key: str, col: str = "ref") -> DataFrame:
    """(key, dest) by the longest matching rule, ties to the last; a rule with an empty src is the default; no match gives ''."""
    best = _prefixed(refs, col, rules).groupBy(key).agg(F.max_by(_dest(col), F.struct(F.length("src"), "rule_no")).alias("hit"))
    default = rules.where("src = ''").agg(F.max_by("dst", "rule_no").alias("default"))
    default = default.first()[0]
    other = F.lit("") if default is None else F.concat(F.lit(default), F.lit("/"), F.col(col))
    return refs.join(best, key, "left").select(key, F.coalesce("hit", other).alias("dest"))


def by_digest(blobs: DataFrame, rules: DataFrame) -> DataFrame:
    return blobs.join(rules.select(F.col("src").alias("digest"), F.col("dst").alias("dest")), "digest")


def nest(base: str, ref: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(ref, "^/+", ""))
