"""Catalog operators: part status, ledger, cache index, reports, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits of a part's status.
EXISTS, CACHED, CHANGED, DIGEST_MATCH, NEW, DELETED, VIRTUAL = 1, 2, 4, 8, 16, 32, 64


def part_status(tracked: DataFrame, disk: DataFrame, cached: DataFrame, virtual: DataFrame) -> DataFrame:
    """(name, status): tracked(name, size, digest, layer_digest, modified) full outer disk(name, size, digest, modified).

    Bits as in EXISTS ...; cached(layer_digest) and virtual(content_id) are looked up by equality.
    """
    t = tracked.select("name", F.struct("size", "digest", "layer_digest", "modified").alias("t"))
    d = disk.select("name", F.struct("size", "digest", "modified").alias("d"))
    j = t.join(d, "name", "full").withColumn("layer_digest", F.col("t.layer_digest"))
    j = j.join(cached.select("layer_digest").distinct().withColumn("c", F.lit(True)), "layer_digest", "left")
    j = j.withColumn("content_id", F.col("t.digest")).join(virtual.select("content_id").distinct().withColumn("v", F.lit(True)), "content_id", "left")
    on = lambda c, bit: F.when(F.coalesce(c, F.lit(False)), F.lit(bit)).otherwise(F.lit(0))
    known, here = F.col("t").isNotNull(), F.col("d").isNotNull()
    both = known & here
    changed = both & ((F.col("t.modified") < F.col("d.modified")) | (F.col("t.size") != F.col("d.size")) | (F.coalesce(F.col("t.digest"), F.lit("")) == ""))
    same = both & (F.coalesce(F.col("d.digest"), F.lit("")) != "") & (F.col("t.digest") == F.col("d.digest"))
    status = on(known, EXISTS) + on(known & F.col("c"), CACHED) + on(changed, CHANGED) + on(same, DIGEST_MATCH) + on(here & ~known, NEW) + on(known & ~here, DELETED) + on(known & F.col("v"), VIRTUAL)
    return j.select("name", status.alias("status"))


def action(status: Column) -> Column:
    """What the catalog does with a part: remove, insert, reset, keep."""
    has = lambda b: status.bitwiseAND(b) != 0
    return F.when(has(DELETED), F.lit("remove")).when(has(NEW), F.lit("insert")).when(has(CHANGED) & ~has(DIGEST_MATCH), F.lit("reset")).otherwise(F.lit("keep"))


def running_total(df: DataFrame, value: str, order: str, to: str) -> DataFrame:
    """df with the sum of value over all rows up to this one by order (unique), in two passes.

    Rows are range-partitioned and summed in partitions; the totals of the partitions, one row
    each, give the offsets. No task sees all rows.
    """
    from cairn.operators.graph import cut

    part = cut(df.repartitionByRange(F.col(order)).withColumn("part__", F.spark_partition_id()))
    offsets, n = [], 0
    for r in part.groupBy("part__").agg(F.sum(value).alias("s")).orderBy("part__").collect():
        offsets.append((r[0], int(n)))
        n += r[1] or 0
    w = Window.partitionBy("part__").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    base = F.broadcast(df.sparkSession.createDataFrame(offsets, "part__ int, base__ long"))
    return part.join(base, "part__").withColumn(to, F.col("base__") + F.sum(value).over(w)).drop("part__", "base__")


def prune_plan(files: DataFrame, max_size: int, order: str = "atime") -> DataFrame:
    """files(..., size) with ``delete``: oldest first until what is left is at most max_size; max_size <= 0 deletes all."""
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long")).first()[0]
    r = running_total(files, "size", order, "cum")
    return r.withColumn("delete", F.lit(True) if max_size <= 0 else (F.lit(total) - (F.col("cum") - F.col("size")) > max_size)).drop("cum")


def candidates(locations: DataFrame, primary: Column, untransformed: Column, by: list[str]) -> DataFrame:
    """Ranked blob locations: the wanted digest first, its untransformed form last, then newest, then digest."""
    w = Window.partitionBy(*by).orderBy(F.when(primary, 0).when(untransformed, 2).otherwise(1), F.desc("last_seen"), "digest", "location")
    return locations.withColumn("rank", F.row_number().over(w).cast("int"))


def severity_pivot(matches: DataFrame, severities: list[str]) -> DataFrame:
    """(reference, one count for each severity); other severities are dropped."""
    return matches.groupBy("reference").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in severities])


def distinct_last(matches: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row by order of each key."""
    rest = [c for c in matches.columns if c not in keys]
    return matches.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with rows of new in the place of those with their keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def upsert_item(items: Column, item: Column, same) -> Column:
    """An array of structs with item instead of the first that is the same, or at the end."""
    at = F.array_position(F.transform(items, same), True)
    return F.when(at > 0, F.concat(F.slice(items, 1, F.greatest(at - 1, F.lit(0)).cast("int")), F.array(item), F.slice(items, (at + 1).cast("int"), F.greatest(F.size(items), F.lit(1))))).otherwise(F.concat(items, F.array(item)))
