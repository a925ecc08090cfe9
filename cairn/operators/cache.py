"""Parts on their way into a cache and out of it: what is archived, digested, committed, copied; what lookups find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.codecs import measured, part_content, part_form


def _without(parts: DataFrame, virtual: DataFrame) -> DataFrame:
    return parts.join(virtual.select(F.col("content_id").alias("digest")), "digest", "left_anti")


def to_archive(parts: DataFrame, virtual: DataFrame, cached: DataFrame, opt_out: str = "compression") -> DataFrame:
    """parts(key, name, digest, layer_digest, media_type, labels) to be archived, as they are.

    Not those that a label keeps uncompressed, the virtual ones (virtual(content_id)), those whose layer is in cached(digest), nor raw ones.
    A null digest is that of a new part: neither virtual nor cached.
    """
    out = _without(parts.where(F.coalesce(F.col("labels")[opt_out] != "none", F.lit(True))), virtual)
    out = out.join(cached.select(F.col("digest").alias("layer_digest")), "layer_digest", "left_anti")
    return out.where(F.coalesce(part_form(F.col("media_type")) != "raw", F.lit(False)))


def digest_parts(parts: DataFrame, codec: Column) -> DataFrame:
    """parts(..., content, digest, layer_digest) with both digests and sizes; a part that has both digests keeps them."""
    have = F.col("digest").isNotNull() & F.col("layer_digest").isNotNull()
    # A null content is not encoded, so parts that have their digests cost no codec.
    m = parts.withColumn("m__", measured(F.when(~have, F.col("content")), codec))
    new = lambda c: F.when(have, F.col(c)).otherwise(F.col(f"m__.{c}")).alias(c)
    rest = [c for c in parts.columns if c not in ("digest", "layer_digest")]
    return m.select(*rest, new("digest"), new("layer_digest"), F.col("m__.size").alias("size"), F.col("m__.layer_size").alias("layer_size"), F.col("m__.layer").alias("layer"))


def to_commit(parts: DataFrame, virtual: DataFrame, cached: DataFrame) -> DataFrame:
    """(layer_digest, name) that the cache gets: each layer once, by the least name; no virtual part, none that is cached. No digest is an error."""
    p = _without(parts, virtual)
    told = F.coalesce("layer_digest", F.raise_error(F.concat(F.lit("no digest of "), "name")).cast("string"))
    p = p.select(told.alias("layer_digest"), "name").join(cached.select(F.col("digest").alias("layer_digest")), "layer_digest", "left_anti")
    return p.groupBy("layer_digest").agg(F.min("name").alias("name"))


def from_cache(parts: DataFrame, cache: DataFrame) -> DataFrame:
    """parts(..., layer_digest, media_type) with ``copied`` and the bytes that cache(digest, content) gives, decoded; null where it has none."""
    c = cache.select(F.col("digest").alias("layer_digest"), F.col("content").alias("c__")).dropDuplicates(["layer_digest"])
    out = parts.join(c, "layer_digest", "left")
    there = F.col("c__").isNotNull()
    return out.withColumn("copied", there).withColumn("content", F.when(there, part_content(F.col("c__"), F.when(there, F.col("media_type")).otherwise("raw")))).drop("c__")


def existence(lookups: DataFrame, present: DataFrame) -> DataFrame:
    """(digest, found) of each digest that was looked up, once, found or not."""
    have = present.select("digest").distinct().withColumn("found", F.lit(True))
    return lookups.select("digest").distinct().join(have, "digest", "left").select("digest", F.coalesce("found", F.lit(False)).alias("found"))


def observed(blobs: DataFrame, name: str):
    """blobs(size, ...) and an observation of the blobs and bytes that went by, filled by the first action."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return blobs.observe(seen, F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")), seen


def dry_run(blobs: DataFrame) -> None:
    """Do all the work of a write and store nothing."""
    blobs.write.format("noop").mode("overwrite").save()


def by_reference(rows: DataFrame) -> DataFrame:
    """rows(ref, digest, ...) by reference, all of them."""
    return rows.orderBy("ref", "digest")


def by_filename(rows: DataFrame, stable: str) -> DataFrame:
    """rows(filename, ...) with ``place``, from 1, by name; equal names in the order of a unique column. No task sorts all rows."""
    from cairn.operators.catalog import running_total

    keyed = rows.withColumn("one__", F.lit(1).cast("long")).withColumn("by__", F.struct("filename", stable))
    return running_total(keyed, "one__", "by__", "place").drop("one__", "by__")
