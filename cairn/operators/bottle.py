"""Edits of a document of parts, labels, metrics, authors, artifacts and links: arrays of structs in, arrays of structs out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.catalog import upsert_item


def put_label(labels: Column, key: Column, value: Column) -> Column:
    """A map with one key set, whatever it was."""
    return F.map_concat(F.map_filter(labels, lambda k, v: k != key), F.create_map(key, value))


def drop_label(labels: Column, key: Column) -> Column:
    """A map without a key; a key that is not there is an error."""
    return F.when(F.map_contains_key(labels, key), F.map_filter(labels, lambda k, v: k != key)).otherwise(F.raise_error(F.concat(F.lit("no label "), key)).cast("map<string,string>"))


def put_metric(metrics: Column, metric: Column) -> Column:
    """array<struct<name, ...>> with the metric in the place of the one of its name, or at the end."""
    return upsert_item(metrics, metric, lambda x: x["name"] == metric["name"])


def drop_named(items: Column, field: str, value: Column) -> Column:
    return F.filter(items, lambda x: ~x[field].eqNullSafe(value))


def put_author(authors: Column, author: Column) -> Column:
    """The first author of that name or e-mail gives way; else it is put at the end."""
    return upsert_item(authors, author, lambda x: (x["name"] == author["name"]) | (x["email"] == author["email"]))


def drop_author(authors: Column, name: Column) -> Column:
    """Authors but those of a name, without regard to case and outer spaces."""
    return F.filter(authors, lambda x: F.lower(F.trim(x["name"])) != F.lower(F.trim(name)))


def put_artifact(artifacts: Column, artifact: Column) -> Column:
    return upsert_item(artifacts, artifact, lambda x: x["path"] == artifact["path"])


def deprecate(links: Column, bottle: Column) -> Column:
    """Links with one more, unless it is there."""
    return F.when(F.array_contains(links, bottle), links).otherwise(F.concat(links, F.array(bottle)))


def touched(a: Column, b: Column) -> Column:
    """The later of two times; a null gives way."""
    return F.greatest(a, b)


def update_parts(parts: DataFrame, changes: DataFrame) -> DataFrame:
    """parts(key, name, size, digest, layer_size, layer_digest, labels, media_type) as changes of the same columns leave them.

    A part without a change stays, a change without a part is a new part. Names do not change. A negative size is no change; a
    new size clears both digests unless the change brings them; labels are replaced if there are any and they differ; an empty media type
    or digest keeps the old one.
    """
    cols = [c for c in parts.columns if c not in ("key", "name")]
    a = parts.select("key", "name", F.struct(*cols).alias("a"))
    b = changes.select("key", "name", F.struct(*cols).alias("b"))
    j, some = a.join(b, ["key", "name"], "full"), lambda c: F.nullif(F.col(f"b.{c}"), F.lit(""))
    resized = (F.col("b.size") >= 0) & (F.col("b.size") != F.col("a.size"))
    kept = lambda c, zero: F.when(resized, zero).otherwise(F.col(f"a.{c}"))
    new = {
        "size": F.when(resized, F.col("b.size")).otherwise(F.col("a.size")),
        "digest": F.coalesce(some("digest"), kept("digest", F.lit(""))),
        "layer_size": F.when(F.col("b.layer_size") > 0, F.col("b.layer_size")).otherwise(kept("layer_size", F.lit(0))),
        "layer_digest": F.coalesce(some("layer_digest"), kept("layer_digest", F.lit(""))),
        "labels": F.coalesce("b.labels", "a.labels"),
        "media_type": F.coalesce(some("media_type"), F.col("a.media_type")),
    }
    pick = lambda c: F.when(F.col("b").isNull(), F.col(f"a.{c}")).when(F.col("a").isNull(), F.col(f"b.{c}")).otherwise(new[c])
    return j.select("key", "name", *[pick(c).alias(c) for c in cols])


def remove_parts(parts: DataFrame, names: DataFrame) -> DataFrame:
    return parts.join(names.select("key", "name"), ["key", "name"], "left_anti")


def label_parts(parts: DataFrame, provided: DataFrame) -> DataFrame:
    """parts(key, name, ...) with the labels that provided(key, dir, base, labels) has for their folder and base; none are empty."""
    from cairn.functions.labels import split_part_name

    at = parts.withColumn("at", split_part_name(F.col("name")))
    at = at.withColumn("dir", F.col("at.dir")).withColumn("base", F.regexp_replace("at.base", "/$", "")).drop("at", "labels")
    out = at.join(provided.select("key", "dir", "base", "labels"), ["key", "dir", "base"], "left")
    return out.withColumn("labels", F.coalesce("labels", F.create_map().cast("map<string,string>"))).drop("dir", "base")


def manifest(parts: DataFrame, config: Column) -> DataFrame:
    """(key, manifest, digest): a manifest of parts(key, ordinal, layer_digest, layer_size, media_type), its layers in order, as JSON."""
    layers = F.array_sort(F.collect_list(F.struct("ordinal", F.col("media_type").alias("mediaType"), F.col("layer_digest").alias("digest"), F.col("layer_size").alias("size"))))
    layers = F.transform(layers, lambda x: F.struct(x["mediaType"].alias("mediaType"), x["digest"].alias("digest"), x["size"].alias("size")))
    out = parts.groupBy("key").agg(layers.alias("layers"))
    out = out.select("key", F.to_json(F.struct(F.lit(2).alias("schemaVersion"), config.alias("config"), "layers")).alias("manifest"))
    return out.withColumn("digest", F.concat(F.lit("sha256:"), F.sha2("manifest", 256)))


def add_virtual(virtual: DataFrame, parts: DataFrame) -> DataFrame:
    """(layer_digest, content_id): records of parts that were not pulled; one for each layer, the one that was there first stays."""
    new = parts.select("layer_digest", "content_id").dropDuplicates(["layer_digest"])
    return virtual.select("layer_digest", "content_id").unionByName(new.join(virtual, "layer_digest", "left_anti"))


def pull_command(parts: DataFrame, virtual: DataFrame, ref: Column) -> DataFrame:
    """(key, command): a pull that names each part of parts(key, name, content_id) that is not virtual, by name; no filter where none is."""
    p = parts.join(virtual.select("content_id").distinct().withColumn("gone", F.lit(True)), "content_id", "left")
    here = F.array_sort(F.collect_list(F.when(F.col("gone").isNull(), F.col("name"))))
    args = F.when(F.bool_or(F.col("gone").isNotNull()), F.array_join(F.transform(here, lambda n: F.concat(F.lit(" -p "), n)), "")).otherwise("")
    return p.groupBy("key").agg(args.alias("args")).select("key", F.concat(F.lit("pull "), ref, "args").alias("command"))
