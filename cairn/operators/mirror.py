"""Gather indexes, successors that are copied, batch files, blob locations: what a mirror run selects and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import platforms as P
from cairn.functions.names import GATHER_TYPE

DESCRIPTOR = "struct<mediaType: string, digest: string, size: bigint, annotations: map<string,string>>"
INDEX = f"struct<schemaVersion: int, artifactType: string, manifests: array<{DESCRIPTOR}>, annotations: map<string,string>>"
REF = "org.opencontainers.image.ref.name"


def gather_index(images: DataFrame, version: str) -> DataFrame:
    """(key, index, digest): one index for each key of images(key, ref, digest, size, media_type), as JSON.

    Manifests stand in order of their reference, those without one as if it were zz, then of digest; the sizes of all are summed in an
    annotation. Equal images are one.
    """
    each = images.select("key", "ref", "digest", "size", "media_type").distinct()
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("ref", F.lit("zz")).alias("o"), "digest", "size", "media_type", "ref")))
    made = F.transform(order, lambda x: F.struct(x["media_type"].alias("mediaType"), x["digest"].alias("digest"), x["size"].alias("size"), F.when(x["ref"].isNotNull(), F.create_map(F.lit(REF), x["ref"])).alias("annotations")))
    out = each.groupBy("key").agg(made.alias("manifests"), F.sum("size").alias("bytes"))
    notes = F.map_from_arrays(F.array(F.lit("version"), F.lit("bytes")), F.array(F.lit(version), F.col("bytes").cast("string")))
    out = out.select("key", F.to_json(F.struct(F.lit(2).alias("schemaVersion"), F.lit(GATHER_TYPE).alias("artifactType"), "manifests", notes.alias("annotations"))).alias("index"))
    return out.withColumn("digest", F.concat(F.lit("sha256:"), F.sha2("index", 256)))


def read_index(json: Column) -> Column:
    """An index document as a struct; null where it is none."""
    return F.from_json(json, INDEX)


def gathered(indexes: DataFrame) -> DataFrame:
    """(key, ref, pinned): the reference of each manifest of indexes(key, index), and the same with its digest."""
    m = indexes.select("key", F.inline(read_index(F.col("index"))["manifests"]))
    ref = F.col("annotations")[REF]
    return m.select("key", ref.alias("ref"), F.concat_ws("@", ref, "digest").alias("pinned"))


def is_mirror_artifact(media_type: Column, artifact_type: Column) -> Column:
    return media_type.isin(*P.INDEX_TYPES) & F.coalesce(artifact_type == GATHER_TYPE, F.lit(False))


def with_shadows(successors: DataFrame, indexes: DataFrame, annotation: str) -> DataFrame:
    """(parent, child): successors(parent, child) and the manifests that indexes(parent, annotations) keep as JSON in an annotation."""
    extra = indexes.select("parent", F.inline(F.from_json(F.col("annotations")[annotation], f"array<{DESCRIPTOR}>")))
    return successors.select("parent", "child").union(extra.select("parent", "digest")).distinct()


def fallback_index(children: DataFrame) -> DataFrame:
    """(parent, manifests, annotation): children(parent, ordinal, digest, size, media_type) split into images, which stay, and indexes, kept as JSON."""
    one = F.struct(F.col("media_type").alias("mediaType"), "digest", "size")
    listed = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ordinal", one.alias("d"))))), lambda x: x["d"])
    kind = P.media_kind(F.col("media_type"))
    return children.groupBy("parent").agg(F.to_json(listed(kind != "index")).alias("manifests"), F.to_json(listed(kind == "index")).alias("annotation"))


def wanted_children(children: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of children(..., platform) whose platform matches any of wanted(platform), each once; wanted is a short list."""
    return children.join(F.broadcast(wanted.select(F.col("platform").alias("want__"))), P.match(F.col("platform"), F.col("want__")), "left_semi")


def image_passes(config_type: Column, standard: str, matched: Column) -> Column:
    """An image whose config is not the standard one always passes; others by platform."""
    return (config_type != standard) | matched


def select_successors(layers: DataFrame, selected: Column | None) -> DataFrame:
    """layers(...) with ``copied`` and ``virtual``: the selected are copied, the others become virtual; no selector copies none."""
    take = F.lit(False) if selected is None else F.coalesce(selected, F.lit(False))
    return layers.withColumn("copied", take).withColumn("virtual", ~take)


def metadata_only(nodes: DataFrame, manifest: str, config: str, layer_prefix: str) -> DataFrame:
    """nodes(..., media_type) with ``does``: manifest and config are copied, layers skipped, all else rejected."""
    m = F.col("media_type")
    return nodes.withColumn("does", F.when(m.isin(manifest, config), "copy").when(m.startswith(layer_prefix), "skip").otherwise("reject"))


def layer_count_errors(parts: DataFrame, layers: DataFrame) -> DataFrame:
    """(key, parts, layers) where the numbers of parts(key) and layers(key) differ."""
    a, b = parts.groupBy("key").agg(F.count("*").alias("parts")), layers.groupBy("key").agg(F.count("*").alias("layers"))
    return a.join(b, "key", "full").select("key", F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("layers", F.lit(0)).alias("layers")).where("parts <> layers")


def unsynced(files: DataFrame, synced: DataFrame, ext: str = ".tar") -> DataFrame:
    """Names of files(name, is_dir) still to be read: no folder, no .csv, nothing hidden, none of synced(name)."""
    f = files.where(~F.col("is_dir") & ~F.col("name").endswith(".csv") & ~F.col("name").startswith(".") & F.col("name").endswith(ext))
    return f.select("name").join(synced.select("name"), "name", "left_anti")


def updated_since(files: DataFrame, since: Column) -> DataFrame:
    return files.where(F.col("mtime") > since)


def existing_syncs(tracker: DataFrame) -> DataFrame:
    """(name, artifacts, next): what tracker(name, artifact, number) knows of each name, as a map of latest numbers, and the number to go on with."""
    each = tracker.groupBy("name", "artifact").agg(F.max("number").alias("number"))
    out = each.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("artifact", "number")))).alias("artifacts"))
    last = tracker.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    return out.withColumn("next", F.lit(last + 1))


def located(candidates: DataFrame, same_registry: bool) -> DataFrame:
    """candidates(key, rank, ref, registry) that parse, only those of the key's own registry if so asked, by rank."""
    c = candidates.where(F.col("ref").contains("/")).withColumn("from", F.substring_index("ref", "/", 1))
    return c.where(F.col("from") == F.col("registry")) if same_registry else c


def record_location(index: DataFrame, seen: DataFrame) -> DataFrame:
    """index(digest, location, transformer, last_seen) with what was seen: each key once, with its latest time."""
    return index.unionByName(seen).groupBy("digest", "location").agg(F.max_by("transformer", "last_seen").alias("transformer"), F.max("last_seen").alias("last_seen"))


def mount_sources(sources: DataFrame) -> DataFrame:
    """sources(blob, registry, repository) each once."""
    return sources.select("blob", "registry", "repository").dropDuplicates()


def work(blobs: DataFrame, *by: str) -> DataFrame:
    """(by..., blobs, bytes) that were moved."""
    return blobs.groupBy(*by).agg(F.count("*").alias("blobs"), F.sum("size").alias("bytes"))


def map_merge(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of both; b wins."""
    return a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full").select(key, F.coalesce("b", "a").alias(value))


def joined_errors(errors: DataFrame, *by: str) -> DataFrame:
    """(by..., error): distinct errors(by..., error) in order, a line each."""
    return errors.where("error is not null").groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("error")), "\n").alias("error"))


def missing_in_order(missing: DataFrame) -> DataFrame:
    """missing(digest) by algorithm, then hex."""
    return missing.orderBy(F.substring_index("digest", ":", 1), F.substring_index("digest", ":", -1))


def map_by(kind: str, **mappers):
    """The mapper of ``TYPE=ARG``: mappers[TYPE](ARG). An unknown type is an error."""
    name, _, arg = kind.partition("=")
    if name not in mappers:
        raise ValueError(f"no mapper {name}: one of {sorted(mappers)}")
    return mappers[name](arg)


def tag_names(tags: DataFrame) -> DataFrame:
    """tags(tag, ...) that are names: those with a ':' are not."""
    return tags.where(~F.col("tag").contains(":"))


def kept_entries(entries: DataFrame, yanked: bool = False) -> DataFrame:
    """Stored entries(yanked, ...) that are not yanked, or all."""
    return entries if yanked else entries.where(F.col("yanked").isNull())


def current_version(documents: DataFrame, version: str) -> DataFrame:
    """documents(api_version, ...) of the current version only: others are not to be pulled by id."""
    return documents.where(F.col("api_version") == version)


def artifact_files(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """artifacts(digest, ...) with the path of a file(digest, path) of that content, the least by name."""
    return artifacts.join(files.groupBy("digest").agg(F.min("path").alias("path")), "digest")


def set_add(items: Column, item: Column) -> Column:
    """A set as a sorted array, with one more."""
    return F.array_sort(F.array_union(items, F.array(item)))


def set_remove(items: Column, item: Column) -> Column:
    return F.array_sort(F.array_remove(F.array_distinct(items), item))
