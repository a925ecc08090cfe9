"""Artifact lists and their sinks' rows: nested gathers, trees, referrers, platform merges, blob writes, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import graph as G


def nested_images(edges: DataFrame, roots: DataFrame, gathers: DataFrame) -> DataFrame:
    """(root, node): leaf images below each root; only nodes of gathers(node) are opened."""
    opened = edges.join(gathers.select(F.col("node").alias("parent")), "parent", "left_semi")
    reach = labelled_closure(opened, roots.select(F.col("node").alias("root"), "node"))
    return reach.join(gathers, "node", "left_anti").where("root <> node")


def labelled_closure(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, node): what each start(root, node) reaches, itself included; cycles are no harm."""
    step = G.steps(edges)
    seen = frontier = G.cut(starts.select("root", "node").distinct())
    for i in G.levels(depth):
        found = frontier.join(step, "node").select("root", F.col("child").alias("node")).distinct()
        frontier = G.cut(found.join(seen, ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = G.cut(seen.unionByName(frontier)) if i % 5 == 0 else seen.unionByName(frontier)
    return seen


def list_images(images: DataFrame, edges: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of images(node, ...) once each, without what existing(node) already reaches."""
    known = G.closure(edges, existing).select("node")
    return images.join(known, "node", "left_anti").dropDuplicates(["node"])


def tree(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """(path, depth, line, again): printed lines in path order; a node met before is marked and not opened."""
    first = G.first_paths(edges, root, depth)
    lines = edges.join(first.select(F.col("node").alias("parent"), F.col("path").alias("up")), "parent")
    lines = lines.select(F.concat("up", F.lpad(F.col("ordinal").cast("string"), 9, "0")).alias("path"), F.col("child").alias("node"))
    out = lines.join(first.select("node", F.col("path").alias("met")), "node").withColumn("depth", (F.length("path") / 9).cast("int"))
    again = F.col("path") != F.col("met")
    return out.where(F.col("depth") <= depth).select("path", "depth", F.concat(F.repeat(F.lit("  "), F.col("depth")), "node", F.when(again, " (repeated)").otherwise("")).alias("line"), again.alias("again"))


def sbom_map(index_edges: DataFrame, manifests: DataFrame, referrers: DataFrame, kind: str) -> DataFrame:
    """(index, platform, referrer): referrers(subject, referrer, artifact_type) of a kind, by platform of their manifest."""
    platform = F.concat_ws("/", F.coalesce("os", F.lit("unknown")), F.coalesce("architecture", F.lit("unknown")))
    found = referrers.where(F.col("artifact_type") == kind).select(F.col("subject").alias("manifest"), "referrer")
    return index_edges.join(manifests.select("manifest", platform.alias("platform")), "manifest").join(found, "manifest").select("index", "platform", "referrer")


def replace_platforms(index: DataFrame, pushed: DataFrame, by: list[str]) -> DataFrame:
    """Manifests of index(by..., ordinal, os, architecture, variant, digest), with those pushed put in their platform's place or appended.

    Nulls of a platform are equal to each other. ``pushed`` holds one row for each platform at most; it has no ordinal.
    """
    parts = [*by, "os", "architecture", "variant"]
    new = pushed.select(*parts, F.col("digest").alias("new"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in parts]
    kept = index.alias("a").join(new.alias("b"), same, "left").select(*[f"a.{c}" for c in parts], "a.ordinal", F.coalesce("b.new", "a.digest").alias("digest"))
    last = index.groupBy(*by).agg(F.max("ordinal").alias("last"))
    more = pushed.alias("a").join(index.alias("b"), same, "left_anti").join(last, by, "left")
    return kept.unionByName(more.select(*parts, (F.coalesce("last", F.lit(-1)) + 1).alias("ordinal"), "digest"))


def save_blobs(blobs: DataFrame, existing: DataFrame) -> DataFrame:
    """(digest, size, verified): blobs(digest, size, content) still to be written, once each, checked against digest and size."""
    ok = (F.concat(F.lit("sha256:"), F.sha2("content", 256)) == F.col("digest")) & (F.octet_length("content") == F.col("size"))
    new = blobs.join(existing.select("digest"), "digest", "left_anti")
    return new.select("digest", "size", ok.alias("ok")).groupBy("digest").agg(F.max("size").alias("size"), F.bool_and("ok").alias("verified"))


def failed_requirements(projects: DataFrame, requirements: DataFrame) -> DataFrame:
    """(project, line_no, line): a file that can be replayed, one comment for each project and the requirements of those that failed.

    projects(project, error), requirements(project, no, requirement); a null error is success.
    """
    q = F.concat(F.lit('# "'), "project", F.lit('" '))
    head = projects.select("project", F.lit(0).cast("long").alias("line_no"), F.when(F.col("error").isNull(), F.concat(q, F.lit("processed successfully"))).otherwise(F.concat(q, F.lit("failed to process with error "), "error")).alias("line"))
    failed = projects.where("error is not null").select("project")
    return head.union(requirements.join(failed, "project", "left_semi").select("project", F.col("no").cast("long"), "requirement"))


def latest_of(deprecates: DataFrame) -> DataFrame:
    """(node, latest): the end of each node's chain of deprecates(newer, older); links are doubled, so rounds are logarithmic."""
    jump = G.cut(deprecates.groupBy(F.col("older").alias("node")).agg(F.max("newer").alias("latest")))
    for _ in range(64):
        nxt = jump.join(jump.select(F.col("node").alias("latest"), F.col("latest").alias("far")), "latest", "left")
        nxt = G.cut(nxt.select("node", F.coalesce("far", "latest").alias("latest"), F.col("far").isNotNull().alias("moved")))
        jump = nxt.select("node", "latest")
        if nxt.where("moved").isEmpty():
            break
    return jump


def first_valid(candidates: DataFrame, key: str) -> DataFrame:
    """(key, ref): of candidates(key, server, position, ref, valid), the first valid one in order of server and position."""
    return candidates.where("valid").groupBy(key).agg(F.min_by("ref", F.struct("server", "position")).alias("ref"))


def serialize_batch(known: DataFrame, batch: DataFrame, number: int) -> DataFrame:
    """(digest, sync): images of a batch that no earlier sync holds, under this sync's number."""
    return batch.select("digest").distinct().join(known.select("digest"), "digest", "left_anti").withColumn("sync", F.lit(number))


def walk_parts(files: DataFrame) -> DataFrame:
    """(part, kind, size, error) of files(path, size): a first component is a file or a folder part; hidden paths are skipped.

    A folder that holds a label file is no part, its entries are; an empty file is an error. One level of label files is followed.
    """
    shown = files.where(~F.col("path").rlike(r"(^|/)\.(?!labels\.ya?ml$)"))
    top = F.substring_index("path", "/", 1)
    labelled = shown.where(F.col("path").rlike(r"^[^/]+/\.labels\.ya?ml$")).select(top.alias("top")).distinct().withColumn("open", F.lit(True))
    f = shown.where(~F.col("path").rlike(r"(^|/)\.labels\.ya?ml$")).withColumn("top", top).join(labelled, "top", "left")
    part = F.when(F.col("open"), F.substring_index("path", "/", 2)).otherwise(F.col("top"))
    return f.groupBy(part.alias("part")).agg(F.when(F.max(F.col("path") != part), "dir").otherwise("file").alias("kind"), F.sum("size").alias("size"), F.bool_or(F.col("size") == 0).alias("error"))


def stored_index(rows: DataFrame, version: str = "5", row_version: str = "7") -> DataFrame:
    """Rows of a stored index that this version may read; all others start empty."""
    return rows.where((F.col("index_version") == version) & (F.col("row_version") == row_version))


def distinct_suffixes(a: Column, b: Column) -> Column:
    """struct(a, b): the shortest trailing parts of two paths that tell them apart; equal paths stay whole."""
    pa, pb = F.reverse(F.split(a, "/")), F.reverse(F.split(b, "/"))
    same = F.transform(F.arrays_zip(pa.alias("x"), pb.alias("y")), lambda z: z["x"].eqNullSafe(z["y"]))
    n = F.array_position(same, False).cast("int")
    short = lambda p: F.array_join(F.filter(F.reverse(F.slice(p, F.lit(1), n)), lambda x: x != ""), "/")
    return F.struct(F.when(a == b, a).otherwise(short(pa)).alias("a"), F.when(a == b, b).otherwise(short(pb)).alias("b"))


SEMVER = r"^v?([0-9]+(?:\.[0-9]+)*)(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?$"


def version_key(v: Column) -> Column:
    """An ordered key of a semantic version, null if it is none: a pre-release sorts before its release, numbers before words."""
    v = F.trim(v)
    nums = F.transform(F.split(F.regexp_extract(v, SEMVER, 1), r"\."), lambda x: x.cast("long"))
    pad = F.concat(nums, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), 3 - F.size(nums))))
    pre = F.regexp_extract(v, SEMVER, 2)
    number = lambda x: F.when(x.rlike("^[0-9]+$"), x.cast("long"))
    ids = F.transform(F.split(pre, r"\."), lambda x: F.struct(number(x).isNull().alias("word"), F.coalesce(number(x), F.lit(0)).alias("number"), x.alias("text")))
    return F.when(v.rlike(SEMVER), F.struct(pad.alias("nums"), (pre == "").alias("release"), ids.alias("ids")))


def version_ok(got: Column, minimum: Column) -> Column:
    """Whether a version reaches a minimum; null if either is no semantic version."""
    return version_key(got) >= version_key(minimum)


def thumbprints(certificates: Column) -> Column:
    """JSON list of the SHA-256 of each certificate of a chain, in order."""
    return F.to_json(F.transform(certificates, lambda c: F.sha2(c, 256)))
