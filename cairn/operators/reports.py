"""Scan results, SBOM lists and signatures: sizes, classes, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.names import NOT_SCANNED, SBOM_TYPES

NOTATION = "application/vnd.cncf.notary.signature"


def artifact_size(manifests: DataFrame, children: DataFrame, layers: DataFrame) -> DataFrame:
    """(node, size): of an index, its own size, those of its children and of their layers; of any other manifest, its own alone.

    manifests(node, size), children(node, child), layers(node, size): configs are no layers.
    """
    own = manifests.select("node", "size")
    kids = children.join(manifests.select(F.col("node").alias("child"), F.col("size").alias("s")), "child")
    below = children.join(layers.select(F.col("node").alias("child"), F.col("size").alias("s")), "child")
    each = own.union(kids.select("node", "s")).union(below.select("node", "s"))
    return each.groupBy("node").agg(F.sum("size").alias("size"))


def scannable(results: DataFrame) -> DataFrame:
    """results(config_type, ...) that are there and of a kind that is scanned."""
    return results.where(F.col("config_type").isNotNull() & ~F.col("config_type").isin(*NOT_SCANNED))


def listed_sboms(sboms: DataFrame, platforms: list[str], image: str | None = None) -> DataFrame:
    """sboms(image, platform, ...) of the platforms listed, if any, and of one image, if any."""
    out = sboms.where(F.col("platform").isin(*platforms)) if platforms else sboms
    return out.where(F.col("image") == image) if image else out


def predecessor_roles(predecessors: DataFrame, checksum: Column, report_type: str) -> DataFrame:
    """(subject, signature, sbom, report): the last of each kind of predecessors(subject, ordinal, digest, artifact_type, checksum).

    A report counts if its database's checksum is the one given.
    """
    t = F.col("artifact_type")
    last = lambda cond: F.max_by(F.when(cond, F.col("digest")), F.when(cond, F.col("ordinal")))
    return predecessors.groupBy("subject").agg(
        last(t == NOTATION).alias("signature"), last(t.isin(*SBOM_TYPES)).alias("sbom"), last((t == report_type) & (F.col("checksum") == checksum)).alias("report"))


def referrers(edges: DataFrame, artifact_type: str | None = None) -> DataFrame:
    """(subject, digests): manifests that name a subject in edges(subject, digest, artifact_type), sorted, of one type if it is given."""
    e = edges if artifact_type is None else edges.where(F.col("artifact_type") == artifact_type)
    return e.groupBy("subject").agg(F.array_sort(F.collect_set("digest")).alias("digests"))


def sbom_layers(manifests: DataFrame, layers: DataFrame) -> DataFrame:
    """(image, platform, digest): the SBOM of each platform of manifests(image, platform, manifest): the last layer of layers(manifest, ordinal, digest)."""
    return manifests.join(layers, "manifest").groupBy("image", "platform").agg(F.max_by("digest", F.struct("manifest", "ordinal", "digest")).alias("digest"))


def short_names(images: DataFrame, top: int, score: str = "critical") -> DataFrame:
    """(ref, short): the images(ref, score) of the highest scores with names that tell them apart: the last part, with the one before where two
    share it, the whole where that is shared too."""
    first = images.orderBy(F.desc(score), "ref").limit(top)
    tail = lambda n: F.substring_index("ref", "/", -n)
    n1, n2 = Window.partitionBy(tail(1)), Window.partitionBy(tail(2))
    counted = first.withColumn("n1", F.count("*").over(n1)).withColumn("n2", F.count("*").over(n2))
    return counted.select("ref", F.when(F.col("n1") == 1, tail(1)).when(F.col("n2") == 1, tail(2)).otherwise(F.col("ref")).alias("short"))


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): each row as a line of a Markdown table."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("line"))


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): each row as a line of CSV; what holds a comma, quote or line end is quoted."""
    cell = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return rows.select(F.concat_ws(",", *[cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]).alias("line"))


def padded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with their columns as text of the column's greatest width."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    width = rows.agg(*[F.coalesce(F.max(F.length(text[c])), F.lit(0)).alias(c) for c in columns]).first()
    return rows.select(*[F.rpad(text[c], max(width[c], len(c)), " ").alias(c) for c in columns])


def write_report(rows: DataFrame, columns: list[str], target: str) -> None:
    """``method=folder``: json, csv, table or markdown lines below a folder."""
    method, _, path = target.partition("=")
    if method == "json":
        rows.select(*columns).write.mode("overwrite").json(path)
        return
    lines = {"csv": csv_lines, "markdown": markdown, "table": lambda r, c: padded(r, c).select(F.concat_ws("  ", *c).alias("line"))}
    if method not in lines:
        raise ValueError(f"no report {method}")
    lines[method](rows, columns).write.mode("overwrite").text(path)


def valid_signature(manifest: Column, payload_type: str = "application/jose+json") -> Column:
    """Whether struct(schemaVersion, mediaType, config, layers) is a signature's manifest: version 2, an image, notation config, layers with type, digest, size."""
    ok = lambda d: d["digest"].rlike("^sha(256|384|512):[0-9a-f]{64,128}$") & (d["size"] >= 0)
    layers = (F.size(manifest["layers"]) > 0) & F.forall(manifest["layers"], lambda x: (x["mediaType"] == payload_type) & ok(x))
    head = (manifest["schemaVersion"] == 2) & (manifest["mediaType"] == "application/vnd.oci.image.manifest.v1+json")
    return F.coalesce(head & (manifest["config"]["mediaType"] == NOTATION) & ok(manifest["config"]) & layers, F.lit(False))


def verified(signatures: DataFrame) -> DataFrame:
    """(subject, verified, good, failed) of signatures(subject, signature, payload): a subject passes if all of its signatures name it.

    A payload is the base64 of {"targetArtifact": {"digest": ...}}; the digest must be the subject's. Null signatures stand for none: not verified.
    """
    target = F.get_json_object(F.unbase64("payload").cast("string"), "$.targetArtifact.digest")
    s = signatures.withColumn("ok", F.coalesce(target == F.col("subject"), F.lit(False)))
    listed = lambda c: F.array_sort(F.collect_list(F.when(F.col("signature").isNotNull() & c, F.col("signature"))))
    return s.groupBy("subject").agg(F.bool_and("ok").alias("verified"), listed(F.col("ok")).alias("good"), listed(~F.col("ok")).alias("failed"))


def signature_summary(signatures: DataFrame) -> DataFrame:
    """(subject, signatures): JSON list of signatures(subject, digest, annotations) by digest, for events."""
    return signatures.groupBy("subject").agg(F.to_json(F.array_sort(F.collect_list(F.struct("digest", "annotations")))).alias("signatures"))


def by_coverage(rows: DataFrame) -> DataFrame:
    """rows(platform, coverage) from the highest number down, ties by name."""
    return rows.orderBy(F.desc("coverage"), "platform")
