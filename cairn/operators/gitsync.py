"""Git histories as edge tables: bundles, heads, LFS objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import graph as G


def thin_bundle(parents: DataFrame, refs: DataFrame, excluded: DataFrame) -> DataFrame:
    """(node): commits that refs(node) reach by parents(parent, child) and excluded(node) do not."""
    return G.closure(parents, refs).select("node").join(G.closure(parents, excluded).select("node"), "node", "left_anti")


def merge_base(parents: DataFrame, a: DataFrame, b: DataFrame, generation: DataFrame) -> DataFrame:
    """(node): of the commits that both a(node) and b(node) reach, that of the highest generation(node, generation); ties to the least name."""
    both = G.closure(parents, a).select("node").join(G.closure(parents, b).select("node"), "node", "left_semi")
    return both.join(generation, "node").agg(F.min_by("node", F.struct(-F.col("generation"), "node")).alias("node"))


def oldest_layer(layers: DataFrame, reach: DataFrame) -> DataFrame:
    """(commit, layer): the first layer of layers(commit, idx) from which a commit is reached, by reach(head, commit); else the last layer."""
    last = layers.agg(F.max("idx")).first()[0]
    hit = reach.join(layers.select(F.col("commit").alias("head"), "idx"), "head").groupBy("commit").agg(F.min("idx").alias("idx"))
    return reach.select("commit").distinct().join(hit, "commit", "left").select("commit", F.coalesce("idx", F.lit(last)).alias("layer"))


def refs_by_layer(refs: DataFrame) -> DataFrame:
    """(layer, commits) of refs(ref, commit, layer)."""
    return refs.groupBy("layer").agg(F.array_sort(F.collect_set("commit")).alias("commits"))


def heads_at(refs: DataFrame) -> DataFrame:
    """(commit, heads): the names that point at each commit."""
    return refs.where("kind = 'heads'").groupBy("commit").agg(F.array_sort(F.collect_set("ref")).alias("heads"))


def new_objects(reachable: DataFrame, held: DataFrame) -> DataFrame:
    """(oid): LFS objects that are reachable and not held."""
    return reachable.select("oid").distinct().join(held.select("oid"), "oid", "left_anti")


def uncached_bundles(layers: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows of layers(repo, idx, commit) from the first whose commit is not in cached(commit) on: the suffix that is needed."""
    cut = layers.join(cached.select("commit"), "commit", "left_anti").groupBy("repo").agg(F.min("idx").alias("cut"))
    return layers.join(cut, "repo").where("idx >= cut").select("repo", "idx", "commit")


def update_refs(config: DataFrame, remote: DataFrame) -> DataFrame:
    """(ref, commit, layer): config(ref, commit, layer) with remote(ref, commit, layer) in its place where the commit is new or has changed."""
    r = remote.select("ref", F.struct("commit", "layer").alias("r"))
    j = config.select("ref", F.struct("commit", "layer").alias("c")).join(r, "ref", "full")
    keep = F.col("r").isNull() | F.coalesce(F.col("c.commit") == F.col("r.commit"), F.lit(False))
    return j.select("ref", F.when(keep, F.col("c")).otherwise(F.col("r")).alias("x")).select("ref", "x.*")


def override_successors(edges: DataFrame, needed: DataFrame) -> DataFrame:
    """edges(parent, child, kind) whose bundles or LFS objects are needed(node); other kinds stay."""
    kept = edges.where("kind in ('bundle', 'lfs')").join(needed.select(F.col("node").alias("child")), "child", "left_semi").select("parent", "child", "kind")
    return edges.where("kind not in ('bundle', 'lfs')").select("parent", "child", "kind").union(kept)
