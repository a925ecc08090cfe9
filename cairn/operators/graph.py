"""Artifact graphs as edge tables: closure, accounting, integrity, completeness."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels after which path_counts looks for a cycle.
LONG = 100


def levels(depth: int | None):
    """1, 2, ... up to depth, or without end."""
    return itertools.count(1) if depth is None else range(1, depth + 1)


def cut(df: DataFrame) -> DataFrame:
    """Write below the cluster's checkpoint folder and read again: lineage ends, and the plans that follow know the table's size.

    A folder of our own is made only in local mode without one. The tables go when the session ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = getattr(sc, "_cairn_tables", None)
    if folder is None:
        base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="cairn-")
        folder = sc._cairn_tables = f"{base.rstrip('/')}/cairn-tables-{uuid.uuid4().hex[:12]}"
        atexit.register(_drop, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark, folder: str) -> None:
    with contextlib.suppress(Exception):  # at exit the JVM may be gone
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def steps(edges: DataFrame, *more: str) -> DataFrame:
    """Edges as (node, child, more...), written once, so that no level makes them again; a small frontier is broadcast to them."""
    return cut(edges.select(F.col("parent").alias("node"), "child", *more))


def path_counts(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, level, paths): paths from the roots(node) that reach a node, by length.

    Counts travel, not paths, so shared subgraphs cost one row for each node and level. Without a depth, a cycle that
    the roots reach is an error, as its paths have no end.
    """
    level = cut(roots.select("node", F.lit(0).alias("level"), F.lit(1).cast("long").alias("paths")))
    out, edges = level, steps(edges)
    for i in levels(depth):
        step = level.join(edges, "node").groupBy(F.col("child").alias("node")).agg(F.sum("paths").alias("paths"))
        level = cut(step.select("node", F.lit(i).alias("level"), "paths"))
        if level.isEmpty():
            break
        if depth is None and i == LONG:
            parents = edges.select("node").distinct().count()
        if depth is None and i >= LONG and i > parents:  # some parent comes twice
            raise ValueError("paths run in a cycle")
        out = cut(out.unionByName(level)) if i % 50 == 0 else out.unionByName(level)
    return out


def closure(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, level): every node reachable, at its smallest distance; cycles are no harm."""
    seen = frontier = cut(roots.select("node").distinct().withColumn("level", F.lit(0)))
    edges = steps(edges)
    for i in levels(depth):
        step = frontier.select("node").join(edges, "node").select(F.col("child").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("level", F.lit(i)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier)) if i % 5 == 0 else seen.unionByName(frontier)
    return seen


def byte_tracker(occurrences: DataFrame, *by: str) -> DataFrame:
    """(by..., occurrences, total, deduplicated) of blobs(digest, size): bytes of all and of each digest once."""
    each = occurrences.groupBy(*by, "digest").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.max("size").alias("one"))
    return each.groupBy(*by).agg(F.sum("n").alias("occurrences"), F.sum("all").alias("total"), F.sum("one").alias("deduplicated"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose child is not there: must be empty before a manifest is pushed."""
    return edges.join(nodes.select(F.col("node").alias("child")), "child", "left_anti")


def complete(edges: DataFrame, arrived: DataFrame) -> DataFrame:
    """(node): manifests that have arrived with everything below them, in any order of arrival.

    Incompleteness climbs: a parent of what is missing or incomplete is incomplete.
    """
    edges, arrived = cut(edges.select("parent", "child")), cut(arrived.select("node"))
    parents = cut(edges.select("parent").distinct())
    bad = cut(edges.join(arrived.select(F.col("node").alias("child")), "child", "left_anti").select(F.col("parent").alias("node")).union(parents.select(F.col("parent").alias("node")).join(arrived, "node", "left_anti")).distinct())
    up = closure(edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")), bad)
    return parents.select(F.col("parent").alias("node")).join(up.select("node"), "node", "left_anti")


def missing(edges: DataFrame, arrived: DataFrame) -> DataFrame:
    """(node): distinct children that have not arrived."""
    return edges.select(F.col("child").alias("node")).distinct().join(arrived, "node", "left_anti")


def first_paths(edges: DataFrame, root: str, depth: int | None = None) -> DataFrame:
    """(node, path): the first path from root, in depth-first pre-order of edges(parent, child, ordinal), to each node."""
    spark = edges.sparkSession
    level = cut(spark.createDataFrame([(root, "", f"|{root}|")], "node string, path string, trail string"))
    out, edges = level, steps(edges, "ordinal")
    for _ in levels(depth):
        nxt = level.join(edges, "node").where("not contains(trail, concat('|', child, '|'))")
        nxt = nxt.select(F.col("child").alias("node"), F.concat("path", F.lpad(F.col("ordinal").cast("string"), 9, "0")).alias("path"), F.concat("trail", "child", F.lit("|")).alias("trail"))
        level = cut(nxt.groupBy("node").agg(F.min("path").alias("path"), F.min_by("trail", "path").alias("trail")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return cut(out.groupBy("node").agg(F.min("path").alias("path")))


def write_order(edges: DataFrame, root: str, depth: int | None = None) -> DataFrame:
    """(node, seq): depth-first pre-order from root of edges(parent, child, ordinal), each node where it is first met."""
    spark, first = edges.sparkSession, first_paths(edges, root, depth)
    # Order by range partition, then add the rows of the partitions before: no single-task sort.
    ranked = cut(first.orderBy("path").withColumn("part", F.spark_partition_id()))
    sizes = ranked.groupBy("part").count().orderBy("part").collect()
    base, n = [], 0
    for r in sizes:
        base.append((r[0], n))
        n += r[1]
    from pyspark.sql.window import Window

    w = Window.partitionBy("part").orderBy("path")
    return ranked.join(F.broadcast(spark.createDataFrame(base, "part int, base long")), "part").select("node", (F.col("base") + F.row_number().over(w)).alias("seq"))


def subdag_size(edges: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """(root, size) of each of roots(node): its own size and that of each child it comes by; a manifest met again adds its own size, not what is below."""
    from cairn.operators.artifacts import labelled_closure

    edges = cut(edges.select("parent", "child"))
    reach = labelled_closure(edges, roots.select(F.col("node").alias("root"), "node"))
    met = reach.join(edges.withColumnRenamed("parent", "node"), "node").select("root", F.col("child").alias("node"))
    return met.union(roots.select(F.col("node").alias("root"), "node")).join(sizes, "node").groupBy("root").agg(F.sum("size").alias("size"))
