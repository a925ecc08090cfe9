"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosine.

Equal vectors of a label are one node with a weight, known by a 64-bit hash. A node's unit vector is hashed in ``TABLES``
tables by ``HASHES`` quantised random projections each, floor((a.v + b) / WIDTH). At cosine 0.93
(distance 0.374) a projection agrees with probability 0.80, a table with 0.17, so a pair is found
with probability 0.99; nearer pairs more often. Members of a bucket meet in tiles of at most
``BLOCK_ROWS`` by ``BLOCK_ROWS`` nodes, twice. First they bring ``SKETCH`` signs of further projections only: nodes that differ
from all others of the tile in more than ``FAR`` of them go (at cosine 0.93 some 15 differ, more than ``FAR`` with a probability below
1e-12), and with them nearly all that share a bucket by chance. What is left brings its vector, and cosines are exact doubles. A pair is
counted in the first of its common tables, so that the number of links adds up without listing the pairs, and a tile
yields only the links that span it. Buckets have no cap.

Labels null and vectors null, empty, zero, or with null or non-finite components link with nothing.
Vectors of different length link with nothing of another length. Equal vectors link (cosine 1) by
definition. Rows that repeat a vec_id are vectors of their own, each with its links; a component is named by the smallest
vec_id in it. A null vec_id links like others and names no component, unless there is no other. Empty tables give empty results.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, components, find_roots, fixed, mix, n_parts, rows_out, sorted_runs, start_task

TABLES = 24
HASHES = 8
WIDTH = 1.5
BLOCK_ROWS = 512
COSINE = 0.93
SEED = 99
#: Signs in a sketch, and how many may differ.
SKETCH, FAR = 128, 44


def hasher(dim: int, tables: int, hashes: int, width: float):
    rng = np.random.Generator(np.random.PCG64([SEED, dim]))
    a, b = rng.standard_normal((dim, tables * hashes)), rng.uniform(0, width, tables * hashes)
    salt = rng.integers(1, 2**63, hashes, dtype=np.uint64) | np.uint64(1)
    signs = rng.standard_normal((dim, SKETCH))

    def run(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """uint32 bucket of each vector in each table, and its sketch as two words."""
        h = np.floor((unit @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, hashes)
        sketch = np.packbits(unit @ signs > 0, axis=1).view(np.int64)
        return (mix((h * salt[None, None]).sum(2, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32), sketch

    return run


def near_duplicates(rows: DataFrame, cosine: float = COSINE, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of rows(vec_id, embedding, label)."""
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "pstable")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0)
    r = rows.select(F.col("vec_id").cast("long"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    # + 0.0 makes -0.0 and 0.0 one value.
    r = r.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    r = r.withColumn("k1", F.xxhash64("label", "v")).withColumn("k2", F.xxhash64(F.lit(7), "label", "v"))
    nodes = r.where("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = scratch.save(nodes.withColumnRenamed("k1", "node").withColumn("dim", F.size("v")), "nodes")

    def sign(batches):
        start_task()
        run = {}
        for b in batches:
            off = b.column("v").offsets.to_numpy()
            val = b.column("v").values.to_numpy(zero_copy_only=False)
            dims = np.diff(off)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                v = val[off[at][:, None] + np.arange(d)]
                v = v / np.abs(v).max(1, keepdims=True)  # so that squares neither pass nor vanish
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                h, s = run.setdefault(int(d), hasher(int(d), tables, hashes, width))(v)
                of = [b.column(c).take(pa.array(at)) for c in ("node", "weight", "label")]
                yield rows_out(["node", "weight", "label", "dim", "unit", "sig", "s1", "s2"], [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()],
                               [*of, dims[at].astype(np.int32), [x.tobytes() for x in v], [x.tobytes() for x in h], s[:, 0].copy(), s[:, 1].copy()])

    signed = scratch.save(nodes.select("node", "weight", F.col("label").cast("string"), "dim", "v").mapInArrow(sign, "node long, weight long, label string, dim int, unit binary, sig binary, s1 long, s2 long"), "signed")
    # Bucket keys from the packed signature, in SQL: 4 bytes for each table.
    keys = signed.select("node", "label", "dim", "sig", "s1", "s2", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t"))
    keys = keys.select("node", "s1", "s2", F.xxhash64("label", "dim", "t", F.substring("sig", F.col("t") * 4 + 1, 4)).alias("bucket"), F.col("t").cast("short").alias("t"))
    big = scratch.save(keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    member = keys.join(big, "bucket").withColumn("nb", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")).withColumn("mine", F.pmod(F.xxhash64(F.lit(5), "node"), "nb").cast("int"))
    tiles = member.select("node", "s1", "s2", "bucket", "t", "mine", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")).select(
        "node", "s1", "s2", "t", "mine", (F.col("mine") == F.col("other")).alias("inner"), F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"))
    parts = n_parts(spark)

    def screen(batches):
        start_task()
        for t, start in sorted_runs(batches, "tile", 1 << 15):
            s = np.stack([t.column("s1").to_numpy(), t.column("s2").to_numpy()], 1).view(np.uint64)  # of signed words, only the bits of the absolute value would count
            mine, inner = t.column("mine").to_numpy(), t.column("inner").to_numpy()
            keep = np.zeros(len(s), bool)
            for at in by_size(start, len(s), 1 << 20):
                near = np.bitwise_count(s[at][:, :, None] ^ s[at][:, None]).sum(3, dtype=np.int64) <= FAR
                near &= allowed(mine[at], inner[at])
                keep[at] = near.any(2)
            yield from t.select(["node", "t", "mine", "inner", "tile"]).filter(pa.array(keep)).to_batches()

    near = scratch.save(tiles.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(screen, "node long, t short, mine int, inner boolean, tile long"), "near")
    near = near.join(signed.select("node", "weight", "dim", "unit", "sig"), "node").repartition(parts, "tile").sortWithinPartitions("tile", "mine", "node")

    def solve(batches):
        start_task()
        for g, start in sorted_runs(batches, "tile", 1 << 12):
            dim, table = g.column("dim").to_numpy(), g.column("t").to_numpy()
            sig, (mine, node, weight, inner) = fixed(g.column("sig"), np.uint32, tables), (g.column(c).to_numpy() for c in ("mine", "node", "weight", "inner"))
            raw = g.column("unit").to_pylist()
            for at in by_size(start, len(node), 1 << 20):
                for d in np.unique(dim[at[:, 0]]):
                    a = at[dim[at[:, 0]] == d]
                    u = np.frombuffer(b"".join([raw[i] for i in a.ravel()]), np.float64).reshape(*a.shape, d)
                    of, i, j = np.nonzero(np.triu((u @ u.transpose(0, 2, 1) >= cosine) & allowed(mine[a], inner[a]), 1))
                    i, j = a[of, i], a[of, j]
                    # A pair counts in the first of its common tables.
                    new = ~((sig[i] == sig[j]) & (np.arange(tables) < table[i][:, None])).any(1)
                    i, j = i[new], j[new]
                    if not len(i):
                        continue
                    links = np.zeros(len(node), np.int64)
                    np.add.at(links, i, weight[j])
                    np.add.at(links, j, weight[i])
                    root, on = find_roots(len(node), i, j), np.flatnonzero(links)
                    yield rows_out(["node", "links", "root"], [pa.int64(), pa.int64(), pa.int64()], [node[on], links[on], node[root[on]]])

    found = scratch.save(near.mapInArrow(solve, "node long, links long, root long"), "found")
    comp = components(scratch, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = scratch.save(nodes.select("node", "k2", "least", "weight").join(counted, "node", "left").join(comp, "node", "left"), "linked")
    named = linked.where("component is not null").groupBy("component").agg(F.min("least").alias("id"))
    known = linked.join(named, "component", "left").select(F.col("node").alias("k1"), "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("id", "least").alias("component_id"))
    known = scratch.save(known, "known")
    for t in ("signed", "buckets", "near", "found", "nodes", "linked"):
        scratch.drop(t)
    r = r.select("vec_id", "good", F.when(F.col("good"), F.col("k1")).otherwise(F.col("vec_id")).alias("k1"), F.when(F.col("good"), F.col("k2")).otherwise(F.lit(0)).alias("k2"))
    out = r.join(known, ["k1", "k2"], "left")
    return out.select("vec_id", F.when(F.col("good"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))


def by_size(start: np.ndarray, n: int, cells: int):
    """Row numbers [groups, size] of the groups of two or more rows, those of one size together, at most some ``cells`` pairs at once."""
    size = np.diff(np.append(start, n))
    for s in np.unique(size[size > 1]):
        of, step = start[size == s], max(1, cells // int(s * s))
        for k in range(0, len(of), step):
            yield of[k : k + step, None] + np.arange(s)


def allowed(mine: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Which pairs [groups, size, size] belong to a tile: those of two blocks, or all others in a tile of one block."""
    s = mine.shape[1]
    return (inner[:, :1, None] | (mine[:, :, None] != mine[:, None])) & ~np.eye(s, dtype=bool)
