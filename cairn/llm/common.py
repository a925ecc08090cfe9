"""What the training-data operators share: the scratch folder, packed rows, components.

Scratch tables are Parquet in the folder that ``spark.checkpoint.dir`` names, so a lost
executor costs a re-read, never the data.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; temporaries are about 60 times that.
CHUNK_BYTES = 1 << 20
#: Values that one pass of a range hash works on: long texts are hashed in such pieces.
HASH_VALUES = 1 << 18
#: Links that one task may join at the end of ``components``; more are contracted by shuffles first.
FINISH_LINKS = 1 << 17


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't share the driver's path."""
    sc = spark.sparkContext
    if getattr(sc, "_cairn_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(), "cairn_llm_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(os.path.join(root, "cairn")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(top, n), os.path.relpath(os.path.join(top, n), root))
    sc.addPyFile(path)
    sc._cairn_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cairn-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


class Scratch:
    """Named tables of one operator run. ``drop`` what no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.dir = spark, f"{shared_dir(spark)}/cairn-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.dir}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.dir}/{name}")

    def drop(self, name: str = "") -> None:
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  at exit the JVM may be gone
            if name:
                raise


#: What an operator keeps in a Python worker from task to task, by operator.
KEPT: dict[str, object] = {}


def start_task(operator: str = "") -> None:
    """Python workers are reused: drop what other operators left in this one and return free memory to the system."""
    for k in [k for k in KEPT if k != operator]:
        del KEPT[k]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- text in numpy

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(m, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _POWERS[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ranges_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """64-bit polynomial hash of values[start:end] for each range (starts ascending), independent of its place.

    Works through ``HASH_VALUES`` values at a time, so that temporaries do not grow with a text.
    """
    start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
    size = end - start
    total = np.zeros(len(start), np.uint64)
    for i in np.flatnonzero(size > HASH_VALUES):
        for lo in range(int(start[i]), int(end[i]), HASH_VALUES):
            part = values[lo : min(lo + HASH_VALUES, int(end[i]))]
            part = (part * powers(base, len(part))[0]).sum(dtype=np.uint64, keepdims=True)
            total[i : i + 1] += part * np.uint64(pow(base, lo - int(start[i]), 2**64))
    short = np.flatnonzero(size <= HASH_VALUES)
    i = 0
    while i < len(short):
        j = i + max(1, int(np.searchsorted(start[short[i:]], start[short[i]] + HASH_VALUES)))
        at = short[i:j]
        lo, hi = int(start[at[0]]), int(end[at].max())
        part = values[lo:hi]
        up, down = powers(base, hi - lo + 1)
        cum = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(part * up[:-1], out=cum[1:])
        total[at] = (cum[end[at] - lo] - cum[start[at] - lo]) * down[start[at] - lo]
        i = j
    return mix(total + size.astype(np.uint64) * np.uint64(_Q))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a few documents that lie one after another in a buffer."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.buf = buf
        solid = ~IS_SPACE[buf]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        at = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[at] = solid[at]
        last[(at - 1)[at > 0]] = solid[(at - 1)[at > 0]]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.lower = lower
        #: Words of document i are first[i]:first[i + 1].
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)

    def hashes(self) -> np.ndarray:
        value, out, i = LOWER_VALUE if self.lower else BYTE_VALUE, [], 0
        while i < len(self.start):
            lo = int(self.start[i])
            j = i + max(1, int(np.searchsorted(self.start[i:], lo + HASH_VALUES)))
            out.append(ranges_hash(value[self.buf[lo : int(self.end[j - 1])]], self.start[i:j] - lo, self.end[i:j] - lo, _P))
            i = j
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes."""
    at = np.arange(max(0, len(h) - k + 1))
    return ranges_hash(h, at, at + k, _Q)


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES):
    """(first row, uint8 buffer, offsets) of runs of rows; a longer text is a run of its own. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by block prefixes and suffixes."""
    n = len(a)
    if n < w:
        return a[:0]
    pad = np.full(-n % w, np.iinfo(a.dtype).max, a.dtype)
    b = np.concatenate([a, pad]).reshape(-1, w)
    pre = np.minimum.accumulate(b, axis=1).ravel()
    suf = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


def find_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over links a-b (union-find by labels)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def components(scratch: Scratch, edges: DataFrame, name: str = "cc", finish: int | None = None) -> DataFrame:
    """(node long, component long): the smallest node reachable, of every node in edges(a, b).

    Contraction: in a round each node joins the neighbour that a hash of the round and the node puts first, links are
    renamed and loops dropped. As the order is drawn anew each round, a constant share of the nodes is expected to go,
    whatever their ids, so rounds are logarithmic. Rounds are written tables. When at most ``finish`` links are left, one task
    joins them: a bound, not a group of the data. The way back goes from the last round to the first, over tables that grow
    by rounds. Nothing is gathered on the driver but counts.
    """
    spark, finish = scratch.spark, FINISH_LINKS if finish is None else finish
    e = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e0")
    steps: list[DataFrame] = []
    while (n := e.count()) > finish:
        k = len(steps)
        near = e.select(F.col("a").alias("x"), F.col("b").alias("y")).union(e.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("y"))  # noqa: B023, E731
        to = near.groupBy("x").agg(F.min(order("y")).alias("m")).select("x", F.least("m", order("x"))["y"].alias("y"))
        steps.append(to := scratch.save(to, f"{name}-m{k}"))
        ta, tb = to.select(F.col("x").alias("a"), F.col("y").alias("ya")), to.select(F.col("x").alias("b"), F.col("y").alias("yb"))
        joined = e.join(ta, "a").select("b", "ya").join(tb, "b").where("ya <> yb").select(F.least("ya", "yb").alias("a"), F.greatest("ya", "yb").alias("b"))
        e = scratch.save(joined.distinct(), f"{name}-e{k + 1}")
        scratch.drop(f"{name}-e{k}")
    if n:
        last = e.repartition(1).mapInArrow(_finish, "node long, component long")
    else:
        last = spark.createDataFrame([], "node long, component long")
    lab = scratch.save(last, f"{name}-last")
    for k in range(len(steps) - 1, -1, -1):
        far = lab.select(F.col("node").alias("y"), F.col("component").alias("far"))
        lab = scratch.save(steps[k].join(far, "y", "left").select(F.col("x").alias("node"), F.coalesce("far", "y").alias("component")), f"{name}-l{k}")
        scratch.drop(f"{name}-m{k}")
    if steps:  # the one that stands for a component is any of its nodes so far
        least = lab.groupBy("component").agg(F.min("node").alias("least"))
        lab = scratch.save(lab.join(least, "component").select("node", F.col("least").alias("component")), f"{name}-out")
    return lab


def _finish(batches):
    """Components of all the links of a bounded table."""
    ab = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches if b.num_rows]
    if ab:
        ab = np.concatenate(ab, axis=1)
        nodes, at = np.unique(ab, return_inverse=True)
        a, b = at.reshape(2, -1)
        yield rows_out(["node", "component"], [pa.int64(), pa.int64()], [nodes, nodes[find_roots(len(nodes), a, b)]])


def sorted_groups(batches, keys: list[str]):
    """Arrow tables of the groups of a stream that is sorted by keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        differ = np.zeros(n, bool)
        for k in keys:
            c = batch.column(k)
            v = c.to_numpy(zero_copy_only=False)
            differ[1:] |= v[1:] != v[:-1]
            if held:
                differ[0] |= held[-1].column(k)[-1].as_py() != c[0].as_py()
        cuts = np.flatnonzero(differ)
        if not len(cuts):
            held.append(batch)
            continue
        held.append(batch.slice(0, int(cuts[0])))
        if any(h.num_rows for h in held):
            yield pa.Table.from_batches(held)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield pa.Table.from_batches([batch.slice(int(a), int(b - a))])
        held = [batch.slice(int(cuts[-1]))]
    if any(h.num_rows for h in held):
        yield pa.Table.from_batches(held)


def sorted_runs(batches, key: str, rows: int = 1 << 14):
    """(Arrow table, group starts): whole groups of a stream that is sorted by key, some ``rows`` rows at a time."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        have += batch.num_rows
        if have < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        v = t.column(key).to_numpy()
        start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        if len(start) > 1:  # the last group may go on
            yield t.slice(0, int(start[-1])), start[:-1]
            t = t.slice(int(start[-1]))
        held, have = t.to_batches(), t.num_rows
    if have:
        t = pa.Table.from_batches(held).combine_chunks()
        v = t.column(key).to_numpy()
        yield t, np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))


def fixed(column, dtype, width: int) -> np.ndarray:
    """Rows of equal-length binary values as a matrix."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype).reshape(-1, width)


def rows_out(names: list[str], types: list, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
