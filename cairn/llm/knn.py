"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors of each length are searched among themselves. Pivots are rows chosen by a hash of their id, ``PIVOTS`` or, in large tables, a
sixteenth of the root of the rows, ``MOST_PIVOTS`` at most. Every vector joins the cell of its nearest
pivot; the summaries of the cells (count, radius) are a bounded table. A query q bounds its
score with a member x of cell c by q.p +- |q| r. The cells whose lower bounds hold more than k
candidates give a score that the k-th best must reach, and a cell whose upper bound is lower is
not needed. Queries are grouped by the first pivots (a group for each ``GROUP_ROWS`` of them),
a group needs the cells that any of its queries needs, and only these are replicated to it,
in blocks of at most about ``BLOCK_ROWS`` rows against ``GROUP_ROWS`` queries. Vectors travel in the fewest bytes that hold
their integers. Each tile is solved by matrix products in exact integers (doubles below 2**53, then 64 bits, then integers of any size),
and the tiles' k best of a query meet in a ranked window.

Vectors that are null, empty, or hold null or non-finite components take no part. Scores beyond 64 bits are cut to the
largest or smallest of them. Ties go to the smaller id, a null id last. Rows that repeat a vec_id are candidates of all other ids; as
a query the smallest vector of an id counts. A row with a null id is a candidate and no query. Fewer than k
candidates give fewer rows; an empty table none. Other columns are ignored.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import Scratch, n_parts, rows_out, sorted_groups, start_task

PIVOTS, MOST_PIVOTS = 32, 256
GROUP_ROWS = 16384
BLOCK_ROWS = 16384
#: Queries that one product takes, so that scores of a tile need little memory.
ASK_ROWS = 512
SCALE = 256
LEAST, MOST = -(2**63), 2**63 - 1


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q, dim, v): floor(scale * x) of each valid vector, packed in 2, 4 or (as doubles) 8 bytes a component."""
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def run(batches):
        start_task()
        for b in batches:
            e = b.column("embedding")
            off = e.offsets.to_numpy()
            with np.errstate(over="ignore"):
                v = np.floor(e.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            v = np.clip(v, -np.finfo(float).max, np.finfo(float).max)
            raw = []
            for x, y in zip(off[:-1], off[1:], strict=True):
                top = np.abs(v[x:y]).max()
                raw.append(v[x:y].astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.float64).tobytes())
            yield rows_out(["vec_id", "q", "dim", "v"], [pa.int64(), pa.bool_(), pa.int32(), pa.binary()], [b.column("vec_id"), b.column("q"), np.diff(off).astype(np.int32), raw])

    return rows.where(good).select(F.col("vec_id").cast("long"), "q", "embedding").mapInArrow(run, "vec_id long, q boolean, dim int, v binary")


def unpacked(raw: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as rows of doubles."""
    kinds = {dim * 2: np.int16, dim * 4: np.int32, dim * 8: np.float64}
    size = {len(x) for x in raw}
    if len(size) == 1:
        return np.frombuffer(b"".join(raw), kinds[size.pop()]).reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(x, kinds[len(x)]).astype(np.float64) for x in raw]) if raw else np.zeros((0, dim))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: doubles where they are exact, else integers, cut to 64 bits."""
    top = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    if top < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
    return np.clip(whole(a) @ whole(b).T, LEAST, MOST).astype(np.int64)


def top_k(rows: DataFrame, query: Column, k: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows(vec_id, embedding) where ``query`` holds, against all rows."""
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "knn")
    base = scratch.save(integers(rows.withColumn("q", F.coalesce(query, F.lit(False)) & F.col("vec_id").isNotNull())), "ints")
    sizes = {r[0]: (r[1], r[2]) for r in base.groupBy("dim").agg(F.count("*"), F.count_if("q")).collect()}  # a row for each length
    n_pivots = {d: min(MOST_PIVOTS, max(PIVOTS, isqrt(n) // 16)) for d, (n, _) in sizes.items()}
    n_groups = {d: min(n_pivots[d], max(1, q // GROUP_ROWS)) for d, (_, q) in sizes.items()}
    chosen = base.select("dim", "v", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64(F.lit(11), "vec_id"), "vec_id", "v")).alias("r")).where(F.col("r") <= MOST_PIVOTS)
    at: dict[int, list] = {}
    for d, v, r in sorted(map(tuple, chosen.collect())):
        if r <= n_pivots[d]:
            at.setdefault(d, []).append((r, v))
    pivots = {d: unpacked([v for _, v in sorted(x)], d) for d, x in at.items()}

    def cells(batches):
        start_task()
        for b in batches:
            dims, raw = b.column("dim").to_numpy(), b.column("v").to_pylist()
            for d in np.unique(dims):
                on, p = np.flatnonzero(dims == d), pivots[int(d)]
                with np.errstate(all="ignore"):
                    v = unpacked([raw[i] for i in on], int(d))
                    far = np.sqrt(np.maximum((v * v).sum(1)[:, None] - 2 * v @ p.T + (p * p).sum(1)[None], 0))
                    far = np.where(np.isnan(far), np.inf, far)
                    c = far.argmin(1)
                    dist = np.linalg.norm(v - p[c], axis=1)
                of = [b.column(x).take(pa.array(on)) for x in ("vec_id", "q", "dim", "v")]
                yield rows_out(["vec_id", "q", "dim", "v", "cell", "grp", "dist"], [pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.float64()],
                               [*of, c.astype(np.int32), far[:, : n_groups[int(d)]].argmin(1).astype(np.int32), np.where(np.isnan(dist), np.inf, dist)])

    placed = scratch.save(base.mapInArrow(cells, "vec_id long, q boolean, dim int, v binary, cell int, grp int, dist double"), "cells")
    scratch.drop("ints")
    # One query for each id, whatever its rows.
    asked = placed.where("q").groupBy("vec_id").agg(F.min(F.struct("dim", "v", "grp")).alias("x"), F.count("*").alias("own"))
    asked = scratch.save(asked.select("vec_id", "own", "x.*"), "asked")
    summary: dict[int, list] = {}
    for d, *r in placed.groupBy("dim", "cell").agg(F.count("*"), F.max("dist")).collect():  # at most MOST_PIVOTS rows a length
        summary.setdefault(d, []).append(r)
    summary = {d: [np.array(c) for c in zip(*sorted(x), strict=True)] for d, x in summary.items()}

    def need(batches):
        start_task()
        seen = set()
        for b in batches:
            dims, raw, grp, own = b.column("dim").to_numpy(), b.column("v").to_pylist(), b.column("grp").to_numpy(), b.column("own").to_numpy()
            for d in np.unique(dims):
                on, (cell, count, radius) = np.flatnonzero(dims == d), summary[int(d)]
                with np.errstate(all="ignore"):
                    v, p = unpacked([raw[i] for i in on], int(d)), pivots[int(d)][cell]
                    mid, size, reach = v @ p.T, np.linalg.norm(v, axis=1)[:, None], np.linalg.norm(p, axis=1)[None]
                    slack = size * (radius[None] * (1 + 1e-9) + reach * 1e-9) + 1e-6
                    low, high = mid - slack, mid + slack
                low, high = np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)
                order = np.argsort(-low, axis=1, kind="stable")
                # More than k, as the query's own rows may be among them.
                enough = np.cumsum(count[order], axis=1) >= k + own[on][:, None]
                pos = np.where(enough.any(1), enough.argmax(1), -1)
                floor = np.where(pos >= 0, np.take_along_axis(low, np.take_along_axis(order, np.maximum(pos, 0)[:, None], 1), 1)[:, 0], -np.inf)
                use, g_all = high >= floor[:, None], grp[on]
                for g in np.unique(g_all):
                    seen |= {(int(d), int(g), int(cell[c])) for c in np.flatnonzero(use[g_all == g].any(0))}
        yield rows_out(["dim", "grp", "cell"], [pa.int32()] * 3, list(zip(*seen, strict=True)) or [[], [], []])

    # A bounded table: groups by cells, at most MOST_PIVOTS**2 rows a length, with the blocks of each.
    pairs = asked.mapInArrow(need, "dim int, grp int, cell int").distinct()
    nb = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("nb"))
    nq = asked.groupBy("dim", "grp").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("nq"))
    pairs = F.broadcast(scratch.save(pairs.join(nb, ["dim", "cell"]).join(nq, ["dim", "grp"]), "pairs"))
    keys = ["dim", "grp", "qb", "cell", "block"]
    data = placed.select("vec_id", "v", "dim", "cell").join(pairs, ["dim", "cell"])
    data = data.select("dim", "grp", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), "cell", F.pmod(F.xxhash64("vec_id", "v"), "nb").cast("int").alias("block"), F.lit(False).alias("ask"), "vec_id", "v")
    ask = asked.join(pairs, ["dim", "grp"]).select("dim", "grp", F.pmod(F.xxhash64(F.lit(5), "vec_id"), "nq").cast("int").alias("qb"), "cell", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"), F.lit(True).alias("ask"), "vec_id", "v")
    both = ask.select(*keys, "ask", "vec_id", "v").unionByName(data.select(*keys, "ask", "vec_id", "v"))
    tiles = both.select(F.xxhash64(*keys).alias("tile"), "dim", "ask", "vec_id", "v").repartition(n_parts(spark), "tile").sortWithinPartitions("tile", F.col("vec_id").asc_nulls_last(), "v")

    def solve(batches):
        start_task()
        for g in sorted_groups(batches, ["tile"]):
            dim, ask, raw = g.column("dim")[0].as_py(), g.column("ask").to_numpy(), g.column("v").to_pylist()
            ids, known = g.column("vec_id").fill_null(MOST).to_numpy(), g.column("vec_id").is_valid().to_numpy()
            on, off = np.flatnonzero(ask), np.flatnonzero(~ask)
            if not len(on) or not len(off):
                continue
            x = unpacked([raw[i] for i in off], dim)
            for lo in range(0, len(on), ASK_ROWS):
                part = on[lo : lo + ASK_ROWS]
                s = products(unpacked([raw[i] for i in part], dim), x)
                mine = (ids[part][:, None] == ids[off][None]) & known[off][None]
                n = min(k, len(off))
                # Below all scores, so that a query's own rows are only taken where nothing else is left, and then dropped.
                edge = np.where(mine, LEAST, s)
                edge = np.partition(edge, len(off) - n, axis=1)[:, len(off) - n]
                q, c = np.nonzero((s >= edge[:, None]) & ~mine)
                o = np.lexsort((c, -s[q, c].astype(object) if (s[q, c] == LEAST).any() else -s[q, c], q))
                q, c = q[o], c[o]
                o = np.arange(len(q)) - np.searchsorted(q, q) < k
                q, c = q[o], c[o]
                yield rows_out(["query_id", "vec_id", "score"], [pa.int64()] * 3, [ids[part][q], pa.array(ids[off][c], pa.int64(), mask=~known[off][c]), s[q, c]])

    near = tiles.mapInArrow(solve, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
