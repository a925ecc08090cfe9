"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source is dealt into shards by a seeded hash of the document id. Within a shard the
documents stand in seeded order, shards stand one after the other, and the line of a source's tokens is cut into blocks of
equal size, of which only its last may be short. The driver holds one row per (source, shard): at most ``MAX_SHARDS`` and one for
each source. Sainte-Lague first gives each source its blocks, then each of its shards an integer quota of the blocks that start
in it. A seeded affine permutation selects the quota's blocks, repeats included. The words by which a source's blocks still
miss its target, less than two blocks, are taken from (or left of) one or two blocks more, so that each source comes to its
target to the word, whatever the size of the blocks. Documents meet the plan by a join of that small table (broadcast up to
``BROADCAST_ROWS`` rows); the only other shuffle is of ids and sizes.

Nulls: text null or without words has size 0 and takes nothing; source null is a source of its
own, last in order. Repeated rows: rows of one doc_id are placed one after the other and each
keeps its row. An empty table gives an empty result. A source without words has target 0.
Other columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SHARD_TOKENS = 65536
MAX_SHARDS = 20_000
BROADCAST_ROWS = 200_000
SEED = 17
#: Parts of a document that whole() counts in.
UNIT = 1 << 20


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Tokens of each source: share of all sizes by weight, at most ``most`` times its size,
    the excess dealt again by weight among those below."""
    total, n = share * sum(sizes), len(sizes)
    got, free = [0.0] * n, set(range(n))
    left = total
    while free:
        w = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / w >= most * sizes[i]}
        if not full:
            for i in free:
                got[i] = left * weights[i] / w
            break
        for i in full:
            got[i] = most * sizes[i]
        left -= sum(got[i] for i in full)
        free -= full
    return got


def sainte_lague(seats: int, weights: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients weight / (2 k + 1), none above its cap; ties to the first.

    The common divisor is found by bisection, then the last seats go one by one, so the cost
    does not depend on the number of seats.
    """
    w, caps = np.asarray(weights, float), np.asarray(caps, np.int64)
    seats = int(min(seats, caps[w > 0].sum()))
    at = lambda q: np.minimum(np.where(w > 0, np.ceil(w / (2 * q) - 0.5), 0).astype(np.int64), caps)  # noqa: E731  quotients above q
    if seats <= 0 or not (w > 0).any():
        return np.zeros(len(w), np.int64)
    low, high = float(w[w > 0].min()) / (4.0 * (int(caps.max()) + 1)), float(w.max()) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid).sum() > seats else (low, mid)
    got = at(high)
    while got.sum() < seats:
        q = np.where((got < caps) & (w > 0), w / (2 * got + 1), -1.0)
        got[int(np.argmax(q))] += 1
    return got


def plan(rows: list[tuple], total: int, share: float, most: float, weights: tuple) -> tuple[list[tuple], int]:
    """Rows (source, shard, size) to (source, shard, source_size, target, off, first, head, nb, every, more, mult, add, trims).

    A shard's words stand from ``off`` on in its source's line; ``first`` is the first block that starts in it, those before
    are taken ``head`` times. Block ``first + b`` of its ``nb`` is taken ``every`` times, and once more if
    (b * mult + add) % nb < more. Words lo..hi of the line are taken d times more for each (lo, hi, d) of ``trims``.
    """
    of_source: dict = {}
    for s, k, size in rows:
        of_source.setdefault(s, []).append((k, int(size)))
    sources = sorted(of_source, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, n in of_source[s]) for s in sources]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], share, most)
    block = int(min(4096, max(1, total // 100_000)))
    repeats = math.ceil(most)
    quota = sainte_lague(round(sum(goal) / block), np.array(goal), np.array([-(-n // block) * repeats for n in sizes]))
    out = []
    for i, s in enumerate(sources):
        of, off, spans = sorted(of_source[s], key=lambda x: (x[0] is None, x[0])), 0, []
        for k, n in of:
            spans.append((k, off, -(-off // block), -(-(off + n) // block)))
            off += n
        nb = np.array([b - a for *_, a, b in spans], np.int64)
        head, found = 0, []
        for (k, at, a, b), q in zip(spans, sainte_lague(int(quota[i]), nb.astype(float), nb * repeats).tolist(), strict=True):
            n = b - a
            every, more = divmod(q, n) if n else (0, 0)
            rng = np.random.Generator(np.random.PCG64([SEED, i, k]))
            mult = int(rng.integers(1, max(2, n)))
            while n and math.gcd(mult, n) != 1:
                mult = mult % n + 1
            found.append((s, k, sizes[i], float(goal[i]), at, a, head, n, every, more, mult, int(rng.integers(0, max(1, n)))))
            if n:
                head = every + int(((n - 1) * mult + found[-1][-1]) % n < more)
        last = (-(-sizes[i] // block) - 1) * block  # where the source's last block starts
        taken = int(quota[i]) * block - (head * (last + block - sizes[i]) if sizes[i] else 0)
        trims = trimmed(found, round(goal[i]) - taken, block, sizes[i], repeats)
        out += [(*r, trims) for r in found]
    return out, block


def trimmed(shards: list[tuple], miss: int, block: int, size: int, repeats: int) -> list[tuple[int, int, int]]:
    """(lo, hi, 1 or -1): word ranges to take once more, or once less, so that a source's blocks come to its target."""
    out, d = [], 1 if miss > 0 else -1
    changed: dict[int, int] = {}
    for _ in range(repeats):
        for *_, first, _, n, every, more, mult, add in shards:
            if not miss:
                return out
            if not n:
                continue
            # Places in the permutation whose blocks can be taken once more (less).
            low, high = (0, n) if (every + 1 < repeats if d > 0 else every > 0) else (more, n) if d > 0 and every < repeats else (0, more) if d < 0 else (0, 0)
            back = pow(mult, -1, n) if n > 1 else 0
            for x in range(high - 1, low - 1, -1):
                b = first + (x - add) * back % n
                times = every + (x < more) + changed.get(b, 0)
                if (times < repeats) if d > 0 else (times > 0):
                    use = min(abs(miss), block, size - b * block)
                    out.append((b * block, b * block + use, d))
                    changed[b] = changed.get(b, 0) + d
                    miss -= d * use
                    if not miss:
                        return out
    return out


def placed(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, source, size, shard, source_size, target, taken): the rows of mix() with their shards."""
    spark = docs.sparkSession
    # Words are counted once; what follows reads ids and sizes.
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    scratch = Scratch(spark, "mix")
    d = scratch.save(sized, "sizes")
    by_source = d.groupBy("source").agg(F.sum("size").alias("n"))
    n_sources, total = by_source.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    unit = max(shard_tokens, 2 * total // MAX_SHARDS)
    small = lambda t: F.broadcast(t) if n_sources + MAX_SHARDS <= BROADCAST_ROWS else t
    known = scratch.save(by_source.select(F.col("source").alias("s"), F.greatest(F.lit(1), F.round(F.col("n") / unit)).cast("long").alias("n_shards")), "sources")
    d = d.join(small(known), d.source.eqNullSafe(known.s), "left").withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), "n_shards")).drop("s", "n_shards")
    rows = [tuple(r) for r in d.groupBy("source", "shard").agg(F.sum("size")).collect()]
    planned, block = plan(rows, total, share, most, weights)
    p = spark.createDataFrame(planned, "s string, k long, source_size long, target double, off long, first long, head long, nb long, every long, more long, mult long, add long, trims array<struct<lo: long, hi: long, d: long>>")
    w = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(SEED + 1), "doc_id"), "doc_id", "size")
    d = d.withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.join(small(p), d.source.eqNullSafe(p.s) & (d.shard == p.k), "left").withColumn("upto", F.col("upto") + F.col("off"))
    taken = F.expr(f"""
        if(size = 0, 0L, aggregate(sequence((upto - size) div {block}L, (upto - 1) div {block}L), 0L, (acc, b) -> acc
            + (least(upto, (b + 1) * {block}L) - greatest(upto - size, b * {block}L))
            * if(b < first, head, every + if(((b - first) * mult + add) % greatest(nb, 1L) < more, 1L, 0L)))
            + aggregate(trims, 0L, (acc, t) -> acc + t.d * greatest(0L, least(upto, t.hi) - greatest(upto - size, t.lo))))""")
    return d.select("doc_id", "source", "size", "shard", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): words that the mix takes of each row."""
    return placed(docs, share, most, weights, shard_tokens).drop("shard")


def whole(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, times): the mix in whole documents, those taken at least once.

    The shares taken / size of a shard's documents are added up in order of size from a seeded start, and a document is
    taken as often as the total passes a whole number: its share rounded down or up, while the words of a shard stay
    within about one document of its quota. Rows of one doc_id share one number.
    """
    d = placed(docs, share, most, weights, shard_tokens).where("size > 0")
    d = d.groupBy("doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.min(F.struct("source", "shard")).alias("at"))
    d = d.withColumn("part", F.expr(f"(taken * {UNIT}L + size div 2) div size"))
    w = Window.partitionBy("at").orderBy("size", F.xxhash64(F.lit(SEED + 2), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("part").over(w) + F.pmod(F.xxhash64(F.lit(SEED + 3), "at.source", "at.shard"), F.lit(UNIT))
    return d.withColumn("end", end).select("doc_id", F.expr(f"int(end div {UNIT}L - (end - part) div {UNIT}L)").alias("times")).where("times > 0")
