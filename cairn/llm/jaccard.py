"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact sorted-array intersection.

A document is the set of its distinct word ``size``-grams, as sorted 64-bit hashes. Equal sets are one
node from the start (its id is a hash of the set), so copies cost no pairs. Sizes form bands, each
wide enough that linked sets lie in one band or in neighbours.

Candidates, exactly: linked sets of a band differ in at most k elements, k being
``2 (1 - t) / (1 + t)`` of the band's largest size. The hash range is cut into K > k parts; at least K - k
parts of two linked sets are equal, so they share a signature (the hash of a part's elements)
unless all of the equal parts are empty, for which the sets of a band with so many empty parts have one
key more. With a signature goes a sketch of the next eight parts on the ring of parts, a byte of parity bits each. If part j
differs in d(j) elements, the sum of 1 - d(j) over the ring is at least K - k, so by the cycle lemma at least K - k parts are such that
the j parts after them differ in at most j elements, for every j. A set's own size may make its k smaller and the starts more. So those that share a signature are linked only if the bytes say that
this may hold, and a passage that many documents share makes no candidates; only sets that are alike nearly everywhere meet. (The key of sets with many
empty parts has a parity bitmap of the whole set instead, bound by k.) Of equal signatures and sketches one goes on from each task, and
each task gives star links of the groups that it has found, whose components are the candidate clusters.

A cluster's members of a band, and those of the band below that are large enough, form a tile; tiles of over ``BLOCK``
members or a number of elements are cut into pairs of blocks. In a tile a set is compared with those not yet
connected to it. Tiles are worked through twice. First they hold bitmaps only, some three bits an element: bit i is the
parity of the elements that hash to i, so the bits in which two bitmaps differ are at most the elements in which the sets
do, which bounds the overlap from above. Pairs that may still reach the threshold connect, and the components of that
are clusters again, far smaller where documents share passages. Tiles of those hold the sets, and pairs within the bound
are settled by intersecting the sorted arrays. Only links that join two groups are kept, which loses no component.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered. Fewer words than ``size`` make one gram of all; null
texts and texts without words are empty sets, linked with nothing. Ties and repeated rows are equal
sets. Texts are whole, whatever their length. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, Words, components, find_roots, grams, mix, n_parts, ranges_hash, rows_out, sorted_groups, start_task, text_chunks

SIZE = 4
NUM, DEN = 85, 100
#: Sets in a block, and elements in a block of bitmaps or of sets.
BLOCK, BLOCK_BITS, BLOCK_GRAMS = 1024, 32_000_000, 2_000_000
BROADCAST_ROWS = 1_000_000
#: Bytes of signatures and sketches that one task sorts, and the signatures that a task gathers before it sends them.
MEET_BYTES, SEND = 64 << 20, 1_000_000
#: Parts after its own that a signature's sketch covers, a byte each in words of 64 bits.
CHAIN = 8
WORDS = CHAIN // 8
#: Up to so many sketches of one signature are compared by shifted arrays, more one by one with those not yet connected.
SHIFTS = 32
_U = np.uint64


def shingle_sets(column, size: int):
    """(row, sorted distinct gram hashes) of each text."""
    for row, buf, off in text_chunks(column):
        w = Words(buf, off, lower=True)
        h = w.hashes()
        g = grams(h, size)
        for i in range(len(off) - 1):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= size:
                s = np.sort(g[a : b - size + 1])
                yield row + i, s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                yield row + i, ranges_hash(h[a:b], np.array([0]), np.array([b - a]), 0xC2B2AE3D27D4EB4F)
            else:
                yield row + i, np.zeros(0, _U)


def set_id(s: np.ndarray) -> int:
    return int(mix(total(s) + _U(len(s))).view(np.int64)[0])


def total(s: np.ndarray) -> np.ndarray:
    """Sum of the mixed hashes, as an array of one (whose arithmetic wraps silently)."""
    return mix(s).sum(dtype=_U, keepdims=True)


class Bands:
    """Size bands for a threshold num / den: band i holds sizes starts[i] .. starts[i + 1] - 1."""

    def __init__(self, num: int, den: int, most: int = 1 << 40):
        self.num, self.den = num, den
        starts = [1]
        while starts[-1] < most:
            starts.append(max(starts[-1] + 1, starts[-1] * den // num + 1))
        self.starts = np.array(starts, np.int64)
        top = self.starts[1:] - 1
        self.k = 2 * (den - num) * top // (den + num)
        self.top = top
        #: Parts: room for a few empty ones.
        self.parts = np.where(self.k == 0, 1, self.k + 2 + self.k // 16 + (self.k < 12))

    def of(self, n) -> np.ndarray:
        return np.searchsorted(self.starts, n, "right") - 1

    def most(self, n: int, band: int) -> int:
        """Elements in which a set of n and one of the band or the band below, neither over the band's top, may differ and link."""
        return (n + min(int(self.top[band]), n * self.den // self.num)) * (self.den - self.num) // (self.den + self.num)

    def reaches_up(self, n, band) -> np.ndarray:
        """Can a set of n in band link with one of the next band?"""
        return n * self.den >= self.starts[band + 1] * self.num


def signatures(s: np.ndarray, band: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, sketch) of each part that is not empty; the lowest bit of a signature tells the key of sets with many empty parts."""
    parts = int(bands.parts[band])
    tag = _U((band + 1) * 0x9E3779B97F4A7C15 % 2**64)
    if parts == 1:
        return mix(total(s) + tag) & ~_U(1), np.zeros((1, WORDS), _U)
    part = ((s >> _U(32)) * _U(parts)) >> _U(32)
    start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    at = part[start].astype(np.int64)
    sig = mix(np.add.reduceat(mix(s ^ _U(0xA5A5A5A5)), start) + mix(part[start] + tag)) & ~_U(1)
    chain = min(CHAIN, parts - 1)
    ring = np.zeros(parts + chain, np.uint8)
    ring[at] = np.bitwise_xor.reduceat(np.left_shift(1, (s & _U(7)).astype(np.uint8), dtype=np.uint8), start)
    ring[parts:] = ring[:chain]
    after = np.zeros((len(at), CHAIN), np.uint8)
    after[:, :chain] = np.lib.stride_tricks.sliding_window_view(ring, chain)[at + 1]
    sketch = after.view("<u8")
    slack = parts - bands.most(len(s), band)  # so many starts of chains are there in sets that link with this one at least
    empty = parts - len(start)
    if empty >= slack:
        # All equal parts may be empty: such sets, of which there are few, meet by a key of the band, with its k in the top byte.
        odd = np.bincount((s % _U(64 * WORDS - 8)).astype(np.int64), minlength=64 * WORDS) & 1
        whole = np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")
        whole[-1] |= _U(min(int(bands.k[band]), 255) << 56)
        sig = np.concatenate([sig, mix(np.array([0x5E7], _U) + tag) | _U(1)])
        sketch = np.concatenate([sketch, whole[None]])
    return sig, sketch


def near(sketch: np.ndarray, other: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Places where two sketches of one signature allow a link."""
    x = sketch ^ other
    bits = np.bitwise_count(x).sum(1)
    c = np.flatnonzero(np.where(whole, bits <= (sketch[:, -1] >> _U(56)), bits <= CHAIN))
    differ = np.cumsum(np.bitwise_count(np.ascontiguousarray(x[c]).view(np.uint8)), axis=1)  # in the first 1, 2, .. parts
    return c[whole[c] | (differ <= np.arange(1, CHAIN + 1)).all(1)]


def alike(sig: np.ndarray, sketch: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the nodes of each signature whose sketches allow it, of rows sorted by signature."""
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(sig)))
    a, b = [node[:0]], [node[:0]]
    for i, m in zip(start[size > SHIFTS].tolist(), size[size > SHIFTS].tolist(), strict=True):
        sk, of = sketch[i : i + m], node[i : i + m]
        whole = np.full(m, bool(sig[i] & _U(1)))
        rest, left, queue = np.arange(m), sk, []
        while len(rest):
            if not queue:
                queue.append(int(rest[-1]))
                rest, left = rest[:-1], left[:-1]
            v = queue.pop()
            hit = near(left, sk[v], whole[: len(rest)])
            if len(hit):
                a.append(of[rest[hit]])
                b.append(np.full(len(hit), of[v]))
                queue += rest[hit].tolist()
                rest, left = np.delete(rest, hit), np.delete(left, hit, axis=0)
    some = np.repeat((size > 1) & (size <= SHIFTS), size)
    sig, sketch, node = sig[some], sketch[some], node[some]
    for o in range(1, SHIFTS):
        i = np.flatnonzero(sig[o:] == sig[:-o]) if o < len(sig) else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[near(sketch[i], sketch[i + o], (sig[i] & _U(1)).astype(bool))]
        a.append(node[i])
        b.append(node[i + o])
    return np.concatenate(a), np.concatenate(b)


def collapse(sig: np.ndarray, sketch: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sig, sketch, node) of one row of each equal signature and sketch, by signature, and the links of the others with it."""
    order = np.argsort(sig, kind="stable")
    sig, sketch, node = sig[order], sketch[order], node[order]
    again = np.concatenate([[False], sig[1:] == sig[:-1]])
    again[:-1] |= again[1:]
    at = np.flatnonzero(again)
    to = at[np.lexsort((node[at], *sketch[at].T, sig[at]))]
    sketch[at], node[at] = sketch[to], node[to]
    first = np.concatenate([[True], (sig[1:] != sig[:-1]) | (sketch[1:] != sketch[:-1]).any(1)])
    stands = node[first][np.cumsum(first) - 1]
    return sig[first], sketch[first], node[first], node[~first], stands[~first]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) of the groups that the links a-b join."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = find_roots(len(nodes), at[: len(a)], at[len(a) :])
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def may_link(a: int, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest overlap that links a set of a with sets of b."""
    return -(-num * (a + b) // (den + num))


def parity(s: np.ndarray) -> np.ndarray:
    """Bitmap of two to four bits an element: the parity of the elements that fall on each bit."""
    width = max(64, 1 << int(2 * len(s) - 1).bit_length())
    odd = np.bincount((s & _U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(_U)


def folded(bits: list[np.ndarray]) -> np.ndarray:
    """Bitmaps as rows, brought to the smallest width: halves fold by exclusive or, as parities do."""
    least = min(len(b) for b in bits)
    return np.stack([np.bitwise_xor.reduce(b.reshape(-1, least), axis=0) for b in bits])


def linked_tile(n: np.ndarray, bits: np.ndarray, sets: list[np.ndarray] | None, block: np.ndarray, small: np.ndarray, inner: bool, num: int, den: int) -> list[tuple[int, int]]:
    """Links that span the groups of a tile; pairs of two small sets belong to another tile. Without sets the bound decides."""
    m = len(n)
    group, done, links = np.arange(m), np.zeros(m, bool), []
    queue, rest = [], list(range(m - 1, -1, -1))
    while queue or rest:
        v = queue.pop() if queue else rest.pop()
        if done[v]:
            continue
        done[v] = True
        c = (group != group[v]) & ~done & ~(small & small[v])
        if not inner:
            c &= block != block[v]
        c &= np.minimum(n, n[v]) * den >= np.maximum(n, n[v]) * num
        c = np.flatnonzero(c)
        if not len(c):
            continue
        differ = np.bitwise_count(bits[c] ^ bits[v]).sum(1, dtype=np.int64)
        c = c[n[v] + n[c] - differ >= 2 * may_link(int(n[v]), n[c], num, den)]
        if not len(c):
            continue
        if sets is not None:
            flat, size = np.concatenate([sets[i] for i in c]), n[c]
            at = np.minimum(np.searchsorted(sets[v], flat), n[v] - 1)
            both = np.add.reduceat((sets[v][at] == flat).astype(np.int64), np.cumsum(size) - size)
            c = c[both * den >= (n[v] + size - both) * num]
        for i in c.tolist():
            if group[i] != group[v]:
                links.append((v, i))
                group[group == group[i]] = group[v]
            queue.append(i)
    return links


def tiled(scratch: Scratch, clusters: DataFrame, name: str, num: int, den: int, block: int, grams: int) -> DataFrame:
    """(first, node, small, mine, inner, tile): the places of the members of clusters(node, first, component, n) in tiles."""
    bands = Bands(num, den)
    edge = [(i, int(a), int(b - 1), int(-(-b * num // den))) for i, (a, b) in enumerate(zip(bands.starts[:-1], bands.starts[1:], strict=True))]
    table = F.broadcast(scratch.spark.createDataFrame(edge, "band int, low long, high long, up long"))
    own, above = F.struct("band", F.lit(False).alias("small")), F.struct((F.col("band") + 1).alias("band"), F.lit(True).alias("small"))
    banded = clusters.join(table, F.col("n").between(F.col("low"), F.col("high")))
    banded = banded.select("node", "first", "component", "n", F.explode(F.when(F.col("n") >= F.col("up"), F.array(own, above)).otherwise(F.array(own))).alias("x")).select("node", "first", "component", "n", "x.*")
    counts = scratch.save(banded.groupBy("component", "band").agg(F.count("*").alias("m"), F.count_if(~F.col("small")).alias("own"), F.sum("n").alias("grams")).where("m > 1 and own > 0"), f"{name}-counts")
    tiles = banded.join(counts, ["component", "band"]).withColumn("nb", F.ceil(F.greatest(F.col("m") / block, F.col("grams") / grams)).cast("int")).withColumn("mine", F.pmod(F.xxhash64(F.lit(5), "node"), "nb").cast("int"))
    tiles = tiles.select("node", "first", "component", "band", "small", "mine", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    tiles = tiles.select("first", "node", "small", "mine", (F.col("mine") == F.col("other")).alias("inner"), F.xxhash64("component", "band", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"))
    return scratch.save(tiles, f"{name}-tiles")


def join(docs: DataFrame, size: int = SIZE, num: int = NUM, den: int = DEN, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text)."""
    return grouped(docs, size, num, den, block, scratch).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, size: int = SIZE, num: int = NUM, den: int = DEN, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """join() with ``row``, a hash of the text, and ``grp``, a hash that names the group, null for empty sets."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")
    parts = n_parts(spark)
    ids = scratch.save(docs.mapInArrow(lambda b: _ids(b, size), "doc_id long, row long, n long, node long, bits binary"), "ids")
    nodes = scratch.save(ids.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("n").alias("n")), "nodes")

    # A set has a signature for each five elements or so, mostly in two bands, of 24 bytes with its sketch.
    meet = max(parts, 10 * (nodes.agg(F.sum("n")).first()[0] or 0) // MEET_BYTES)
    packed = docs.mapInArrow(lambda b: _signed(b, size, num, den, 4 * meet), "p int, sig binary, sketch binary, node binary")
    pairs = packed.repartition(meet, "p").mapInArrow(_meet, "a long, b long")
    met = scratch.save(pairs.distinct(), "stars")
    clusters = components(scratch, met, "candidates")
    clusters = scratch.save(clusters.join(nodes, "node"), "candidates")

    tiles = tiled(scratch, clusters, "bits", num, den, block, BLOCK_BITS)
    bits = ids.where("n > 0").select(F.col("doc_id").alias("first"), "node", "n", "bits").dropDuplicates(["first", "node"])
    tiles = tiles.join(bits, ["first", "node"]).drop("first").repartition(parts, "tile").sortWithinPartitions("tile", "node")
    screened = scratch.save(tiles.mapInArrow(lambda b: _screen(b, num, den), "a long, b long"), "alike")
    clusters = scratch.save(components(scratch, screened, "alike").join(nodes, "node"), "clusters")
    tiles = tiled(scratch, clusters, "sets", num, den, block, BLOCK_GRAMS)
    # The sets are made again from the texts of the members and go straight to their tiles.
    few = tiles.groupBy("first").agg(F.collect_list(F.struct("node", "small", "mine", "inner", "tile")).alias("to")).select(F.col("first").alias("doc_id"), "to")
    texts = docs.join(F.broadcast(few) if tiles.count() <= BROADCAST_ROWS else few, "doc_id")
    tiles = texts.mapInArrow(lambda b: _sets(b, size), "to array<struct<node: long, small: boolean, mine: int, inner: boolean, tile: long>>, node long, s binary")
    tiles = tiles.select(F.col("node").alias("made"), "s", F.inline("to")).where("made = node").drop("made").repartition(parts, "tile").sortWithinPartitions("tile", "node")
    links = scratch.save(tiles.mapInArrow(lambda b: _solve(b, num, den), "a long, b long"), "links")

    found = components(scratch, links, "linked")
    for t in ("stars", "candidates", "bits-tiles", "alike", "clusters", "sets-tiles"):
        scratch.drop(t)
    of = scratch.save(nodes.join(found, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")), "of")
    least = scratch.save(of.join(found.select("component").distinct(), "component").groupBy("component").agg(F.min("first").alias("least")), "least")
    named = scratch.save(of.join(least, "component", "left").select("node", F.coalesce("least", "first").alias("component_id"), F.col("component").alias("grp")), "named")
    some = lambda c, other: F.when(F.col("n") > 0, F.col(c)).otherwise(other).alias(c)
    return ids.join(named, "node", "left").select("doc_id", "row", F.col("n").alias("n_shingles"), some("component_id", F.col("doc_id")), some("grp", F.lit(None)))


def _ids(batches, size):
    start_task()
    for b in batches:
        n, node, bits = [], [], []
        for _, s in shingle_sets(b.column("text"), size):
            n.append(len(s))
            node.append(set_id(s))
            bits.append(parity(s).tobytes() if len(s) else b"")
        yield rows_out(["doc_id", "row", "n", "node", "bits"], [*[pa.int64()] * 4, pa.binary()], [b.column("doc_id"), b.column("row"), n, node, bits])


def _sets(batches, size):
    start_task()
    for b in batches:
        rows = [(set_id(s), s.tobytes()) for _, s in shingle_sets(b.column("text"), size)]
        yield pa.RecordBatch.from_arrays([b.column("to"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["to", "node", "s"])


def _signed(batches, size, num, den, parts):
    """Signatures by ranges of them, and the links of what met in this task already, as rows without signatures."""
    start_task()
    bands, seen = Bands(num, den), set()
    sigs, sketches, nodes, have = [], [], [], 0

    def flush():
        sig, sketch, node, a, b = collapse(np.concatenate(sigs), np.concatenate(sketches), np.concatenate(nodes))
        at = (((sig >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)
        cut = np.searchsorted(at, np.arange(parts + 1))
        rows = [(p, *[c[cut[p] : cut[p + 1]].tobytes() for c in (sig, sketch, node)]) for p in np.flatnonzero(np.diff(cut)).tolist()]
        if len(a):
            a, b = stars(a, b)
            rows.append((int(a[0] % parts), b"", a.tobytes(), b.tobytes()))
        return rows_out(["p", "sig", "sketch", "node"], [pa.int32(), *[pa.binary()] * 3], list(zip(*rows, strict=True)))

    for b in batches:
        for _, s in shingle_sets(b.column("text"), size):
            if not len(s) or (i := set_id(s)) in seen:
                continue
            seen.add(i)
            band = int(bands.of(len(s)))
            for at in (band, band + 1) if bands.reaches_up(len(s), band) else (band,):
                sig, sketch = signatures(s, at, bands)
                sigs.append(sig)
                sketches.append(sketch)
                nodes.append(np.full(len(sig), i, np.int64))
                have += len(sig)
            if have >= SEND:
                yield flush()
                sigs, sketches, nodes, have = [], [], [], 0
        if len(seen) > 1_000_000:
            seen.clear()
    if have:
        yield flush()


def _meet(batches):
    """Star links of the nodes that share a signature with sketches that allow a link."""
    start_task()
    rows, links = [], []
    for b in batches:
        for sig, sketch, node in zip(*[b.column(c).to_pylist() for c in ("sig", "sketch", "node")], strict=True):
            (rows if sig else links).append((sig, sketch, node))
    sig, sketch, node = (np.frombuffer(b"".join(r[i] for r in rows), t) for i, t in enumerate((_U, _U, np.int64)))
    sketch = sketch.reshape(-1, WORDS)
    a, b = (np.frombuffer(b"".join(r[i] for r in links), np.int64) for i in (1, 2))
    del rows, links
    if len(sig):
        sig, sketch, node, *same = collapse(sig, sketch, node)
        a, b = (np.concatenate(x) for x in zip((a, b), same, alike(sig, sketch, node), strict=True))
    if not len(a):
        return
    a, b = stars(a, b)
    for i in range(0, len(a), 50_000):
        yield rows_out(["a", "b"], [pa.int64(), pa.int64()], [a[i : i + 50_000], b[i : i + 50_000]])


def _screen(batches, num, den):
    """Links between sets that their bitmaps allow to be alike."""
    start_task()
    for g in sorted_groups(batches, ["tile"]):
        bits = folded([np.frombuffer(x, _U) for x in g.column("bits").to_pylist()])
        yield from _links(g, g.column("n").to_numpy(), bits, None, num, den)


def _solve(batches, num, den):
    start_task()
    for g in sorted_groups(batches, ["tile"]):
        sets = [np.frombuffer(x, _U) for x in g.column("s").to_pylist()]
        yield from _links(g, np.array([len(s) for s in sets]), folded([parity(s) for s in sets]), sets, num, den)


def _links(g, n, bits, sets, num, den):
    links = linked_tile(n, bits, sets, g.column("mine").to_numpy(), g.column("small").to_numpy(), g.column("inner")[0].as_py(), num, den)
    if links:
        node = g.column("node").to_pylist()
        yield rows_out(["a", "b"], [pa.int64(), pa.int64()], [[node[i] for i, _ in links], [node[j] for _, j in links]])
