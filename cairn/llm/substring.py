"""Substring dedup: suffix automata of reference passages, matching statistics of documents.

A window is ``window`` consecutive words of a document. A word goes if a window covers it whose
words also start in a document with a smaller doc_id.

Windows are routed to reference shards by their anchor, the smallest hash among the window's
``GRAM``-grams: equal windows have equal anchors. A stretch is a run of at most ``RUN`` windows with one anchor, known by
128 bits of its words' hashes. Stretches go no further whose anchor stands in one document only, and of equal stretches only
one does: a document with a larger id than the first that has the stretch loses all its words, as one row.

The distinct stretches of an anchor meet in the anchor's shard. Its reference is the first ``REFERENCE`` of them by doc_id: all
of them nearly always. They stream in doc_id order past a generalised suffix automaton of the references before them:
matching statistics of ``window`` or more mark words. An anchor with more stretches than ``SALT_ROWS`` has its
reference sent to as many tasks as that takes, so that a passage that a third of the corpus has, each time in other surroundings, is no hot
task. Windows that the reference leaves open, in stretches beyond it, are dealt once more by a second anchor, the smallest of
another hash among the window's grams that the reference does not have (of all, if it has all): what stands around a hot passage, not the passage.
Runs of them are one row each and are met as stretches are: a second anchor in one document only
goes no further, equal runs are one, and only the windows of those left are settled one by one, by keys of 128 bits. The automata are not broadcast to every task:
the reference is the corpus, so that a broadcast has no bound; a shard's automaton meets the stretches with its anchor only.

Documents of equal word sequences are known by a hash of 128 bits: those after the first lose every
word if they have ``window`` words, as each of their windows starts in the first.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; null texts have none. Texts are whole, whatever their length; long ones are hashed
in pieces. A row is known by its doc_id and a hash of its text: rows that repeat a doc_id are one document for "smaller
doc_id", each with its own removals. Rows whose doc_id is null lose nothing and are no
reference. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import Scratch, Words, grams, mix, n_parts, ranges_hash, rows_out, sliding_min, start_task, text_chunks

WINDOW = 50
GRAM = 8
#: Windows of a stretch, stretches in an anchor's reference, and stretches that one task streams past it.
RUN, REFERENCE, SALT_ROWS = 128, 128, 2048
_U = np.uint64
_B1, _B2 = 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25
#: A row that loses all its words.
ALL = (1 << 31) - 1


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]

    def add(self, words: list) -> None:
        last = 0
        for c in words:
            last = self._extend(last, c)

    def _extend(self, last: int, c) -> int:
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c, q: int) -> int:
        nxt, link = self.next, self.link
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        self.len.append(self.len[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def ends(self, words: list, least: int) -> list[int]:
        """Ends of the stretches of ``least`` words that occur in a sequence."""
        nxt, link, length = self.next, self.link, self.len
        v = l = 0
        out = []
        for i, c in enumerate(words, 1):
            while v and c not in nxt[v]:
                v = link[v]
                l = length[v]
            to = nxt[v].get(c)
            if to is not None:
                v, l = to, l + 1
                if l >= least:
                    out.append(i)
        return out


def merged(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Word ranges that windows with these ascending starts cover."""
    out: list[list[int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1][1] = s + window
        else:
            out.append([s, s + window])
    return [(a, b) for a, b in out]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, reference: int = REFERENCE, salt_rows: int = SALT_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, kept string, n_words, n_removed) of every row of docs(doc_id, text); kept words are joined by one space."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "substring")
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")
    gram, content, place = min(GRAM, window), ["m", "s1", "s2"], ["doc_id", "row"]

    known = docs.where("doc_id is not null").mapInArrow(lambda b: _stretches(b, window, gram), "m long, s1 long, s2 long, doc_id long, row long, at int, n int")
    known = scratch.save(known, "stretches")
    wholes, parts = known.where("at < 0"), known.where("at >= 0")
    firsts = scratch.save(wholes.groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "firsts")
    copies = wholes.join(firsts, ["s1", "s2"]).where("doc_id > first").select(*place, F.lit(0).alias("lo"), F.lit(ALL).alias("hi"))

    shared = scratch.save(parts.groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("m"), "anchors")
    shared = scratch.save(parts.join(shared, "m"), "shared")
    once = scratch.save(shared.groupBy(*content).agg(F.min(F.struct("doc_id", "row", "at")).alias("least"), F.max("n").alias("n")), "once")
    many = scratch.save(once.groupBy("m").agg(F.count("*").alias("k")), "many")
    once = scratch.save(once.join(many, "m"), "contents")
    placed = scratch.save(shared.join(once.select(*content, F.col("least.doc_id").alias("first"), "k"), content), "placed")
    covered = placed.where("doc_id > first").select(*place, F.col("at").alias("lo"), (F.col("at") + F.col("n") + (window - 1)).alias("hi"))
    owned = placed.where("doc_id = first and k > 1").select(*content, *place, "at")

    # The reference of an anchor: its first stretches. The rank has a limit, so that a task sends few of each anchor.
    some, order = once.where(F.col("k") > 1), ["least.doc_id", *content[1:]]
    hot = some.where(F.col("k") > reference)
    ranked = hot.select(*content, F.row_number().over(Window.partitionBy("m").orderBy(*order)).alias("r")).where(F.col("r") <= reference)
    hot = hot.join(ranked, content, "left").withColumn("ref", F.col("r").isNotNull()).drop("r")
    some = some.where(F.col("k") <= reference).withColumn("ref", F.lit(True)).unionByName(hot)
    salts = F.ceil(F.col("k") / salt_rows).cast("int")
    mine = F.pmod(F.col("s1"), salts).cast("int")
    spots = some.groupBy(F.col("least.doc_id").alias("doc_id"), F.col("least.row").alias("row")).agg(F.collect_list(F.struct(*content, "least.at", "n", "k", "ref", salts.alias("salts"), mine.alias("mine"))).alias("spots"))
    pieces = docs.join(scratch.save(spots, "spots"), place).mapInArrow(lambda b: _pieces(b, window), "m long, s1 long, s2 long, doc_id long, ref boolean, salts int, mine int, open boolean, words binary")
    # In each salt the reference comes by (role 0); a stretch is matched in its own (role 1), or both at once (2).
    both = F.when(F.col("ref"), F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda i: F.struct(i.alias("salt"), F.when(i == F.col("mine"), 2).otherwise(0).alias("role"))))
    tiles = pieces.select(*content, "doc_id", "open", "words", F.inline(both.otherwise(F.array(F.struct(F.col("mine").alias("salt"), F.lit(1).alias("role"))))))
    tiles = tiles.withColumn("shard", F.xxhash64("m", "salt")).repartition(n_parts(spark), "shard").sortWithinPartitions("shard", "m", "salt", "doc_id", "s1", "s2")
    found = scratch.save(tiles.mapInArrow(lambda b: _match(b, window, gram), "m long, s1 long, s2 long, doc_id long, lo int, hi int, m2 long, c1 long, c2 long, keys binary"), "found")

    left, run = found.where("m2 is not null"), ["m", "m2", "c1", "c2"]
    runs = scratch.save(left.groupBy(*run).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "runs")
    again = scratch.save(runs.groupBy("m", "m2").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b").select("m", "m2"), "again")
    alike = left.drop("keys").join(runs.where("first < last"), run).where("doc_id > first").select(*content, "lo", "hi")
    unlike = left.join(again, ["m", "m2"]).join(runs.drop("last"), run).where("doc_id = first").select(*content, "doc_id", "lo", "keys")
    single = scratch.save(unlike.mapInArrow(lambda b: _singles(b, window), "m long, s1 long, s2 long, doc_id long, lo int, hi int, w1 long, w2 long"), "single")
    least = scratch.save(single.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "least")
    late = single.join(least, ["w1", "w2"]).where("doc_id > first").select(*content, "lo", "hi")
    answers = found.where("m2 is null").select(*content, "lo", "hi").union(alike).union(late)
    told = owned.join(answers, content).select(*place, (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
    ranges = scratch.save(covered.union(told).union(copies).groupBy(*place).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "ranges")
    for t in ("stretches", "firsts", "anchors", "shared", "once", "many", "contents", "placed", "spots", "found", "runs", "again", "single", "least"):
        scratch.drop(t)
    return docs.join(ranges, place, "left").mapInArrow(_kept, "doc_id long, kept string, n_words long, n_removed long")


def _stretches(batches, window, gram):
    """Rows of stretches, and one with ``at`` -1 of each text of ``window`` words: the hash of all its words."""
    start_task()
    names, types = ["m", "s1", "s2", "doc_id", "row", "at", "n"], [*[pa.int64()] * 5, pa.int32(), pa.int32()]
    seen: dict[tuple[int, int], tuple[int, int]] = {}
    for b in batches:
        ids, row_of = b.column("doc_id").to_numpy(), b.column("row").to_numpy()
        for i, buf, off in text_chunks(b.column("text")):
            w = Words(buf, off)
            size = np.diff(w.first)
            long = np.flatnonzero(size >= window)
            if not len(long):
                continue
            h, doc, row = w.hashes(), ids[i : i + len(size)], row_of[i : i + len(size)]
            q1, q2 = (ranges_hash(h, w.first[long], w.first[long + 1], x).view(np.int64) for x in (_B1, _B2))
            yield rows_out(names, types, [np.zeros(len(long), np.int64), q1, q2, doc[long], row[long], np.full(len(long), -1, np.int32), size[long].astype(np.int32)])
            # A copy of a text that this task has sent with a smaller doc_id has nothing to add.
            use = []
            for d, x, y in zip(long.tolist(), q1.tolist(), q2.tolist(), strict=True):
                me = (int(doc[d]), int(row[d]))
                was = seen.get((x, y))
                if was is None or me[0] < was[0] or (me[0] == was[0] and me != was):
                    seen[x, y] = me
                    use.append(d)
            if len(seen) > 500_000:
                seen.clear()
            d = np.array(use, np.int64)
            if not len(d):
                continue
            low = sliding_min(grams(h, gram), window - gram + 1)
            n = size[d] - window + 1
            end = np.cumsum(n)
            k = np.arange(end[-1])
            at = np.repeat(w.first[d] - (end - n), n) + k
            m, of = low[at], np.repeat(d, n)
            new = np.ones(len(k), bool)
            new[1:] = (m[1:] != m[:-1]) | (of[1:] != of[:-1])
            new |= (k - np.maximum.accumulate(np.where(new, k, 0))) % RUN == 0
            s = np.flatnonzero(new)
            n, a, of = np.diff(np.append(s, len(k))), at[s], of[s]
            s1, s2 = (ranges_hash(h, a, a + n + window - 1, x).view(np.int64) for x in (_B1, _B2))
            yield rows_out(names, types, [m[s].view(np.int64), s1, s2, doc[of], row[of], (a - w.first[of]).astype(np.int32), n.astype(np.int32)])


def _pieces(batches, window):
    """The words of stretches, joined by one space."""
    start_task()
    names, types = ["m", "s1", "s2", "doc_id", "ref", "salts", "mine", "open", "words"], [*[pa.int64()] * 4, pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    for b in batches:
        ids, spots = b.column("doc_id").to_pylist(), b.column("spots")
        rows = []
        for i, buf, off in text_chunks(b.column("text")):
            w = Words(buf, off)
            raw = buf.tobytes()
            for d in range(len(off) - 1):
                first = int(w.first[d])
                for s in spots[i + d].as_py():
                    a = first + s["at"]
                    words = b" ".join(raw[w.start[a] : w.end[a + s["n"] + window - 2]].split())
                    rows.append((s["m"], s["s1"], s["s2"], ids[i + d], s["ref"], s["salts"], s["mine"], not s["ref"], words))
                if len(rows) > 5000:
                    yield rows_out(names, types, list(zip(*rows, strict=True)))
                    rows = []
        if rows:
            yield rows_out(names, types, list(zip(*rows, strict=True)))


def _match(batches, window, gram):
    """Ranges of a stretch's words that a smaller document has, and the runs of windows that stay open with a key of each."""
    start_task()
    names = ["m", "s1", "s2", "doc_id", "lo", "hi", "m2", "c1", "c2", "keys"]
    types = [*[pa.int64()] * 4, pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.binary()]
    out, still = [], []

    def flush():
        if out:
            yield rows_out(names, types, [*zip(*out, strict=True), *[[None] * len(out)] * 4])
        if still:
            w = _joined([r[4] for r in still])
            h = w.hashes()
            g = grams(h, gram)
            # Grams that the reference has come last.
            low = sliding_min((mix(g) >> _U(1)) | (np.isin(g, known).astype(_U) << _U(63)), window - gram + 1)
            of = np.repeat(np.arange(len(still)), [len(r[5]) for r in still])
            lo = np.concatenate([r[5] for r in still])
            at = w.first[of] + lo
            m2 = low[at]
            new = np.ones(len(at), bool)
            new[1:] = (m2[1:] != m2[:-1]) | (of[1:] != of[:-1]) | (lo[1:] != lo[:-1] + 1)
            s = np.flatnonzero(new)
            e = np.append(s[1:], len(at))
            c1, c2 = (ranges_hash(h, at[s], at[e - 1] + window, x).view(np.int64) for x in (_B1, _B2))
            keys = np.stack([ranges_hash(h, at, at + window, x) for x in (_B1, _B2)], axis=1)
            mine = [[still[i][c] for i in of[s]] for c in range(4)]
            yield rows_out(names, types, [*mine, lo[s], lo[e - 1] + window, m2[s].view(np.int64), c1, c2, [keys[i:j].tobytes() for i, j in zip(s, e, strict=True)]])

    at, was, doc_at, sam, refs, waiting, known = None, None, None, None, [], [], None
    for b in batches:
        for m, s1, s2, doc, is_open, raw, salt, role in zip(*(b.column(c).to_pylist() for c in ("m", "s1", "s2", "doc_id", "open", "words", "salt", "role")), strict=True):
            if at != (m, salt):
                if still:
                    yield from flush()
                    out, still = [], []
                at, sam, refs, waiting, doc_at, known = (m, salt), Automaton(), [], [], doc, None
            elif was == (s1, s2, doc):
                continue  # a repeated row
            was = (s1, s2, doc)
            if doc != doc_at:  # a document's own stretches are no reference for it
                for r in waiting:
                    sam.add(r.split(b" "))
                waiting, doc_at = [], doc
            words = raw.split(b" ")
            last = len(words) - window + 1
            ends = sam.ends(words, window) if refs else []
            if role:
                out += [(m, s1, s2, doc, x, y) for x, y in merged([e - window for e in ends], window)]
                if is_open and len(ends) < last:
                    if known is None:  # the whole reference has come: it goes by doc_id, s1, s2 as the rows do
                        known = _grams_of(refs, gram)
                    still.append((m, s1, s2, doc, raw, np.setdiff1d(np.arange(last), np.array(ends, np.int64) - window)))
            if role != 1 and len(ends) < last:
                waiting.append(raw)
                refs.append(raw)
            if len(out) > 20_000 or len(still) > 5000:
                yield from flush()
                out, still = [], []
    yield from flush()


def _joined(raw: list[bytes]) -> Words:
    return Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def _grams_of(raw: list[bytes], gram: int) -> np.ndarray:
    """Hashes of the grams of word sequences, none across two of them."""
    if not raw:
        return np.zeros(0, _U)
    w = _joined(raw)
    g = grams(w.hashes(), gram)
    at = np.arange(len(g))
    return np.unique(g[at + gram <= w.first[np.searchsorted(w.first, at, "right")]])


def _singles(batches, window):
    """The windows of runs, by their keys."""
    start_task()
    names, types = ["m", "s1", "s2", "doc_id", "lo", "hi", "w1", "w2"], [*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    for b in batches:
        raw = b.column("keys").to_pylist()
        n = np.array([len(k) // 16 for k in raw], np.int64)
        if not len(n):
            continue
        keys = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
        mine = [np.repeat(b.column(c).to_numpy(), n) for c in names[:4]]
        lo = np.repeat(b.column("lo").to_numpy() - (np.cumsum(n) - n), n) + np.arange(len(keys))
        yield rows_out(names, types, [*mine, lo, lo + window, keys[:, 0], keys[:, 1]])


def _kept(batches):
    start_task()
    for b in batches:
        kept, total, gone = [], [], []
        for text, ranges in zip(*(b.column(c).to_pylist() for c in ("text", "ranges")), strict=True):
            words = (text or "").encode().split()
            n = len(words)
            if ranges and any(r["hi"] == ALL for r in ranges):
                words = []
            elif ranges:
                on = np.zeros(n + 1, np.int64)
                for r in ranges:
                    on[r["lo"]] += 1
                    on[r["hi"]] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(on)[:n] == 0)]
            kept.append(b" ".join(words).decode())
            total.append(n)
            gone.append(n - len(words))
        yield rows_out(["doc_id", "kept", "n_words", "n_removed"], [pa.int64(), pa.string(), pa.int64(), pa.int64()], [b.column("doc_id").to_pylist(), kept, total, gone])
