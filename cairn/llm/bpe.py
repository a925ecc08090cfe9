"""BPE encoding and decoding with a pair occurrence index.

A text is split at added tokens and by the byte-level pattern; the distinct pieces of a stretch
of a partition are laid out as one array of byte tokens. An index maps each adjacent pair that
the merge list ranks to all its positions. Active ranks are taken in ascending order: a rank's
positions are merged together, and the pairs that arise beside them, whose ranks are always
higher, join the index. Pieces met before are remembered up to ``MEMORY`` pieces.

The vocabulary file is a parameter, read on the driver and broadcast (its size is that of the
vocabulary, not of the data). A null text is empty; an empty text has no tokens; whole texts of
any length are encoded; repeated rows are encoded like any other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import KEPT, rows_out, ship, start_task

#: The byte-level pattern; \s is Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts of these characters alone, where the standard library's engine is four times as fast.
PLAIN = re.compile("[\x00-\x1b\x20-\x7f\xc0-\u024f]*")
_L = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
PLAIN_PATTERN = rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s0-9{_L}]+|\s+(?!\S)|\s+"
STRETCH = 4 << 20
MEMORY = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """What the encoder needs of a tokenizer file with a byte-level BPE model."""
    with open(path, "rb") as f:
        raw = f.read()
    j = json.loads(raw)
    letters = byte_letters()
    vocab, merges = j["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in j["model"]["merges"]]
    added = {t["content"]: t["id"] for t in j["added_tokens"]}
    spelled = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
    first = np.full(256, -1, np.int64)
    for c, b in letters.items():
        first[b] = vocab.get(c, -1)
    size = max(spelled) + 1
    key = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
    order = np.argsort(key, kind="stable")
    made = np.array([vocab[a + b] for a, b in merges], np.int64)
    return {"name": hashlib.sha256(raw).hexdigest(), "size": size, "first": first, "key": key[order], "rank": order.astype(np.int64), "left": key // size, "right": key % size, "made": made, "added": added, "spelled": [spelled.get(i, b"") for i in range(size)]}


class Encoder:
    def __init__(self, model: dict):
        self.m = model
        self.find_any, self.find_plain = regex.compile(PATTERN).findall, re.compile(PLAIN_PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(model["added"], key=len, reverse=True)) + ")") if model["added"] else None
        self.lens = np.array([len(b) for b in model["spelled"]], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lens)])
        self.blob = np.frombuffer(b"".join(model["spelled"]), np.uint8)
        self.forget()

    def forget(self) -> None:
        #: Piece to number; number to its tokens. Added tokens are the first numbers.
        self.number: dict[str, int] = {}
        self.tokens, self.off, self.new = np.array(list(self.m["added"].values()), np.int64), np.arange(len(self.m["added"]) + 1), []
        self.of_added = {t: i for i, t in enumerate(self.m["added"])}

    def pieces(self, text: str) -> np.ndarray:
        """Numbers of the pieces of a text."""
        number, new, base = self.number, self.new, len(self.off) - 1
        out: list[int] = []
        for part in self.cut.split(text) if self.cut and any(t in text for t in self.of_added) else (text,):
            if part in self.of_added:
                out.append(self.of_added[part])
                continue
            found = (self.find_plain if PLAIN.fullmatch(part) else self.find_any)(part)
            known = list(map(number.get, found))
            if None in known:
                for k, i in enumerate(known):
                    if i is None:
                        p = found[k]
                        i = number.get(p)
                        if i is None:
                            i = number[p] = base + len(new)
                            new.append(p)
                        known[k] = i
            out += known
        return np.array(out, np.int64)

    def settle(self) -> None:
        """Encode the pieces that are new."""
        if self.new:
            tokens, lens = merge(self.m, [p.encode("utf-8", "surrogatepass") for p in self.new])
            self.tokens = np.concatenate([self.tokens, tokens])
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(lens)])
            self.new = []

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        return self.tokens[spread(self.off[numbers], self.off[numbers + 1] - self.off[numbers])]

    def decode(self, ids: np.ndarray) -> str:
        return self.blob[spread(self.at[ids], self.lens[ids])].tobytes().decode("utf-8", "replace")


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, then of start[1], and so on."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(total)


def merge(model: dict, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words in turn, and how many each has."""
    # Words stand between separators (-1), so that no pair crosses them.
    raw = np.frombuffer(b"\0".join([b"", *words, b""]), np.uint8)
    lens = np.array([len(w) for w in words], np.int64)
    sep = np.concatenate([[0], np.cumsum(lens + 1)])
    tok = model["first"][raw]
    tok[sep] = -1
    n, size, keys, ranks = len(tok), model["size"], model["key"], model["rank"]
    nxt, prv = np.arange(1, n + 1, dtype=np.int64), np.arange(-1, n - 1, dtype=np.int64)
    nxt[-1] = n - 1
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Put positions into the index under the rank of the pair that starts there."""
        a, b = tok[at], tok[nxt[at]]
        good = (a >= 0) & (b >= 0)
        at, k = at[good], a[good] * size + b[good]
        if not len(at):
            return
        i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        good = keys[i] == k
        at, r = at[good], ranks[i[good]]
        if not len(at):
            return
        if len(at) > 1:
            o = np.argsort(r, kind="stable")
            at, r = at[o], r[o]
        cuts = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1, [len(r)]])
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rank = int(r[x])
            if rank in index:
                index[rank].append(at[x:y])
            else:
                index[rank] = [at[x:y]]
                heapq.heappush(heap, rank)

    if len(keys):
        # Of two bytes, by a table.
        bytes2 = (model["first"][:, None] * size + model["first"][None, :]).ravel()
        i = np.minimum(np.searchsorted(keys, bytes2), len(keys) - 1)
        table = np.where((keys[i] == bytes2) & (bytes2 >= 0), ranks[i], -1).astype(np.int32)
        r = table[(raw[:-1].astype(np.int32) << 8) | raw[1:]]
        r[(tok[:-1] < 0) | (tok[1:] < 0)] = -1
        at = np.flatnonzero(r >= 0)
        r = r[at]
        o = np.argsort(r, kind="stable")
        at, r = at[o], r[o]
        cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)] if len(r) else []
        for x, y in zip(cuts[:-1], cuts[1:]):
            index[int(r[x])] = [at[x:y]]
        heap = sorted(index)
    while heap:
        rank = heapq.heappop(heap)
        found = index.pop(rank)
        at = found[0] if len(found) == 1 else np.concatenate(found)
        left, right = model["left"][rank], model["right"][rank]
        at = at[(tok[at] == left) & (tok[nxt[at]] == right)]
        if len(at) > 1:
            at = np.sort(at)
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            if left == right:  # overlapping pairs: every second one of a run, from its left
                chained = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
                start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
        if not len(at):
            continue
        gone = nxt[at]
        tok[at], tok[gone] = model["made"][rank], -2
        after = nxt[gone]
        nxt[at], prv[after] = after, at
        before = prv[at]
        enter(np.concatenate([before, at]))
    alive = tok >= 0
    count = np.add.reduceat(alive.astype(np.int64), sep[:-1]) if len(words) else np.zeros(0, np.int64)
    return tok[alive], count


def remembered(model) -> Encoder:
    """The encoder of a broadcast model; a worker process keeps it, with its pieces, until another operator's task."""
    start_task("bpe")
    name = model.value["name"]
    if name not in (kept := KEPT.setdefault("bpe", {})):
        kept.clear()
        kept[name] = Encoder(model.value)
    return kept[name]


ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"


def stretches(batches, columns: list[str]):
    """Batches joined to about STRETCH bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch.select(columns))
        size += batch.column("text").nbytes
        if size >= STRETCH:
            yield from held if len(held) == 1 else [pa.Table.from_batches(held)]
            held, size = [], 0
    if held:
        yield from held if len(held) == 1 else [pa.Table.from_batches(held)]


def byte_slices(table):
    """Slices of about STRETCH bytes of text, each a row at least."""
    n = table.num_rows
    size = np.cumsum([0 if x is None else x for x in pc.binary_length(table.column("text")).to_pylist()])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + STRETCH, "right")))
        yield table.slice(i, j - i)
        i = j


def encode_texts(encoder: Encoder, texts: list[str | None]) -> list[np.ndarray]:
    """Token ids of each text."""
    if len(encoder.number) > MEMORY:
        encoder.forget()
    numbers = [encoder.pieces(t or "") for t in texts]
    encoder.settle()
    return [encoder.ids(x) for x in numbers]


def bpe(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """ENCODED: ids as little-endian uint32 and the text that they decode to; with ``digests``
    (doc_id, n_tokens, ids_sha256, decoded_sha256) instead."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(load(path))

    def run(batches):
        encoder = remembered(model)
        for table in stretches(batches, ["doc_id", "text"]):
            for part in byte_slices(table):
                ids = encode_texts(encoder, part.column("text").to_pylist())
                raw = [x.astype("<u4").tobytes() for x in ids]
                text = [encoder.decode(x) for x in ids]
                n = [len(x) for x in ids]
                if digests:
                    yield rows_out(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()],
                                   [part.column("doc_id").to_pylist(), n, [hashlib.sha256(x).hexdigest() for x in raw], [hashlib.sha256(x.encode()).hexdigest() for x in text]])
                else:
                    yield rows_out(["doc_id", "n_tokens", "ids", "decoded"], [pa.int64(), pa.int64(), pa.binary(), pa.string()], [part.column("doc_id").to_pylist(), n, raw, text])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else ENCODED)
