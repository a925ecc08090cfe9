"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins word features (a hashed embedding, and the log-odds of its presence in labelled toxic
documents with their support) and character features (the mean hashed embedding of its character trigrams, and the
mean and the largest of the trigrams' log-odds). A word of more than ``PIECE`` bytes counts as
several, one for each piece, so that no byte of a text without spaces is left out. Windows of ``LENGTH`` words, each overlapping
the next by ``LENGTH - STRIDE``, run through the network; attention pools the states of a window, and a document's score is
that of its highest window. Every window of the whole text is scored.

Training takes labelled documents chosen by a hash of doc_id; ``TRAIN_DOCS`` bounds the number
expected. The log-odds that a training document sees come from the other half of the sample, so that the
network learns how far to trust them. Each step finds a document's highest window and moves the
network on that window (multiple-instance learning) by Adam.

Null and empty texts and texts without words score the base rate of the sample; a
sample without both labels scores that rate everywhere, 0 if there is none. Repeated labels of a doc_id teach once
each. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import LOWER_VALUE, Words, mix, rows_out, ship, start_task, text_chunks

LENGTH, STRIDE = 40, 28
TRAIN_DOCS = 5000
HIDDEN = 8
WORD_SLOTS, CHAR_SLOTS, DIM = 1 << 15, 1 << 13, 4
EPOCHS, LEAST_STEPS, BATCH, RATE = 5, 240, 64, 0.01
PRIOR = 5.0
#: Bytes of a word that take one place in a window; longer words take as many places as they need.
PIECE = 18
f4 = np.float32


def pieces(w: Words, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts the words of w into consecutive pieces of at most PIECE bytes, in place: (start, end, byte value before, and after, first piece of each word).

    What lies beyond a word is a space, whatever stands there; a piece inside a word has its neighbours.
    """
    n = -(-(w.end - w.start) // PIECE)
    total = np.concatenate([[0], np.cumsum(n)])
    word = np.repeat(np.arange(len(n)), n)
    k = np.arange(total[-1]) - total[word]
    start = w.start[word] + k * PIECE
    end = np.minimum(start + PIECE, w.end[word])
    space = LOWER_VALUE[32]
    before = np.where(k > 0, v[np.maximum(start - 1, 0)], space) if len(v) else np.zeros(0, np.uint64)
    after = np.where(k < n[word] - 1, v[np.minimum(end, len(v) - 1)], space) if len(v) else np.zeros(0, np.uint64)
    w.start, w.end, w.first = start, end, total[w.first]
    return start, end, before, after, total[:-1]


def features(buf: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words cut into pieces, type of each piece, word slot of each type, its character slots [types, PIECE] with -1 as filling)."""
    w = Words(buf, off, lower=True)
    v = np.where(np.isin(buf, (9, 10, 11, 12, 13)), LOWER_VALUE[32], LOWER_VALUE[buf])
    whole = w.hashes()
    start, end, before, after, named = pieces(w, v)
    # Beyond the first piece, pieces share one slot: nearly all would be new words that teach by rote.
    slot = np.zeros(len(start), np.uint64)
    slot[named] = whole & np.uint64(WORD_SLOTS - 1)
    name = np.zeros(len(start), np.uint64)
    name[named] = whole
    _, first, of = np.unique(mix(mix(w.hashes() + before * np.uint64(31) + after * np.uint64(961)) + name), return_index=True, return_inverse=True)
    # Trigrams of each piece with the byte before and after it: all those of " word " over the pieces of a word.
    start, size = start[first], (end - start)[first]
    k = np.arange(PIECE)
    at = start[:, None] + k
    ok = k[None] < size[:, None]
    last = max(0, len(buf) - 1)
    b = v[np.minimum(at, last)] if len(buf) else np.zeros(at.shape, np.uint64)
    left = np.concatenate([before[first][:, None], b[:, :-1]], 1)
    right = np.where(k[None] == size[:, None] - 1, after[first][:, None], np.concatenate([b[:, 1:], b[:, -1:]], 1))
    tri = (mix(left + b * np.uint64(31) + right * np.uint64(961)) & np.uint64(CHAR_SLOTS - 1)).astype(np.int32)
    return w, of.reshape(-1), slot[first].astype(np.int32), np.where(ok, tri, -1).astype(np.int32)


class Odds:
    """Smoothed log-odds of presence in toxic documents, by slot."""

    def __init__(self, slots: int):
        self.n, self.a = np.zeros(slots, f4), np.zeros(slots, f4)

    def add(self, slots: np.ndarray, label: int) -> None:
        s = np.unique(slots[slots >= 0])
        self.n[s] += 1
        self.a[s] += label

    def table(self, rate: float) -> tuple[np.ndarray, np.ndarray]:
        return (np.log((self.a + PRIOR * rate) / ((self.n + PRIOR) * rate)) / 2).astype(f4), (np.log1p(self.n) / 6).astype(f4)


def odds(docs: list, rate: float) -> dict:
    w, c = Odds(WORD_SLOTS), Odds(CHAR_SLOTS)
    for d in docs:
        w.add(d["word"], d["label"])
        c.add(d["chars"].ravel(), d["label"])
    a, b = w.table(rate)
    return {"w": a, "support": b, "c": c.table(rate)[0]}


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        e, h = 2 * DIM + 4, HIDDEN
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(f4)
        self.p = {"word": draw(WORD_SLOTS, DIM) * 4, "char": draw(CHAR_SLOTS, DIM) * 4, "Wf": draw(e, 3 * h), "Wb": draw(e, 3 * h), "Uf": draw(h, 3 * h), "Ub": draw(h, 3 * h),
                  "bf": np.zeros(3 * h, f4), "bb": np.zeros(3 * h, f4), "A": draw(2 * h, h), "a": draw(h), "o": draw(2 * h), "c": np.full(1, -1.0, f4)}
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def inputs(self, word: np.ndarray, chars: np.ndarray, o: dict) -> np.ndarray:
        """Input vector of each word type."""
        ok = chars >= 0
        n = np.maximum(ok.sum(1), 1).astype(f4)[:, None]
        co = np.where(ok, o["c"][chars], 0)
        ce = (self.p["char"][chars] * ok[:, :, None]).sum(1) / n
        return np.concatenate([o["w"][word][:, None] * 2, o["support"][word][:, None], (co.sum(1, keepdims=True) / n) * 2, np.where(ok, co, -9).max(1, keepdims=True, initial=-9).clip(-9) * 2, self.p["word"][word], ce], 1).astype(f4)

    def forward(self, xf: np.ndarray, xb: np.ndarray, idx: np.ndarray, keep: bool = False):
        """Logit of windows idx [n, LENGTH] of types (-1: filling) from projected inputs; with keep, also what backward needs."""
        p, h, (n, length) = self.p, HIDDEN, idx.shape
        state = np.zeros((length, n, 2 * h), f4)
        tape = []
        filled = idx >= 0
        full = filled.all(0)
        for x, u, cols, order in ((xf, p["Uf"], slice(0, h), range(length)), (xb, p["Ub"], slice(h, 2 * h), range(length - 1, -1, -1))):
            s = np.zeros((n, h), f4)
            steps = []
            for t in order:
                g, q = x[idx[:, t]], s @ u
                zr = 1 / (1 + np.exp(-(g[:, : 2 * h] + q[:, : 2 * h])))
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(g[:, 2 * h :] + r * q[:, 2 * h :])
                new = c + z * (s - c)
                if not full[t]:
                    new = np.where(filled[:, t, None], new, s)
                if keep:
                    steps.append((t, s, z, r, c, q[:, 2 * h :]))
                s = new
                state[t, :, cols] = s
            tape.append(steps)
        a = np.tanh(state @ p["A"])
        e = a @ p["a"]
        e = np.where(filled.T, e, -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        ctx = np.einsum("tn,tnh->nh", w, state)
        logit = ctx @ p["o"] + p["c"][0]
        return (logit, (state, tape, a, w, ctx, filled)) if keep else logit

    def backward(self, kept, d: np.ndarray, idx: np.ndarray, x: np.ndarray, word: np.ndarray, chars: np.ndarray) -> dict:
        """Gradients for d = d loss / d logit."""
        p, h = self.p, HIDDEN
        state, tape, a, w, ctx, filled = kept
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        g["o"], g["c"] = ctx.T @ d, np.array([d.sum()], f4)
        dctx = d[:, None] * p["o"][None]
        dw = np.einsum("tnh,nh->tn", state, dctx)
        ds = w[:, :, None] * dctx[None]
        de = w * (dw - (w * dw).sum(0))
        g["a"] = np.einsum("tn,tnh->h", de, a)
        da = de[:, :, None] * p["a"] * (1 - a * a)
        g["A"] = np.einsum("tni,tnj->ij", state, da)
        ds += da @ p["A"].T
        dx = np.zeros_like(x)
        for steps, U, W, B, cols in ((tape[0], "Uf", "Wf", "bf", slice(0, h)), (tape[1], "Ub", "Wb", "bb", slice(h, 2 * h))):
            dnext = np.zeros((len(d), h), f4)
            for t, s, z, r, c, qn in reversed(steps):
                m = filled[:, t, None]
                dn = ds[t][:, cols] + dnext
                on = dn * m
                dc = on * (1 - z) * (1 - c * c)
                dz = on * (s - c) * z * (1 - z)
                dr = dc * qn * r * (1 - r)
                dq, dg = np.concatenate([dz, dr, dc * r], 1), np.concatenate([dz, dr, dc], 1)
                g[U] += s.T @ dq
                dnext = dn * (1 - m) + on * z + dq @ p[U].T
                i = np.maximum(idx[:, t], 0)
                g[W] += (x[i] * m).T @ dg
                g[B] += dg.sum(0)
                np.add.at(dx, i, (dg @ p[W].T) * m)
        used = np.flatnonzero(np.bincount(idx[idx >= 0], minlength=len(x)))
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], word[used], dx[used, 4 : 4 + DIM])
        g["char"] = np.zeros_like(p["char"])
        ok = chars[used] >= 0
        share = dx[used, 4 + DIM :] / np.maximum(ok.sum(1), 1)[:, None]
        np.add.at(g["char"], chars[used][ok], np.repeat(share, ok.sum(1), axis=0))
        return g

    def step(self, g: dict, rate: float) -> None:
        self.t += 1
        for k, v in g.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * v
            self.v[k] = 0.99 * self.v[k] + 0.01 * v * v
            self.p[k] -= (rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)).astype(f4)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]


def windows(of: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(types in each window [n, LENGTH], document of each): the last of a document may be short."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - LENGTH) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    at = first[doc] + k * STRIDE
    pos = at[:, None] + np.arange(LENGTH)
    ok = pos < first[doc + 1][:, None]
    return np.where(ok, of[np.minimum(pos, max(0, len(of) - 1))] if len(of) else -1, -1), doc


def train(rows: list[tuple[str, int]]) -> dict | float:
    """The model, or the rate of label 1 where there is no model to learn."""
    rate = float(np.mean([y for _, y in rows])) if rows else 0.0
    if not 0 < rate < 1:
        return rate
    docs = []
    for text, y in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        w, of, word, chars = features(raw, np.array([0, len(raw)]))
        if len(of):
            docs.append({"label": y, "of": of, "word": word, "chars": chars, "windows": windows(of, w.first)[0]})
    half = [odds(docs[1::2], rate), odds(docs[0::2], rate)]
    net, rng = Network(), np.random.Generator(np.random.PCG64(1))
    each = -(-len(docs) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // each))
    steps, total = 0, epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for b in range(0, len(docs), BATCH):
            part = [docs[i] for i in order[b : b + BATCH]]
            xs, base, picked = [], 0, []
            words, chars = [], []
            for i, d in zip(order[b : b + BATCH], part, strict=True):
                xs.append(net.inputs(d["word"], d["chars"], half[i % 2]))
                words.append(d["word"])
                chars.append(d["chars"])
            x, words, chars = np.concatenate(xs), np.concatenate(words), np.concatenate(chars)
            every, of_doc = [], []
            for k, d in enumerate(part):
                every.append(np.where(d["windows"] >= 0, d["windows"] + base, -1))
                of_doc.append(np.full(len(d["windows"]), k))
                base += len(d["word"])
            every, of_doc = np.concatenate(every), np.concatenate(of_doc)
            xf, xb = net.project(x)
            score = net.forward(xf, xb, every)
            o = np.lexsort((-score, of_doc))
            picked = o[np.searchsorted(of_doc[o], np.arange(len(part)))]
            idx = every[picked]
            logit, kept = net.forward(xf, xb, idx, keep=True)
            y = np.array([d["label"] for d in part], f4)
            g = net.backward(kept, ((sigmoid(logit) - y) / len(part)).astype(f4), idx, x, words, chars)
            net.step(g, RATE * (1 - 0.9 * steps / total))
            steps += 1
    return {"p": net.p, "odds": odds(docs, rate), "rate": rate}


def probabilities(model: dict | float, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Score of each text in a buffer."""
    n = len(off) - 1
    if isinstance(model, float):
        return np.full(n, model)
    net = Network.__new__(Network)
    net.p = model["p"]
    w, of, word, chars = features(buf, off)
    out = np.full(n, model["rate"])
    if len(of):
        xf, xb = net.project(net.inputs(word, chars, model["odds"]))
        idx, doc = windows(of, w.first)
        score = np.concatenate([net.forward(xf, xb, idx[i : i + 8192]) for i in range(0, len(idx), 8192)])
        start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[doc[start]] = sigmoid(np.maximum.reduceat(score, start))
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, score) of every row of docs(doc_id, text), learned from labels(doc_id, toxic)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long"), "toxic").distinct()
    part = min(1.0, train_docs / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) < int(part * 1_000_000 + 0.999))
    rows = sorted((r[0], r[1] or "", r[2]) for r in docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect())  # about train_docs rows
    model = spark.sparkContext.broadcast(train([(t, int(y)) for _, t, y in rows]))

    def run(batches):
        start_task()
        for b in batches:
            for i, buf, off in text_chunks(b.column("text"), 3 << 20):
                s = probabilities(model.value, buf, off)
                yield rows_out(["doc_id", "score"], [pa.int64(), pa.float64()], [b.column("doc_id").slice(i, len(s)).to_pylist(), s])

    return docs.mapInArrow(run, "doc_id long, score double")
