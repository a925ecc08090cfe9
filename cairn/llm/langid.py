"""Language ID by multilingual mixture inference.

Byte trigrams of lower-cased words, hashed to ``SLOTS`` slots, are counted for each language over
a sample of labelled documents (whole texts, chosen by a hash of doc_id; ``TRAIN_ROWS`` bounds the
number expected). A word's likelihood under a language is that of its trigrams. For each document
expectation-maximisation estimates the proportions of the languages among its words; the language
set is the prefix of the languages by proportion with the highest likelihood less a penalty of
``PENALTY * log(words)`` for each language. The prediction is the set's largest proportion.

Nulls and texts without a letter are ``und`` with score 0. Texts are read whole, whatever their
length. A corpus without labelled rows predicts ``und`` everywhere. Ties go to the language that
is first by code point. At most ``MAX_LANGS`` languages; more raise an error. Other columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Words, rows_out, ship, start_task, text_chunks

SLOTS = 1 << 16
TRAIN_ROWS = 6000
MAX_LANGS = 256
ROUNDS = 8
PENALTY = 2.0
SMOOTH = 0.5
UND = "und"
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def trigrams(buf: np.ndarray) -> np.ndarray:
    """Slot of the trigram around each byte; the buffer's ends count as spaces."""
    b = np.full(len(buf) + 2, 32, np.uint32)
    b[1:-1] = _FOLD[buf]
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [slots, languages]) from labelled(doc_id, text, lang)."""
    n = labelled.count()
    part = min(1.0, train_rows / max(1, n))
    sample = labelled.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) < int(part * 1_000_000 + 0.999)).select("lang", "text").repartition(8)

    def count(batches):
        start_task()
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, buf, off in text_chunks(batch.column("text")):
                slots = trigrams(buf)
                for k in range(len(off) - 1):
                    at = total.setdefault(langs[i + k], np.zeros(SLOTS, np.int64))
                    at += np.bincount(slots[off[k] : off[k + 1]], minlength=SLOTS)
                    if len(total) > MAX_LANGS:
                        raise ValueError(f"more than {MAX_LANGS} languages")
        yield rows_out(["lang", "counts"], [pa.string(), pa.binary()], [list(total), [zlib.compress(c.tobytes(), 1) for c in total.values()]])

    total: dict[str, np.ndarray] = {}
    for lang, raw in sample.mapInArrow(count, "lang string, counts binary").collect():  # languages by 8 tasks
        total[lang] = total.get(lang, 0) + np.frombuffer(zlib.decompress(raw), np.int64)
    langs = sorted(total)
    if not langs:
        return [], np.zeros((SLOTS, 0), np.float32)
    c = np.stack([total[x] for x in langs], 1) + SMOOTH
    return langs, np.log(c / c.sum(0)).astype(np.float32)


def infer(score: np.ndarray, first: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its proportion, languages in the set) of documents whose words are score[first[i]:first[i + 1]].

    Documents without words get language -1.
    """
    n_docs, n_lang = len(first) - 1, score.shape[1]
    n = np.diff(first)
    best, share, sets = np.full(n_docs, -1), np.zeros(n_docs), np.zeros(n_docs, np.int64)
    have = np.flatnonzero(n)
    if not len(have) or not n_lang:
        return best, share, sets
    at, words = first[:-1][have], n[have]
    doc = np.repeat(np.arange(len(have)), words)
    top = score.max(1, keepdims=True)
    like = np.exp(score - top)
    base = np.add.reduceat(top[:, 0].astype(float), at)

    def em(pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            r = like * pi[doc]
            r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
            pi = np.add.reduceat(r, at, axis=0) / words[:, None]
        total = np.maximum((like * pi[doc]).sum(1), 1e-30)
        return pi, base + np.add.reduceat(np.log(total).astype(float), at)

    pi, _ = em(np.full((len(have), n_lang), 1.0 / n_lang, np.float32), rounds)
    order = np.argsort(-pi, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    value = np.full(len(have), -np.inf)
    b, s, z = np.zeros(len(have), np.int64), np.zeros(len(have)), np.zeros(len(have), np.int64)
    for k in range(1, n_lang + 1):
        start = np.where(rank < k, np.maximum(pi, 1e-3), 0).astype(np.float32)
        p, ll = em(start / start.sum(1, keepdims=True), 0 if k == 1 else 3)
        ll = ll - penalty * k * np.log(words + 1.0)
        better = ll > value
        if not better.any():
            break
        value = np.where(better, ll, value)
        b, s, z = np.where(better, p.argmax(1), b), np.where(better, p.max(1), s), np.where(better, k, z)
    best[have], share[have], sets[have] = b, s, z
    return best, share, sets


def identify(docs: DataFrame, learn: Column, train_rows: int = TRAIN_ROWS, keep: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, n_langs) of every document; the rows where ``learn`` holds and lang is not null teach.

    With ``keep`` the columns of docs come before lang_pred, score and n_langs, which replace columns of the same names.
    """
    spark = docs.sparkSession
    ship(spark)
    langs, table = train(docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text"), train_rows)
    model = spark.sparkContext.broadcast(table)
    made = ["lang_pred", "score", "n_langs"]
    docs = docs.drop(*made) if keep else docs.select(F.col("doc_id").cast("long"), "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if keep or f.name == "doc_id"), "lang_pred string", "score double", "n_langs int"])
    names = [f.name for f in docs.schema if keep or f.name == "doc_id"]

    def run(batches):
        start_task()
        logp = model.value
        for batch in batches:
            letter = batch.column("letter__cairn").to_pylist()
            for i, buf, off in text_chunks(batch.column("text")):
                w = Words(buf, off)
                slots = trigrams(buf)
                cum = np.zeros((len(buf) + 1, len(langs)))
                np.cumsum(logp[slots], axis=0, out=cum[1:])
                best, share, sets = infer((cum[w.end] - cum[w.start]).astype(np.float32), w.first)
                ok = np.array(letter[i : i + len(best)]) & (best >= 0)
                pred = [langs[b] if o else UND for b, o in zip(best.tolist(), ok.tolist(), strict=True)]
                cols = [batch.column(n).slice(i, len(best)) for n in names]
                cols += [pa.array(pred, pa.string()), pa.array(np.where(ok, np.clip(share, 0, 1), 0.0)), pa.array(np.where(ok, sets, 0).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names + made)

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter__cairn")
    return docs.select(*docs.columns, letter).mapInArrow(run, schema)
