"""Operators on documents against plain versions, with odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import bpe, jaccard, langid, linededup, mix, substring, toxicity
from cairn.llm.common import Scratch
from tests.llm import brute

DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


@pytest.mark.parametrize("seed,size,num", [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_jaccard(spark, seed, size, num):
    docs = brute.corpus(seed)
    got = {r[0]: (r[1], r[2]) for r in jaccard.join(frame(spark, docs), size, num, 100, block=7).collect()}
    assert got == brute.jaccard(docs, size, num, 100)


@pytest.mark.parametrize("num", [80, 85])
def test_jaccard_signatures_miss_no_link(num):
    """Sets that link share a signature whose sketches allow it, whatever their size; empty parts included."""
    rng = np.random.default_rng(num)
    bands = jaccard.Bands(num, 100)
    for n in [*range(1, 60), *range(60, 400, 23), 1000]:
        for _ in range(20):
            one = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            gone, more = rng.integers(0, max(1, n // 6) + 1, 2)
            other = np.unique(np.concatenate([rng.permutation(one)[gone:], rng.integers(0, 2**64, more, dtype=np.uint64)]))
            both = len(np.intersect1d(one, other))
            if not len(other) or 100 * both < num * (len(one) + len(other) - both):
                continue
            low, high = sorted((one, other), key=len)
            band = int(bands.of(len(high)))
            sets = [jaccard.signatures(s, band, bands) for s in (low, high)]
            assert int(bands.of(len(low))) == band or (int(bands.of(len(low))) == band - 1 and bands.reaches_up(len(low), band - 1))
            sig, sketch = (np.concatenate(x) for x in zip(*sets, strict=True))
            node = np.concatenate([np.full(len(s[0]), i) for i, s in enumerate(sets)])
            sig, sketch, node, *same = jaccard.collapse(sig, sketch, node)
            assert len(same[0]) or len(jaccard.alike(sig, sketch, node)[0])


def test_jaccard_many_sketches_of_one_signature():
    """A signature of more sketches than are compared by shifted arrays joins what a comparison of all pairs joins."""
    rng = np.random.default_rng(5)
    some = np.uint64(0x0301030103010301)
    sketch = np.unique(rng.integers(0, 2**64, (300, jaccard.WORDS), dtype=np.uint64) & rng.integers(0, 2**64, (300, jaccard.WORDS), dtype=np.uint64) & some, axis=0)
    m = len(sketch)
    assert m > jaccard.SHIFTS
    sig, node = np.full(m, 8, np.uint64), np.arange(m)
    i, j = np.triu_indices(m, 1)
    c = jaccard.near(sketch[i], sketch[j], np.zeros(len(i), bool))
    want, got = jaccard.stars(i[c], j[c]), jaccard.stars(*jaccard.alike(sig, sketch, node))
    assert 0 < len(want[0]) < m and [x.tolist() for x in want] == [x.tolist() for x in got]


def test_jaccard_band_edges(spark):
    rng = __import__("random").Random(5)
    docs = []
    for base in (3, 6, 7, 12, 13, 20, 40, 90):  # pairs just above and below the threshold
        w = ["b%d_%d" % (base, k) for k in range(base + 3)]
        docs.append((len(docs), " ".join(w)))
        for cut in range(1, 12):
            docs.append((len(docs), " ".join(w[: max(1, len(w) - cut)])))
            v = list(w)
            v[rng.randrange(len(v))] = "x%d" % cut
            docs.append((len(docs), " ".join(v)))
    got = {r[0]: (r[1], r[2]) for r in jaccard.join(frame(spark, docs)).collect()}
    assert got == brute.jaccard(docs, 4, 85, 100)


@pytest.mark.parametrize("seed,window,reference,salt", [(1, 50, 128, 2048), (2, 10, 128, 2048), (3, 10, 3, 2), (4, 50, 2, 5)])
def test_substring(spark, seed, window, reference, salt):
    docs = brute.corpus(seed)
    df = frame(spark, docs).withColumn("row", F.lit("clash")).withColumn("m", F.lit(1))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.dedup_substrings(df, window, reference, salt).collect()}
    assert got == brute.substrings(docs, window)


@pytest.mark.parametrize("reference,salt", [(128, 2048), (2, 3)])
def test_substring_hot_passage(spark, reference, salt):
    rng = __import__("random").Random(6)
    passage = ["p%d" % k for k in range(90)]
    docs = []
    for i in range(80):  # a passage in ever other surroundings, slightly other each time
        w = list(passage)
        if i % 3:
            w[rng.randrange(90)] = "x%d" % rng.randrange(4)
        docs.append((i, " ".join(["a%d" % rng.randrange(30) for _ in range(rng.randint(0, 60))] + w + ["b%d" % rng.randrange(30) for _ in range(rng.randint(0, 60))])))
    docs += [(200, "la " * 3000), (201, "la " * 2000 + "lo " + "la " * 60), (202, "la " * 49), (203, " ".join(passage * 4))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.dedup_substrings(frame(spark, docs), 50, reference, salt).collect()}
    assert got == brute.substrings(docs, 50)


class Counted(Scratch):
    def save(self, df, name):
        out = super().save(df, name)
        self.rows = {**getattr(self, "rows", {}), name: out.count()}
        return out


def test_substring_open_windows_are_runs(spark):
    """Around a hot passage a run of windows is a row, not each window, and only what may be shared is settled one by one."""
    rng = __import__("random").Random(9)
    passage = ["p%d" % k for k in range(90)]
    docs = []
    for i in range(240):
        w = list(passage)
        if i % 4 == 0:
            w[rng.randrange(90)] = "x%d" % rng.randrange(3)
        left = ["a%d" % (k if i % 5 == 0 else rng.randrange(10**6)) for k in range(60)]
        docs.append((i, " ".join(left + w + ["b%d" % (rng.randrange(3) if i % 7 == 0 else rng.randrange(10**6)) for _ in range(60)])))
    scratch = Counted(spark, "counted")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.dedup_substrings(frame(spark, docs), reference=16, scratch=scratch).collect()}
    assert got == brute.substrings(docs, 50)
    assert scratch.rows["found"] < 4000 and 0 < scratch.rows["single"] < 1000


def test_substring_repeated_ids(spark):
    w, u, v = (" ".join("%s%d" % (c, k) for k in range(60)) for c in "wuv")
    rows = [(1, w), (7, w), (7, u), (7, u), (8, u + " " + w), (9, v), (9, v), (9, v + "  "), (None, w), (None, v)]
    got = sorted((r["doc_id"] or 0, r["kept"][:2], r["n_removed"]) for r in substring.dedup_substrings(frame(spark, rows)).collect())
    assert got == sorted([(1, "w0", 0), (7, "", 60), (7, "u0", 0), (7, "u0", 0), (8, "", 120), (9, "v0", 0), (9, "v0", 0), (9, "v0", 0), (0, "w0", 0), (0, "v0", 0)])


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_lines(spark, n):
    rng = __import__("random").Random(n)
    docs = [(i, "\n".join(rng.choice("abc ") for _ in range(rng.randint(1, 14)))) for i in range(60)] + [(90, None), (91, ""), (92, "\n\n\n\n\n\n"), (93, "x" * 50_000)]
    df = frame(spark, docs).withColumn("n_lines", F.lit("clash")).withColumn("runs", F.lit(1))
    out = linededup.dedup_lines(df, n)
    assert out.columns == ["doc_id", "text", "runs", "n_lines", "n_removed"]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()}
    assert got == brute.line_runs(docs, n)


def test_lines_of_long_runs(spark):
    rng = __import__("random").Random(1)
    run = ["r%d" % k for k in range(45)]
    docs = []
    for i in range(40):
        n = rng.choice([2, 3, 5, 40])
        k = rng.randrange(45 - n + 1)
        docs.append((i, "\n".join(["a%d" % rng.randrange(999) for _ in range(rng.randint(0, 9))] + run[k : k + n] + ["b%d" % rng.randrange(999) for _ in range(rng.randint(0, 9))])))
    docs += [(50, "\n" * 300), (51, "\n" * 500)]
    for n in (2, 3):
        got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linededup.dedup_lines(frame(spark, docs), n).collect()}
        assert got == brute.line_runs(docs, n)


def test_lines_of_repeated_ids(spark):
    long, short = "\n".join("l%d" % k for k in range(48)), "x\ny"
    rows = [(5, long), (5, short), (6, long), (7, short), (7, short), (None, short), (None, long), (8, "q\nr"), (8, "q\nr"), (9, "z\n" + short + "\nz")]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in linededup.dedup_lines(frame(spark, rows)).collect()), key=repr)
    want = [(5, 48, 0, long), (5, 2, 0, short), (6, 48, 48, ""), (7, 2, 2, ""), (7, 2, 2, ""), (None, 2, 0, short), (None, 48, 0, long), (8, 2, 0, "q\nr"), (8, 2, 0, "q\nr"), (9, 4, 2, "z\nz")]
    assert got == sorted(want, key=repr)


def test_mix(spark):
    rng = __import__("random").Random(1)
    docs = [(i, "w " * rng.choice([0, 1, 3, 40, 300]), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(800)] + [(900, None, "z"), (901, "v " * 5000, "b")]
    df = frame(spark, docs, DOCS + ", source string").withColumn("size", F.lit("clash"))
    a, b = ({r["doc_id"]: r for r in mix.mix(d, shard_tokens=2000).collect()} for d in (df, df.repartition(5)))
    assert a == b and len(a) == len(docs)
    sources = sorted({d[2] for d in docs}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len(brute.words(t)) for _, t, x in docs if x == s) for s in sources}
    want = dict(zip(sources, mix.targets([sizes[s] for s in sources], [(3, 1, 2)[i % 3] for i in range(len(sources))]), strict=True))
    total = sum(sizes.values())
    assert sum(want.values()) == pytest.approx(min(1.5 * total, 2 * total))
    for s in sources:
        rows = [r for r in a.values() if r["source"] == s]
        assert all(0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[s] for r in rows)
        assert all(r["target"] == pytest.approx(want[s]) for r in rows)
        assert sum(r["taken"] for r in rows) == round(want[s])


@pytest.mark.parametrize("total,seed", [(4 * 10**8, 1), (2 * 10**9, 2), (3 * 10**5, 3), (4 * 10**7, 4)])
def test_mix_plan_at_any_block_size(total, seed):
    rng = __import__("random").Random(seed)
    parts = [rng.random() ** 6 for _ in range(11)]
    rows = [("s%02d" % i, k, int(total * p / sum(parts) / n * rng.uniform(0.5, 1.5))) for i, p in enumerate(parts) for n in [max(1, int(p / sum(parts) * total) // 65536)] for k in range(n)]
    rows += [("tiny", 0, 7), (None, 0, 3), ("none", 0, 0)]
    size = {s: sum(n for x, _, n in rows if x == s) for s in {r[0] for r in rows}}
    planned, block = mix.plan(rows, sum(size.values()), 1.5, 2.0, (3, 1, 2))
    line, sizes = {s: 0 for s in size}, {(s, k): n for s, k, n in rows}
    goals = {}
    for s, k, source_size, goal, off, first, head, nb, every, more, mult, add, trims in planned:
        n, goals[s] = sizes[s, k], goal
        assert source_size == size[s] and nb == -(-(off + n) // block) - first
        line[s] += max(0, min(off + n, first * block) - off) * head
        for b in range(first, first + nb):  # block by block
            times = every + (((b - first) * mult + add) % nb < more)
            assert 0 <= times <= 2
            line[s] += (min(off + n, (b + 1) * block) - b * block) * times
        line[s] += sum(d * max(0, min(off + n, hi) - max(off, lo)) for lo, hi, d in trims)
    assert {s: round(g) for s, g in goals.items()} == line


def test_mix_repeated_rows(spark):
    rows = [(1, "a b c", "x")] * 3 + [(2, "d", None), (2, None, "x")]
    got = mix.mix(frame(spark, rows, DOCS + ", source string")).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"]) for r in got) == [(1, 3, 9), (1, 3, 9), (1, 3, 9), (2, 0, 9), (2, 1, 1)]


def test_sainte_lague_is_highest_quotients():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(50):
        w, caps, seats = rng.integers(0, 40, 7).astype(float), rng.integers(0, 30, 7), int(rng.integers(0, 80))
        got, left = np.zeros(7, int), seats
        while left and ((got < caps) & (w > 0)).any():
            q = np.where((got < caps) & (w > 0), w / (2 * got + 1), -1)
            got[int(np.argmax(q))] += 1
            left -= 1
        assert mix.sainte_lague(seats, w, caps).sum() == got.sum()
        q = lambda s: sorted(w[i] / (2 * k + 1) for i in range(7) for k in range(s[i]))
        assert q(mix.sainte_lague(seats, w, caps)) == pytest.approx(q(got))


def test_bpe(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    rng = __import__("random").Random(2)
    alpha = "aaaabcde hello  \n\t'sré0129漢🙂​<|endoftext|>\x1c\x85"
    texts = ["", None, "a" * 3000, "<|endoftext|>", "x<|endoftext|> y", " \n "] + ["".join(rng.choice(alpha) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    tok = Tokenizer.from_file(path)
    for r in bpe.bpe(frame(spark, list(enumerate(texts))), path).collect():
        want = tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        got = memoryview(bytes(r["ids"])).cast("I").tolist()
        assert got == want and r["n_tokens"] == len(want) and r["decoded"] == tok.decode(want, skip_special_tokens=False)


def lang_rows():
    rng = __import__("random").Random(4)
    parts = {"en": ["the", "of", "tion", "ing", "and"], "de": ["der", "ung", "sch", "ein", "keit"], "fr": ["eau", "que", "les", "ment", "oui"]}
    return [(i, " ".join("".join(rng.choice(parts[g]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 60))), g) for i in range(300) for g in [rng.choice(list(parts))]], parts


def test_language(spark):
    rows, _ = lang_rows()
    odd = [(900, None, "en"), (901, "", None), (902, "123 &&& ...", "en"), (903, "x", None)]
    df = frame(spark, rows + odd, DOCS + ", lang string").withColumn("score", F.lit("clash"))
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    got = {r["doc_id"]: r for r in langid.identify(df, learn).collect()}
    held = [(i, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 40 and sum(got[i]["lang_pred"] == g for i, g in held) >= 0.95 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] in ("en", "de", "fr")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.identify(df, learn, keep=True)
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "score", "n_langs"] and kept.count() == len(rows) + 4
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string")), learn).collect()} == {"und"}


def test_mixture_of_two_languages():
    import numpy as np

    score = np.array([[0.0, -9, -20]] * 30 + [[-9.0, 0, -20]] * 20, np.float32)
    best, share, n = langid.infer(score, np.array([0, 50, 50]))
    assert best.tolist() == [0, -1] and n[0] == 2 and share[0] == pytest.approx(0.6, abs=0.02)


def test_toxicity(spark):
    rng = __import__("random").Random(6)
    docs, labels = [], []
    for i in range(500):
        w = ["".join(rng.choice("aeioubdg") for _ in range(4)) for _ in range(rng.randint(3, 150))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "Moron,", "scum"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    odd = [(900, None), (901, ""), (902, " "), (903, "word " * 30_000), (904, "word " * 20_000 + "idiot scum " + "word " * 20_000)]
    lab = spark.createDataFrame([x for x in labels if x[0] % 5] + [(5000, None), (5001, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(frame(spark, docs + odd), lab).collect()}
    held = [x for x in labels if x[0] % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(y) for i, y in held) >= 0.95 * len(held)
    assert got[900] == got[901] == got[902] < 0.5 and got[903] < 0.5 < got[904]
    assert {r["score"] for r in toxicity.score_toxicity(frame(spark, docs), lab.where("toxic = 0")).collect()} == {0.0}


def test_toxicity_gradients():
    import numpy as np

    rows = [("a b c d e f g idiot", 1), ("k l m n", 0)] * 3
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    raw = np.frombuffer(rows[0][0].encode(), np.uint8)
    w, of, word, chars = toxicity.features(raw, np.array([0, len(raw)]))
    o = {"w": np.zeros(toxicity.WORD_SLOTS), "support": np.zeros(toxicity.WORD_SLOTS), "c": np.zeros(toxicity.CHAR_SLOTS)}
    idx = toxicity.windows(of, w.first)[0]

    def logit(keep=False):
        x = np.asarray(net.inputs(word, chars, o), np.float64)
        xf, xb = net.project(x)
        return x, net.forward(xf, xb, idx, keep)

    x, (_, kept) = logit(True)
    g = net.backward(kept, np.ones(1), idx, x, word, chars)
    for name in ("Uf", "Ub", "Wf", "Wb", "bf", "A", "a", "o"):
        at = tuple(0 for _ in net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = logit()[1][0]
        net.p[name][at] = old - 1e-3
        down = logit()[1][0]
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-3), name


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS + ", source string, lang string")
    assert jaccard.join(none).collect() == [] and substring.dedup_substrings(none).collect() == []
    assert linededup.dedup_lines(none).collect() == [] and mix.mix(none).collect() == []
    assert langid.identify(none, F.lit(True)).collect() == []
    assert toxicity.score_toxicity(none, spark.createDataFrame([], "doc_id long, toxic int")).collect() == []


def test_toxicity_reads_long_words_whole():
    import numpy as np

    rng = __import__("random").Random(8)
    rows = []
    for i in range(500):
        w = ["".join(rng.choice("aeioubdg") for _ in range(4)) for _ in range(rng.randint(20, 120))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = [rng.choice(["idiot", "moron", "scum"]) for _ in range(3)]
        rows.append(("-".join(w), int(i % 3 == 0)))
    raw = [t.encode() for t, _ in rows[400:]]
    off = np.cumsum([0, *map(len, raw)])
    model = toxicity.train(rows[:400])
    got = toxicity.probabilities(model, np.frombuffer(b"".join(raw), np.uint8), off)
    assert sum((p >= 0.5) == bool(y) for p, (_, y) in zip(got, rows[400:], strict=True)) >= 95
    alone = [toxicity.probabilities(model, np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0] for r in raw]
    assert alone == pytest.approx(got.tolist(), abs=1e-5)
