import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import knn, pstable, warc
from cairn.llm.common import Scratch, components, shared_dir
from tests.llm import brute

VEC = "vec_id long, embedding array<float>, label int"


def vectors(seed, n=300, dim=8):
    rng = np.random.default_rng(seed)
    rows, base = [], rng.standard_normal((12, dim))
    for i in range(n):
        v = base[i % 12] + rng.standard_normal(dim) * rng.choice([0.05, 0.2, 0.6])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 12 % 3)))
    rows += [(1000, rows[5][1], rows[5][2]), (1001, rows[5][1], rows[5][2]), (1002, rows[5][1], None), (1003, None, 1), (1004, [0.0] * dim, 1), (1005, [float("nan")] * dim, 1), (1006, [None] * dim, 1), (1007, [1.0], 1), (1008, [], 1)]
    return rows


def test_near_duplicate_vectors(spark):
    rows = vectors(1)
    df = spark.createDataFrame(rows, VEC).repartition(3).withColumn("node", F.lit("clash"))
    got = {r[0]: (r[1], r[2]) for r in pstable.near_duplicates(df, tables=40, hashes=6).collect()}
    links, n = [], {r[0]: 0 for r in rows}
    good = [(i, np.array(v, float), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    for k, (i, a, y) in enumerate(good):
        for j, b, z in good[:k]:
            if y == z and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    found = sum(x for x, _ in got.values())
    assert 0.98 * 2 * len(links) <= found <= 2 * len(links) and all(got[i][0] <= n[i] for i in n)
    r = brute.roots(list(n), links)
    assert sum(got[i][1] == r[i] for i in n) >= 0.99 * len(n)
    assert got[1002] == (0, 1002) and got[1003] == (0, 1003)


def test_near_vectors_shipped_recall(spark):
    rng = np.random.default_rng(9)
    rows, pairs = [], 0
    for i in range(600):  # pairs at cosine 0.93 to 0.95
        a, b = rng.standard_normal((2, 48))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        c = rng.uniform(0.93001, 0.95)
        rows += [(2 * i, (a * 3).tolist(), i % 4), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist(), i % 4)]
        pairs += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r[0]: (r[1], r[2]) for r in pstable.near_duplicates(df).collect()}
    assert sum(n for n, _ in got.values()) >= 0.95 * 2 * pairs
    assert all(c == i or (c == i - 1 and i % 2) for i, (_, c) in got.items())


def test_near_vectors_odd_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (None, [-1.0, 0.5], 1), (3, [-1.0, 0.51], 1), (None, [0.0, -1.0], 1)]
    got = sorted(((r[0], r[1], r[2]) for r in pstable.near_duplicates(spark.createDataFrame(rows, VEC)).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (1, 0, 1), (2, 1, 1), (None, 1, 3), (3, 1, 3), (None, 0, None)], key=repr)


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (20, [2.0, 1.0], 1), (20, [3.0, 3.0], 1), (None, [5.0, 5.0], 1), (7, [1.0], 1), (40, [4.0], 1), (8, [1e9, 1e9], 1), (60, [1e9, -1e9], 1), (9, [1e300, 1.0], 1), (80, [1e7, 3.0], 1)]
    q = lambda v: [int(np.floor(256 * float(np.float32(x) if abs(x) < 1e38 else x))) for x in v]
    df = spark.createDataFrame([(i, [float(np.float32(x)) if abs(x) < 1e38 else x for x in v], y) for i, v, y in rows], "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in knn.top_k(df, F.col("vec_id") % 20 == 0, 20).collect())
    want = []
    for i in (0, 20, 40, 60, 80):
        mine = min(q(v) for j, v, _ in rows if j == i)
        cand = []
        for j, v, _ in rows:
            if len(v) == len(mine) and j != i:
                s = sum(a * b for a, b in zip(mine, q(v), strict=True))
                cand.append((-max(-(2**63), min(2**63 - 1, s)), 2**63 if j is None else j))
        want += [(i, k + 1, None if j == 2**63 else j, -s) for k, (s, j) in enumerate(sorted(cand))]
    assert got == sorted(want)


def test_blocks_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(pstable, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(0)
    rows = [(i, [1.0 + float(rng.normal()) * 1e-3, 1.0, 0.5], 1) for i in range(40)]
    got = pstable.near_duplicates(spark.createDataFrame(rows, VEC)).collect()
    assert {(r[1], r[2]) for r in got} == {(39, 0)}


@pytest.mark.parametrize("block,group", [(4096, 1024), (16, 3)])
def test_top_k(spark, monkeypatch, block, group):
    monkeypatch.setattr(knn, "BLOCK_ROWS", block)
    monkeypatch.setattr(knn, "GROUP_ROWS", group)
    rows = vectors(2)
    df = spark.createDataFrame(rows, VEC).repartition(3).withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in knn.top_k(df, F.col("vec_id") % 20 == 0, 5).collect())
    q = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v, _ in rows if v and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all()}
    want = []
    for i in q:
        if i % 20 == 0:
            best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_nothing(spark):
    assert knn.top_k(spark.createDataFrame([], VEC), F.lit(True)).collect() == []
    assert pstable.near_duplicates(spark.createDataFrame([], VEC)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    rng.shuffle(links)
    got = {r[0]: r[1] for r in components(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.roots({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if k in got} and set(got) == {x for a, b in links if a != b for x in (a, b)}


@pytest.mark.parametrize("shape", ["ascending", "zigzag", "star"])
def test_components_rounds_are_logarithmic(spark, shape):
    n = 5000
    ids = list(range(n)) if shape != "zigzag" else [x for p in zip(range(n // 2), range(n - 1, n // 2 - 1, -1), strict=True) for x in p]
    links = [(0, k) for k in range(1, n)] if shape == "star" else list(zip(ids, ids[1:]))
    saved, scratch = [], Scratch(spark, "t")
    save = scratch.save
    scratch.save = lambda df, name: (saved.append(name), save(df, name))[1]
    got = components(scratch, spark.createDataFrame(links, "a long, b long"), finish=40)
    assert got.where("component = 0").count() == got.count() == n and got.select("node").distinct().count() == n
    assert 0 < sum("-m" in x for x in saved) <= 20


def test_warc(spark):
    rng = random.Random(1)
    big = "é" * 600
    pages = [(i, f"http://a/{i}", "".join(rng.choice("ab<>\r\n") for _ in range(rng.randint(0, 3000)))) for i in range(150)]
    pages += [(300, "u", big), (301, None, big), (302, "u\r\nX: y", big), (303, "u", "short"), (304, "u", "short"), (305, "u", None), (306, "u", ""), (None, "u", big), (302, "again", big), (307, "u", "WARC/1.1\r\n\r\n" * 400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).withColumn("to", F.lit(1))

    def write(name):
        uri = f"{shared_dir(spark)}/{name}"
        done = warc.write_warc(df if name == "a" else df.repartition(7), uri, Scratch(spark, "w"), shard_bytes=20_000, roll_bytes=3_000)
        files = sorted(map(tuple, warc.manifest(spark, uri).collect()))
        assert done["files"] == len(files) and done["records"] == len(pages) and done["bytes"] == sum(r[4] for r in files)
        return uri, files

    (uri, files), (_, again) = write("a"), write("b")
    assert files == again and len(files) > 10 and all(r[2].startswith("shard-") for r in files)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, uri).collect()), key=repr)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        revisit = i is not None and h == big and i < 302
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 302 if revisit else None))
    assert got == sorted(want, key=repr)
    empty = f"{shared_dir(spark)}/none"
    assert warc.write_warc(df.limit(0), empty, Scratch(spark, "w"))["files"] == 0 and warc.read_warc(spark, empty).collect() == []


def test_warc_shards_by_any_ids(spark):
    rng = random.Random(2)
    rows = [(i, f"u{i % 3}", "x" * rng.randint(500, 1500)) for i in range(1000)]
    odd = [(-(2**62) - 5, "u", "low"), (2**62 + 5, "u", "high"), (-(2**63), "u", "least"), (2**63 - 1, "u", "most"), (-4, "b", "same"), (-4, "a", "same"), (-4, "a", "same")]
    schema = "page_id long, url string, html string"

    def write(name, rows):
        df = spark.createDataFrame(rows, schema).repartition(5)
        done = warc.write_warc(df, f"{shared_dir(spark)}/{name}", Scratch(spark, "w"), shard_bytes=25_000)
        got = warc.read_warc(spark, f"{shared_dir(spark)}/{name}").collect()
        assert sorted(r["page_id"] for r in got) == sorted(r[0] for r in rows)
        return done["written"], sorted(map(tuple, warc.manifest(spark, f"{shared_dir(spark)}/{name}").collect()))

    rng.shuffle(rows)
    plain, one, all_odd = write("p", rows), write("o", rows + odd[1:2]), write("q", rows + odd)
    assert 35 <= plain[0] <= 60 and plain[0] <= one[0] <= plain[0] + 1 and plain[0] <= all_odd[0] <= plain[0] + 4
    again = rows + odd
    rng.shuffle(again)
    assert write("r", again) == all_odd
