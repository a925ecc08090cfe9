"""The pipeline, stage by stage, against plain versions."""

import pytest
from pyspark.sql import functions as F

from tests.llm import brute


def test_pipeline(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline as P

    rows = [(i, t, None if i % 7 == 0 else "en", f"src{i % 3}", len(t or "")) for i, t in brute.corpus(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "bpe" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs.collect(), spark.read.parquet(f"{tmp_path}/{name}").collect())
        docs = spark.read.parquet(f"{tmp_path}/{name}")

    before, after = seen["language_id"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
    assert all(r["lang"] == "en" for r in after)
    before, after = seen["line_dedup"]
    want = brute.line_runs([(r["doc_id"], r["text"]) for r in before], 2)
    assert {r["doc_id"]: r["text"] for r in after} == {i: t for i, (t, n, gone) in want.items() if gone < n}
    before, after = seen["near_duplicates"]
    want = brute.jaccard([(r["doc_id"], r["text"]) for r in before], 5, 80, 100)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, c) in want.items() if c == i)
    before, after = seen["mixing"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and max(map([r["doc_id"] for r in after].count, {r["doc_id"] for r in after})) <= 2
    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    before, after = seen["bpe"]
    text = {r["doc_id"]: r["text"] for r in before}
    assert len(before) == len(after)
    assert all(memoryview(bytes(r["ids"])).cast("I").tolist() == tok.encode(text[r["doc_id"]], add_special_tokens=False).ids for r in after)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in P.run(spark, str(tmp_path)).collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in after)


def test_mixing_keeps_the_target_of_a_hot_source(spark):
    import corpus_pipeline as P
    from cairn.llm import mix

    rng = __import__("random").Random(4)
    docs = [(i, "w " * rng.randint(20, 200), f"s{1 if rng.random() < 0.23 else rng.randrange(12):02d}") for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    words, sources = {i: len(brute.words(t)) for i, t, _ in docs}, sorted({s for _, _, s in docs})
    sizes = {s: sum(words[i] for i, _, x in docs if x == s) for s in sources}
    want = dict(zip(sources, mix.targets(list(sizes.values()), [(3, 1, 2)[i % 3] for i in range(12)]), strict=True))
    assert want["s01"] < 0.5 * sizes["s01"]
    got = [r["doc_id"] for r in P.mixing(spark, df, "").collect()]
    assert got and max(map(got.count, set(got))) <= 2
    for s in sources:
        assert abs(sum(words[i] for i in got if docs[i][2] == s) - want[s]) <= 400, s


def test_near_duplicates_of_repeated_ids(spark):
    import corpus_pipeline as P

    w, v, u = (" ".join("%s%d" % (c, k) for k in range(40)) for c in "wvu")
    rows = [(1, w), (2, w + " x"), (5, v), (5, v), (5, u), (6, u), (5, v + " y"), (7, None), (8, ""), (None, w), (7, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("grp", F.lit("own"))
    got = sorted(((r["doc_id"], r["text"], r["grp"]) for r in P.near_duplicates(spark, docs, "").collect()), key=repr)
    five = [r for r in got if r[0] == 5]
    assert [r for r in got if r[0] != 5] == sorted([(1, w, "own"), (7, None, "own"), (7, " ", "own"), (8, "", "own"), (None, w, "own")], key=repr)
    assert len(five) == 2 and sum(r[1] == u for r in five) == 1


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score int, n_lines string, n_removed string, times string"
    none = spark.createDataFrame([], schema)
    own = spark.createDataFrame([(1, "some words here\nand more", "en", "s", 20, "own", 7, "a", "b", "c"), (2, "other text", None, None, 9, "own", 7, "a", "b", "c")], schema)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, none, "")
        assert out.columns == none.columns and out.collect() == [], name
        for r in stage(spark, own, "").collect():
            assert (r["lang_pred"], r["score"], r["n_lines"], r["n_removed"], r["times"]) == ("own", 7, "a", "b", "c"), name
