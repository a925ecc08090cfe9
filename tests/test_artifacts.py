"""Names, documents, mirror runs, reports and histories on odd rows; graph walks on deep and cyclic graphs."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairn.functions import names as N
from cairn.operators import bottle as B
from cairn.operators import gitsync as S
from cairn.operators import graph as G
from cairn.operators import mirror as M
from cairn.operators import reports as T


def chain(spark, n):
    return spark.range(n).select(F.concat(F.lit("m"), "id").alias("parent"), F.concat(F.lit("m"), (F.col("id") + 1).cast("string")).alias("child"))


def test_walks_of_deep_chains(spark):
    n = 105  # deeper than a hundred levels, where walks once stopped
    e, root = chain(spark, n), spark.createDataFrame([("m0",)], "node string")
    assert G.closure(e, root).agg(F.count("*"), F.max("level")).first() == (n + 1, n)
    arrived = e.select(F.col("parent").alias("node"))  # all but the last
    assert G.complete(e, arrived).count() == 0


def test_walks_of_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    assert sorted(r[0] for r in G.closure(e, spark.createDataFrame([("b",)], "node string")).collect()) == ["a", "b", "c", "d"]
    sizes = spark.createDataFrame([(x, k) for x, k in zip("abcd", (1, 10, 100, 1000), strict=True)], "node string, size long")
    assert [tuple(r) for r in G.subdag_size(e, spark.createDataFrame([("b",)], "node string"), sizes).collect()] == [("b", 10 + 100 + 1 + 1000 + 10)]


def test_urls_resolve(spark):
    base = "https://h.example.com/a/b/c?x=1"
    cases = {"d": "/a/b/d", "./d": "/a/b/d", "../d": "/a/d", "../../../d": "/d", "/z?q": "/z?q", "..": "/a/", ".": "/a/b/", "": "/a/b/c", "d/../e#frag": "/a/b/e"}
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in cases], "r string").select("r", N.resolve_url(F.lit(base), F.col("r"))).collect()}
    assert got == {k: "https://h.example.com" + v for k, v in cases.items()}


def test_document_edits(spark):
    row = spark.range(1)
    author = F.struct(F.lit("x").alias("name"), F.lit("b@x").alias("email"))
    two = F.array(F.struct(F.lit("ann").alias("name"), F.lit("a@x").alias("email")), F.struct(F.lit("bob").alias("name"), F.lit("b@x").alias("email")))
    assert [a["name"] for a in row.select(B.put_author(two, author)).first()[0]] == ["ann", "x"]
    labels = F.create_map(F.lit("k"), F.lit("v"))
    with pytest.raises(PySparkException):
        row.select(B.drop_label(labels, F.lit("none"))).collect()
    assert row.select(B.drop_label(labels, F.lit("k"))).first()[0] == {}


def test_parts_keep_what_a_change_does_not_bring(spark):
    schema = "key int, name string, size long, digest string, layer_size long, layer_digest string, labels map<string,string>, media_type string"
    old = spark.createDataFrame([(1, "a", 5, "d", 4, "l", {"k": "v"}, "tar"), (1, "b", 5, "d", 4, "l", {}, "tar")], schema)
    new = spark.createDataFrame([(1, "a", 6, "", 0, "", None, ""), (1, "b", 7, "e", 9, "m", {"k": "w"}, "raw"), (2, "c", 1, "", 0, "", {}, "x")], schema)
    got = {r["name"]: tuple(r)[2:] for r in B.update_parts(old, new).collect()}
    assert got == {"a": (6, "", 0, "", {"k": "v"}, "tar"), "b": (7, "e", 9, "m", {"k": "w"}, "raw"), "c": (1, "", 0, "", {}, "x")}


def test_gather_index_round_trip(spark):
    rows = [("k", "b/x", "sha256:2", 5, "m"), ("k", None, "sha256:3", 7, "m"), ("k", "a/x", "sha256:1", 9, "m"), ("k", "a/x", "sha256:1", 9, "m")]
    made = M.gather_index(spark.createDataFrame(rows, "key string, ref string, digest string, size long, media_type string"), "v1")
    x = made.select(M.read_index(F.col("index")).alias("i")).first()["i"]
    assert [m["digest"] for m in x["manifests"]] == ["sha256:1", "sha256:2", "sha256:3"] and x["annotations"]["bytes"] == "21"
    assert [r["pinned"] for r in M.gathered(made).collect()] == ["a/x@sha256:1", "b/x@sha256:2", "sha256:3"]
    assert spark.range(1).select(M.read_index(F.lit("no json"))["manifests"]).first()[0] is None


def test_mapper_of_a_kind():
    assert M.map_by("nest=low", nest=lambda a: a + "!") == "low!"
    with pytest.raises(ValueError):
        M.map_by("other=1", nest=str)


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "n int, s string")
    assert [r[0] for r in T.csv_lines(rows, ["n", "s"]).collect()] == ['1,"a ""b"", c"', "2,"]
    for method in ("json", "csv", "table", "markdown"):
        T.write_report(rows, ["n", "s"], f"{method}={tmp_path}/{method}")
        assert spark.read.text(f"{tmp_path}/{method}").count() == 2
    with pytest.raises(ValueError):
        T.write_report(rows, ["n"], "xml=nowhere")


def test_no_signature_is_not_verified(spark):
    import base64

    ok = base64.b64encode(b'{"targetArtifact": {"digest": "sha256:a"}}').decode()
    rows = [("sha256:a", "s1", ok), ("sha256:a", "s2", "bad"), ("sha256:b", None, None)]
    got = {r["subject"]: (r["verified"], r["good"], r["failed"]) for r in T.verified(spark.createDataFrame(rows, "subject string, signature string, payload string")).collect()}
    assert got == {"sha256:a": (False, ["s1"], ["s2"]), "sha256:b": (False, [], [])}


def test_histories(spark):
    e = spark.createDataFrame([("c3", "c2"), ("c2", "c1"), ("d3", "c2"), ("c1", "c0")], "parent string, child string")
    node = lambda *x: spark.createDataFrame([(i,) for i in x], "node string")
    generation = spark.createDataFrame([("c0", 0), ("c1", 1), ("c2", 2), ("c3", 3), ("d3", 3)], "node string, generation long")
    assert S.merge_base(e, node("c3"), node("d3"), generation).first()[0] == "c2"
    assert sorted(r[0] for r in S.thin_bundle(e, node("c3"), node("c1")).collect()) == ["c2", "c3"]
    layers = spark.createDataFrame([("r", 0, "x"), ("r", 1, "y"), ("r", 2, "x"), ("s", 0, "x")], "repo string, idx long, commit string")
    assert sorted(r["idx"] for r in S.uncached_bundles(layers, spark.createDataFrame([("x",)], "commit string")).collect()) == [1, 2]
