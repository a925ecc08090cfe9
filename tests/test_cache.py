import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairn.functions import codecs as C
from cairn.operators import cache as K
from cairn.sources import lists

PART = "key long, name string, digest string, layer_digest string, media_type string, labels map<string,string>"


def test_codecs_round_trip(spark):
    raws = [b"", b"a" * 1000, bytes(range(256)) * 10, None]
    x = spark.createDataFrame([(r, c) for r in raws for c in ("zstd", "gzip", "", "other")], "raw binary, codec string")
    rows = x.select("raw", "codec", C.encode(F.col("raw"), F.col("codec")).alias("e"), C.decode(C.encode(F.col("raw"), F.col("codec")), F.col("codec")).alias("d")).collect()
    assert all(r["d"] == r["raw"] for r in rows)
    assert all(len(r["e"]) < 100 for r in rows if r["raw"] and len(r["raw"]) == 1000 and r["codec"] in C.LEVELS)
    m = x.where("raw is not null").select("raw", "codec", C.measured(F.col("raw"), F.col("codec")).alias("m")).select("raw", "codec", "m.*").collect()
    assert all(r["size"] == len(r["raw"]) and r["layer_size"] == len(r["layer"]) for r in m)
    assert all(r["digest"] == r["layer_digest"] for r in m if r["codec"] not in C.LEVELS)


def test_part_content(spark):
    z = spark.createDataFrame([(b"abc", "layer+zstd", "zstd"), (b"abc", "layer.tar", ""), (b"abc", "layer.raw", ""), (b"abc", "layer.tar+zstd", "zstd")], "raw binary, mt string, codec string")
    assert {bytes(r[0]) for r in z.select(C.part_content(C.encode(F.col("raw"), F.col("codec")), F.col("mt"))).collect()} == {b"abc"}
    for bad in ("layer.tar+gzip", "text/plain", None):
        one = spark.createDataFrame([(b"abc", bad)], "raw binary, mt string")
        with pytest.raises(PySparkException):
            one.select(C.part_content(F.col("raw"), F.col("mt"))).collect()


def test_what_is_archived_and_committed(spark):
    rows = [
        (1, "new", None, None, "layer+zstd", None), (1, "off", "d1", None, "layer+zstd", {"compression": "none"}), (1, "gone", "v", "l9", "layer+zstd", {}),
        (1, "there", "d2", "l1", "layer+zstd", {}), (1, "raw", "d3", "l2", "layer.raw", {}), (1, "old", "d4", "l3", "layer.tar", {}), (2, "twin", "d4", "l3", "layer.tar", {}),
    ]
    parts = spark.createDataFrame(rows, PART)
    virtual, cached = spark.createDataFrame([("v",)], "content_id string"), spark.createDataFrame([("l1",)], "digest string")
    assert sorted(r["name"] for r in K.to_archive(parts, virtual, cached).collect()) == ["new", "old", "twin"]
    got = K.to_commit(parts.where("layer_digest is not null"), virtual, cached).collect()
    assert sorted(map(tuple, got)) == [("l2", "raw"), ("l3", "old")]
    with pytest.raises(PySparkException):
        K.to_commit(parts, virtual, cached).collect()
    none = parts.limit(0)
    assert K.to_archive(none, virtual, cached).isEmpty() and K.to_commit(none, virtual, cached).isEmpty()


def test_cache_round_trip(spark):
    parts = spark.createDataFrame([(1, "a", b"text a", None, None), (2, "b", b"text b", "have", "too")], "key long, name string, content binary, digest string, layer_digest string")
    done = K.digest_parts(parts, F.lit("zstd")).withColumn("media_type", F.lit("layer+zstd"))
    rows = {r["name"]: r for r in done.collect()}
    assert rows["a"]["size"] == 6 and rows["a"]["digest"] != rows["a"]["layer_digest"]
    assert (rows["b"]["digest"], rows["b"]["layer_digest"], rows["b"]["layer"]) == ("have", "too", None)
    cache = done.where("layer is not null").select(F.col("layer_digest").alias("digest"), F.col("layer").alias("content"))
    got = {r["name"]: (r["copied"], r["content"]) for r in K.from_cache(done.drop("content"), cache).collect()}
    assert got == {"a": (True, b"text a"), "b": (False, None)}


def test_lookups_and_progress(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "digest string") for xs in (("x", "y", "x"), ("y", "z")))
    assert sorted(map(tuple, K.existence(a, b).collect())) == [("x", False), ("y", True)]
    df, seen = K.observed(spark.createDataFrame([(3,), (None,), (4,)], "size long"), "moved")
    K.dry_run(df)
    assert seen.get == {"blobs": 3, "bytes": 7}
    names = spark.createDataFrame([("b", 1), ("a", 3), ("a", 2)], "filename string, n long")
    assert sorted((r["place"], r["n"]) for r in K.by_filename(names, "n").collect()) == [(1, 2), (2, 3), (3, 1)]
    assert [r["ref"] for r in K.by_reference(spark.createDataFrame([("b", "2"), ("a", "1")], "ref string, digest string")).collect()] == ["a", "b"]


def test_batch_files(spark, tmp_path):
    (tmp_path / "list.csv").write_text("name,images\n# comment\none, reg/a:v1\ntwo,reg/b\n")
    (tmp_path / "track.csv").write_text("sync_name,artifact,digest\n0-one.tar,reg/a:v1,sha256:1\n12-two.tar, reg/b,sha256:2\n")
    (tmp_path / "bad.csv").write_text("sync_name,artifact,digest\n0-one-two.tar,a,b\n")
    assert sorted(map(tuple, lists.read_gather_list(spark, str(tmp_path / "list.csv")).collect())) == [("one", "reg/a:v1"), ("two", "reg/b")]
    assert sorted(map(tuple, lists.read_tracker(spark, str(tmp_path / "track.csv")).collect())) == [(0, "one", "reg/a:v1", "sha256:1"), (12, "two", "reg/b", "sha256:2")]
    with pytest.raises(PySparkException):
        lists.read_tracker(spark, str(tmp_path / "bad.csv")).collect()


def test_sources_of_a_run(spark):
    listed, made = spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([("b", "b@sha256:1")], "ref string, pinned string")
    assert lists.source_refs(listed).first()[:] == ("a", "a") and lists.source_refs(listed, made).first()[:] == ("b", "b@sha256:1")
    with pytest.raises(ValueError):
        lists.source_refs()


def test_local_signatures(spark, tmp_path):
    assert lists.read_signatures(spark, str(tmp_path / "none")).isEmpty()
    (tmp_path / "s" / "t").mkdir(parents=True)
    (tmp_path / "s" / "t" / "sig").write_bytes(b"x")
    assert [bytes(r["content"]) for r in lists.read_signatures(spark, str(tmp_path / "s")).collect()] == [b"x"]
