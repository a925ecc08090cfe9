"""Catalog operators: every query against its SQL, and tables of cases."""

import glob
import inspect
import itertools
import os

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import labels as L
from cairn.functions import platforms as P
from cairn.functions import refs as R
from cairn.functions.template import compile_template
from cairn.operators import artifacts as A
from cairn.operators import catalog as C
from cairn.operators import graph as G
from cairn.operators import mapping as M
from cairn.plans import queries as Q
from cairn.sources import archives, lists
from cairn.streaming import tracker

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in Q.SQL:
        got = duck.execute(Q.SQL[name])
        cols = sorted(c[0] for c in got.description)
        at = [[c[0] for c in got.description].index(c) for c in cols]
        assert sorted(df.columns) == cols
        assert sorted((plain([r[c] for c in cols]) for r in rows), key=repr) == sorted((plain([r[i] for i in at]) for r in got.fetchall()), key=repr)
    else:
        assert rows


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


D = "sha256:" + "ab" * 32


@pytest.mark.parametrize("s,want", [
    ("reg.example.com/a/name", ("", "reg.example.com", "a", "name", "latest", "", True)), ("reg.example.com/name:v1", ("", "reg.example.com", "", "name", "v1", "", True)),
    (f"reg.example.com/a/b/name@{D}", ("", "reg.example.com", "a/b", "name", "", D, True)), (f"reg:5000/name:v2@{D}", ("", "reg:5000", "", "name", "v2", D, True)),
    ("reg.example.com/name@sha256:bad", ("", "reg.example.com", "", "name", "latest", "", True)), ("http://reg/name", ("http", "reg", "", "name", "latest", "", True)),
])
def test_parse(spark, s, want):
    assert tuple(value(spark, R.parse(F.lit(s)))) == want


@pytest.mark.parametrize("s", ["reg/Name", "reg/name/", "name", "reg/a:b:c", "/name"])
def test_parse_rejects(spark, s):
    assert not value(spark, R.parse(F.lit(s)))["ok"]


@pytest.mark.parametrize("text,want", [("a=1", True), ("a==2", False), ("a!=2", True), ("x!=2", True), ("a in (1, 2),b", True), ("a notin (1)", False), ("x notin (1)", True), ("!x", True), ("!a", False), ("n>4,n<6", True), ("b<3", False), ("x>1", False), ("", True)])
def test_selector(spark, text, want):
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("word"), F.lit("n"), F.lit("5"))
    assert value(spark, L.selector(text, m)) is want
    assert value(spark, L.selectors([], m)) is True and value(spark, L.selectors(["x", text], m)) is want


def test_selector_errors(spark):
    for bad in ("a<b", "= 3", "a in b"):
        with pytest.raises(ValueError):
            L.selector(bad, F.create_map())


def test_prefix_rules(spark, tmp_path):
    (tmp_path / "rules.csv").write_text("# rules\nreg.example.com/low/source1, high.example.com/one\nreg.example.com/low/source, high.example.com/two\nreg.example.com/low/sources2:v2,high.example.com/four:v3\n,high.example.com/default\n")
    rules = lists.read_rules(spark, f"{tmp_path}/rules.csv")
    refs = spark.createDataFrame([("reg.example.com/low/source1:v1",), ("reg.example.com/low/sources2:v2",), ("reg2.example.com/other",)], "ref string")
    got = {r[0]: r[1] for r in M.longest_prefix(refs, rules, "ref").collect()}
    assert got == {"reg.example.com/low/source1:v1": "high.example.com/one:v1", "reg.example.com/low/sources2:v2": "high.example.com/four:v3", "reg2.example.com/other": "high.example.com/default/reg2.example.com/other"}
    assert {r[1] for r in M.first_prefix(refs, rules, "ref").collect()} == {"high.example.com/one:v1", "high.example.com/twos2:v2"}
    assert M.all_prefix(refs, rules).count() == 4
    (tmp_path / "bad.csv").write_text("a,b,c\n")
    with pytest.raises(ValueError):
        lists.read_rules(spark, f"{tmp_path}/bad.csv")


def test_sources_list(spark, tmp_path):
    (tmp_path / "s").write_text("# comment\nb/x, k=v\n\na/y,k=w,z=1\n")
    assert [tuple(r) for r in lists.read_sources(spark, f"{tmp_path}/s").collect()] == [("a/y", {"k": "w", "z": "1"}), ("b/x", {"k": "v"})]
    assert [r[0] for r in lists.read_sources(spark, f"{tmp_path}/s", ["k=v"]).collect()] == ["b/x"]
    (tmp_path / "t").write_text("a,k=v=w\n")
    with pytest.raises(Exception, match="not a label"):
        lists.read_sources(spark, f"{tmp_path}/t").collect()


def test_requirements(spark, tmp_path):
    (tmp_path / "r.txt").write_text("--index-url https://i/simple\nA.b \\\n >= 1 # old\n# note\n-r more.txt\n")
    (tmp_path / "more.txt").write_text("c[x]===2\n")
    assert [r[0].split() for r in lists.read_requirements(spark, f"{tmp_path}/r.txt").collect()] == [["A.b", ">=", "1"], ["c[x]===2"]]


@pytest.mark.parametrize("tag,want", [("manylinux2014_x86_64", ("linux", "x86_64")), ("manylinux_2_28_aarch64", ("linux", "aarch64")), ("win32", ("windows", "x86")), ("win_amd64", ("windows", "amd64")), ("macosx_10_9_universal2", ("darwin", "universal2")), ("any", ("any", "any"))])
def test_platform_tag(spark, tag, want):
    assert tuple(value(spark, P.decode_tag(F.lit(tag)))) == want


def test_template():
    f = compile_template('{{- if hasPrefix .Ref "a/" -}}\n one/{{ trimPrefix .Ref "a/" }}\n{{ else if (and (contains .Ref "x") (not (eq .Ref "x"))) }}two/{{ index .Ann "k" }}\n{{ else }}{{ end }}\nall/{{ .Ref }}\n')
    assert f({"Ref": "a/b", "Ann": {}}) == ["one/b", "all/a/b"] and f({"Ref": "xx", "Ann": {"k": "v"}}) == ["two/v", "all/xx"] and f({"Ref": "x", "Ann": None}) == ["all/x"]


# The large fixture graph, parent to children in order (subject, config, layers; subject, manifests).
GRAPH = {
    "index1": ["manifest9", "index2", "manifest5"], "index2": ["manifest3", "manifest4"], "manifest3": ["manifest5", "blob1", "blob2", "manifest4"], "manifest4": ["blob3", "blob4"], "manifest5": ["blob5", "blob6", "blob7"],
    "manifest6": ["manifest5", "blob1", "blob8"], "manifest7": ["index1", "blob9", "blob10"], "manifest8": ["manifest7", "blob1", "blob11", "blob12"], "manifest9": ["blob1", "blob2"],
}


def graph(spark):
    return spark.createDataFrame([(p, c, i) for p, cs in GRAPH.items() for i, c in enumerate(cs)], "parent string, child string, ordinal int")


def test_fixture_graph(spark):
    e, root = graph(spark), spark.createDataFrame([("index1",)], "node string")
    order = [r[0] for r in G.write_order(e, "index1").orderBy("seq").collect()]
    assert order == ["index1", "manifest9", "blob1", "blob2", "index2", "manifest3", "manifest5", "blob5", "blob6", "blob7", "manifest4", "blob3", "blob4"]
    n = {r[0]: r[1] for r in G.path_counts(e, root).where("node like 'blob%'").groupBy("node").agg(F.sum("paths")).collect()}
    assert (n["blob1"], n["blob2"], n["blob5"]) == (2, 2, 2)
    both = e.select("parent", "child").union(spark.createDataFrame([("manifest5", "manifest6"), ("index1", "manifest7"), ("manifest7", "manifest8")], "parent string, child string"))
    assert G.closure(both, root).count() == 21


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.sampled_from([f"blob{i}" for i in range(1, 13)]), max_size=5))
def test_completeness(spark, lost):
    nodes = {x for p, cs in GRAPH.items() for x in [p, *cs]} - lost
    below = lambda m: all(c not in lost and (c not in GRAPH or below(c)) for c in GRAPH[m])
    got = {r[0] for r in G.complete(graph(spark), spark.createDataFrame([(n,) for n in nodes], "node string")).collect()}
    assert got == {m for m in GRAPH if below(m)}


def test_stream_tracker(spark, tmp_path):
    nodes = sorted({x for p, cs in GRAPH.items() for x in [p, *cs]})
    for i, part in enumerate((nodes[:12], nodes[12:])):
        spark.createDataFrame([(n,) for n in part], "node string").coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    for i in range(2):
        spark.read.parquet(f"{tmp_path}/in{i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = tracker.new_files(spark, f"{tmp_path}/in", "node string", per_batch=1)
    q = tracker.track(src, graph(spark).select("parent", "child"), f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [r["node"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(rows) == sorted(GRAPH)


def test_stages(spark):
    rows = [("a", i, k) for i, k in enumerate(["layout", "index", "blob", "index"])] + [("b", i, k) for i, k in enumerate(["index", "blob"])] + [("c", i, k) for i, k in enumerate(["layout", "blob", "layout", "index", "index", "index"])]
    got = {tuple(r) for r in tracker.stage_errors(spark.createDataFrame(rows, "archive string, seq int, kind string"), True).collect()}
    assert got == {("b", 0, "no layout"), ("c", 1, "no index"), ("c", 2, "second layout"), ("c", 5, "too many indexes")}


def test_archives(spark):
    files = spark.createDataFrame([(1, "b", bytearray(b"x")), (1, "a", bytearray(b""))], "archive int, path string, content binary")
    packed = archives.pack(files)
    assert packed.select(archives.codec(F.col("content"))).first()[0] == "gzip"
    assert sorted((r[0], bytes(r[1])) for r in archives.unpack(packed).collect()) == [("a", b""), ("b", b"x")]
    good = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    e = spark.createDataFrame([("oci-layout", bytearray(b"{}")), (f"blobs/sha256/{good}", bytearray(b"")), ("./blobs/sha256/00", bytearray(b"1"))], "path string, content binary")
    assert [tuple(r) for r in archives.layout_records(e).collect()] == [("layout", None, 2, True), ("blob", f"sha256:{good}", 0, True), ("blob", "sha256:00", 1, False)]


def test_prune(spark):
    f = spark.createDataFrame([(i, 10) for i in range(10)], "atime long, size long").repartition(3)
    assert sorted(r["atime"] for r in C.prune_plan(f, 35).where("delete").collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert C.prune_plan(f, 0).where("delete").count() == 10 and C.prune_plan(f, 1000).where("delete").count() == 0


def test_closure_has_no_end_of_its_own(spark, monkeypatch):
    for f in (G.closure, G.path_counts, G.first_paths, G.write_order, A.labelled_closure):
        assert inspect.signature(f).parameters["depth"].default is None
    assert list(itertools.islice(G.levels(None), 150))[-1] == 150 and list(G.levels(2)) == [1, 2]
    monkeypatch.setattr(G, "LONG", 1)
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    with pytest.raises(ValueError):
        G.path_counts(loop, spark.createDataFrame([("a",)], "node string"))
