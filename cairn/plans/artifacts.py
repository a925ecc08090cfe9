"""Queries of names, documents, mirror runs, reports and histories, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import names as N
from cairn.functions import platforms as P
from cairn.functions import refs as R
from cairn.operators import bottle as B
from cairn.operators import gitsync as S
from cairn.operators import graph as G
from cairn.operators import mirror as M
from cairn.operators import reports as T
from cairn.plans import catalog as V
from cairn.plans.queries import query
from cairn.sources.lists import parse_oid_refs


def docs(spark, d):
    return V.read(spark, d, "documents")


def sql_list(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


# ---------------------------------------------------------------- names


@query(f"""with {V.REFS}, a as (select doc_id, regexp_replace(s, '^(http|https|bottle|hash):(//)?', '') as rest from refs),
    b as (select doc_id, split_part(rest, '/', 1) as reg, regexp_replace(rest, '^[^/]*/', '') as path from a),
    c as (select *, split_part(path, '@', 1) as head, case when contains(path, '@') then regexp_replace(path, '^[^@]*@', '') else '' end as dig from b),
    e as (select *, case when dig similar to '[a-z0-9]+:[0-9a-f]{{32,}}' then dig else '' end as digest from c)
    select doc_id, reg, split_part(head, ':', 1) as repo, split_part(head, ':', 1) as name, case when contains(head, ':') then regexp_replace(head, '^[^:]*:', '') when digest <> '' then '' else 'latest' end as tag, digest from e""")
def fn02_lenient_repo(spark, d):
    return V.refs(spark, d).select("doc_id", N.lenient_repo(F.col("s")).alias("r")).select("doc_id", "r.*")


@query("""with s as (select doc_id, sha256(text) as h from documents where text is not null) select doc_id, case doc_id % 3 when 0 then 'bottle' when 1 then 'hash' end as scheme,
    case doc_id % 3 when 0 then 'sha256:' || h when 1 then 'sha256:' || h end as digest, case doc_id % 3 when 0 then '' when 1 then 'q=' || doc_id end as query,
    case doc_id % 3 when 0 then 'a,b=' || doc_id when 1 then '' end as selectors from s""")
def fn05_bottle_uri(spark, d):
    i = F.col("doc_id")
    x = docs(spark, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    s = F.when(i % 3 == 0, F.concat(F.lit("bottle:sha256:"), "h", F.lit("#a|b="), i.cast("string"))).when(i % 3 == 1, F.concat(F.lit("hash://sha256/"), "h", F.lit("?q="), i.cast("string"))).otherwise("bottle:none#x")
    return x.select("doc_id", N.bottle_uri(s).alias("u")).select("doc_id", "u.scheme", "u.digest", "u.query", F.array_join("u.selectors", ",").alias("selectors"))


@query("""with s as (select doc_id, source, lang, sha256(text) as h from documents where text is not null) select doc_id, 'reg.example.com' as registry, 'low/' || source as repository,
    case when doc_id % 2 = 0 then lang else 'sha256:' || h end as tag, 'low/' || source || case when doc_id % 2 = 0 then ':' || lang else '@sha256:' || h end as package,
    'out/reg.example.com/low/' || source || '/' || case when doc_id % 2 = 0 then lang else 'sha256:' || h end || '/linux/arm' || case when doc_id % 5 = 0 then '-v7' else '' end || '/sbom.json' as path,
    'linux/arm' || case when doc_id % 5 = 0 then '/v7' else '' end as platform from s where lang is not null and source is not null""")
def fn08_template_parts(spark, d):
    i = F.col("doc_id")
    x = docs(spark, d).where("text is not null and lang is not null and source is not null")
    ref = F.concat(F.lit("reg.example.com/low/"), "source", F.when(i % 2 == 0, F.concat(F.lit(":"), "lang")).otherwise(F.concat(F.lit("@sha256:"), F.sha2("text", 256))))
    x = x.select("doc_id", ref.alias("ref"), F.when(i % 5 == 0, "v7").otherwise("").alias("variant"), F.lit("linux").alias("os"), F.lit("arm").alias("arch"))
    r, parts = F.col("ref"), (F.col("os"), F.col("arch"), F.col("variant"))
    return x.select("doc_id", N.registry_of(r).alias("registry"), N.repository_of(r).alias("repository"), N.tag_of(r).alias("tag"), N.package_of(r).alias("package"), N.sbom_path("out", r, *parts).alias("path"), N.platform_path(*parts).alias("platform"))


@query("""select p_partkey, case when n like '%.whl' then 'applications/vnd.act3-ace.python.bdist.wheel+zip' when n like '%.tar.gz' then 'applications/vnd.act3-ace.python.sdist.tar+gzip' when n like '%.egg' then 'applications/vnd.act3-ace.python.bdist.egg+zip' else 'applications/vnd.act3-ace.python.unknown' end as media_type
    from (select p_partkey, 'pkg-1' || (['.whl', '.tar.gz', '.egg', '.zip'])[p_partkey % 4 + 1] as n from part)""")
def fn25_dist_media_type(spark, d):
    ext = F.element_at(F.array(*map(F.lit, (".whl", ".tar.gz", ".egg", ".zip"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return V.read(spark, d, "part").select("p_partkey", N.dist_media_type(F.concat(F.lit("pkg-1"), ext)).alias("media_type"))


@query("""with r as (select p_partkey as k, sha256(p_name) as a, sha256(p_brand) as b from part)
    select k as p_partkey, 'pkg-' || k || case when k % 2 = 0 then '[x,y]' else '' end || '>=' || (k % 7) || '.0' || ' ; ' || case when k % 3 = 0 then 'python_version < "3"' else '' end
    || ' \\' || chr(10) || chr(9) || '--hash=sha256:' || least(a, b) || case when a <> b then ' \\' || chr(10) || chr(9) || '--hash=sha256:' || greatest(a, b) else '' end as line,
    case when k % 2 = 0 then 'pkg-' || k || ',pkg-' || k || '[x],pkg-' || k || '[y]' else 'pkg-' || k end as wanted from r""")
def fn27_requirement_text(spark, d):
    k = F.col("p_partkey")
    line = F.concat(F.lit("Pkg_"), k.cast("string"), F.when(k % 2 == 0, "[x, y]").otherwise(""), F.lit(" >="), (k % 7).cast("string"), F.lit(".0"), F.when(k % 3 == 0, '; python_version < "3"').otherwise(""), F.lit(" --hash=sha256:"), F.sha2("p_name", 256), F.lit(" --hash=sha256:"), F.sha2("p_brand", 256))
    x = V.read(spark, d, "part").select(k, P.parse_requirement(line).alias("r"))
    return x.select("p_partkey", N.requirement_text(F.col("r")).alias("line"), F.array_join(N.with_extras(F.col("r.name"), F.col("r.extras")), ",").alias("wanted"))


@query("""with p as (select page_id as i, sha256(url) as h from pages) select i as page_id, case i % 6 when 0 then 'https://idx.example.com/files/f' || i || '.whl' when 1 then 'https://idx.example.com/abs/f.whl?x=1' when 2 then 'https://other.example.com/y.whl'
    when 3 then 'https://idx.example.com/simple/p/rel.whl' when 4 then 'https://cdn.example.com/z' else 'https://idx.example.com/simple/' end as url, case when i % 6 in (0, 3) then 'sha256:' || h else '' end as digest,
    case i % 6 when 0 then 'https://idx.example.com/files/f' || i || '.whl.metadata' when 3 then 'https://idx.example.com/simple/p/rel.whl.metadata' else '' end as metadata from p""")
def fn29_resolve_url(spark, d):
    i, h = F.col("page_id"), F.sha2("url", 256)
    href = F.when(i % 6 == 0, F.concat(F.lit("../../files/f"), i.cast("string"), F.lit(".whl#sha256="), h)).when(i % 6 == 1, "/abs/./f.whl?x=1#md5=zz").when(i % 6 == 2, "https://other.example.com/y.whl").when(i % 6 == 3, F.concat(F.lit("./rel.whl#sha256="), h)).when(i % 6 == 4, "//cdn.example.com/z").otherwise("..")
    x = V.read(spark, d, "pages").select("page_id", N.resolve_url(F.lit("https://idx.example.com/simple/p/"), href).alias("url"), N.fragment_digest(href).alias("digest"))
    return x.withColumn("metadata", N.metadata_url(F.col("url"), F.col("digest")))


@query("""select c_custkey, printf('%06d-', c_custkey) || case when c_custkey % 3 = 0 then 'a-b' else 'set' end || '.tar' as file, case when c_custkey % 3 > 0 then c_custkey end as number, case when c_custkey % 3 > 0 then 'set' end as name from customer""")
def fn32_sync_names(spark, d):
    k = F.col("c_custkey")
    x = V.read(spark, d, "customer").select(k, N.sync_name(k, F.when(k % 3 == 0, "a-b").otherwise("set"), ".tar").alias("file"))
    return x.withColumn("p", N.parse_sync_name(F.col("file"), ".tar")).select("c_custkey", "file", "p.number", "p.name")


@query("""select sha256(text) as oid, (['tags', 'heads', ''])[turn % 3 + 1] as kind, case when turn % 3 = 2 then 'refs/notes/' else '' end || 'v' || conv_id as name from conversations where text is not null""")
def fn33_git_refs(spark, d):
    t = F.col("turn").cast("int") % 3
    line = F.concat(F.sha2("text", 256), F.lit(" refs/"), F.when(t == 0, "tags").when(t == 1, "heads").otherwise("notes"), F.lit("/v"), F.col("conv_id").cast("string"))
    return parse_oid_refs(V.read(spark, d, "conversations").where("text is not null").select(line.alias("value")))


KINDS = [*P.INDEX_TYPES[:1], *P.IMAGE_TYPES[:1], *N.SBOM_TYPES, "application/x-tar+zstd", "text/plain"]


@query(f"""with p as (select p_partkey as k, ([{sql_list(KINDS)}])[p_partkey % 6 + 1] as m, (['low', 'Normal', '', 'MEDIUM', 'max', 'Maximum', 'other'])[p_partkey % 7 + 1] as l, (['Critical', 'HIGH', 'medium', 'low', 'Unknown', 'none'])[p_partkey % 6 + 1] as s, p_name from part)
    select k as p_partkey, case k % 6 when 0 then 'index' when 1 then 'image' else 'blob' end as kind, k % 6 in (2, 3) as sbom, case lower(l) when 'low' then 'fastest' when 'medium' then 'better' when 'max' then 'best' when 'maximum' then 'best' else 'default' end as level,
    case when k % 2 = 0 then m when m like '%tar%' then 'tar' else 'plain' end as stored, case when k % 6 < 5 then chr(27) || '[' || (['1;31', '31', '33', '34', '90'])[k % 6 + 1] || 'm' || s || chr(27) || '[0m' else s end as coloured,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') as title, to_base64(p_name::blob) as payload, k % 5 > 0 as portable from p""")
def fn42_classes(spark, d):
    k = F.col("p_partkey")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    m = pick(KINDS)
    return V.read(spark, d, "part").select(
        k, P.media_kind(m).alias("kind"), N.is_sbom(m).alias("sbom"), N.codec_level(pick(["low", "Normal", "", "MEDIUM", "max", "Maximum", "other"])).alias("level"), N.stored_media_type(m, k % 2 == 0, "plain", "tar").alias("stored"),
        N.coloured(pick(["Critical", "HIGH", "medium", "low", "Unknown", "none"])).alias("coloured"), F.initcap("p_name").alias("title"), F.base64(F.encode("p_name", "utf-8")).alias("payload"), N.portable_path(pick(["../x", "a/b.txt", "c-1/d_2", "e", "f/g"])).alias("portable"))


@query(f"""with {V.PARSED} select doc_id, case when reg = 'docker.io' then 'https://mirror.example.com' else 'https://' || reg end as endpoint, scheme = 'http' as insecure, reg = '' as empty from parsed where reg is not null""")
def fn10_endpoints(spark, d):
    r = V.refs(spark, d).select("doc_id", R.parse(F.col("s")).alias("r"))
    return r.select("doc_id", R.resolve_endpoint(F.col("r.reg"), {"docker.io": ["https://mirror.example.com"]}).alias("endpoint"), R.is_insecure(F.col("r")).alias("insecure"), R.is_empty(F.col("r")).alias("empty"))


# ---------------------------------------------------------------- documents

PARTS = "parts as (select doc_id % 40 as key, 'p/' || doc_id as name, strlen(text)::bigint as size, 'sha256:' || sha256(text) as digest, source, lang, doc_id from documents where text is not null)"


def parts(spark, d):
    i = F.col("doc_id")
    return docs(spark, d).where("text is not null").select((i % 40).alias("key"), F.concat(F.lit("p/"), i.cast("string")).alias("name"), F.octet_length("text").cast("long").alias("size"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("digest"), "source", "lang", "doc_id")


@query(f"""with {PARTS} select key, name, case when doc_id % 4 = 1 then size + 1 else size end as size, case when doc_id % 4 = 1 then '' else digest end as digest,
    case when doc_id % 4 = 1 then 0 when doc_id % 4 = 2 then 9 else 7 end as layer_size, case when doc_id % 4 = 1 then '' else 'l' || doc_id end as layer_digest, case when doc_id % 4 = 2 then 'new' else 'old' end as label, 'tar' as media_type from parts where doc_id % 5 > 0
    union all select key, 'n/' || doc_id, 1, '', 0, '', 'added', 'raw' from parts where doc_id % 4 = 3""")
def dml01_update_parts(spark, d):
    i, p = F.col("doc_id"), parts(spark, d)
    label = lambda x: F.create_map(F.lit("k"), F.lit(x))
    old = p.select("key", "name", "size", "digest", F.lit(7).cast("long").alias("layer_size"), F.concat(F.lit("l"), i.cast("string")).alias("layer_digest"), label("old").alias("labels"), F.lit("tar").alias("media_type"))
    none = F.lit("")
    grown = p.where("doc_id % 4 = 1").select("key", "name", (F.col("size") + 1).alias("size"), none, F.lit(0).cast("long"), none, F.lit(None).cast("map<string,string>"), none)
    labelled = p.where("doc_id % 4 = 2").select("key", "name", F.lit(-1).cast("long"), none, F.lit(9).cast("long"), none, label("new"), none)
    added = p.where("doc_id % 4 = 3").select("key", F.concat(F.lit("n/"), i.cast("string")), F.lit(1).cast("long"), none, F.lit(0).cast("long"), none, label("added"), F.lit("raw"))
    out = B.remove_parts(B.update_parts(old, grown.union(labelled).union(added).toDF(*old.columns)), p.where("doc_id % 5 = 0"))
    return out.withColumn("labels", F.col("labels")["k"]).withColumnRenamed("labels", "label")


@query("""select doc_id, 'x:' || case when doc_id % 2 = 0 then '9' else '1' end || ',y:2' || case when doc_id % 2 = 1 then ',z:9' else '' end as metrics, case when doc_id % 2 = 0 then 'new:a@x' else 'ann:a@x,new:b@x' end as authors,
    'Bob:b' as others, 'a.txt:' || doc_id as artifacts, case when doc_id % 3 = 0 then 'b0,b1' else 'b0,b1,b2' end as links, 'k=w' as labels, greatest(doc_id, 500) as touched from documents""")
def dml04_edits(spark, d):
    i = F.col("doc_id")
    arr = lambda names, rows: F.array(*[F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])
    show = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit(":"), x[b])), ",")
    one = lambda names, r: arr(names, [r])[0]
    metrics = B.put_metric(arr(["name", "value"], [("x", "1"), ("y", "2")]), one(["name", "value"], (F.when(i % 2 == 0, "x").otherwise("z"), "9")))
    who = ["name", "email"]
    authors = B.put_author(arr(who, [("ann", "a@x")]), one(who, ("new", F.when(i % 2 == 0, "a@x").otherwise("b@x"))))
    others = B.drop_author(arr(who, [(" Ann ", "a"), ("Bob", "b")]), F.lit("ann"))
    files = B.put_artifact(arr(["path", "v"], [("a.txt", "0")]), one(["path", "v"], ("a.txt", i.cast("string"))))
    links = B.deprecate(F.array(F.lit("b0"), F.lit("b1")), F.when(i % 3 == 0, "b1").otherwise("b2"))
    labels = B.drop_label(B.put_label(F.create_map(F.lit("k"), F.lit("v"), F.lit("gone"), F.lit("1")), F.lit("k"), F.lit("w")), F.lit("gone"))
    return docs(spark, d).select("doc_id", show(metrics, "name", "value").alias("metrics"), show(authors, "name", "email").alias("authors"), show(others, "name", "email").alias("others"), show(files, "path", "v").alias("artifacts"),
                                 F.array_join(links, ",").alias("links"), F.array_join(F.transform(F.map_entries(labels), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("labels"), B.touched(i, F.lit(500).cast("long")).alias("touched"))


@query(f"""with {PARTS}, m as (select key, '{{"schemaVersion":2,"config":"c","layers":[' || string_agg('{{"mediaType":"tar","digest":"' || digest || '","size":' || size || '}}', ',' order by doc_id) || ']}}' as manifest from parts group by 1)
    select key, manifest, 'sha256:' || sha256(manifest) as digest from m""")
def dml12_manifest(spark, d):
    p = parts(spark, d).select("key", F.col("doc_id").alias("ordinal"), F.col("digest").alias("layer_digest"), F.col("size").alias("layer_size"), F.lit("tar").alias("media_type"))
    return B.manifest(p, F.lit("c"))


@query(f"""with {PARTS}, v as (select distinct digest from parts where lang = 'en'), c as (select key, count(*) filter (digest in (select digest from v)) as gone, string_agg(' -p ' || name, '' order by name) filter (digest not in (select digest from v)) as args from parts group by 1)
    select key, 'pull bottle:' || key || case when gone > 0 then coalesce(args, '') else '' end as command from c""")
def jn29_pull_command(spark, d):
    p = parts(spark, d).withColumnRenamed("digest", "content_id")
    none = spark.createDataFrame([], "layer_digest string, content_id string")
    virtual = B.add_virtual(none, p.where("lang = 'en'").withColumn("layer_digest", F.col("content_id")))
    return B.pull_command(p, virtual, F.concat(F.lit("bottle:"), F.col("key").cast("string")))


@query(f"""with {PARTS} select key, name, case when doc_id % 2 = 0 then 'even' end as label from parts""")
def jn18_part_labels(spark, d):
    p = parts(spark, d).select("key", "name", "doc_id")
    given = p.where("doc_id % 2 = 0").select("key", F.lit("p").alias("dir"), F.col("doc_id").cast("string").alias("base"), F.create_map(F.lit("k"), F.lit("even")).alias("labels"))
    return B.label_parts(p, given).select("key", "name", F.col("labels")["k"].alias("label"))


# ---------------------------------------------------------------- mirror runs


@query(f"""with {PARTS}, i as (select distinct source as key, case when doc_id % 7 > 0 then 'low/' || doc_id end as ref, digest, size from parts where source is not null),
    x as (select key, '{{"schemaVersion":2,"artifactType":"{N.GATHER_TYPE}","manifests":[' || string_agg('{{"mediaType":"m","digest":"' || digest || '","size":' || size || case when ref is not null then ',"annotations":{{"{M.REF}":"' || ref || '"}}' else '' end || '}}', ',' order by coalesce(ref, 'zz'), digest, size)
        || '],"annotations":{{"version":"v1","bytes":"' || sum(size) || '"}}}}' as index from i group by 1)
    select key, index, 'sha256:' || sha256(index) as digest from x""")
def snk01_gather_index(spark, d):
    p = parts(spark, d).where("source is not null")
    return M.gather_index(p.select(F.col("source").alias("key"), F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("low/"), F.col("doc_id").cast("string"))).alias("ref"), "digest", "size", F.lit("m").alias("media_type")), "v1")


@query(f"""with {PARTS} select distinct source as key, case when doc_id % 7 > 0 then 'low/' || doc_id end as ref, case when doc_id % 7 > 0 then 'low/' || doc_id || '@' else '' end || digest as pinned from parts where source is not null""")
def src21_gathered(spark, d):
    return M.gathered(snk01_gather_index(spark, d)).distinct()


@query(f"""with {V.EDGES} select parent, child from edges where child not like 'part:%' union select 'nation:' || n_nationkey, 'shadow:' || n_name from nation""")
def gr02_shadows(spark, d):
    e = V.edges(spark, d).where("not (child like 'part:%')")
    notes = F.create_map(F.lit("extra"), F.to_json(F.array(F.struct(F.lit("m").alias("mediaType"), F.concat(F.lit("shadow:"), "n_name").alias("digest"), F.lit(1).alias("size")))))
    return M.with_shadows(e, V.read(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("parent"), notes.alias("annotations")), "extra")


_I, _M = P.INDEX_TYPES[0], P.IMAGE_TYPES[0]


@query(f"""with c as (select n_regionkey as parent, n_nationkey as o, n_name as digest, n_nationkey as size, n_nationkey % 3 = 0 as ix from nation), j as (select *, '{{"mediaType":"' || case when ix then '{_I}' else '{_M}' end || '","digest":"' || digest || '","size":' || size || '}}' as t from c)
    select parent, '[' || coalesce(string_agg(t, ',' order by o) filter (not ix), '') || ']' as manifests, '[' || coalesce(string_agg(t, ',' order by o) filter (ix), '') || ']' as annotation from j group by 1""")
def dml15_fallback_index(spark, d):
    n = V.read(spark, d, "nation").select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("digest"), F.col("n_nationkey").alias("size"), F.when(F.col("n_nationkey") % 3 == 0, _I).otherwise(_M).alias("media_type"))
    return M.fallback_index(n)


@query("""select o_orderkey, o_orderkey % 3 = 0 as standard_passes, (o_orderkey % 4 = 0) or (o_orderkey % 3 = 0) as image_passes from orders""")
def flt11_image_platform(spark, d):
    k = F.col("o_orderkey")
    o = V.read(spark, d, "orders").select(k, P.parse(F.when(k % 3 == 0, "linux/arm64/v8").otherwise("linux/amd64")).alias("platform"))
    want = spark.createDataFrame([("linux/arm64",), ("windows/amd64",)], "s string").select(P.parse(F.col("s")).alias("platform"))
    kept = M.wanted_children(o, want).select("o_orderkey", F.lit(True).alias("hit"))
    x = o.join(kept, "o_orderkey", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return x.select("o_orderkey", F.col("hit").alias("standard_passes"), M.image_passes(F.when(k % 4 == 0, "other").otherwise("std"), "std", F.col("hit")).alias("image_passes"))


@query(f"""with {PARTS} select key, name, lang in ('en', 'de') as copied, not (lang in ('en', 'de')) as virtual, (['copy', 'copy', 'skip', 'reject'])[doc_id % 4 + 1] as does from parts where lang is not null""")
def flt04_select_successors(spark, d):
    p = parts(spark, d).where("lang is not null").withColumn("media_type", F.element_at(F.array(*map(F.lit, ("manifest", "config", "layer+tar", "else"))), (F.col("doc_id") % 4 + 1).cast("int")))
    return M.metadata_only(M.select_successors(p, F.col("lang").isin("en", "de")), "manifest", "config", "layer").select("key", "name", "copied", "virtual", "does")


@query("""with a as (select o_custkey as key, count(*)::bigint as parts from orders group by 1), b as (select c_custkey as key, 10::bigint as layers from customer)
    select key, coalesce(parts, 0) as parts, coalesce(layers, 0) as layers from a full join b using (key) where coalesce(parts, 0) <> coalesce(layers, 0)""")
def flt25_layer_count(spark, d):
    c = V.read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.explode(F.sequence(F.lit(1), F.lit(10))))
    return M.layer_count_errors(V.read(spark, d, "orders").select(F.col("o_custkey").alias("key")), c)


@query("""with f as (select printf('%06d-', o_orderkey) || o_orderpriority || '.tar' as name, o_orderkey % 5 as k from orders) select name from f where k in (0, 4)""")
def src17_unsynced(spark, d):
    k = F.col("o_orderkey")
    f = V.read(spark, d, "orders").select(k, N.sync_name(k, F.col("o_orderpriority"), ".tar").alias("name"))
    seen = f.where(k % 5 == 1).select("name")
    f = f.select(F.when(k % 5 == 2, F.concat("name", F.lit(".csv"))).when(k % 5 == 3, F.concat(F.lit("."), "name")).otherwise(F.col("name")).alias("name"), F.lit(False).alias("is_dir"))
    return M.unsynced(f, seen)


@query("""with e as (select o_orderpriority as name, o_custkey::varchar as artifact, max(o_orderkey) as n from orders group by 1, 2) select name, string_agg(artifact || '=' || n, ',' order by artifact) as artifacts, (select max(o_orderkey) + 1 from orders) as next from e group by 1""")
def jn28_existing_syncs(spark, d):
    t = V.read(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_custkey").cast("string").alias("artifact"), F.col("o_orderkey").alias("number"))
    return M.existing_syncs(t).select("name", F.array_join(F.transform(F.map_entries("artifacts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("artifacts"), "next")


@query("""select user_id as digest, arg_max(event_id, (ts, event_id)) as transformer, max(ts) as last_seen from events group by 1""")
def dml14_record_location(spark, d):
    e = V.read(spark, d, "events").select(F.col("user_id").alias("digest"), F.lit("loc").alias("location"), F.col("event_id").alias("transformer"), F.struct("ts", "event_id").alias("last_seen"))
    old = e.where("event_type = 'click'")
    return M.record_location(old, e).select("digest", "transformer", F.col("last_seen.ts").alias("last_seen"))


@query("""select distinct l_partkey as blob, l_suppkey as registry, l_returnflag as repository from lineitem""")
def dml18_mount_sources(spark, d):
    return M.mount_sources(V.read(spark, d, "lineitem").select(F.col("l_partkey").alias("blob"), F.col("l_suppkey").alias("registry"), F.col("l_returnflag").alias("repository")))


@query("""with c as (select event_id, user_id, case when event_id % 3 = 0 then 'plain' else 'r' || (event_id % 4) || '/x' end as ref, 'r' || (user_id % 4) as registry from events) select event_id, user_id from c where contains(ref, '/') and split_part(ref, '/', 1) = registry""")
def jn23_located(spark, d):
    e, k = V.read(spark, d, "events"), F.col("event_id")
    c = e.select("event_id", "user_id", F.when(k % 3 == 0, "plain").otherwise(F.concat(F.lit("r"), (k % 4).cast("string"), F.lit("/x"))).alias("ref"), F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("registry"))
    return M.located(c, True).select("event_id", "user_id")


@query(f"""with {V.BLOBS} select media_type, count(*)::bigint as blobs, sum(size)::bigint as bytes from blobs group by 1""")
def agg03_work(spark, d):
    return M.work(V.blobs(spark, d), "media_type")


@query("""select coalesce(a.c_custkey, b.k) as c_custkey, coalesce(b.v, c_mktsegment) as value from customer a full join (select o_custkey as k, max(o_orderpriority) as v from orders where o_orderstatus = 'F' group by 1) b on a.c_custkey = b.k""")
def set03_map_merge(spark, d):
    a = V.read(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("value"))
    b = V.read(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("value"))
    return M.map_merge(a, b, "c_custkey", "value")


@query("""select o_custkey, string_agg(distinct o_orderpriority, chr(10) order by o_orderpriority) as error from orders where o_orderstatus = 'F' group by 1""")
def agg22_joined_errors(spark, d):
    return M.joined_errors(V.read(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("error")), "o_custkey")


@query(f"""with {V.BLOBS} select digest, row_number() over (order by digest)::bigint as place from (select distinct digest from blobs where digest is not null)""")
def srt08_missing_in_order(spark, d):
    from cairn.operators.catalog import running_total

    x = M.missing_in_order(V.blobs(spark, d).where("digest is not null").select("digest").distinct()).withColumn("one", F.lit(1).cast("long"))
    return running_total(x, "one", "digest", "place").select("digest", "place")


# ---------------------------------------------------------------- reports


@query("""with li as (select distinct l_orderkey, l_linenumber from lineitem) select 'o' || o_orderkey as node, (100 + case when o_orderkey % 2 = 0 then coalesce((select sum(10 + l_linenumber) from li where l_orderkey = o_orderkey), 0) else 0 end)::bigint as size from orders
    union all select l_orderkey || ':' || l_linenumber, 10 from li""")
def agg12_artifact_size(spark, d):
    o, li = V.read(spark, d, "orders"), V.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    child = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    manifests = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"), F.lit(100).cast("long").alias("size")).union(li.select(child, F.lit(10).cast("long")))
    children = li.where("l_orderkey % 2 = 0").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("node"), child.alias("child"))
    return T.artifact_size(manifests, children, li.select(child.alias("node"), F.col("l_linenumber").cast("long").alias("size")))


@query("""select o_orderkey, o_orderpriority as image from orders where o_orderkey % 4 > 1 and o_orderkey % 3 < 2""")
def flt16_scannable(spark, d):
    k = F.col("o_orderkey")
    x = V.read(spark, d, "orders").select(k, F.col("o_orderpriority").alias("image"), F.when(k % 4 == 0, N.NOT_SCANNED[0]).when(k % 4 == 2, "std").when(k % 4 == 3, "other").alias("config_type"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("platform"))
    return T.listed_sboms(T.scannable(x), ["p0", "p1"]).select("o_orderkey", "image")


@query("""with p as (select l_orderkey as subject, l_linenumber as ordinal, l_orderkey || '/' || l_linenumber as digest, l_linenumber % 4 as k, l_suppkey % 2 as ok from lineitem)
    select subject, arg_max(digest, ordinal) filter (k = 0) as signature, arg_max(digest, ordinal) filter (k in (1, 2)) as sbom, arg_max(digest, ordinal) filter (k = 3 and ok = 1) as report from p group by 1""")
def jn20_classify(spark, d):
    n = F.col("l_linenumber").cast("int") % 4
    p = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("subject"), F.col("l_linenumber").alias("ordinal"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("digest"),
                                            F.when(n == 0, T.NOTATION).when(n == 1, N.SBOM_TYPES[0]).when(n == 2, N.SBOM_TYPES[1]).otherwise("report").alias("artifact_type"), (F.col("l_suppkey") % 2).cast("string").alias("checksum"))
    return T.predecessor_roles(p, F.lit("1"), "report")


@query("""select l_orderkey as subject, string_agg(distinct l_partkey::varchar, ',' order by l_partkey::varchar) as digests from lineitem where l_returnflag = 'R' group by 1""")
def gr10_referrers(spark, d):
    e = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("subject"), F.col("l_partkey").cast("string").alias("digest"), F.col("l_returnflag").alias("artifact_type"))
    return T.referrers(e, "R").select("subject", F.array_join("digests", ",").alias("digests"))


@query("""select o_custkey as image, 'p' || (o_orderkey % 3) as platform, arg_max(l_partkey, (o_orderkey, l_linenumber, l_partkey)) as digest from orders join lineitem on l_orderkey = o_orderkey group by 1, 2""")
def jn27_sbom_layers(spark, d):
    o = V.read(spark, d, "orders").select(F.col("o_custkey").alias("image"), F.concat(F.lit("p"), (F.col("o_orderkey") % 3).cast("string")).alias("platform"), F.col("o_orderkey").alias("manifest"))
    return T.sbom_layers(o, V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("manifest"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("digest")))


@query("""with t as (select 'r' || (c_custkey % 3) || '/g' || (c_custkey % 2) || '/n' || (c_custkey % 5) || case when c_custkey % 4 = 0 then c_custkey::varchar else '' end as ref, max(c_acctbal) as critical from customer group by 1),
    a as (select ref from t order by critical desc, ref limit 10), b as (select ref, split_part(ref, '/', 3) as x, split_part(ref, '/', 2) || '/' || split_part(ref, '/', 3) as y from a)
    select ref, case when count(*) over (partition by x) = 1 then x when count(*) over (partition by y) = 1 then y else ref end as short from b""")
def win08_short_names(spark, d):
    k = F.col("c_custkey")
    ref = F.concat(F.lit("r"), (k % 3).cast("string"), F.lit("/g"), (k % 2).cast("string"), F.lit("/n"), (k % 5).cast("string"), F.when(k % 4 == 0, k.cast("string")).otherwise(""))
    return T.short_names(V.read(spark, d, "customer").groupBy(ref.alias("ref")).agg(F.max("c_acctbal").alias("critical")), 10)


@query("""select n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' |' as markdown, n_nationkey || ',' || case when n_nationkey % 2 = 0 then chr(34) || n_name || ', ' || chr(34) || chr(34) || 'x' || repeat(chr(34), 3) else n_name end as csv, rpad(n_name, (select max(length(n_name)) from nation)::int, ' ') as padded from nation""")
def snk11_report_lines(spark, d):
    n = V.read(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(', "x"'))).otherwise(F.col("n_name")).alias("odd"))
    key = lambda df, c: df.select(F.regexp_extract("line", "([0-9]+)", 1).cast("long").alias("n_nationkey"), F.col("line").alias(c))
    wide = T.padded(n, ["n_nationkey", "n_name"]).select(F.trim("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_name").alias("padded"))
    out = key(T.markdown(n, ["n_nationkey", "n_name"]), "markdown").join(key(T.csv_lines(n, ["n_nationkey", "odd"]), "csv"), "n_nationkey").join(wide, "n_nationkey")
    return out.select(F.col("n_nationkey").cast(n.schema["n_nationkey"].dataType).alias("n_nationkey"), "markdown", "csv", "padded")


@query("""select doc_id, doc_id % 3 = 0 and text is not null as valid from documents""")
def flt23_valid_signature(spark, d):
    i, g = F.col("doc_id"), F.concat(F.lit("sha256:"), F.sha2("text", 256))
    at = lambda kind: F.struct(F.lit(kind).alias("mediaType"), g.alias("digest"), F.lit(1).alias("size"))
    m = F.struct(F.when(i % 3 == 1, 1).otherwise(2).alias("schemaVersion"), F.lit(_M).alias("mediaType"), at(T.NOTATION).alias("config"), F.array(at("application/jose+json"), F.struct(F.when(i % 3 == 2, "x").otherwise("application/jose+json").alias("mediaType"), g.alias("digest"), F.lit(0).alias("size"))).alias("layers"))
    return docs(spark, d).select("doc_id", T.valid_signature(m).alias("valid"))


@query("""with s as (select c.conv_id, c.turn, c.conv_id || '/' || c.turn as signature, not (c.turn = 1 and c.conv_id % 2 = 0) as ok from conversations c)
    select 'sha256:' || sha256(conv_id::varchar) as subject, bool_and(ok) as verified, coalesce(string_agg(signature, ',' order by signature) filter (ok), '') as good, coalesce(string_agg(signature, ',' order by signature) filter (not ok), '') as failed from s group by 1""")
def sig02_verify_payloads(spark, d):
    c = V.read(spark, d, "conversations")
    subject = F.concat(F.lit("sha256:"), F.sha2(F.col("conv_id").cast("string"), 256))
    wrong = (F.col("turn") == 1) & (F.col("conv_id") % 2 == 0)
    payload = F.base64(F.encode(F.to_json(F.struct(F.struct(F.when(wrong, "sha256:0").otherwise(subject).alias("digest")).alias("targetArtifact"))), "utf-8"))
    s = c.select(subject.alias("subject"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("signature"), payload.alias("payload"))
    return T.verified(s).select("subject", "verified", F.array_join("good", ",").alias("good"), F.array_join("failed", ",").alias("failed"))


@query("""select conv_id as subject, '[' || string_agg('{"digest":"' || turn || '","annotations":{"by":"' || role || '"}}', ',' order by turn::varchar) || ']' as signatures from conversations group by 1""")
def sig05_summary(spark, d):
    c = V.read(spark, d, "conversations").select(F.col("conv_id").alias("subject"), F.col("turn").cast("string").alias("digest"), F.struct(F.col("role").alias("by")).alias("annotations"))
    return T.signature_summary(c)


# ---------------------------------------------------------------- histories

COMMITS = "c as (select conv_id, turn, conv_id || ':' || turn as node, conv_id || ':' || (turn - 1) as parent, max(turn) over (partition by conv_id) as head from conversations)"


def commits(spark, d):
    """Turns as commits: (node, child) where child is the turn before, and the head of each conversation."""
    c = V.read(spark, d, "conversations")
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    x = c.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("head", F.max("turn").over(Window.partitionBy("conv_id")))
    return x.select("conv_id", "turn", "role", "text", "head", name(F.col("turn")).alias("node"), name(F.col("turn") - 1).alias("before"), name(F.col("head")).alias("tip"))


@query(f"""with {COMMITS} select distinct node from c where turn > head // 2""")
def gr14_thin_bundle(spark, d):
    c = commits(spark, d)
    e = c.join(c.select(F.col("node").alias("before")), "before", "left_semi").select(F.col("node").alias("parent"), F.col("before").alias("child"))
    old = c.where(F.col("turn") == F.floor(F.col("head") / 2)).select("node")
    return S.thin_bundle(e, c.select(F.col("tip").alias("node")).distinct(), old)


@query("""select (select 'order:' || max(o_orderkey) from orders where o_custkey = (select max(o_custkey) from orders)) as node""")
def gr13_merge_base(spark, d):
    o = V.read(spark, d, "orders")
    top = o.agg(F.max("o_custkey")).first()[0]
    mine = o.where(F.col("o_custkey") == top).select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("child"), F.col("o_orderkey").alias("generation"))
    sides = spark.createDataFrame([("left",), ("right",)], "parent string")
    e = sides.join(F.broadcast(mine.select("child")), F.lit(True))
    generation = mine.select(F.col("child").alias("node"), "generation").union(sides.select("parent", F.lit(2**40)))
    return S.merge_base(e, spark.createDataFrame([("left",)], "node string"), spark.createDataFrame([("right",)], "node string"), generation)


@query("""with o as (select o_custkey as repo, o_orderkey as idx, o_orderkey % 3 > 0 as cached from orders), c as (select repo, min(idx) as cut from o where not cached group by 1) select repo, idx from o join c using (repo) where idx >= cut""")
def jn12b_uncached_bundles(spark, d):
    o = V.read(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("idx"), F.col("o_orderkey").alias("commit"))
    return S.uncached_bundles(o, o.where("commit % 3 > 0")).select("repo", "idx")


@query("""select sha256(text) as oid from conversations where text is not null except select sha256(text) from conversations where role = 'user' and text is not null""")
def jn11_new_lfs(spark, d):
    c = V.read(spark, d, "conversations").where("text is not null").select(F.sha2("text", 256).alias("oid"), "role")
    return S.new_objects(c, c.where("role = 'user'"))


@query("""with r as (select o_custkey as commit, o_orderpriority as ref, o_orderstatus as layer from orders) select layer, 'refs' as what, string_agg(distinct commit::varchar, ',' order by commit::varchar) as items from r group by 1
    union all select commit::varchar, 'heads', string_agg(distinct ref, ',' order by ref) from r where commit % 2 = 0 group by 1""")
def agg16_refs_by_layer(spark, d):
    r = V.read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("commit"), F.col("o_orderpriority").alias("ref"), F.col("o_orderstatus").alias("layer"), F.when(F.col("o_custkey") % 2 == 0, "heads").otherwise("tags").alias("kind"))
    a = S.refs_by_layer(r).select("layer", F.lit("refs").alias("what"), F.array_join("commits", ",").alias("items"))
    return a.union(S.heads_at(r).select("commit", F.lit("heads"), F.array_join("heads", ",")))


@query("""with l as (select o_custkey as commit, min(o_orderkey) as idx from orders group by 1) select c_custkey as commit, coalesce(l.idx, (select max(idx) from l)) as layer from customer left join l on l.commit = c_custkey""")
def win06_oldest_layer(spark, d):
    layers = V.read(spark, d, "orders").select(F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("commit"), F.col("o_orderkey").alias("idx"))
    layers = layers.groupBy("commit").agg(F.min("idx").alias("idx"))
    return S.oldest_layer(layers, V.read(spark, d, "customer").select(F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("head"), F.col("c_custkey").alias("commit")))


@query("""select o_orderkey as ref, o_custkey + case when o_orderkey % 2 = 0 then 1 else 0 end as commit, case when o_orderkey % 2 = 0 then 'new' else 'old' end as layer from orders where o_orderkey % 5 > 0
    union all select o_orderkey, o_custkey + case when o_orderkey % 2 = 0 then 1 else 0 end, 'new' from orders where o_orderkey % 5 = 0""")
def dml16_update_refs(spark, d):
    o, k = V.read(spark, d, "orders"), F.col("o_orderkey")
    remote = o.select(k.alias("ref"), (F.col("o_custkey") + F.when(k % 2 == 0, 1).otherwise(0)).alias("commit"), F.lit("new").alias("layer"))
    return S.update_refs(o.where(k % 5 > 0).select(k.alias("ref"), F.col("o_custkey").alias("commit"), F.lit("old").alias("layer")), remote)


@query("""with e as (select l_orderkey as parent, l_partkey as child, (['bundle', 'lfs', 'config'])[l_linenumber % 3 + 1] as kind from lineitem) select parent, child, kind, count(*)::bigint as n from e where kind = 'config' or child % 2 = 0 group by 1, 2, 3""")
def gr17_overrides(spark, d):
    e = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("child"), F.element_at(F.array(*map(F.lit, ("bundle", "lfs", "config"))), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("kind"))
    needed = V.read(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("node"))
    return S.override_successors(e, needed).groupBy("parent", "child", "kind").agg(F.count("*").alias("n"))


@query(f"""with recursive {V.EDGES}, w as (select 'nation:' || n_nationkey as root, 'nation:' || n_nationkey as node from nation union select root, child from w join edges on parent = node)
    select root, (length(root) + sum(length(child)))::bigint as size from w join edges on parent = node group by 1""")
def agg20_subdag_size(spark, d):
    e = V.edges(spark, d)
    nodes = e.select(F.col("parent").alias("node")).union(e.select("child")).distinct().withColumn("size", F.length("node").cast("long"))
    return G.subdag_size(e, V.read(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node")), nodes)


# ---------------------------------------------------------------- small filters, sorts and sets


@query("""select doc_id, 'v' || lang as tag from documents where doc_id % 3 > 0 and lang is not null""")
def flt19_tag_names(spark, d):
    tag = F.concat(F.when(F.col("doc_id") % 3 == 0, "sha256:").otherwise("v"), "lang")
    return M.tag_names(docs(spark, d).select("doc_id", tag.alias("tag")))


@query(f"with {V.WHEELS} select p_partkey, filename from wheels where yanked is null")
def flt18_kept_entries(spark, d):
    return M.kept_entries(V.wheels(spark, d)).select("p_partkey", "filename")


@query("""select event_id from events where ts > (select min(ts) + interval '1 day' from events)""")
def flt21_updated_since(spark, d):
    e = V.read(spark, d, "events")
    first = e.agg((F.min("ts") + F.expr("interval 1 day")).alias("t")).first()[0]
    return M.updated_since(e.withColumnRenamed("ts", "mtime"), F.lit(first).cast(e.schema["ts"].dataType)).select("event_id")


@query("""select c_custkey from customer where c_custkey % 2 = 0""")
def flt24_current_version(spark, d):
    c = V.read(spark, d, "customer").withColumn("api_version", F.when(F.col("c_custkey") % 2 == 0, "v1").otherwise("v0"))
    return M.current_version(c, "v1").select("c_custkey")


@query(f"with {V.BLOBS} select b.doc_id, m.path from blobs b join (select digest, min('f/' || doc_id) as path from blobs group by 1) m using (digest)")
def jn26_artifact_files(spark, d):
    b = V.blobs(spark, d)
    return M.artifact_files(b.select("doc_id", "digest"), b.select("digest", F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("path"))).select("doc_id", "path")


@query("""select conv_id, array_to_string(list_sort(list_distinct(list_append(list(role), 'tool'))), ',') as added, array_to_string(list_sort(list_filter(list_distinct(list(role)), lambda x: x <> 'user')), ',') as removed from conversations where role is not null group by 1""")
def agg23_sets(spark, d):
    c = V.read(spark, d, "conversations").where("role is not null").groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    show = lambda x: F.array_join(x, ",")
    return c.select("conv_id", show(M.set_add(F.col("r"), F.lit("tool"))).alias("added"), show(M.set_remove(F.col("r"), F.lit("user"))).alias("removed"))


@query("""with c as (select l_shipmode_or as platform, round(count(*) * 100.0 / (select count(*) from lineitem), 2)::double as coverage from (select l_returnflag || l_linestatus as l_shipmode_or from lineitem) group by 1)
    select platform, coverage, row_number() over (order by coverage desc, platform)::bigint as place from c""")
def srt05_by_coverage(spark, d):
    li = V.read(spark, d, "lineitem")
    n = li.count()
    c = li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("platform")).agg(F.round(F.count("*") * 100.0 / F.lit(n), 2).alias("coverage"))
    # A handful of rows: flags by status.
    return T.by_coverage(c).withColumn("place", F.row_number().over(Window.orderBy(F.desc("coverage"), "platform")).cast("long"))
