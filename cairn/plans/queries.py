"""One query for each catalog operator, over the test tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import labels as L
from cairn.functions import platforms as P
from cairn.functions import refs as R
from cairn.operators import artifacts as A
from cairn.operators import catalog as C
from cairn.operators import graph as G
from cairn.operators import mapping as M
from cairn.plans import catalog as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- flagship

RULES = [(0, "src1", "low/one"), (1, "src", "low/default"), (2, "src12", "low/twelve"), (3, "", "other")]
RULES_SQL = "rules as (select * from (values (0, 'src1', 'low/one'), (1, 'src', 'low/default'), (2, 'src12', 'low/twelve'), (3, '', 'other')) as r(rule_no, src, dst))"


def rules(spark):
    return spark.createDataFrame(RULES, "rule_no int, src string, dst string")


@query(f"""with {V.BLOBS}, {RULES_SQL},
    picked as (select * from blobs where lang in ('en', 'de') and media_type <> 'src3'),
    routed as (select b.doc_id, b.digest, b.size, coalesce((select arg_max(dst || substr(b.media_type, length(src) + 1), length(src) * 100 + rule_no) from rules where src <> '' and starts_with(b.media_type, src)), 'other/' || b.media_type) as dest from picked b),
    each as (select dest, digest, count(*) as n, sum(size) as a, max(size) as one from routed group by 1, 2)
    select dest, sum(n)::bigint as occurrences, sum(a)::bigint as total, sum(one)::bigint as deduplicated from each group by 1""")
def gather_accounting(spark: SparkSession, d: str) -> DataFrame:
    b = V.blobs(spark, d).where(L.selectors(["lang in (en,de),source!=src3"], F.col("labels")))
    keys = b.select("media_type").distinct().withColumnRenamed("media_type", "ref")
    routed = M.longest_prefix(keys, rules(spark), "ref")
    return G.byte_tracker(b.join(routed.withColumnRenamed("ref", "media_type"), "media_type"), "dest")


# ---------------------------------------------------------------- sources


@query("""select 'doc' || doc_id as name, '{"lang":"' || lang || '","source":"' || source || '"}' as labels from documents where lang <> 'fr'""")
def src01_sources_labels(spark, d):
    from cairn.sources.lists import parse_sources

    lines = V.read(spark, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(", lang="), "lang", F.lit(",source = "), "source").alias("value"))
    return parse_sources(lines, ["lang!=fr"]).select("name", F.to_json("labels").alias("labels"))


@query("""with a as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 0)) as tag from pages)
    select page_id, regexp_extract(tag, 'href="([^"]*)"', 1) as href, regexp_extract(tag, '>([^<]*)<', 1) as text, count(*)::bigint as n from a group by all""")
def src13_anchor_entries(spark, d):
    from cairn.sources.lists import anchors

    return anchors(V.read(spark, d, "pages")).groupBy("page_id", "href", "text").agg(F.count("*").alias("n"))


@query("""with a as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) as filename from pages),
    r as (select *, row_number() over (partition by filename order by page_id) as k from a) select filename, page_id from r where k = 1""")
def src14_first_index_wins(spark, d):
    from cairn.sources.lists import anchors

    return anchors(V.read(spark, d, "pages")).groupBy(F.col("href").alias("filename")).agg(F.min("page_id").alias("page_id"))


@query("""select event_id, json_extract_string(props, '$.k')::bigint as k from events""")
def src19_json_after_prefix(spark, d):
    s = V.read(spark, d, "events").withColumn("s", F.concat(F.lit("WARN db is old\n"), "props"))
    return s.select("event_id", F.from_json(F.expr("substring(s, instr(s, '{'))"), "k long")["k"].alias("k"))


@query("""select event_id, coalesce(nullif(case when event_id % 2 = 0 then '' else event_type end, ''), nullif(user_id::varchar, '')) as value from events""")
def src20_database_checksum(spark, d):
    f = F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("event_type"))
    return V.read(spark, d, "events").select("event_id", F.coalesce(F.nullif(f, F.lit("")), F.nullif(F.col("user_id").cast("string"), F.lit(""))).alias("value"))


# ---------------------------------------------------------------- scalar functions


@query(f"with {V.PARSED} select doc_id, scheme, reg, repo, name, tag, digest, ok from parsed")
def fn01_ref_parse(spark, d):
    return V.refs(spark, d).select("doc_id", R.parse(F.col("s")).alias("r")).select("doc_id", "r.*")


@query(f"""with {V.PARSED}, f as (select *, case when repo = '' then name else repo || '/' || name end as path from parsed)
    select doc_id, reg || '/' || path || case when tag <> '' then ':' || tag else '' end || case when digest <> '' then '@' || digest else '' end as string,
    case when scheme = 'http' then 'http://' else 'https://' end || case when reg = 'docker.io' then 'index.docker.io' else reg end || '/v2/' || path || '/manifests/' || case when digest <> '' then digest else tag end as api,
    scheme = 'http' as insecure from f where ok""")
def fn06_ref_format(spark, d):
    r = F.col("r")
    return V.refs(spark, d).select("doc_id", R.parse(F.col("s")).alias("r")).where("r.ok").select("doc_id", R.to_string(r).alias("string"), R.api_url(r).alias("api"), R.is_insecure(r).alias("insecure"))


@query(f"""with {V.REFS} select doc_id, case when regexp_matches(s, 'docker\\.io/(.*)') then regexp_replace(s, 'docker\\.io/(.*)', 'mirror/\\1') when regexp_matches(s, 'reg([0-9])\\.example') then regexp_replace(s, 'reg([0-9])\\.example', 'r\\1.internal') else s end as dest from refs""")
def fn09_rewrite(spark, d):
    return V.refs(spark, d).select("doc_id", R.rewrite(F.col("s"), [(r"docker\.io/(.*)", "mirror/$1"), (r"reg([0-9])\.example", "r$1.internal")]).alias("dest"))


@query(f"""with {V.REFS} select doc_id, case when s like 'http:%' then 'http' when s like 'bottle:%' then 'bottle' else 'oci' end as transport, regexp_replace('https://u:p@' || s, '://[^/@\\s]+@', '://xxxxx@') as redacted from refs""")
def fn11_transport_redact(spark, d):
    s = F.col("s")
    return V.refs(spark, d).select("doc_id", R.transport(s).alias("transport"), R.redact_url(F.concat(F.lit("https://u:p@"), s)).alias("redacted"))


@query(f"""with {V.URLS} select page_id, coalesce(nullif(regexp_extract(ref, '^(.*)/[^/]+/?$', 1), ''), '.') as dir, regexp_extract(ref, '([^/]+/?)$', 1) as base from urls""")
def fn13_part_split(spark, d):
    return V.urls(spark, d).select("page_id", L.split_part_name(F.col("ref")).alias("x")).select("page_id", "x.*")


@query(f"""with {V.URLS}, p as (select page_id, string_split(ref, '/') as a from urls), i as (select page_id, a, unnest(range(1, len(a))) as n from p)
    select page_id, array_to_string(a[1:n], '/') as dir from i""")
def fn14_ancestors(spark, d):
    return V.urls(spark, d).select("page_id", F.explode(L.ancestors(F.col("ref"))).alias("dir"))


@query("""select doc_id, 'k.' || lang as key, source || '=x' as value, doc_id % 2 = 0 as gone from documents""")
def fn15_label_pair(spark, d):
    s = F.concat(F.lit("k."), "lang", F.lit("="), "source", F.lit("=x"))
    x = L.split_pair(s)
    gone = L.is_delete(F.when(F.col("doc_id") % 2 == 0, F.lit("key-")).otherwise(F.lit("key=v-")))
    return V.read(spark, d, "documents").select("doc_id", x["key"].alias("key"), x["value"].alias("value"), gone.alias("gone"))


PLATFORMS = ("linux/amd64", "linux/arm/v7", "windows/amd64:10.0.1", "all", "linux", "a/b/c/d", "darwin/arm64")
PLAT_SQL = "plats as (select p_partkey, (['linux/amd64', 'linux/arm/v7', 'windows/amd64:10.0.1', 'all', 'linux', 'a/b/c/d', 'darwin/arm64'])[p_partkey % 7 + 1] as s from part)"
PLAT_PARSED = PLAT_SQL + """, pp as (select p_partkey, s, string_split(split_part(s, ':', 1), '/') as a from plats),
    pq as (select p_partkey, s, s <> 'all' and len(a) in (2, 3) as ok, a[1] as os, a[2] as architecture, a[3] as variant, nullif(split_part(s, ':', 2), '') as os_version from pp)"""


def plats(spark, d):
    return V.read(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, PLATFORMS)), (F.col("p_partkey") % 7 + 1).cast("int")).alias("s"))


@query(f"""with {PLAT_PARSED} select p_partkey, case when ok then os end as os, case when ok then architecture end as architecture, case when ok then variant end as variant, case when ok then os_version end as os_version, case when ok then s else 'all' end as string from pq""")
def fn16_platform_roundtrip(spark, d):
    return plats(spark, d).select("p_partkey", P.parse(F.col("s")).alias("p")).select("p_partkey", "p.os", "p.architecture", "p.variant", "p.os_version", P.to_string(F.col("p")).alias("string"))


@query(f"""with {V.WHEELS}, p as (select p_partkey, filename, string_split(regexp_replace(filename, '\\.whl$', ''), '-') as a from wheels where filename like '%.whl')
    select p_partkey, 'my-pkg-' || (p_partkey % 50) as project, a[2] as version, case when len(a) = 6 then a[3] end as build, 'py2,py3' as python,
    case p_partkey % 6 when 0 then 'linux' when 1 then 'windows' when 2 then 'windows' when 3 then 'darwin' when 4 then 'any' else 'linux' end as os,
    case p_partkey % 6 when 0 then 'x86_64' when 1 then 'amd64' when 2 then 'x86' when 3 then 'arm64' when 4 then 'any' else 'aarch64' end as arch,
    '{{"version.major":"' || string_split(split_part(a[2], '+', 1), '.')[1] || '","version.minor":"' || string_split(split_part(a[2], '+', 1), '.')[2] || '"' || case when p_partkey % 3 = 0 then ',"version.patch":"1"' else '' end || '}}' as labels from p""")
def fn19_wheel_labels(spark, d):
    w = V.wheels(spark, d).select("p_partkey", P.parse_wheel(F.col("filename")).alias("w")).where("w is not null")
    t = P.decode_tag(F.col("w.platform")[0])
    return w.select("p_partkey", "w.project", "w.version", "w.build", F.array_join("w.python", ",").alias("python"), t["os"].alias("os"), t["arch"].alias("arch"), F.to_json(P.version_labels(F.col("w.version"))).alias("labels"))


@query(f"""with {V.WHEELS} select p_partkey, case when filename like '%.whl' then 'wheel' when filename like '%.tar.gz' then 'sdist' end as kind,
    case when filename like '%.tar.gz' then 'my-pkg-' || (p_partkey % 50) end as project, case when filename like '%.tar.gz' then regexp_extract(regexp_replace(filename, '\\.tar\\.gz$', ''), '-([^-]*)$', 1) end as version from wheels""")
def fn22_sdist_kind(spark, d):
    f = F.col("filename")
    return V.wheels(spark, d).select("p_partkey", P.dist_kind(f).alias("kind"), P.parse_sdist(f)["project"].alias("project"), P.parse_sdist(f)["version"].alias("version"))


@query("""select p_partkey, 'my-pkg-' || (p_partkey % 50) as name, case when p_partkey % 2 = 0 then 'a,b' else '' end as extras, '>=1.0,===' || (p_partkey % 4) || '.0' as spec,
    case when p_partkey % 3 = 0 then 'python_version<"3"' else '' end as constraints, case when p_partkey % 5 = 0 then 'sha256:ab,sha256:cd' else '' end as digests,
    '>= 1.0|=== ' || (p_partkey % 4) || '.0' as clauses from part""")
def fn26_requirement_parse(spark, d):
    k = F.col("p_partkey")
    line = F.concat(F.lit("My_Pkg."), (k % 50).cast("string"), F.when(k % 2 == 0, F.lit("[a, b]")).otherwise(""), F.lit(" >=1.0,==="), (k % 4).cast("string"), F.lit(".0"), F.when(k % 3 == 0, F.lit(' ; python_version<"3"')).otherwise(""), F.when(k % 5 == 0, F.lit(" --hash=sha256:ab --hash=sha256:cd")).otherwise(""))
    r = P.parse_requirement(line)
    return V.read(spark, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.name", F.array_join("r.extras", ",").alias("extras"), "r.spec", "r.constraints", F.array_join("r.digests", ",").alias("digests"), F.array_join(F.transform(P.clauses(F.col("r.spec")), lambda c: F.concat_ws(" ", c["op"], c["value"])), "|").alias("clauses"))


@query("""select doc_id, 'sha256:' || sha256(text) as digest, substr(sha256(text), 1, 12) as short, 'blobs/sha256/' || sha256(text) as path, doc_id % 2 = 0 as verified,
    substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) as lfs from documents""")
def fn36_digest(spark, d):
    t, dig = F.col("text"), P.digest(F.col("text"))
    return V.read(spark, d, "documents").select("doc_id", dig.alias("digest"), P.short_digest(dig).alias("short"), P.blob_path(dig).alias("path"), P.verify(F.when(F.col("doc_id") % 2 == 0, dig).otherwise(F.lit("sha256:00")), t).alias("verified"), P.lfs_path(F.sha2(t, 256)).alias("lfs"))


@query("""with s as (select doc_id, strlen(text) * (doc_id % 4 * doc_id % 997 + 1) as n from documents),
    v as (select *, case when n >= 1000000000 then floor(n / 1e9 * 10 + 0.5) / 10 when n >= 1000000 then floor(n / 1e6 * 10 + 0.5) / 10 when n >= 1000 then floor(n / 1e3 * 10 + 0.5) / 10 end as x,
    case when n >= 1000000000 then ' GB' when n >= 1000000 then ' MB' when n >= 1000 then ' kB' else ' B' end as u from s)
    select doc_id, case when n < 1000 then n::varchar when x < 10 then printf('%.1f', x) else printf('%.0f', x) end || u as human from v""")
def fn40_human_bytes(spark, d):
    i = F.col("doc_id")
    return V.read(spark, d, "documents").select("doc_id", P.human_bytes(F.octet_length("text") * (i % 4 * i % 997 + 1)).alias("human"))


@query(f"""with {V.MATCHES} select severity, case severity when 'Critical' then 5 when 'High' then 4 when 'Medium' then 3 when 'Low' then 2 when 'Negligible' then 1 else 0 end as rank, count(*)::bigint as n from matches group by 1""")
def fn44_severity_rank(spark, d):
    return V.matches(spark, d).groupBy("severity").agg(F.count("*").alias("n")).withColumn("rank", P.severity_rank(F.upper("severity")))


@query()
def fn46_compressible(spark, d):
    from cairn.sources.archives import compressible

    return compressible(V.read(spark, d, "documents").select("doc_id", "text"))


# ---------------------------------------------------------------- filters

SELECTORS = {"eq": "lang=en", "eq2": "lang==en,source=src1", "ne": "lang!=en", "in_": "lang in (de, fr)", "notin_": "missing notin (x)", "has": "lang", "hasnot": "!missing", "gt": "n>2000", "lt": "n<300"}


@query("""select doc_id, lang = 'en' as eq, lang = 'en' and source = 'src1' as eq2, lang <> 'en' as ne, lang in ('de', 'fr') as in_, true as notin_, true as has, true as hasnot, n_chars > 2000 as gt, n_chars < 300 as lt from documents""")
def flt01_selector_dnf(spark, d):
    return V.blobs(spark, d).select("doc_id", *[L.selectors([s], F.col("labels")).alias(k) for k, s in SELECTORS.items()])


@query("""select doc_id, source in ('src1', 'src2') or lang = 'fr' or (lang = 'en' and n_chars > 5000) as selected, false as none, true as every from documents""")
def flt03_part_selector(spark, d):
    n, lab, arts = F.col("media_type"), F.col("labels"), F.array("lang")
    return V.blobs(spark, d).select("doc_id", L.part_selected(n, lab, arts, names=["src1", "src2"], artifacts=["fr"], texts=["lang=en,n>5000"]).alias("selected"), L.part_selected(n, lab, arts, empty=True).alias("none"), L.part_selected(n, lab, arts).alias("every"))


@query("""select doc_id, lang = 'de' or source = 'src4' as hit from documents""")
def flt05_match_any(spark, d):
    return V.read(spark, d, "documents").select("doc_id", L.any_match(["k=de", "k=src4"], F.array(F.create_map(F.lit("k"), "lang"), F.create_map(F.lit("k"), "source"))).alias("hit"))


@query(f"""with {V.WHEELS} select filename, count(*)::bigint as n from wheels where yanked is null and filename not like '%.exe'
    and (p_partkey % 50 between 3 and 20 or (p_partkey % 50 = 30 and regexp_extract(filename, '^[^-]*-([^-]*?)(-|\\.tar)', 1) = '2.0')) group by 1""")
def flt06_dist_filter(spark, d):
    reqs = spark.createDataFrame([(f"my-pkg-{i}", ">=9") for i in range(3, 21)] + [("my-pkg-30", "===2.0")], "name string, spec string").withColumn("cl", P.clauses(F.col("spec")))
    f = F.col("filename")
    w = V.wheels(spark, d).where("yanked is null").withColumn("p", F.coalesce(P.parse_wheel(f)["project"], P.parse_sdist(f)["project"])).withColumn("v", F.coalesce(P.parse_wheel(f)["version"], P.parse_sdist(f)["version"])).where("p is not null")
    w = w.alias("w")
    hit = w.join(F.broadcast(reqs), (F.col("p") == F.col("name")) & P.clauses_match(F.col("v"), F.col("cl")), "left_semi")
    return hit.groupBy("filename").agg(F.count("*").alias("n"))


@query(f"""with {PLAT_PARSED} select p_partkey, ok and os = 'linux' and architecture = 'amd64' or (ok and os = 'linux' and architecture = 'arm' and variant = 'v7') as hit, not ok as none from pq""")
def flt09_platform_match(spark, d):
    p = P.parse(F.col("s"))
    want = [P.parse(F.lit("linux/amd64")), P.parse(F.lit("linux/arm/v7"))]
    return plats(spark, d).select("p_partkey", (P.match(p, want[0]) | P.match(p, want[1])).alias("hit"), P.match(p, P.parse(F.lit("all"))).alias("none"))


@query(f"""with {V.PARSED}, y as (select distinct reg, tag from parsed)
    select x.doc_id, count(*)::bigint as n from parsed x join y on lower(x.reg) = lower(y.reg) and lower(x.tag) = lower(y.tag) group by 1""")
def flt12_ref_match_mask(spark, d):
    r = V.refs(spark, d).select("doc_id", R.parse(F.col("s")).alias("r"))
    y = r.select("r.reg", "r.tag").distinct().select(F.struct("reg", "tag").alias("y"))
    return r.join(y, R.match(F.col("r"), F.col("y"), R.BITS["reg"] | R.BITS["tag"])).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"with {V.MATCHES} select reference, count(*)::bigint as n from matches where severity in ('Critical', 'High') group by 1")
def flt15_min_severity(spark, d):
    return V.matches(spark, d).where(P.severity_rank(F.col("severity")) >= P.SEVERITY["high"]).groupBy("reference").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- joins

URL_RULES = [(0, "m.", "mobile/"), (1, "th", "t/"), (2, "ththth", "ttt/"), (3, "m.th", "mt/"), (4, "th", "last/")]
URL_RULES_SQL = "rules as (select * from (values (0, 'm.', 'mobile/'), (1, 'th', 't/'), (2, 'ththth', 'ttt/'), (3, 'm.th', 'mt/'), (4, 'th', 'last/')) as r(rule_no, src, dst)), hits as (select page_id, rule_no, src, dst || substr(ref, length(src) + 1) as dest from urls join rules on starts_with(ref, src))"


def url_rules(spark):
    return spark.createDataFrame(URL_RULES, "rule_no int, src string, dst string")


@query(f"with {V.URLS}, {URL_RULES_SQL} select page_id, arg_min(dest, rule_no) as dest from hits group by 1")
def jn01_first_prefix(spark, d):
    return M.first_prefix(V.urls(spark, d), url_rules(spark), "page_id")


@query(f"with {V.URLS}, {URL_RULES_SQL} select page_id, rule_no, dest from hits")
def jn02_all_prefix(spark, d):
    return M.all_prefix(V.urls(spark, d), url_rules(spark)).select("page_id", "rule_no", "dest")


@query(f"with {V.URLS}, {URL_RULES_SQL} select u.page_id, coalesce(dest, '') as dest from urls u left join (select page_id, arg_max(dest, length(src) * 100 + rule_no) as dest from hits group by 1) using (page_id)")
def jn03_longest_prefix(spark, d):
    return M.longest_prefix(V.urls(spark, d), url_rules(spark), "page_id")


@query(f"with {V.BLOBS}, r as (select digest, 'd' || (doc_id % 3) as dest from blobs where doc_id % 4 = 0) select b.doc_id, r.dest, count(*)::bigint as n from blobs b join r using (digest) group by all")
def jn04_digest_map(spark, d):
    b = V.blobs(spark, d)
    r = b.where("doc_id % 4 = 0").select(F.col("digest").alias("src"), F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string")).alias("dst"))
    return M.by_digest(b.select("doc_id", "digest"), r).groupBy("doc_id", "dest").agg(F.count("*").alias("n"))


@query(f"with {V.URLS} select page_id, 'base/nest/' || ref as dest from urls")
def jn05_nest(spark, d):
    return V.urls(spark, d).select("page_id", M.nest("base/nest/", F.concat(F.lit("/"), "ref")).alias("dest"))


@query(f"with {V.BLOBS} select doc_id from blobs where digest not in (select digest from blobs where doc_id % 3 = 0)")
def jn07_diff(spark, d):
    b = V.blobs(spark, d)
    return b.join(b.where("doc_id % 3 = 0").select("digest"), "digest", "left_anti").select("doc_id")


@query(f"with {V.BLOBS} select min(doc_id) as doc_id, digest, max(size) as size from blobs where lang = 'en' and digest not in (select digest from blobs where lang <> 'en' or doc_id % 5 = 0) group by digest")
def jn08_existing(spark, d):
    b = V.blobs(spark, d)
    new = b.where("lang = 'en'").join(b.where("lang <> 'en' or doc_id % 5 = 0").select("digest"), "digest", "left_anti")
    return new.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"))


LEDGER = f"{V.BLOBS}, ledger as (select doc_id, digest, size, sum(size) over (order by doc_id rows unbounded preceding)::bigint as off from blobs)"


@query(f"with {LEDGER} select doc_id from ledger where digest not in (select digest from ledger where off < 500000)")
def jn09_resume(spark, d):
    led = C.running_total(V.blobs(spark, d).select("doc_id", "digest", "size"), "size", "doc_id", "off")
    return led.join(led.where("off < 500000").select("digest"), "digest", "left_anti").select("doc_id")


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 12)")
def jn10_missing(spark, d):
    return V.read(spark, d, "orders").join(V.read(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'O')")
def jn14_subset(spark, d):
    return V.read(spark, d, "customer").join(V.read(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


STATUS = f"""{V.BLOBS}, t as (select 'f' || doc_id as name, size, case when doc_id % 13 = 0 then '' else digest end as digest, digest || 'z' as layer, 100 as m from blobs where doc_id % 5 <> 0),
    k as (select 'f' || doc_id as name, case when doc_id % 3 = 0 then size + 1 else size end as size, case when doc_id % 3 = 0 then 'other' when doc_id % 7 = 0 then '' else digest end as digest, case when doc_id % 4 = 0 then 200 else 50 end as m from blobs where doc_id % 6 <> 0),
    cached as (select distinct digest || 'z' as layer from blobs where doc_id % 2 = 0), virt as (select distinct digest as c from blobs where doc_id % 8 = 1),
    j as (select coalesce(t.name, k.name) as name, t.name is not null as known, k.name is not null as here, t.size ts, k.size ks, t.digest td, k.digest kd, t.m tm, k.m km, cached.layer is not null as c, virt.c is not null as v
      from t full join k on t.name = k.name left join cached on cached.layer = t.layer left join virt on virt.c = t.digest),
    s as (select name, (case when known then 1 else 0 end + case when known and c then 2 else 0 end + case when known and here and (tm < km or ts <> ks or td = '') then 4 else 0 end + case when known and here and kd <> '' and kd = td then 8 else 0 end
      + case when here and not known then 16 else 0 end + case when known and not here then 32 else 0 end + case when known and v then 64 else 0 end)::int as status from j)"""
ACTION = "case when status & 32 <> 0 then 'remove' when status & 16 <> 0 then 'insert' when status & 4 <> 0 and status & 8 = 0 then 'reset' else 'keep' end"


def status(spark, d):
    b = V.blobs(spark, d)
    i = F.col("doc_id")
    name = F.concat(F.lit("f"), i.cast("string")).alias("name")
    t = b.where("doc_id % 5 <> 0").select(name, "size", F.when(i % 13 == 0, "").otherwise(F.col("digest")).alias("digest"), F.concat("digest", F.lit("z")).alias("layer_digest"), F.lit(100).alias("modified"))
    k = b.where("doc_id % 6 <> 0").select(name, F.when(i % 3 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(i % 3 == 0, "other").when(i % 7 == 0, "").otherwise(F.col("digest")).alias("digest"), F.when(i % 4 == 0, 200).otherwise(50).alias("modified"))
    return C.part_status(t, k, b.where("doc_id % 2 = 0").select(F.concat("digest", F.lit("z")).alias("layer_digest")), b.where("doc_id % 8 = 1").select(F.col("digest").alias("content_id")))


@query(f"with {STATUS} select name, status from s")
def jn17_status(spark, d):
    return status(spark, d)


@query("""with m as (select conv_id, turn, role from conversations) select s.conv_id, count(*)::bigint as referrers, arg_max(case r.role when 'user' then 'signature' when 'assistant' then 'sbom' else 'report' end, r.turn) as kind
    from m s join m r on r.conv_id = s.conv_id and r.turn > 0 where s.turn = 0 group by 1""")
def jn19_referrers(spark, d):
    c = V.read(spark, d, "conversations").select("conv_id", "turn", "role")
    kind = F.when(F.col("role") == "user", "signature").when(F.col("role") == "assistant", "sbom").otherwise("report")
    r = c.where("turn > 0").groupBy("conv_id").agg(F.count("*").alias("referrers"), F.max_by(kind, "turn").alias("kind"))
    return c.where("turn = 0").select("conv_id").join(r, "conv_id")


@query("""with e as (select event_id, user_id % 40 as grp, user_id as digest, ts as last_seen from events), r as (select *, row_number() over (partition by grp order by case when digest < 500 then 0 when digest % 7 = 0 then 2 else 1 end, last_seen desc, digest, event_id) as rank from e)
    select grp, event_id, rank::int as rank from r""")
def jn22_bic_candidates(spark, d):
    e = V.read(spark, d, "events").select((F.col("user_id") % 40).alias("grp"), F.col("user_id").alias("digest"), F.col("ts").alias("last_seen"), F.col("event_id").alias("location"))
    return C.candidates(e, F.col("digest") < 500, F.col("digest") % 7 == 0, ["grp"]).select("grp", F.col("location").alias("event_id"), "rank")


@query(f"""with {V.PARSED}, p as (select * from parsed where ok) select a.doc_id, case when a.reg = 'docker.io' then 'mount' when b.reg is not null then 'cross-copy' else 'upload' end as plan
    from p a left join (select distinct reg from p where doc_id % 2 = 0) b on a.reg = b.reg""")
def jn24_mount_plan(spark, d):
    p = V.refs(spark, d).select("doc_id", R.parse(F.col("s")).alias("r")).where("r.ok").select("doc_id", "r.reg")
    have = p.where("doc_id % 2 = 0").select("reg").distinct().withColumn("have", F.lit(True))
    return p.join(have, "reg", "left").select("doc_id", F.when(F.col("reg") == "docker.io", "mount").when(F.col("have"), "cross-copy").otherwise("upload").alias("plan"))


@query("""with n as (select o_custkey as ref, max(o_orderkey) as commit from orders group by 1), o as (select o_custkey as ref, max(o_orderkey) as commit from orders where o_orderdate < timestamp '1997-01-01' group by 1)
    select n.ref, o.commit as old, n.commit as new from n left join o using (ref) where n.commit is distinct from o.commit""")
def jn25_ref_updates(spark, d):
    o = V.read(spark, d, "orders")
    new = o.groupBy(F.col("o_custkey").alias("ref")).agg(F.max("o_orderkey").alias("new"))
    old = o.where("o_orderdate < timestamp_ntz '1997-01-01'").groupBy(F.col("o_custkey").alias("ref")).agg(F.max("o_orderkey").alias("old"))
    return new.join(old, "ref", "left").where(~F.col("new").eqNullSafe(F.col("old"))).select("ref", "old", "new")


# ---------------------------------------------------------------- aggregates


@query(f"with {V.BLOBS}, e as (select media_type, digest, count(*) n, sum(size) a, max(size) one from blobs group by 1, 2) select media_type, sum(n)::bigint as occurrences, sum(a)::bigint as total, sum(one)::bigint as deduplicated, least(sum(a), sum(one))::bigint as transfer from e group by 1")
def agg01_bytes_dedup(spark, d):
    return G.byte_tracker(V.blobs(spark, d), "media_type").withColumn("transfer", F.least("total", "deduplicated"))


SEVS = ["Critical", "High", "Medium", "Low", "Negligible"]


@query(f"with {V.MATCHES} select reference, {', '.join(f'''count(*) filter (severity = '{s}')::bigint as {s.lower()}''' for s in SEVS)} from matches group by 1")
def agg05_severity_pivot(spark, d):
    return C.severity_pivot(V.matches(spark, d), SEVS)


@query(f"with {V.MATCHES} select reference, severity, array_to_string(list_sort(list(distinct cve_id)), ',') as cves from matches where severity = 'Critical' group by 1, 2")
def agg07_cve_list(spark, d):
    return V.matches(spark, d).where("severity = 'Critical'").groupBy("reference", "severity").agg(F.array_join(F.sort_array(F.collect_set("cve_id")), ",").alias("cves"))


@query(f"with {V.MATCHES} select cve_id, arg_max(reference, seq) as reference, arg_max(severity, seq) as severity from matches group by 1")
def agg08_distinct_cve(spark, d):
    return C.distinct_last(V.matches(spark, d), ["cve_id"], "seq").select("cve_id", "reference", "severity")


@query("""with p as (select l_orderkey, case l_linenumber % 3 when 0 then 'linux/amd64' when 1 then 'linux/arm64' else 'windows/amd64' end as platform from lineitem),
    c as (select platform, count(distinct l_orderkey) as n from p group by 1), t as (select count(*) as total from orders)
    select platform, n::bigint as n, round(least(100.0, n / total::double * 100), 2) as coverage from c, t""")
def agg09_platform_coverage(spark, d):
    n = F.col("l_linenumber") % 3
    p = V.read(spark, d, "lineitem").select("l_orderkey", F.when(n == 0, "linux/amd64").when(n == 1, "linux/arm64").otherwise("windows/amd64").alias("platform")).distinct()
    total = V.read(spark, d, "orders").count()
    return p.groupBy("platform").agg(F.count("*").alias("n")).withColumn("coverage", F.round(F.least(F.lit(100.0), F.col("n") / F.lit(float(total)) * 100), 2))


@query("""select sha256(text) as config, array_to_string(list_sort(list(distinct role || ':' || turn)), ',') as tags from conversations group by 1""")
def agg10_manifest_json(spark, d):
    return V.read(spark, d, "conversations").groupBy(F.sha2("text", 256).alias("config")).agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "role", F.col("turn").cast("string")))), ",").alias("tags"))


@query(f"with {V.BLOBS} select lang, sum(case when n_chars > 2000 then size else 0 end)::bigint as selected, sum(size)::bigint as total from blobs group by 1")
def agg11_selected_total(spark, d):
    return V.blobs(spark, d).groupBy("lang").agg(F.sum(F.when(L.selectors(["n>2000"], F.col("labels")), F.col("size")).otherwise(0)).alias("selected"), F.sum("size").alias("total"))


@query("""select o_custkey as name, o_orderpriority as artifact, max(o_orderkey) as n, printf('%06d-%s', max(o_orderkey), o_orderpriority) as sync_name from orders group by 1, 2""")
def agg13_tracker_latest(spark, d):
    return V.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("artifact")).agg(F.max("o_orderkey").alias("n")).withColumn("sync_name", F.format_string("%06d-%s", "n", "artifact"))


@query(f"with {V.BLOBS}, i as (select media_type, digest, max(size) s, max(doc_id) m from blobs group by 1, 2) select media_type as dir, sum(s)::bigint as size, max(m) as updated from i group by 1")
def agg14_dir_size(spark, d):
    i = V.blobs(spark, d).groupBy("media_type", "digest").agg(F.max("size").alias("s"), F.max("doc_id").alias("m"))
    return i.groupBy(F.col("media_type").alias("dir")).agg(F.sum("s").alias("size"), F.max("m").alias("updated"))


@query(f"with {V.WHEELS} select 'my-pkg-' || (p_partkey % 50) as project, count(*)::bigint as n from wheels where filename like '%.whl' group by 1")
def agg18_projects(spark, d):
    return V.wheels(spark, d).select(P.parse_wheel(F.col("filename"))["project"].alias("project")).where("project is not null").groupBy("project").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- windows, order


@query(f"with {LEDGER} select doc_id, off as \"offset\" from ledger")
def win02_ledger(spark, d):
    return C.running_total(V.blobs(spark, d).select("doc_id", "size"), "size", "doc_id", "offset").select("doc_id", "offset")


@query(f"""with {V.BLOBS}, c as (select doc_id, size, sum(size) over (order by doc_id rows unbounded preceding) as cum, sum(size) over () as total from blobs)
    select doc_id, total - (cum - size) > 400000 as "delete" from c""")
def win03_prune(spark, d):
    return C.prune_plan(V.blobs(spark, d).select("doc_id", "size"), 400000, "doc_id").select("doc_id", "delete")


@query("select conv_id, turn, coalesce(role <> lag(role) over (partition by conv_id order by turn), true) as divider from conversations")
def win05_divider(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return V.read(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.col("role") != F.lag("role").over(w), F.lit(True)).alias("divider"))


@query("""with m as (select conv_id, min(turn) filter (length(text) > 60) as cut from conversations group by 1) select c.conv_id, c.turn from conversations c join m using (conv_id) where c.turn >= m.cut""")
def win07_cutoff(spark, d):
    c = V.read(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return c.join(c.where("n > 60").groupBy("conv_id").agg(F.min("turn").alias("cut")), "conv_id").where("turn >= cut").select("conv_id", "turn")


@query(f"""with {V.URLS}, b as (select page_id, ref, regexp_extract(ref, '([^/]+/?)$', 1) as base, regexp_extract(ref, '([^/]+/[^/]+/?)$', 1) as two from urls)
    select page_id, case when count(*) over (partition by base) = 1 then base else two end as short from b""")
def win08_unique_names(spark, d):
    r = V.urls(spark, d)
    b = r.select("page_id", F.regexp_extract("ref", r"([^/]+/?)$", 1).alias("base"), F.regexp_extract("ref", r"([^/]+/[^/]+/?)$", 1).alias("two"))
    n = b.groupBy("base").agg(F.count("*").alias("n"))
    return b.join(n, "base").select("page_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.col("two")).alias("short"))


@query(f"with {V.MATCHES}, c as (select reference, count(*) filter (severity = 'Critical') as n from matches group by 1), r as (select *, row_number() over (order by n desc, reference) as rank from c) select reference, n::bigint as n, rank::int as rank from r where rank <= 10")
def srt04_top10(spark, d):
    top = V.matches(spark, d).groupBy("reference").agg(F.count_if(F.col("severity") == "Critical").alias("n")).orderBy(F.desc("n"), "reference").limit(10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "reference")).cast("int"))  # ten rows


# ---------------------------------------------------------------- sets


@query("select lang as k from documents union all select source from documents")
def set01_union(spark, d):
    x = V.read(spark, d, "documents")
    return x.select(F.col("lang").alias("k")).unionAll(x.select(F.col("source").alias("k")))


@query("select conv_id, bool_and(role in ('user', 'assistant', 'system')) as subset, bool_and(role in ('user', 'assistant')) as strict from conversations group by 1")
def set06_subset(spark, d):
    c = V.read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    arr = lambda *x: F.array(*map(F.lit, x))
    return c.select("conv_id", P.subset(F.col("r"), arr("user", "assistant", "system")).alias("subset"), P.subset(F.col("r"), arr("user", "assistant")).alias("strict"))


@query(f"with {V.EDGES} select parent, count(*) filter (child like 'part:%')::bigint as blobs, count(*) filter (child not like 'part:%')::bigint as manifests from edges group by 1")
def set08_split(spark, d):
    return V.edges(spark, d).groupBy("parent").agg(F.count_if(F.col("child").startswith("part:")).alias("blobs"), F.count_if(~F.col("child").startswith("part:")).alias("manifests"))


# ---------------------------------------------------------------- graphs


def root(spark, name="region:0"):
    return spark.createDataFrame([(name,)], "node string")


WALK = f"""{V.EDGES}, w as (
    select 'region:0' as node, 0 as level, 1::bigint as paths
    union all select child, level + 1, paths from w join edges on parent = node)"""


@query(f"with recursive {WALK} select node, sum(paths)::bigint as occurrences from w where node like 'part:%' group by 1")
def gr03_blob_paths(spark, d):
    return G.path_counts(V.edges(spark, d), root(spark), 8).where("node like 'part:%'").groupBy("node").agg(F.sum("paths").alias("occurrences"))


@query(f"with recursive {WALK} select level, count(distinct node)::bigint as nodes from w group by 1")
def gr06_closure_levels(spark, d):
    return G.closure(V.edges(spark, d), root(spark)).groupBy("level").agg(F.count("*").alias("nodes"))


@query("""with recursive e as (select 'all' as parent, 'region:' || r_regionkey as child, r_regionkey as ordinal from region union all select 'region:' || n_regionkey, 'nation:' || n_nationkey, n_nationkey from nation
    union all select 'nation:' || c_nationkey, 'customer:' || c_custkey, c_custkey from customer union all select 'customer:' || o_custkey, 'order:' || o_orderkey, o_orderkey from orders),
    w as (select 'all' as node, '' as path union all select child, path || lpad(ordinal::varchar, 9, '0') from w join e on parent = node), f as (select node, min(path) as path from w group by 1)
    select node, row_number() over (order by path)::bigint as seq from f""")
def gr04_dfs_order(spark, d):
    top = V.read(spark, d, "region").select(F.lit("all").alias("parent"), F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("child"), F.col("r_regionkey").cast("long").alias("ordinal"))
    return G.write_order(V.edges(spark, d).where("not (child like 'part:%')").union(top), "all").select("node", F.col("seq").cast("long").alias("seq"))


@query(f"with {V.EDGES} select parent, child from edges where child like 'part:%' and substr(child, 6)::bigint % 10 = 0")
def gr16_integrity(spark, d):
    e = V.edges(spark, d)
    have = e.select(F.col("child").alias("node")).where("not (node like 'part:%' and cast(substring(node, 6) as bigint) % 10 = 0)").distinct()
    return G.dangling(e, have).select("parent", "child")


@query("""with recursive e as (select conv_id, turn from conversations), w as (select conv_id, max(turn) as turn, max(turn) as head from e group by 1
    union all select w.conv_id, e.turn, w.head from w join e on e.conv_id = w.conv_id and e.turn = w.turn - 1) select conv_id, head, count(*)::bigint as ancestors from w group by 1, 2""")
def gr12_ancestry(spark, d):
    c = V.read(spark, d, "conversations").select("conv_id", "turn")
    node = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    e = c.join(c.select("conv_id", (F.col("turn") + 1).alias("turn")), ["conv_id", "turn"]).select(node(F.col("turn")).alias("parent"), node(F.col("turn") - 1).alias("child"))
    heads = c.groupBy("conv_id").agg(F.max("turn").alias("head"))
    up = G.closure(e, heads.select(node(F.col("head")).alias("node")))
    return up.groupBy(F.substring_index("node", ":", 1).cast("long").alias("conv_id")).agg(F.count("*").alias("ancestors")).join(heads, "conv_id").select("conv_id", "head", "ancestors")


@query(f"""with recursive {V.EDGES}, lost as (select distinct child as node from edges where child like 'part:%' and substr(child, 6)::bigint % 500 = 1),
    bad as (select node, 0 as l from lost union select parent, 0 from bad join edges on child = node) select distinct parent as node from edges where parent not in (select node from bad)""")
def str01_complete_set(spark, d):
    e = V.edges(spark, d)
    arrived = e.select(F.col("child").alias("node")).where("not (node like 'part:%' and cast(substring(node, 6) as bigint) % 500 = 1)").union(e.select("parent").where("parent like 'region:%'")).distinct()
    return G.complete(e, arrived)


@query(f"with {V.EDGES} select distinct child as node from edges where child like 'part:%' and substr(child, 6)::bigint % 500 = 1")
def str02_missing(spark, d):
    e = V.edges(spark, d)
    return G.missing(e, e.select(F.col("child").alias("node")).where("not (node like 'part:%' and cast(substring(node, 6) as bigint) % 500 = 1)").distinct())


@query(f"with {LEDGER} select doc_id, floor((off - 1) / 65536)::bigint as block from ledger where size > 0")
def str07_blocks(spark, d):
    return C.running_total(V.blobs(spark, d).select("doc_id", "size"), "size", "doc_id", "off").where("size > 0").select("doc_id", F.floor((F.col("off") - 1) / 65536).cast("long").alias("block"))


@query("select conv_id, sha256(string_agg(text, '' order by turn)) as payload from conversations group by 1")
def str09_mux_roundtrip(spark, d):
    from cairn.streaming.mux import demux, mux

    c = V.read(spark, d, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("seq"), F.encode("text", "utf-8").alias("payload"))
    return demux(mux(c)).select(F.col("stream").cast("long").alias("conv_id"), F.sha2("payload", 256).alias("payload"))


# ---------------------------------------------------------------- documents (DML)


@query(f"with {STATUS} select name, {ACTION} as action from s")
def dml02_merge(spark, d):
    return status(spark, d).select("name", C.action(F.col("status")).alias("action"))


@query("""select doc_id, '{"lang":"' || lang || '","source":"new","tier":"' || case when n_chars > 2000 then 'big' else 'small' end || '"}' as labels from documents""")
def dml03_labels(spark, d):
    x = V.blobs(spark, d)
    put = F.map_concat(F.map_filter("labels", lambda k, v: ~k.isin("n", "source")), F.create_map(F.lit("source"), F.lit("new"), F.lit("tier"), F.when(F.element_at("labels", "n").cast("long") > 2000, "big").otherwise("small")))
    return x.select("doc_id", F.to_json(put).alias("labels"))


@query("""select c_custkey, 'a=' || c_mktsegment || ',' || case when c_custkey % 2 = 0 then 'b=new,c=3' else 'b=2,c=3,d=new' end as sources from customer""")
def dml05_upsert(spark, d):
    old = F.array(F.struct(F.lit("a").alias("name"), F.col("c_mktsegment").alias("uri")), F.struct(F.lit("b").alias("name"), F.lit("2").alias("uri")), F.struct(F.lit("c").alias("name"), F.lit("3").alias("uri")))
    name = F.when(F.col("c_custkey") % 2 == 0, "b").otherwise("d")
    new = C.upsert_item(F.col("s"), F.struct(name.alias("name"), F.lit("new").alias("uri")), lambda x: x["name"] == name)
    return V.read(spark, d, "customer").select("c_custkey", old.alias("s")).select("c_custkey", F.array_join(F.transform(new, lambda x: F.concat_ws("=", x["name"], x["uri"])), ",").alias("sources"))


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'upd' else c_mktsegment end as seg from customer union all select -s_suppkey, 'ins' from supplier""")
def dml17_replace_by_key(spark, d):
    c = V.read(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("upd").alias("seg")).union(V.read(spark, d, "supplier").select(-F.col("s_suppkey"), F.lit("ins")))
    return C.upsert(c, new, ["c_custkey"])


# ---------------------------------------------------------------- extension points, codecs, extras


@query()
def udf01_template(spark, d):
    from cairn.functions.template import template_mapper

    text = '{{ if hasPrefix .Ref "m." }}mobile/{{ .Ref }}\n{{ else if contains .Ref "example.org" }}org/{{ trimPrefix .Ref "th" }}\n{{ end }}all/{{ .Ref }}'
    return template_mapper(V.urls(spark, d), text, {"Ref": "ref"}).select("page_id", "dest")


@query("select doc_id, sha256(text) as sha, strlen(text)::bigint as size from documents")
def cdc01_tar_roundtrip(spark, d):
    from cairn.sources.archives import pack, unpack

    files = V.read(spark, d, "documents").select((F.col("doc_id") % 16).cast("int").alias("archive"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("content"))
    return unpack(pack(files)).select(F.regexp_extract("path", r"docs/([0-9]+)\.txt", 1).cast("long").alias("doc_id"), F.sha2("content", 256).alias("sha"), F.octet_length("content").cast("long").alias("size"))


@query("select quality, bool_and(toxic = 0) as verified, count(*) filter (toxic = 1)::bigint as failed from labels group by 1")
def sig02_verify_all(spark, d):
    return V.read(spark, d, "labels").groupBy("quality").agg(F.bool_and(F.col("toxic") == 0).alias("verified"), F.count_if(F.col("toxic") == 1).alias("failed"))


@query("select time_bucket(interval '1 hour', ts) as hour, event_type, count(*)::bigint as n from events group by 1, 2")
def ext_tumbling(spark, d):
    return V.read(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


# ---------------------------------------------------------------- artifact lists, sinks' rows, lineage


GATHERS = "node like 'region:%' or node like 'nation:%'"
NESTED = f"""{V.EDGES}, w as (select 'region:' || r_regionkey as root, 'region:' || r_regionkey as node from region
    union select root, child from w join edges on parent = node where {GATHERS.replace("node", "parent")}),
    nested as (select distinct root, node from w where not ({GATHERS}))"""


def nested(spark, d):
    e = V.edges(spark, d)
    gathers = e.select(F.col("parent").alias("node")).where(GATHERS).distinct()
    return A.nested_images(e, V.read(spark, d, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node")), gathers)


@query(f"with recursive {NESTED} select root, node from nested")
def gr07_nested(spark, d):
    return nested(spark, d).select("root", "node")


@query(f"""with recursive {NESTED}, have as (select 'nation:3' as node union select 'nation:7' union select child from have join edges on parent = node) select node, min(root) as root from nested where node not in (select node from have) group by 1""")
def gr08_list(spark, d):
    have = spark.createDataFrame([("nation:3",), ("nation:7",)], "node string")
    return A.list_images(nested(spark, d), V.edges(spark, d), have).select("node", "root")


@query(f"""with recursive {V.EDGES}, w as (select 'nation:3' as node, '' as path, 0 as depth
    union all select child, path || lpad(ordinal::varchar, 9, '0'), depth + 1 from w join edges on parent = node where depth < 3),
    f as (select node, min(path) as met from w group by 1)
    select e.path, e.depth, repeat('  ', e.depth) || e.node || case when e.path <> f.met then ' (repeated)' else '' end as line, e.path <> f.met as again from w e join f using (node) where e.depth > 0""")
def gr09_tree(spark, d):
    return A.tree(V.edges(spark, d), "nation:3", 3)


@query("""select 'customer:' || o_custkey as index, coalesce(case when o_orderkey % 3 > 0 then 'linux' end, 'unknown') || '/' || coalesce(case when o_orderkey % 4 > 0 then 'amd64' end, 'unknown') as platform,
    l_orderkey || ':' || l_linenumber as referrer from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'A'""")
def gr11_sbom_map(spark, d):
    o, k = V.read(spark, d, "orders"), F.col("o_orderkey")
    e = o.select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("index"), k.alias("manifest"))
    m = o.select(k.alias("manifest"), F.when(k % 3 > 0, "linux").alias("os"), F.when(k % 4 > 0, "amd64").alias("architecture"))
    r = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("subject"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("referrer"), F.col("l_returnflag").alias("artifact_type"))
    return A.sbom_map(e, m, r, "A")


@query("""with c as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as k, max(turn) over (partition by conv_id) as head, text from conversations)
    select distinct conv_id || ':' || head as ref, sha256(text) as oid from c where k % 2 = 1 and text is not null""")
def gr15_lfs(spark, d):
    c = V.read(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    node = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    t = c.select("conv_id", "text", F.row_number().over(w).alias("k"), node(F.col("turn")).alias("node"), F.when(F.lag("turn").over(w).isNotNull(), node(F.lag("turn").over(w))).alias("child"), node(F.max("turn").over(Window.partitionBy("conv_id"))).alias("head"))
    heads = t.select(F.col("head").alias("root"), F.col("head").alias("node")).distinct()
    reach = A.labelled_closure(t.where("child is not null").select(F.col("node").alias("parent"), "child"), heads)
    files = t.where("k % 2 = 1 and text is not null").select("node", F.sha2("text", 256).alias("oid"))
    return reach.join(files, "node").select(F.col("root").alias("ref"), "oid").distinct()


@query("""with t as (select doc_id, max(doc_id) over (partition by sha256(text)) as latest from documents where text is not null) select doc_id, latest from t where doc_id < latest""")
def gr19_lineage(spark, d):
    t = V.read(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    links = t.select(F.lead("doc_id").over(Window.partitionBy("h").orderBy("doc_id")).alias("newer"), F.col("doc_id").alias("older")).where("newer is not null")
    return A.latest_of(links).select(F.col("node").alias("doc_id"), "latest")


@query("""with c as (select l_partkey, l_suppkey || '/' || l_orderkey as ref, row_number() over (partition by l_partkey order by l_suppkey, l_orderkey * 10 + l_linenumber) as k from lineitem where l_linestatus = 'O') select l_partkey, ref from c where k = 1""")
def gr20_resolve(spark, d):
    c = V.read(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("server"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.concat_ws("/", F.col("l_suppkey").cast("string"), F.col("l_orderkey").cast("string")).alias("ref"), (F.col("l_linestatus") == "O").alias("valid"))
    return A.first_valid(c, "l_partkey")


@query(f"""with {V.URLS}, p as (select a.page_id, a.ref as x, b.ref as y from urls a join urls b on b.page_id = a.page_id + 1),
    r as (select *, list_reverse(string_split(x, '/')) as rx, list_reverse(string_split(y, '/')) as ry from p),
    n as (select *, (select min(i) from range(1, greatest(len(rx), len(ry)) + 1) as t(i) where rx[i] is distinct from ry[i]) as n from r)
    select page_id, case when x = y then x else array_to_string(list_filter(list_reverse(rx[1:n]), lambda s: s <> ''), '/') end as a,
    case when x = y then y else array_to_string(list_filter(list_reverse(ry[1:n]), lambda s: s <> ''), '/') end as b from n""")
def fn31_distinct_suffixes(spark, d):
    u = V.urls(spark, d)
    p = u.withColumnRenamed("ref", "x").join(u.select((F.col("page_id") - 1).alias("page_id"), F.col("ref").alias("y")), "page_id")
    return p.select("page_id", A.distinct_suffixes(F.col("x"), F.col("y")).alias("s")).select("page_id", "s.*")


@query("""with v as (select p_partkey, p_partkey % 4 as a, p_partkey % 10 as b, (['', '-rc.1', '-rc.10', '-rc.beta', '-alpha', '+meta'])[p_partkey % 6 + 1] as tail from part)
    select p_partkey, case when p_partkey % 17 = 0 then null when (a, b) <> (2, 5) then (a, b) > (2, 5) else tail not in ('-rc.1', '-alpha') end as ok from v""")
def fn35_version_minimum(spark, d):
    k = F.col("p_partkey")
    tail = F.element_at(F.array(*map(F.lit, ("", "-rc.1", "-rc.10", "-rc.beta", "-alpha", "+meta"))), (k % 6 + 1).cast("int"))
    v = F.when(k % 17 == 0, "git version").otherwise(F.concat((k % 4).cast("string"), F.lit("."), (k % 10).cast("string"), tail))
    return V.read(spark, d, "part").select(k, A.version_ok(v, F.lit("2.5.0-rc.2")).alias("ok"))


@query("""select conv_id, '[' || string_agg('"' || sha256(text) || '"', ',' order by turn) || ']' as thumbprints from conversations where text is not null group by 1""")
def fn51_thumbprints(spark, d):
    chain = V.read(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    return chain.select("conv_id", A.thumbprints(F.col("c.text")).alias("thumbprints"))


@query("""with p as (select regexp_replace(url, '^[a-z]+://', '') as path, strlen(html)::bigint as size from pages), s as (select * from p where not regexp_matches(path, '(^|/)\\.'))
    select split_part(path, '/', 1) as part, case when bool_or(contains(path, '/')) then 'dir' else 'file' end as kind, sum(size)::bigint as size, coalesce(bool_or(size = 0), false) as error from s group by 1""")
def src10_walk_parts(spark, d):
    f = V.read(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.octet_length("html").cast("long").alias("size"))
    return A.walk_parts(f).withColumn("error", F.coalesce("error", F.lit(False)))


@query("select p_partkey from part where p_partkey % 4 <> 1 and p_partkey % 5 = 2")
def src24_stored_index(spark, d):
    k = F.col("p_partkey")
    rows = V.read(spark, d, "part").select(k, F.when(k % 4 == 1, "4").otherwise("5").alias("index_version"), (k % 5 + 5).cast("string").alias("row_version"))
    return A.stored_index(rows).select("p_partkey")


@query(f"""with {V.BLOBS} select digest, max(size)::bigint as size, bool_and(doc_id % 9 <> 0) as verified from blobs where digest is not null and digest not in (select digest from blobs where digest is not null and lang = 'fr') group by 1""")
def snk03_save_blobs(spark, d):
    b = V.blobs(spark, d).where("digest is not null").join(V.read(spark, d, "documents").select("doc_id", F.encode("text", "utf-8").alias("content")), "doc_id")
    b = b.withColumn("content", F.when(F.col("doc_id") % 9 == 0, F.encode(F.lit("broken"), "utf-8")).otherwise(F.col("content")))
    return A.save_blobs(b, b.where("lang = 'fr'"))


@query("""with p as (select distinct 'pkg-' || (p_partkey % 50) as project, p_partkey % 50 % 7 = 0 as failed from part)
    select project, 0::bigint as line_no, '# "' || project || '" ' || case when failed then 'failed to process with error not found' else 'processed successfully' end as line from p
    union all select project, p_partkey, project || ' >=' || p_size from part join p on project = 'pkg-' || (p_partkey % 50) where failed""")
def snk13_failed_requirements(spark, d):
    k, name = F.col("p_partkey"), F.concat(F.lit("pkg-"), (F.col("p_partkey") % 50).cast("string"))
    part = V.read(spark, d, "part")
    projects = part.select(name.alias("project"), F.when(k % 50 % 7 == 0, "not found").alias("error")).distinct()
    return A.failed_requirements(projects, part.select(name.alias("project"), k.alias("no"), F.concat(name, F.lit(" >="), F.col("p_size").cast("string")).alias("requirement")))


@query("""with i as (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as k from customer), m as (select c_nationkey, max(k) as n from i group by 1)
    select c_nationkey, 'os' || k as os, null::varchar as architecture, k::bigint as ordinal, case when k = 2 then 'new' else 'old' || c_custkey end as digest from i
    union all select c_nationkey, 'plan9', null, n + 1, 'added' from m""")
def snk15_replace_platform(spark, d):
    c, none = V.read(spark, d, "customer"), F.lit(None).cast("string")
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    i = c.select("c_nationkey", F.concat(F.lit("os"), k.cast("string")).alias("os"), none.alias("architecture"), none.alias("variant"), k.cast("long").alias("ordinal"), F.concat(F.lit("old"), F.col("c_custkey").cast("string")).alias("digest"))
    new = i.where("ordinal = 2").select("c_nationkey", "os", "architecture", "variant", F.lit("new").alias("digest")).union(c.select("c_nationkey", F.lit("plan9"), none, none, F.lit("added")).distinct())
    return A.replace_platforms(i, new, ["c_nationkey"]).drop("variant")


@query(f"with {V.BLOBS} select digest, min(doc_id % 3 + 1)::int as sync from blobs where digest is not null group by 1")
def str05_batch_serialize(spark, d):
    b = V.blobs(spark, d).where("digest is not null")
    known = spark.createDataFrame([], "digest string, sync int")
    for n in (1, 2, 3):
        known = G.cut(known.unionByName(A.serialize_batch(known, b.where(F.col("doc_id") % 3 == n - 1), n)))
    return known


from cairn.plans import artifacts, cache  # noqa: E402, F401  their queries register here
