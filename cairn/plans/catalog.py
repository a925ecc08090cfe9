"""Catalog views over the test tables: the same rows in Spark and, as SQL, for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def blobs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as blobs: digest, size, media type, labels."""
    return read(spark, d, "documents").select("doc_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("size"), F.col("source").alias("media_type"), F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("n"), F.col("n_chars").cast("string")).alias("labels"), "lang")


BLOBS = "blobs as (select doc_id, 'sha256:' || sha256(text) as digest, strlen(text)::bigint as size, source as media_type, lang, n_chars from documents)"


def refs(spark: SparkSession, d: str) -> DataFrame:
    """References made of documents, some of them malformed."""
    i = F.col("doc_id")
    tail = F.when(i % 6 == 0, F.lit("")).when(i % 6 == 1, F.concat(F.lit(":v"), (i % 7).cast("string"))).when(i % 6 == 2, F.concat(F.lit("@sha256:"), F.sha2("text", 256))).when(i % 6 == 3, F.concat(F.lit(":v1@sha256:"), F.sha2("text", 256))).when(i % 6 == 4, F.lit("@sha256:bad")).otherwise(F.lit("/"))
    head = F.when(i % 4 == 0, F.lit("http://")).when(i % 4 == 1, F.lit("bottle:")).otherwise(F.lit(""))
    reg = F.when(i % 3 == 0, F.lit("docker.io")).otherwise(F.concat(F.lit("reg"), (i % 5).cast("string"), F.lit(".example.com")))
    return read(spark, d, "documents").select("doc_id", F.concat(head, reg, F.when(i % 11 == 0, F.lit("/LOW")).otherwise(F.lit("/low")), F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), tail).alias("s"))


REFS = """refs as (select doc_id,
    case doc_id % 4 when 0 then 'http://' when 1 then 'bottle:' else '' end
    || case when doc_id % 3 = 0 then 'docker.io' else 'reg' || (doc_id % 5) || '.example.com' end
    || case when doc_id % 11 = 0 then '/LOW' else '/low' end || '/' || source || '/' || lang
    || case doc_id % 6 when 0 then '' when 1 then ':v' || (doc_id % 7) when 2 then '@sha256:' || sha256(text)
       when 3 then ':v1@sha256:' || sha256(text) when 4 then '@sha256:bad' else '/' end as s from documents)"""
PARSED = REFS + """,
    cutref as (select doc_id, s, regexp_replace(s, '^(http|https|bottle|hash):(//)?', '') as rest from refs),
    two as (select *, split_part(rest, '/', 1) as reg, regexp_replace(rest, '^[^/]*/?', '') as path from cutref),
    three as (select *, split_part(path, '@', 1) as head, case when contains(path, '@') then regexp_replace(path, '^[^@]*@', '') else '' end as dig from two),
    parsed as (select doc_id, s, case when s like 'https:%' then 'https' when s like 'bottle:%' then 'bottle' when s like 'http:%' then 'http' when s like 'hash:%' then 'hash' else '' end as scheme,
        reg, regexp_replace(split_part(head, ':', 1), '/?[^/]*$', '') as repo, regexp_extract(split_part(head, ':', 1), '([^/]*)$', 1) as name,
        case when dig similar to '[a-z0-9]+:[0-9a-f]{32,}' then dig else '' end as digest,
        case when contains(head, ':') then regexp_replace(head, '^[^:]*:', '') when dig similar to '[a-z0-9]+:[0-9a-f]{32,}' then '' else 'latest' end as tag,
        s not like '%/' and contains(rest, '/') and (split_part(head, ':', 1) similar to '[a-z0-9]+([._/-]+[a-z0-9]+)*') as ok from three)"""


def urls(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("ref"))


URLS = "urls as (select page_id, regexp_replace(url, '^[a-z]+://', '') as ref from pages)"


def matches(spark: SparkSession, d: str) -> DataFrame:
    """Line items as scan findings."""
    q = F.col("l_quantity")
    sev = F.when(q > 45, F.lit("Critical")).when(q > 35, F.lit("High")).when(q > 20, F.lit("Medium")).when(q > 8, F.lit("Low")).when(q > 3, F.lit("Negligible")).otherwise(F.lit("Unknown"))
    return read(spark, d, "lineitem").select(F.concat(F.lit("img-"), F.col("l_suppkey").cast("string")).alias("reference"), F.concat(F.lit("CVE-"), F.col("l_partkey").cast("string")).alias("cve_id"), sev.alias("severity"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


MATCHES = """matches as (select 'img-' || l_suppkey as reference, 'CVE-' || l_partkey as cve_id,
    case when l_quantity > 45 then 'Critical' when l_quantity > 35 then 'High' when l_quantity > 20 then 'Medium' when l_quantity > 8 then 'Low' when l_quantity > 3 then 'Negligible' else 'Unknown' end as severity,
    l_orderkey * 10 + l_linenumber as seq from lineitem)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """region, nation, customer, order, part as a graph in which parts are shared: (parent, child, ordinal)."""
    n, c, o, li = (read(spark, d, t) for t in ("nation", "customer", "orders", "lineitem"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return (
        n.select(name("region:", "n_regionkey").alias("parent"), name("nation:", "n_nationkey").alias("child"), F.col("n_nationkey").cast("long").alias("ordinal"))
        .union(c.select(name("nation:", "c_nationkey"), name("customer:", "c_custkey"), "c_custkey"))
        .union(o.select(name("customer:", "o_custkey"), name("order:", "o_orderkey"), "o_orderkey"))
        .union(li.select(name("order:", "l_orderkey"), name("part:", "l_partkey"), "l_partkey").distinct())
    )


EDGES = """edges as (
    select 'region:' || n_regionkey as parent, 'nation:' || n_nationkey as child, n_nationkey::bigint as ordinal from nation
    union all select 'nation:' || c_nationkey, 'customer:' || c_custkey, c_custkey from customer
    union all select 'customer:' || o_custkey, 'order:' || o_orderkey, o_orderkey from orders
    union all select distinct 'order:' || l_orderkey, 'part:' || l_partkey, l_partkey from lineitem)"""


def wheels(spark: SparkSession, d: str) -> DataFrame:
    """Parts as names of distributions."""
    k = F.col("p_partkey")
    tag = F.element_at(F.array(*[F.lit(x) for x in ("manylinux2014_x86_64", "win_amd64", "win32", "macosx_11_0_arm64", "any", "musllinux_1_1_aarch64")]), (k % 6 + 1).cast("int"))
    name = F.concat(F.lit("My.Pkg_"), (k % 50).cast("string"))
    version = F.concat((k % 4).cast("string"), F.lit("."), (k % 10).cast("string"), F.when(k % 3 == 0, F.lit(".1+local")).otherwise(F.lit("")))
    file = F.when(k % 5 == 0, F.concat(name, F.lit("-"), version, F.lit(".tar.gz"))).when(k % 7 == 0, F.concat(name, F.lit("-"), version, F.lit(".exe"))).otherwise(F.concat(name, F.lit("-"), version, F.when(k % 2 == 0, F.lit("-1")).otherwise(F.lit("")), F.lit("-py2.py3-none-"), tag, F.lit(".whl")))
    return read(spark, d, "part").select(k, file.alias("filename"), F.when(k % 9 == 0, F.lit("")).alias("yanked"), "p_size")


WHEELS = """wheels as (select p_partkey, 'My.Pkg_' || (p_partkey % 50) || '-' || (p_partkey % 4) || '.' || (p_partkey % 10) || case when p_partkey % 3 = 0 then '.1+local' else '' end
    || case when p_partkey % 5 = 0 then '.tar.gz' when p_partkey % 7 = 0 then '.exe' else case when p_partkey % 2 = 0 then '-1' else '' end || '-py2.py3-none-'
       || (['manylinux2014_x86_64', 'win_amd64', 'win32', 'macosx_11_0_arm64', 'any', 'musllinux_1_1_aarch64'])[p_partkey % 6 + 1] || '.whl' end as filename,
    case when p_partkey % 9 = 0 then '' end as yanked, p_size from part)"""
