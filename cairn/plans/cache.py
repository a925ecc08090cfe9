"""Queries of codecs and the cache, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import codecs as C
from cairn.operators import cache as K
from cairn.operators import graph as G
from cairn.plans import catalog as V
from cairn.plans.queries import query
from cairn.sources.lists import source_refs

PARTS = """parts as (select doc_id as key, 'p' || doc_id as name, 'sha256:' || sha256(text) as digest, case doc_id % 3 when 0 then 'layer.raw' when 1 then 'layer+zstd' else 'layer.tar' end as media_type,
    case when doc_id % 4 > 0 then 'sha256:' || sha256(media_type || text) end as layer_digest, case when doc_id % 5 = 0 then 'none' else 'best' end as compression, source from documents where text is not null),
    virtual as (select digest as content_id from parts where source = 'src1'), cached as (select layer_digest as digest from parts where source = 'src2')"""


def parts(spark, d):
    i = F.col("doc_id")
    sha = lambda c: F.concat(F.lit("sha256:"), F.sha2(c, 256))
    form = F.when(i % 3 == 0, "layer.raw").when(i % 3 == 1, "layer+zstd").otherwise("layer.tar")
    x = V.read(spark, d, "documents").where("text is not null").select(
        i.alias("key"), F.concat(F.lit("p"), i.cast("string")).alias("name"), sha("text").alias("digest"), F.when(i % 4 > 0, sha(F.concat(form, "text"))).alias("layer_digest"), form.alias("media_type"),
        F.create_map(F.lit("compression"), F.when(i % 5 == 0, "none").otherwise("best")).alias("labels"), "source", F.encode("text", "utf-8").alias("content"))
    virtual = x.where("source = 'src1'").select(F.col("digest").alias("content_id"))
    return x, virtual, x.where("source = 'src2'").select(F.col("layer_digest").alias("digest"))


@query("""select doc_id, case doc_id % 4 when 0 then 'zstd' when 1 then 'gzip' else '' end as codec, 'sha256:' || sha256(text) as digest, strlen(text)::bigint as size from documents where text is not null""")
def cdc03_codec_roundtrip(spark, d):
    i = F.col("doc_id")
    name = F.when(i % 4 == 0, "zstd").when(i % 4 == 1, "gzip").when(i % 4 == 2, "lzma").otherwise("")
    x = V.read(spark, d, "documents").where("text is not null").select("doc_id", C.chosen(name).alias("codec"), F.encode("text", "utf-8").alias("raw"))
    back = x.withColumn("raw", C.decode(C.encode(F.col("raw"), F.col("codec")), F.col("codec")))
    return back.select("doc_id", "codec", F.concat(F.lit("sha256:"), F.sha2("raw", 256)).alias("digest"), F.octet_length("raw").cast("long").alias("size"))


@query(f"""with {PARTS} select key, name from parts where compression <> 'none' and media_type <> 'layer.raw' and digest not in (select content_id from virtual)
    and (layer_digest is null or layer_digest not in (select digest from cached where digest is not null))""")
def cdc04_to_archive(spark, d):
    return K.to_archive(*parts(spark, d)).select("key", "name")


@query("""select doc_id as key, case when doc_id % 2 = 0 then 'kept' else 'sha256:' || sha256(text) end as digest, case when doc_id % 2 = 0 then 'kept' else 'sha256:' || sha256(text) end as layer_digest,
    case when doc_id % 2 = 1 then strlen(text)::bigint end as size from documents where text is not null""")
def cdc05_digest_parts(spark, d):
    old = F.when(F.col("key") % 2 == 0, "kept")
    x = parts(spark, d)[0].select("key", "content", old.alias("digest"), old.alias("layer_digest"))
    return K.digest_parts(x, F.lit("")).select("key", "digest", "layer_digest", "size")


@query(f"""with {PARTS} select layer_digest, min(name) as name from parts where layer_digest is not null and digest not in (select content_id from virtual)
    and layer_digest not in (select digest from cached where digest is not null) group by 1""")
def cdc05_to_commit(spark, d):
    x, virtual, cached = parts(spark, d)
    return K.to_commit(x.where("layer_digest is not null"), virtual, cached)


@query(f"""with {PARTS} select key, coalesce(layer_digest in (select digest from cached where digest is not null), false) as copied,
    case when layer_digest in (select digest from cached where digest is not null) then digest end as digest from parts""")
def cdc06_from_cache(spark, d):
    x = parts(spark, d)[0]
    stored = F.when(F.col("media_type") == "layer+zstd", "zstd").otherwise("")
    blobs = x.where("source = 'src2' and layer_digest is not null").select(F.col("layer_digest").alias("digest"), C.encode(F.col("content"), stored).alias("content"))
    got = K.from_cache(x.drop("content"), blobs)
    return got.select("key", "copied", F.when(F.col("copied"), F.concat(F.lit("sha256:"), F.sha2("content", 256))).alias("digest"))


@query(f"""with {PARTS} select distinct digest, digest in (select content_id from virtual) as found from parts""")
def str13_existence(spark, d):
    x, virtual, _ = parts(spark, d)
    return K.existence(x, virtual.select(F.col("content_id").alias("digest")))


@query(f"""with {V.BLOBS} select media_type, count(*)::bigint as occurrences, sum(size)::bigint as total, (select sum(s) from (select max(size) as s from blobs b where b.media_type is not distinct from o.media_type group by b.digest))::bigint as deduplicated
    from blobs o group by media_type""")
def agg02_printed_bytes(spark, d):
    return G.byte_tracker(V.blobs(spark, d), "media_type")


@query(f"with {V.WHEELS} select p_partkey, row_number() over (order by filename, p_partkey)::bigint as place from wheels")
def srt06_by_filename(spark, d):
    return K.by_filename(V.wheels(spark, d), "p_partkey").select("p_partkey", "place")


@query("""select c_name as ref, c_name as pinned from customer""")
def src22_source_refs(spark, d):
    return source_refs(V.read(spark, d, "customer").select(F.col("c_name").alias("name")))
