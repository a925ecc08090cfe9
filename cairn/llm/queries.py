"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, jaccard, knn, langid, linededup, mix, pstable, substring, toxicity, warc
from cairn.llm.common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    uri = f"{scratch.dir}/archive"  # goes with the session
    warc.write_warc(table(spark, sf_dir, "pages"), uri, scratch)
    return warc.read_warc(spark, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(fold(5) != 0)
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(table(spark, sf_dir, "documents"), fold(4) != 2)
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pstable.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mix, op2_line_dedup, op3_warc, op4_ngram_jaccard, op5_exact_topk, op6_substring_dedup, op7_toxicity, op8_bpe, op9_language_id, op10_embedding_neardup, pipeline)}

ORACLE_SQL = {
    "op2_line_dedup": """
        with lines as (
            select doc_id, generate_subscripts(l, 1) - 1 as no, unnest(l) as s
            from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)),
        wins as (
            select doc_id, no, s, lead(s) over (partition by doc_id order by no) as s2,
                   count(*) over (partition by doc_id) as n
            from lines),
        later as (
            select doc_id, no, row_number() over (partition by s, s2 order by doc_id, no) as k
            from wins where no < n - 1),
        gone as (
            select distinct doc_id, no + d as no from later, (values (0), (1)) as o(d) where k > 1),
        kept as (
            select l.doc_id, count(*) as n_lines, count(g.no) as n_removed,
                   coalesce(string_agg(l.s, chr(10) order by l.no) filter (where g.no is null), '') as t
            from lines l left join gone g on l.doc_id = g.doc_id and l.no = g.no group by l.doc_id)
        select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
               case when d.text is null then null else sha256(t) end as kept_sha256
        from documents d left join kept using (doc_id)""",
    "op3_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        d as (select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as payload_digest from p),
        m as (select payload_digest, max(page_id) as top from d where payload_bytes >= 1000 group by 1)
        select d.page_id, payload_bytes, d.payload_digest,
               case when top > d.page_id then 'revisit' else 'response' end as record_type,
               case when top > d.page_id then top end as refers_to
        from d left join m on m.payload_digest = d.payload_digest and payload_bytes >= 1000""",
    "op5_exact_topk": """
        with ok as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
            where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select a.vec_id as query_id, b.vec_id, list_inner_product(a.q::double[], b.q::double[])::bigint as score
            from ok a join ok b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, rank::int as rank, vec_id, score from r where rank <= 5""",
}
