"""A training-data pipeline over ``documents``.

Language ID drops what has no language, line dedup deletes later copies of line runs (and documents
of which nothing is left), the n-gram Jaccard join keeps one document of each group of near
duplicates (five words, 0.8), mixing takes each source to its target weight, and BPE encodes what
is left. Each stage is written and read by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, jaccard, langid, linededup, mix
from cairn.llm.common import Scratch

#: An anti-join sends at most so many ids to every executor; more are shuffled.
BROADCAST_IDS = 1_000_000
#: No stage but mixing alone could be put in SQL: language ID and near duplicates are tested against brute force.
ORACLE_SQL = None


def spared(docs: DataFrame, made: list[str], stage) -> DataFrame:
    """What stage makes of docs, whose own columns of the names that the stage makes are kept aside meanwhile, as its columns."""
    aside = {c: f"{c}__own" for c in docs.columns if c in made}
    out = stage(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; a null ``lang`` gets the prediction. Texts that are null, empty or without letters go.

    Repeated rows are each a row, ties go to the first language by code point, an empty table stays one.
    """

    def stage(d: DataFrame) -> DataFrame:
        out = langid.identify(d, F.lit(True), keep=True).where(F.col("lang_pred") != langid.UND)
        return out.withColumn("lang", F.coalesce("lang", "lang_pred"))

    return spared(docs, ["lang_pred", "score", "n_langs"], stage)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of two lines or more are deleted, and documents of which no line is left.

    Null texts go. Equal rows are one document, each with its lines; rows without a doc_id keep theirs. An empty table stays one.
    """

    def stage(d: DataFrame) -> DataFrame:
        out = linededup.dedup_lines(d).where("n_removed < n_lines")
        return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))) if "n_chars" in d.columns else out

    return spared(docs, ["n_lines", "n_removed"], stage)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates.

    Rows of one group and doc_id: the one whose text has the smallest hash stays, once. Rows of one doc_id in different groups are
    documents of their own. Texts without words are in no group and stay; so do rows without a doc_id. An empty table stays one.
    """
    scratch = Scratch(spark, "near")
    of = scratch.save(jaccard.grouped(docs, size=5, num=80, den=100).where("grp is not null and doc_id is not null"), "groups")
    first = of.where("doc_id = component_id").groupBy("doc_id", "grp").agg(F.min("row").alias("keep"), F.count("*").alias("n")).where("n > 1")
    first = scratch.save(first, "first")
    more = of.join(first, ["doc_id", "grp"]).where("row <> keep").select("doc_id", "row")
    gone = scratch.save(of.where("doc_id <> component_id").select("doc_id", "row").union(more).distinct().withColumnRenamed("row", "row__own"), "gone")
    keyed = docs.withColumn("row__own", F.xxhash64("text"))
    out = keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, ["doc_id", "row__own"], "left_anti")
    if first.limit(1).count():  # rows that are there twice
        twice = F.broadcast(first) if first.count() <= BROADCAST_IDS else first
        twice = twice.select("doc_id", F.col("keep").alias("row__own")).distinct()
        out = out.join(twice, ["doc_id", "row__own"], "left_anti").unionByName(out.join(twice, ["doc_id", "row__own"], "left_semi").dropDuplicates(["doc_id", "row__own"]))
    return out.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document 0, 1 or 2 times, so that the words of each source come to its target.

    A null source is one of its own. Rows of one doc_id, and all rows without one, count as one document and come as often. Texts without words go; an
    empty table stays one.
    """
    taken = mix.whole(docs).select(F.col("doc_id").alias("id__own"), F.col("times").alias("times__own"))
    out = docs.join(taken, docs["doc_id"].eqNullSafe(taken["id__own"])).withColumn("times__own", F.explode(F.sequence(F.lit(1), "times__own")))
    return out.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): token ids as little-endian uint32. A null text is an empty one; each row is encoded; an empty table stays one."""
    import public_tokenizers

    return bpe.bpe(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("decoded")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
