"""Text sources: source lists, mapping rules, requirement files, index pages, git output, ledgers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import labels as L


def parse_sources(lines: DataFrame, selectors: list[str] | None = None) -> DataFrame:
    """(name, labels) of lines(value) ``ref[,key=value]*``; '#' comments; a bad pair is an error; sorted by name."""
    rows = lines.where("trim(value) <> '' and not ltrim(value) like '#%'").select(F.transform(F.split("value", ","), lambda x: F.trim(x)).alias("f"))
    pairs = F.transform(F.slice("f", 2, F.greatest(F.size("f"), F.lit(1))), lambda p: F.when(F.size(F.split(p, "=")) == 2, F.struct(F.trim(F.split(p, "=")[0]).alias("key"), F.trim(F.split(p, "=")[1]).alias("value"))).otherwise(F.raise_error(F.concat(F.lit("not a label: "), p)).cast("struct<key: string, value: string>")))
    out = rows.select(F.col("f")[0].alias("name"), F.map_from_entries(pairs).alias("labels"))
    out = out.withColumn("labels", F.when(L.valid(F.col("labels")), F.col("labels")).otherwise(F.raise_error(F.concat(F.lit("labels of "), "name")).cast("map<string,string>")))
    return out.where(L.selectors(selectors or [], F.col("labels"))).orderBy("name")


def read_sources(spark: SparkSession, path: str, selectors: list[str] | None = None) -> DataFrame:
    return parse_sources(spark.read.text(path), selectors)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule_no, src, dst) of a two-column mapping file, in file order; '#' comments. A small file, read whole as one row."""
    text = spark.read.text(path, wholetext=True).first()
    rows = [[x.strip() for x in r.split(",")] for r in (text[0] if text else "").splitlines() if r.strip() and not r.lstrip().startswith("#")]
    if bad := [r for r in rows if len(r) != 2]:
        raise ValueError(f"not two fields: {bad[0]}")
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "rule_no int, src string, dst string")


def parse_requirements(text: str, include=None) -> tuple[list[str], list[str]]:
    """(requirement lines, index URLs) of a requirements file: '\\' continues a line, '#' ends it, -r includes."""
    lines, urls = [], []
    for raw in text.replace("\\\r\n", "").replace("\\\n", "").splitlines():
        line = raw.split(" #")[0].strip() if not raw.lstrip().startswith("#") else ""
        if not line:
            continue
        if line.startswith(("-r ", "--requirement ")):
            if include is None:
                raise ValueError("an included file needs a reader")
            a, b = parse_requirements(include(line.split(None, 1)[1]), include)
            lines, urls = lines + a, urls + b
        elif line.startswith(("--index-url", "--extra-index-url")):
            urls.append(line.replace("=", " ", 1).split(None, 1)[1].strip())
        elif not line.startswith("-"):
            lines.append(line)
    return lines, urls


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    def include(name: str) -> str:
        row = spark.read.text(os.path.join(os.path.dirname(path), name), wholetext=True).first()
        return row[0] if row else ""

    return spark.createDataFrame([(x,) for x in parse_requirements(include(os.path.basename(path)), include)[0]], "line string")


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, href, text, digest) of every anchor with href and text in pages(page_id, url, html)."""
    tags = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<a\s+[^>]*href=\"[^\"]*\"[^>]*>[^<]*</a>"), 0)).alias("tag"))
    out = tags.select("page_id", "url", F.regexp_extract("tag", r'href="([^"]*)"', 1).alias("href"), F.regexp_extract("tag", r"(?s)>([^<]*)<", 1).alias("text"))
    part = F.regexp_extract("href", r"#(\w+)=([0-9a-f]+)$", 0)
    return out.withColumn("digest", F.when(part != "", F.concat(F.regexp_extract("href", r"#(\w+)=", 1), F.lit(":"), F.regexp_extract("href", r"=([0-9a-f]+)$", 1))))


def parse_oid_refs(lines: DataFrame) -> DataFrame:
    """(oid, kind, name) of lines(value) ``<oid> <ref>``."""
    p = F.split(F.trim("value"), r"\s+")
    ref = F.get(p, F.lit(1))
    return lines.where("trim(value) <> ''").select(F.get(p, F.lit(0)).alias("oid"), F.regexp_extract(ref, "^refs/(tags|heads)/", 1).alias("kind"), F.regexp_replace(ref, "^refs/(tags|heads)/", "").alias("name"))


LEDGER = T.StructType([T.StructField(n, t) for n, t in (("seq", T.LongType()), ("digest", T.StringType()), ("size", T.LongType()), ("offset", T.LongType()))])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path)


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line and '#' comments, blanks before a field cut."""
    return spark.read.schema(schema).csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True, enforceSchema=True)


def read_gather_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, image) of a batch's list. A name that comes twice keeps its greatest image."""
    return _csv(spark, path, "name string, image string").where("name is not null").groupBy("name").agg(F.max("image").alias("image"))


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    """(number, name, artifact, digest) of a batch's tracker; a file name must be ``number-name.ext``, with one '-', else it is an error."""
    rows = _csv(spark, path, "sync_name string, artifact string, digest string")
    good = F.col("sync_name").rlike(r"^[0-9]+-[^-]*$")
    told = F.when(good, F.col("sync_name")).otherwise(F.raise_error(F.concat(F.lit("unexpected tar file name "), "sync_name")).cast("string"))
    part = F.split(told, "-")
    return rows.select(part[0].cast("long").alias("number"), F.substring_index(part[1], ".", 1).alias("name"), "artifact", "digest")


def source_refs(listed: DataFrame | None = None, gathered: DataFrame | None = None) -> DataFrame:
    """(ref, pinned) to work on: of a gather artifact gathered(ref, pinned) if there is one, else each of listed(name) as itself."""
    if gathered is not None:
        return gathered.select("ref", "pinned")
    if listed is None:
        raise ValueError("neither a list of sources nor a gather artifact")
    return listed.select(F.col("name").alias("ref"), F.col("name").alias("pinned"))


def read_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """(path, digest, content) of every file below a folder; a folder that is not there holds none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    schema = "path string, digest string, content binary"
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"), "content")
