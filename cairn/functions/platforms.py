"""Platforms, Python distributions, digests and other scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legacy platform tags, media types, severities.
MANYLINUX = {"manylinux1": "manylinux_2_5", "manylinux2010": "manylinux_2_12", "manylinux2014": "manylinux_2_17"}
SEVERITY = {"critical": 5, "high": 4, "medium": 3, "low": 2, "negligible": 1, "unknown": 0}
INDEX_TYPES = ("application/vnd.oci.image.index.v1+json", "application/vnd.docker.distribution.manifest.list.v2+json")
IMAGE_TYPES = ("application/vnd.oci.image.manifest.v1+json", "application/vnd.docker.distribution.manifest.v2+json")


def parse(s: Column) -> Column:
    """os/arch[/variant][:osversion] as a struct; 'all' and malformed strings are null."""
    p = F.split(F.substring_index(s, ":", 1), "/")
    version = F.when(s.contains(":"), F.regexp_replace(s, "^[^:]*:", ""))
    return F.when((s != "all") & F.size(p).isin(2, 3), F.struct(F.get(p, F.lit(0)).alias("os"), F.get(p, F.lit(1)).alias("architecture"), F.get(p, F.lit(2)).alias("variant"), version.alias("os_version")))


def to_string(p: Column) -> Column:
    return F.when(p.isNull(), F.lit("all")).otherwise(F.concat(F.concat_ws("/", p["os"], p["architecture"], p["variant"]), F.when(p["os_version"].isNotNull(), F.concat(F.lit(":"), p["os_version"])).otherwise("")))


def match(got: Column, want: Column) -> Column:
    """os and architecture equal; variant and os_version only where wanted; wanted features among the got ones where both have
    them. Two nulls match, one null does not."""
    opt = lambda f: want[f].isNull() | (want[f] == "") | F.coalesce(want[f] == got[f], F.lit(False))
    both = (got["os"] == want["os"]) & (got["architecture"] == want["architecture"]) & opt("variant") & opt("os_version")
    return F.when(got.isNull() & want.isNull(), True).when(got.isNull() | want.isNull(), False).otherwise(F.coalesce(both, F.lit(False)))


def subset(want: Column, got: Column) -> Column:
    return F.size(F.array_except(want, got)) == 0


def decode_tag(tag: Column) -> Column:
    """struct(os, arch) of a wheel's platform tag."""
    legacy = F.regexp_extract(tag, r"^(manylinux1|manylinux2010|manylinux2014)_", 1)
    full = F.coalesce(*[F.when(legacy == k, F.concat(F.lit(v), F.substring(tag, len(k) + 1, 1000))) for k, v in MANYLINUX.items()], tag)
    linux = full.startswith("manylinux_") | full.startswith("musllinux_")
    arch = F.regexp_extract(full, r"^[^_]+_[^_]+_[^_]+_(.*)$", 1)
    return F.struct(
        F.when(linux, F.lit("linux")).when(full.startswith("macosx_"), F.lit("darwin")).when((full == "win32") | full.startswith("win_"), F.lit("windows")).when(full == "any", F.lit("any")).otherwise(F.lit("")).alias("os"),
        F.when(linux | full.startswith("macosx_"), arch).when(full == "win32", F.lit("x86")).when(full.startswith("win_"), F.substring(full, 5, 100)).when(full == "any", F.lit("any")).otherwise(F.lit("")).alias("arch"))


def normalize(project: Column) -> Column:
    return F.regexp_replace(F.lower(project), r"[-_.]+", "-")


def parse_wheel(filename: Column) -> Column:
    """struct(project, version, build, python[], abi[], platform[]) of a wheel's name; null where it is none."""
    p = F.split(F.regexp_replace(filename, r"\.whl$", ""), "-")
    tags = lambda i: F.split(F.element_at(p, i), r"\.")
    return F.when(filename.endswith(".whl") & F.size(p).isin(5, 6), F.struct(normalize(F.get(p, F.lit(0))).alias("project"), F.get(p, F.lit(1)).alias("version"), F.when(F.size(p) == 6, F.get(p, F.lit(2))).alias("build"), tags(-3).alias("python"), tags(-2).alias("abi"), tags(-1).alias("platform")))


def parse_sdist(filename: Column) -> Column:
    stem = F.regexp_replace(filename, r"\.tar\.gz$", "")
    return F.when(filename.endswith(".tar.gz") & stem.contains("-"), F.struct(normalize(F.regexp_extract(stem, r"^(.*)-([^-]*)$", 1)).alias("project"), F.regexp_extract(stem, r"^(.*)-([^-]*)$", 2).alias("version")))


def dist_kind(filename: Column) -> Column:
    return F.when(filename.endswith(".whl"), F.lit("wheel")).when(filename.endswith(".tar.gz"), F.lit("sdist"))


def version_labels(version: Column) -> Column:
    """major, minor, patch of a version, as far as it has them; what follows '+' is cut."""
    p = F.split(F.substring_index(version, "+", 1), r"\.")
    keys = ("major", "minor", "patch")
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f"version.{k}").alias("key"), F.get(p, F.lit(i)).alias("value")) for i, k in enumerate(keys)]), lambda e: e["value"].isNotNull()))


def clauses(spec: Column) -> Column:
    """array<struct<op, value>> of a comma-separated version specifier."""
    pattern = r"^\s*(===|~=|==|!=|<=|>=|<|>)\s*(\S+)\s*$"
    return F.transform(F.filter(F.split(spec, ","), lambda c: c.rlike(pattern)), lambda c: F.struct(F.regexp_extract(c, pattern, 1).alias("op"), F.regexp_extract(c, pattern, 2).alias("value")))


def clauses_match(version: Column, cl: Column) -> Column:
    """Only === is compared; other operators always match."""
    return F.forall(cl, lambda c: (c["op"] != "===") | (c["value"] == version))


def parse_requirement(line: Column) -> Column:
    """struct(name, extras[], spec, constraints, digests[]) of a requirement line."""
    main = F.trim(F.regexp_replace(line, r"\s--hash=.*$", ""))
    head, marks = F.trim(F.substring_index(main, ";", 1)), F.when(main.contains(";"), F.trim(F.regexp_replace(main, r"^[^;]*;", ""))).otherwise("")
    extras = F.regexp_extract(head, r"\[([^\]]*)\]", 1)
    return F.struct(
        normalize(F.regexp_extract(head, r"^([A-Za-z0-9._\-]+)", 1)).alias("name"),
        F.when(extras == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(extras, ","), lambda x: F.trim(x))).alias("extras"),
        F.trim(F.regexp_replace(head, r"^[A-Za-z0-9._\-]+\s*(\[[^\]]*\])?", "")).alias("spec"), marks.alias("constraints"),
        F.regexp_extract_all(line, F.lit(r"--hash=(\S+)"), 1).alias("digests"))


def digest(content: Column, alg: int = 256) -> Column:
    return F.concat(F.lit(f"sha{alg}:"), F.sha2(content, alg))


def verify(expected: Column, content: Column) -> Column:
    """Does content have the digest, by the algorithm that the digest names?"""
    return F.coalesce(*[F.when(expected.startswith(f"sha{a}:"), expected == digest(content, a)) for a in (256, 384, 512)], F.lit(False))


def short_digest(d: Column) -> Column:
    return F.substring(F.substring_index(d, ":", -1), 1, 12)


def human_bytes(n: Column) -> Column:
    """SI units: below 10 bytes as they are, then one decimal below 10 of a unit, else a whole number, halves to even."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for e, unit in enumerate(("kB", "MB", "GB", "TB", "PB"), 1):
        v = F.floor(n / F.lit(float(1000**e)) * 10 + 0.5) / 10
        out = F.when(n >= 1000**e, F.concat(F.when(v < 10, F.format_string("%.1f", v)).otherwise(F.bround(v, 0).cast("long").cast("string")), F.lit(f" {unit}"))).otherwise(out)
    return out


def blob_path(d: Column) -> Column:
    return F.concat_ws("/", F.lit("blobs"), F.substring_index(d, ":", 1), F.substring_index(d, ":", -1))


def lfs_path(oid: Column) -> Column:
    return F.concat_ws("/", F.substring(oid, 1, 2), F.substring(oid, 3, 2), oid)


def media_kind(m: Column) -> Column:
    return F.when(m.isin(*INDEX_TYPES), F.lit("index")).when(m.isin(*IMAGE_TYPES), F.lit("image")).otherwise(F.lit("blob"))


def severity_rank(s: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(s) == k, F.lit(v)) for k, v in SEVERITY.items()], F.lit(0))
