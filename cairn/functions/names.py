"""Names made of references, platforms and distributions: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types of distributions by suffix, of SBOMs, and of kinds that are not scanned.
DIST_TYPES = {
    ".whl": "applications/vnd.act3-ace.python.bdist.wheel+zip",
    ".tar.gz": "applications/vnd.act3-ace.python.sdist.tar+gzip",
    ".egg": "applications/vnd.act3-ace.python.bdist.egg+zip",
}
DIST_UNKNOWN = "applications/vnd.act3-ace.python.unknown"
SBOM_TYPES = ("application/spdx+json", "application/vnd.goharbor.harbor.sbom.v1")
NOT_SCANNED = ("application/vnd.cncf.helm.config.v1+json", "application/vnd.act3-ace.git.config.v1+json")
GATHER_TYPE = "application/vnd.act3-ace.data.gather+json"
DIGEST = r"^[a-z0-9]+(?:[.+_-][a-z0-9]+)*:[0-9a-fA-F]{32,}$"


def lenient_repo(s: Column) -> Column:
    """struct(reg, repo, name, tag, digest) of a reference of which parts may be missing; the name is the repository."""
    rest = F.regexp_replace(s, r"^(?:http|https|bottle|hash):(?://)?", "")
    path = F.when(rest.contains("/"), F.regexp_replace(rest, "^[^/]*/", "")).otherwise("")
    head = F.substring_index(path, "@", 1)
    dig = F.when(path.contains("@"), F.regexp_replace(path, "^[^@]*@", "")).otherwise("")
    digest = F.when(dig.rlike(DIGEST), dig).otherwise("")
    tag = F.when(head.contains(":"), F.regexp_replace(head, "^[^:]*:", "")).when((digest != "") | (path == ""), "").otherwise("latest")
    repo = F.substring_index(head, ":", 1)
    return F.struct(F.substring_index(rest, "/", 1).alias("reg"), repo.alias("repo"), repo.alias("name"), tag.alias("tag"), digest.alias("digest"))


def bottle_uri(s: Column) -> Column:
    """struct(scheme, digest, query, selectors) of ``bottle:alg:hex#a|b`` or ``hash://alg/hex?query#a|b``; null where it is neither."""
    after = lambda c, mark: F.when(c.contains(mark), F.substring(c, F.instr(c, mark) + 1, F.length(c)))
    parts = lambda f: F.when(F.coalesce(f, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(f, r"\|"))
    b, h = F.regexp_replace(s, "^bottle:(?://)?", ""), F.regexp_replace(s, "^hash:(?://)?", "")
    bottle, path, query = F.substring_index(b, "#", 1), F.substring_index(h, "?", 1), F.coalesce(after(h, "?"), F.lit(""))
    one = lambda scheme, d, q, sel: F.struct(F.lit(scheme).alias("scheme"), d.alias("digest"), q.alias("query"), sel.alias("selectors"))
    return F.when(s.startswith("bottle:") & bottle.rlike(DIGEST), one("bottle", bottle, F.lit(""), parts(after(b, "#")))).when(
        s.startswith("hash:") & path.contains("/"), one("hash", F.concat_ws(":", F.substring_index(path, "/", 1), F.substring(path, F.instr(path, "/") + 1, F.length(path))), F.substring_index(query, "#", 1), parts(after(query, "#"))))


def registry_of(ref: Column) -> Column:
    return F.substring_index(ref, "/", 1)


def package_of(ref: Column) -> Column:
    """What follows the registry: repository with tag or digest."""
    return F.regexp_replace(ref, "^[^/]*/", "")


def repository_of(ref: Column) -> Column:
    return F.regexp_replace(F.substring_index(package_of(ref), "@", 1), ":[^/:]*$", "")


def tag_of(ref: Column) -> Column:
    """The digest of a reference that has one, else its tag, else ''."""
    p = package_of(ref)
    return F.when(p.contains("@"), F.substring_index(p, "@", -1)).otherwise(F.regexp_extract(p, ":([^/:]*)$", 1))


def platform_path(os: Column, arch: Column, variant: Column) -> Column:
    """os/arch/variant without the empty ones."""
    return F.concat_ws("/", *[F.nullif(c, F.lit("")) for c in (os, arch, variant)])


def sbom_path(base: str, ref: Column, os: Column, arch: Column, variant: Column) -> Column:
    """Where an SBOM is written: base/registry/repository/reference/os/arch[-variant]/sbom.json; no tag is latest."""
    ver = F.coalesce(F.nullif(tag_of(ref), F.lit("")), F.lit("latest"))
    return F.concat_ws("/", F.lit(base), registry_of(ref), repository_of(ref), ver, os, F.concat_ws("-", arch, F.nullif(variant, F.lit(""))), F.lit("sbom.json"))


def dist_media_type(filename: Column) -> Column:
    return F.coalesce(*[F.when(filename.endswith(k), F.lit(v)) for k, v in DIST_TYPES.items()], F.lit(DIST_UNKNOWN))


def requirement_text(r: Column) -> Column:
    """The canonical line of a parsed requirement: extras, version, constraints, then each hash, sorted, on a line of its own."""
    extras = F.when(F.size(r["extras"]) > 0, F.concat(F.lit("["), F.array_join(r["extras"], ","), F.lit("]"))).otherwise("")
    hashes = F.array_join(F.transform(F.array_sort(F.array_distinct(r["digests"])), lambda d: F.concat(F.lit(" \\\n\t--hash="), d)), "")
    return F.concat(r["name"], extras, r["spec"], F.lit(" ; "), r["constraints"], hashes)


def with_extras(name: Column, extras: Column) -> Column:
    """A requirement's name and name[extra] of each distinct extra."""
    return F.concat(F.array(name), F.transform(F.array_distinct(extras), lambda x: F.concat(name, F.lit("["), x, F.lit("]"))))


def fragment_digest(url: Column) -> Column:
    """alg:hex of a fragment #alg=hex; '' where it is none."""
    d = F.replace(F.when(url.contains("#"), F.substring_index(url, "#", -1)).otherwise(""), F.lit("="), F.lit(":"))
    return F.when(d.rlike(DIGEST), d).otherwise("")


def resolve_url(base: Column, ref: Column) -> Column:
    """A reference resolved against a base URL, without its fragment: absolute, of the same scheme or host, or relative; dots removed."""
    r = F.substring_index(ref, "#", 1)
    scheme, host = F.regexp_extract(base, "^([a-z]+:)//", 1), F.regexp_extract(base, "^([a-z]+://[^/?]*)", 1)
    path = F.regexp_extract(base, r"^[a-z]+://[^/?]*([^?]*)", 1)
    full = F.when(r.startswith("/"), r).when(r == "", path).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), r))
    query, pure = F.regexp_extract(full, r"(\?.*)$", 1), F.regexp_replace(full, r"\?.*$", "")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.split(F.regexp_replace(pure, "^/", ""), "/"), F.array().cast("array<string>"), step)
    slash = F.when(pure.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.when(r.rlike("^[a-z][a-z0-9+.-]*:"), r).when(r.startswith("//"), F.concat(scheme, r)).otherwise(F.concat(host, F.lit("/"), F.array_join(kept, "/"), slash, query))


def metadata_url(url: Column, digest: Column) -> Column:
    return F.when(digest != "", F.concat(url, F.lit(".metadata"))).otherwise("")


def sync_name(number: Column, name: Column, ext: str) -> Column:
    return F.concat(F.format_string("%06d-%s", number, name), F.lit(ext))


def parse_sync_name(file: Column, ext: str) -> Column:
    """struct(number, name) of a name with exactly one '-'; else null."""
    p = F.split(F.regexp_replace(file, ext.replace(".", r"\.") + "$", ""), "-")
    return F.when((F.size(p) == 2) & F.get(p, F.lit(0)).rlike("^[0-9]+$"), F.struct(F.get(p, F.lit(0)).cast("long").alias("number"), F.get(p, F.lit(1)).alias("name")))


def is_sbom(artifact_type: Column) -> Column:
    return artifact_type.isin(*SBOM_TYPES)


def codec_level(name: Column) -> Column:
    """Zstandard speed of a level's name, in any case; what is unknown is the default."""
    n = F.lower(name)
    return F.when(n == "low", "fastest").when(n == "medium", "better").when(n.isin("max", "maximum"), "best").otherwise("default")


def stored_media_type(media_type: Column, compressible: Column, plain: str, tar: str) -> Column:
    """What a part is stored as: archived or plain without a codec where that gains too little."""
    return F.when(compressible, media_type).when(media_type.rlike(r"\btar\b"), F.lit(tar)).otherwise(F.lit(plain))


def coloured(severity: Column) -> Column:
    """A severity between the escape codes of its colour."""
    codes = {"critical": "1;31", "high": "31", "medium": "33", "low": "34", "negligible": "90", "unknown": "90"}
    put = lambda c: F.concat(F.lit(f"\x1b[{c}m"), severity, F.lit("\x1b[0m"))
    return F.coalesce(*[F.when(F.lower(severity) == k, put(v)) for k, v in codes.items()], severity)


def portable_path(path: Column) -> Column:
    """Whether every component is of portable characters and is no '.', '..' or leading '-'."""
    return F.forall(F.split(path, "/"), lambda p: p.rlike(r"^[A-Za-z0-9._][A-Za-z0-9._-]*$") & ~p.isin(".", ".."))
