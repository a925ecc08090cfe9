"""Reference strings as columns: parse, format, rewrite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scheme names, registry aliases, character classes of a reference.
SCHEMES = ("http", "https", "bottle", "hash")
ALIASES = {"docker.io": "index.docker.io"}
REGISTRY = r"^[A-Za-z0-9][A-Za-z0-9.\-]*(:[0-9]+)?$"
REPOSITORY = r"^[a-z0-9]+([._\-/]+[a-z0-9]+)*$"
TAG = r"^[A-Za-z0-9_][A-Za-z0-9_.\-]{0,127}$"
DIGEST = r"^[a-z0-9]+:[0-9a-f]{32,}$"


def scheme(s: Column) -> Column:
    """http, https, bottle or hash where the string has it, else ''. Both x:// and x: count."""
    return F.coalesce(*[F.when(s.startswith(f"{x}:"), F.lit(x)) for x in sorted(SCHEMES, key=len, reverse=True)], F.lit(""))


def without_scheme(s: Column) -> Column:
    return F.regexp_replace(s, rf"^({'|'.join(SCHEMES)}):(//)?", "")


def parse(s: Column) -> Column:
    """struct(scheme, reg, repo, name, tag, digest, ok). repo is the path before the last segment; tag defaults to
    latest only where no valid digest is given; an invalid digest is dropped."""
    rest = without_scheme(s)
    reg, path = F.substring_index(rest, "/", 1), F.regexp_replace(rest, "^[^/]*/?", "")
    head = F.substring_index(path, "@", 1)
    digest = F.when(path.contains("@"), F.regexp_replace(path, "^[^@]*@", "")).otherwise("")
    digest = F.when(digest.rlike(DIGEST), digest).otherwise(F.lit(""))
    full = F.substring_index(head, ":", 1)
    tag = F.when(head.contains(":"), F.regexp_replace(head, "^[^:]*:", "")).otherwise("")
    tag = F.when((tag == "") & (digest == ""), F.lit("latest")).otherwise(tag)
    repo, name = F.regexp_replace(full, "/?[^/]*$", ""), F.regexp_extract(full, "([^/]*)$", 1)
    colons = F.length(head) - F.length(F.replace(head, F.lit(":"), F.lit("")))
    ok = ~s.endswith("/") & rest.contains("/") & (colons <= 1) & reg.rlike(REGISTRY) & full.rlike(REPOSITORY) & ((tag == "") | tag.rlike(TAG))
    return F.struct(scheme(s).alias("scheme"), reg.alias("reg"), repo.alias("repo"), name.alias("name"), tag.alias("tag"), digest.alias("digest"), ok.alias("ok"))


def path_of(ref: Column) -> Column:
    return F.when(ref["repo"] == "", ref["name"]).otherwise(F.concat_ws("/", ref["repo"], ref["name"]))


def to_string(ref: Column) -> Column:
    return F.concat(ref["reg"], F.lit("/"), path_of(ref), F.when(ref["tag"] != "", F.concat(F.lit(":"), ref["tag"])).otherwise(""), F.when(ref["digest"] != "", F.concat(F.lit("@"), ref["digest"])).otherwise(""))


def tag_or_digest(ref: Column) -> Column:
    return F.when(ref["digest"] != "", ref["digest"]).otherwise(ref["tag"])


def api_url(ref: Column) -> Column:
    """Manifest endpoint: the registry's alias, https unless the scheme says http."""
    return F.concat(F.when(ref["scheme"] == "http", F.lit("http://")).otherwise("https://"), resolve_registry(ref["reg"]), F.lit("/v2/"), path_of(ref), F.lit("/manifests/"), tag_or_digest(ref))


def resolve_registry(reg: Column, aliases: dict[str, str] = ALIASES) -> Column:
    return F.coalesce(*[F.when(reg == k, F.lit(v)) for k, v in aliases.items()], reg)


def rewrite(s: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule in declared order whose pattern matches; else unchanged."""
    return F.coalesce(*[F.when(s.rlike(p), F.regexp_replace(s, p, r)) for p, r in rules], s)


def resolve_endpoint(reg: Column, endpoints: dict[str, list[str]]) -> Column:
    return F.coalesce(*[F.when(reg == k, F.lit(v[0])) for k, v in endpoints.items() if v], F.concat(F.lit("https://"), reg))


def transport(s: Column) -> Column:
    """Transport of an image name: its prefix before ':', docker as oci, oci where there is none."""
    p = F.regexp_extract(s, r"^([a-z][a-z\-]*):", 1)
    return F.when(p.isin("", "docker"), F.lit("oci")).otherwise(p)


def redact_url(s: Column) -> Column:
    return F.regexp_replace(s, r"://[^/@\s]+@", "://xxxxx@")


#: Bits of ``match``.
BITS = {"scheme": 1, "reg": 2, "repo": 4, "name": 8, "tag": 16, "digest": 32}


def match(a: Column, b: Column, mask: int) -> Column:
    """Equality of the fields in the mask, without regard to case."""
    out = F.lit(True)
    for k, bit in BITS.items():
        if mask & bit:
            out = out & (F.lower(a[k]) == F.lower(b[k]))
    return out


def is_empty(ref: Column) -> Column:
    return F.concat(*[ref[k] for k in ("scheme", "reg", "repo", "name", "tag", "digest")]) == ""


def is_insecure(ref: Column) -> Column:
    return ref["scheme"] == "http"
