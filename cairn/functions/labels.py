"""Label selectors: text to a predicate over map<string,string>, and label parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = r"^([A-Za-z0-9.\-]+/)?[A-Za-z0-9]([A-Za-z0-9_.\-]*[A-Za-z0-9])?$"
VALUE = r"^([A-Za-z0-9]([A-Za-z0-9_.\-]*[A-Za-z0-9])?)?$"
_SET = re.compile(r"^(\S+)\s+(in|notin)\s*\(([^)]*)\)$")
_CMP = re.compile(r"^([^=!<>\s]+)\s*(==|=|!=|<|>)\s*([^=!<>]*)$")


def _split(text: str) -> list[str]:
    return [x.strip() for x in re.split(r",(?![^(]*\))", text) if x.strip()]


def requirement(text: str, labels: Column) -> Column:
    """One requirement: =, ==, !=, in, notin, key, !key, <, >. Absent keys satisfy != and notin; < and > need integers."""
    if m := _SET.match(text):
        key, op, values = m[1], m[2], [v.strip() for v in m[3].split(",")]
        hit = F.coalesce(F.element_at(labels, key).isin(values), F.lit(False))
        return hit if op == "in" else ~hit
    if m := _CMP.match(text):
        key, op, value = m[1], m[2], m[3].strip()
        got = F.element_at(labels, key)
        if op in ("<", ">"):
            if not re.fullmatch(r"-?\d+", value):
                raise ValueError(f"not an integer: {text}")
            n = F.when(got.rlike(r"^-?[0-9]+$"), got).try_cast("long")
            return F.coalesce(n < int(value) if op == "<" else n > int(value), F.lit(False))
        hit = F.coalesce(got == value, F.lit(False))
        return ~hit if op == "!=" else hit
    if text.startswith("!") and re.match(KEY, text[1:].strip()):
        return ~F.coalesce(F.map_contains_key(labels, text[1:].strip()), F.lit(False))
    if re.match(KEY, text):
        return F.coalesce(F.map_contains_key(labels, text), F.lit(False))
    raise ValueError(f"not a requirement: {text}")


def selector(text: str, labels: Column) -> Column:
    """All requirements of one selector."""
    out = F.lit(True)
    for r in _split(text):
        out = out & requirement(r, labels)
    return out


def selectors(texts: list[str], labels: Column) -> Column:
    """Any of the selectors; none given matches everything."""
    if not texts:
        return F.lit(True)
    out = F.lit(False)
    for t in texts:
        out = out | selector(t, labels)
    return out


def any_match(texts: list[str], label_sets: Column) -> Column:
    """Does any of an array of label maps satisfy the selectors?"""
    return F.exists(label_sets, lambda m: selectors(texts, m))


def part_selected(name: Column, labels: Column, artifact_paths: Column, *, empty: bool = False, names: list[str] | None = None, artifacts: list[str] | None = None, texts: list[str] | None = None) -> Column:
    """empty selects nothing; nothing given selects all; else by name, public artifact path or selectors."""
    if empty:
        return F.lit(False)
    if names is None and artifacts is None and texts is None:
        return F.lit(True)
    out = F.lit(False)
    if names:
        out = out | name.isin(names)
    if artifacts:
        out = out | F.exists(artifact_paths, lambda p: p.isin(artifacts))
    if texts:
        out = out | selectors(texts, labels)
    return out


def valid(labels: Column) -> Column:
    return F.forall(F.map_entries(labels), lambda e: e["key"].rlike(KEY) & e["value"].rlike(VALUE) & (F.length(e["value"]) <= 63))


def split_pair(s: Column) -> Column:
    """struct(key, value) at the first '='."""
    return F.struct(F.substring_index(s, "=", 1).alias("key"), F.when(s.contains("="), F.regexp_replace(s, "^[^=]*=", "")).alias("value"))


def is_delete(s: Column) -> Column:
    return s.endswith("-") & ~s.contains("=")


def split_part_name(name: Column) -> Column:
    """struct(dir, base): '.' at top level, a trailing '/' stays with the base."""
    return F.struct(F.coalesce(F.nullif(F.regexp_extract(name, r"^(.*)/[^/]+/?$", 1), F.lit("")), F.lit(".")).alias("dir"), F.regexp_extract(name, r"([^/]+/?)$", 1).alias("base"))


def ancestors(path: Column) -> Column:
    """Every directory above a path, from the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
