"""Line dedup: a suffix array over line-ID sequences, by distributed prefix doubling.

A document is a sequence of lines (split at line feeds). Positions are named by prefix doubling: the names of one line
are the ranks of a distributed sort of line IDs, and the name of 2 d lines is the rank of the pair of names at i and i + d. So
names stand in suffix order, and the positions of one name are an interval of the suffix array whose longest common prefixes
reach its depth. Only keys that stand at two positions are ranked: positions whose name is unique, or whose document ends, drop out
after each step, as their suffixes can extend no common prefix. From one line the depth comes to ``min_lines`` by steps of
at most itself, and is doubled from there until no position is left.

The deepest interval of a position tells how long a prefix it shares (the depths are the levels of the longest common
prefix). All positions of an interval but the first (by doc_id, then line number) are later copies: their shared prefixes,
united, are the maximal repeated runs, which are deleted.

DataFrame functions only. A name's first position is a partial aggregate, so a line that stands
in a third of all documents sends one row per map task, and is sorted once; the join that brings names back reads a
written table on one side, so adaptive execution splits its hot keys. Line IDs are two seeded
64-bit hashes.

Nulls: a text that is null stays null with 0 lines; an empty text is one empty line; a row whose doc_id is null keeps its lines
and is no copy's first. A row is known by its doc_id and a hash of its text: equal rows are one
document, so that they are not copies of each other; texts that share a doc_id are documents of their own, in order of that
hash. Empty tables give empty results. Other columns are kept by ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import Scratch

MIN_LINES = 2
DOC = ["doc_id", "row__cairn"]


def shared_prefixes(docs: DataFrame, min_lines: int, scratch: Scratch) -> DataFrame:
    """(DOC, line, depth): later copies, with the depth of the deepest interval that they are not the first of."""
    lines = docs.where("text is not null and doc_id is not null").select(*DOC, F.posexplode(F.split("text", "\n")).alias("line", "s")).select(
        *DOC, "line", F.xxhash64("s").alias("a"), F.xxhash64(F.lit(7), "s").alias("b"))
    names = named(lines, scratch, "d1", rows_repeat=True)
    depth, later = 1, []
    while True:
        if depth >= min_lines:
            later.append(names.where("later").select(*DOC, "line", F.lit(depth).alias("depth")))
        if names.limit(1).count() == 0:
            break
        step = depth if depth >= min_lines else min(depth, min_lines - depth)
        # Unique names have gone, so the partner must be found by its line number.
        then = F.first("name", True).over(Window.partitionBy(*DOC).orderBy("line").rangeBetween(step, step))
        pairs = names.select(*DOC, "line", F.col("name").alias("a"), then.alias("b")).where("b is not null")
        depth += step
        names = named(pairs, scratch, f"d{depth}")
    if not later:
        return names.select(*DOC, "line", F.lit(depth).alias("depth")).limit(0)
    out = later[0]
    for x in later[1:]:
        out = out.union(x)
    return out.groupBy(*DOC, "line").agg(F.max("depth").alias("depth"))


def named(keys: DataFrame, scratch: Scratch, to: str, rows_repeat: bool = False) -> DataFrame:
    """(DOC, line, name, later) of the positions whose key (a, b) stands elsewhere too; names are in order of keys."""
    at = F.struct(*DOC, "line")
    first = keys.groupBy("a", "b").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last").drop("last")
    first = scratch.save(first.orderBy("a", "b").withColumn("name", F.monotonically_increasing_id()), f"{to}-first")
    # Always a merge join, so that the plan is the same at every size.
    out = keys.join(first.hint("merge"), ["a", "b"]).select(*DOC, "line", "name", (F.col("first") != at).alias("later"))
    out = scratch.save(out.distinct() if rows_repeat else out, to)
    scratch.drop(f"{to}-first")
    return out


def removed_runs(docs: DataFrame, min_lines: int, scratch: Scratch) -> DataFrame:
    """(DOC, runs array<struct<lo, hi>>): maximal runs of lines to delete, in order."""
    w = Window.partitionBy(*DOC).orderBy("line")
    at = shared_prefixes(docs, min_lines, scratch).withColumn("hi", F.col("line") + F.col("depth") - 1)
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    at = at.withColumn("fresh", (before.isNull() | (F.col("line") > before + 1)).cast("int"))
    runs = at.withColumn("island", F.sum("fresh").over(w)).groupBy(*DOC, "island").agg(F.min("line").alias("lo"), F.max("hi").alias("hi"))
    return runs.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs__cairn"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, scratch: Scratch | None = None) -> DataFrame:
    """docs with ``text`` less its later copies of line runs, then n_lines and n_removed (long),
    which replace columns of the same names. A text of which all lines go becomes empty."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    docs = docs.drop("n_lines", "n_removed")
    keyed = docs.withColumn(DOC[1], F.xxhash64("text"))
    runs = scratch.save(removed_runs(keyed.select(*DOC, "text"), min_lines, scratch), "runs")
    kept = F.expr("""
        array_join(flatten(transform(sequence(0, size(runs__cairn)), i ->
            slice(split(text, '\\n'),
                  if(i = 0, 0, runs__cairn[greatest(i - 1, 0)].hi + 1) + 1,
                  if(i = size(runs__cairn), size(split(text, '\\n')), runs__cairn[least(i, size(runs__cairn) - 1)].lo)
                  - if(i = 0, 0, runs__cairn[greatest(i - 1, 0)].hi + 1)))), '\\n')""")
    text = F.when(F.col("runs__cairn").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept).alias("text")
    gone = F.coalesce(F.aggregate("runs__cairn", F.lit(0), lambda a, r: a + r["hi"] - r["lo"] + 1), F.lit(0))
    out = keyed.join(runs.hint("merge"), DOC, "left")
    return out.select(*[text if c == "text" else F.col(c) for c in docs.columns], F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"))
