"""Template mapper: a text template over a descriptor gives destinations, one a line.

The subset: ``{{ if }} {{ else if }} {{ else }} {{ end }}``, ``{{ .Field }}``, ``index .Map "key"``,
string arguments, and the functions below. ``{{-`` and ``-}}`` trim white space.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'"[^"]*"|\(|\)|[^\s()]+')
FUNCTIONS = {
    "hasPrefix": lambda s, p: s.startswith(p), "hasSuffix": lambda s, p: s.endswith(p), "contains": lambda s, p: p in s, "trimPrefix": lambda s, p: s.removeprefix(p),
    "trimSuffix": lambda s, p: s.removesuffix(p), "replace": lambda s, a, b: s.replace(a, b), "regexMatch": lambda s, p: bool(re.search(p, s)), "lower": str.lower, "upper": str.upper, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b,
    "not": lambda a: not a, "and": lambda *a: all(a), "or": lambda *a: any(a), "index": lambda m, k: (m or {}).get(k, ""),
}


def _eval(tokens: list[str], row: dict):
    """Value of an expression: a function with arguments, or one operand."""
    args, i = [], 0
    while i < len(tokens):
        t = tokens[i]
        if t == "(":
            depth, j = 1, i + 1
            while depth:
                depth += (tokens[j] == "(") - (tokens[j] == ")")
                j += 1
            args.append(_eval(tokens[i + 1 : j - 1], row))
            i = j
            continue
        if t.startswith('"'):
            args.append(t[1:-1])
        elif t.startswith("."):
            v = row
            for k in t[1:].split("."):
                v = v.get(k, "") if k else v
            args.append(v)
        else:
            args.append(FUNCTIONS[t])
        i += 1
    return args[0](*args[1:]) if callable(args[0]) else args[0]


def compile_template(text: str):
    """A function from a row (dict) to the list of non-empty lines."""
    text = re.sub(r"\s*\{\{-", "{{", text)
    text = re.sub(r"-\}\}\s*", "}}", text)
    parts = re.split(r"\{\{(.*?)\}\}", text, flags=re.S)

    def block(i: int):
        """Nodes from part i to the matching else or end; the index there."""
        nodes = []
        while i < len(parts):
            if i % 2 == 0:
                nodes.append(parts[i])
                i += 1
                continue
            t = _TOKEN.findall(parts[i])
            if t[0] == "if":
                arms, cond = [], t[1:]
                while True:
                    body, i = block(i + 1)
                    arms.append((cond, body))
                    u = _TOKEN.findall(parts[i])
                    if u[0] == "end":
                        break
                    cond = u[2:] if u[1:2] == ["if"] else None
                nodes.append(arms)
                i += 1
            elif t[0] in ("else", "end"):
                return nodes, i
            else:
                nodes.append(tuple(t))
                i += 1
        return nodes, i

    tree = block(0)[0]

    def render(nodes, row) -> str:
        out = []
        for n in nodes:
            if isinstance(n, str):
                out.append(n)
            elif isinstance(n, tuple):
                out.append(str(_eval(list(n), row)))
            else:
                out.append(next((render(body, row) for cond, body in n if cond is None or _eval(cond, row)), ""))
        return "".join(out)

    return lambda row: [x.strip() for x in render(tree, row).splitlines() if x.strip()]


def template_mapper(refs: DataFrame, text: str, fields: dict[str, str]) -> DataFrame:
    """refs with a row and ``dest`` for each line that the template gives; fields name template fields' columns."""
    cols = list(fields.values())

    @F.pandas_udf("array<string>")
    def run(*series: pd.Series) -> pd.Series:
        f = compile_template(text)
        return pd.Series([f(dict(zip(fields, row, strict=True))) for row in zip(*series, strict=True)])

    return refs.withColumn("dest", F.explode(run(*cols)))
