"""Plain versions of the operators, for small inputs."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def roots(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def jaccard(docs, size, num, den):
    sets = {}
    for i, t in docs:
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(t)]
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    links = []
    for a, b in combinations(sets, 2):
        if sets[a] and sets[b]:
            x = len(sets[a] & sets[b])
            if den * x >= num * (len(sets[a]) + len(sets[b]) - x):
                links.append((a, b))
    r = roots(sets, links)
    return {i: (len(s), r[i]) for i, s in sets.items()}


def substrings(docs, window):
    first = {}
    ws = {i: words(t) for i, t in docs}
    for i in sorted(ws):
        for k in range(len(ws[i]) - window + 1):
            first.setdefault(tuple(ws[i][k : k + window]), i)
    out = {}
    for i, w in ws.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), kept)
    return out


def line_runs(docs, n):
    seen, gone, lines = set(), defaultdict(set), {}
    for i, t in sorted(docs):
        if t is None:
            continue
        lines[i] = t.split("\n")
        for k in range(len(lines[i]) - n + 1):
            w = tuple(lines[i][k : k + n])
            if w in seen:
                gone[i] |= set(range(k, k + n))
            seen.add(w)
    return {i: (None if t is None else "\n".join(x for k, x in enumerate(lines[i]) if k not in gone[i]), 0 if t is None else len(lines[i]), len(gone[i])) for i, t in docs}


def corpus(seed, n=120, vocabulary=60):
    """Documents with copies, near copies, shared passages and odd texts."""
    rng = random.Random(seed)
    vocab = ["w%d" % k for k in range(vocabulary)] + ["Été", "ß", "Ab", "aB"]
    passage = [rng.choice(vocab) for _ in range(70)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.15:
            t = rng.choice(docs)[1]
        elif docs and kind < 0.5:
            w = words(rng.choice(docs)[1])
            for _ in range(rng.randint(1, 4)):
                if w:
                    k = rng.randrange(len(w))
                    w[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [w[k], "new%d" % rng.randrange(9)]])
            t = " ".join(w)
        elif kind < 0.6:
            t = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 6)))
        else:
            w = [rng.choice(vocab) for _ in range(rng.randint(5, 260))]
            if rng.random() < 0.5:
                k = rng.randrange(len(w))
                w[k:k] = passage[rng.randint(0, 20) :]
            t = "".join(x + rng.choice([" ", "\n", "  ", "\t"]) for x in w)
        docs.append((i * 3 + 1, t))
    docs += [(100_000, None), (100_001, ""), (100_002, " \n\t"), (100_003, "one"), (100_004, "One"), (100_005, docs[0][1])]
    rng.shuffle(docs)
    return docs


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
