"""Brute-force versions and edge rows for the text operators."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

from tests.conftest import SF_SMALL


def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def edge_texts(seed: int = 3, n: int = 100):
    """Nulls, empty and wordless texts, periodic and very long ones, ties and copies."""
    rd = random.Random(seed)
    kinds = [lambda: None, lambda: "", lambda: " \n\t", lambda: "".join(rd.choice("ab") for _ in range(rd.randint(0, 60))) * rd.randint(1, 9),
             lambda: "x" * rd.randint(0, 700), lambda: "é" * rd.randint(0, 200), lambda: "w " * rd.randint(0, 1500),
             lambda: " ".join(rd.choice("abc") for _ in range(rd.randint(0, 12))) * rd.randint(1, 29), lambda: "\x0bé\x85 " * rd.randint(0, 200)]
    return [(k, rd.choice(kinds)()) for k in range(n)]


def frame(spark, rows, extra: str = ""):
    """Documents with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "doc_id AS `_id`", "'s' AS source", "1 AS score", "2 AS `_g`", "'r' AS rule")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def repeated_bytes(rows, window=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            if w in seen:
                gone[p : p + window] = b"\1" * window
            else:
                seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest())
    return out


def repeated_words(rows, window=50):
    first, out = {}, {}
    split = [(i, words(t)) for i, t in sorted(rows)]
    for i, w in split:
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    for i, w in split:
        gone = [0] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [1] * window
        kept = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def near_components(rows, similarity=0.8, size=5):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[p : p + size]) for p in range(max(1, len(w) - size + 1))) if w else frozenset()
    at = collections.defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            at[s].append(i)
    common = collections.Counter(p for ids in at.values() for p in itertools.combinations(ids, 2))
    links = [p for p, c in common.items() if c >= similarity * (len(sets[p[0]]) + len(sets[p[1]]) - c) - 1e-9]
    return union(sets, links)


def union(ids, links):
    """Smallest id of each one's component."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
