"""Lexical search, source mixing and whitening against brute force."""

import collections
import math
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from episodic.llm import lexical as L
from episodic.llm import mixing as M
from episodic.llm import whitening as Wh
from tests.conftest import SF_SMALL
from tests.llm import helpers as H
from tools.check_oracle import digest

# ---------------------------------------------------------------- lexical search


def brute_search(docs, items, top=10):
    split = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = {c: c + 32 for c in range(65, 91)}
    terms = [(i, collections.Counter(split.findall((t or "").translate(lower)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n_docs, n_terms = len(terms), sum(sum(c.values()) for _, c in terms)
    df = collections.Counter(t for _, c in terms for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(split.findall((t or "").translate(lower)))
    out = set()
    for item, mine in wanted.items():
        scores = []
        for i, c in terms:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in mine if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out |= {(item, r, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scores)[:top], 1)}
    return out


def test_search_query_matches_brute_force_and_sql(spark):
    got = {tuple(r) for r in L.op11_lexical_search(spark, SF_SMALL).select("item_id", "rank", "doc_id", "score").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert got == brute_search(H.rows_of(H.documents(spark)), items) and got
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    assert set(con.execute(L.OP11_SQL).fetchall()) == got


@pytest.mark.parametrize("sizes", [{}, {"most_items": 2}, {"most_bytes": 3}])
def test_search_edges_in_blocks(spark, sizes):
    docs = [*H.edge_texts(seed=5, n=60), (None, "Ab ab é"), (7, "ab a b"), (7, "ab a b"), (900, "AB"), (901, "zz9 ünï x" * 40)]
    items = [(1, "a b, AB"), (1, "é x"), (2, None), (3, ""), (None, "zz9 ab"), (4, "nowhere"), (5, "ÜNÏ w"), (6, "a b, AB")]
    docs_df = H.frame(spark, docs).selectExpr("*", "1 AS rank", "'x' AS terms", "2.0 AS length", "3 AS n")
    items_df = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS _q", "2 AS score")
    got = [tuple(r) for r in L.ranked_search(docs_df, items_df, **sizes).collect()]
    assert len(got) == len({(g[0], g[1]) for g in got})
    assert set(got) == brute_search(docs, items)


def test_search_rounds_prune_and_keep_all_ties(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(1500)]
    docs += [(2000 + i, "w1 w2 w3") for i in range(700)]  # equal scores beyond the top
    items = [(k, " ".join(rng.sample(words, rng.randint(1, 6)))) for k in range(40)]
    got = {tuple(r) for r in L.ranked_search(H.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), top=7).collect()}
    assert got == brute_search(docs, items, 7)


def test_search_bounds_leave_documents_out():
    """With a threshold the focus terms are fewer than the item's, and the result is the same."""
    rng = np.random.default_rng(2)
    weight = rng.integers(1, 3000, 30).astype(np.int64)
    items = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(20)]
    docs = [np.sort(rng.choice(30, rng.integers(1, 8), replace=False)) for _ in range(400)]
    values = [rng.integers(1, 10**6, len(d)) for d in docs]
    length = np.array([math.sqrt(sum(int(weight[t]) * int(v) ** 2 for t, v in zip(d, x, strict=True))) for d, x in zip(docs, values, strict=True)])
    order = np.argsort(-length)
    search = L.Search(items, weight, np.zeros(20), 5)
    scored = []
    keep = L.Search._score
    L.Search._score = lambda self, left, *a: scored.append(len(left)) or keep(self, left, *a)
    try:
        for at in range(0, 400, 50):
            some = order[at : at + 50]
            offs = np.concatenate(([0], np.cumsum([len(docs[k]) for k in some])))
            search.bucket(some, length[some], offs, np.concatenate([docs[k] for k in some]), np.concatenate([values[k] for k in some]))
    finally:
        L.Search._score = keep
    for q, mine in enumerate(items):
        want = sorted(((-sum(int(weight[t]) * int(v) for t, v in zip(docs[k], values[k], strict=True) if t in mine), k) for k in range(400)))[:5]
        assert [(-int(s), int(i)) for i, s in zip(*search.best[q], strict=True)] == want
    assert sum(scored) < 20 * 400 / 3


def test_search_of_empty_tables_and_long_text(spark, monkeypatch):
    docs, items = H.documents(spark), spark.createDataFrame([(1, "a é")], "item_id long, text string")
    assert L.ranked_search(docs.limit(0), items).count() == 0
    assert L.ranked_search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    monkeypatch.setattr(L, "SLICE", 64)  # long texts are split at separators and counted together
    buf = " ".join(random.Random(3).choices(["a", "é", "bb", "cc9"], k=500)).encode()
    pieces = list(L._pieces(np.frombuffer(buf, np.uint8), np.array([0, len(buf)])))
    assert len(pieces) > 3 and b"".join(p.tobytes() for _, p, _ in pieces) == buf


# ---------------------------------------------------------------- source mixing


def brute_seats(weights, seats):
    """One seat after the other to the highest quotient."""
    have = dict.fromkeys(weights, 0)
    for _ in range(seats):
        live = [k for k in weights if weights[k] > 0]
        if not live:
            break
        have[min(live, key=lambda k: (-weights[k] / (2 * have[k] + 1), k))] += 1
    return {k: n for k, n in have.items() if weights[k] > 0}


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague_matches_one_seat_at_a_time(spark, seed):
    rng = random.Random(seed)
    groups = {g: ({k: float(rng.choice([0, 1, 2, 5, rng.randint(1, 10 ** rng.randint(1, 5))])) for k in range(rng.randint(1, 25))}, rng.choice([0, 1, 7, 100, 999])) for g in range(6)}
    rows = [(g, k, w, n) for g, (ws, n) in groups.items() for k, w in ws.items()]
    df = spark.createDataFrame(rows, "g int, k int, w double, n long")
    got = {(r["g"], r["k"]): r["quota"] for r in M.sainte_lague(df, ["g"], "k", "w", "n").collect()}
    assert got == {(g, k): q for g, (ws, n) in groups.items() for k, q in brute_seats(ws, n).items()}
    one = M.sainte_lague(df.where("g = 0"), [], "k", "w", "n").collect()
    assert {r["k"]: r["quota"] for r in one} == brute_seats(*groups[0])


def water_level(sizes, weights, most=3):
    """Targets by capping and sharing again, in fractions."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[k] for k in capped)
        w = sum(weights[k] for k in range(len(sizes)) if k not in capped) or 1
        share = {k: Fraction(weights[k] * left, w) for k in range(len(sizes)) if k not in capped}
        over = {k for k, s in share.items() if s > most * sizes[k]}
        if not over:
            return [float(share.get(k, most * sizes[k])) for k in range(len(sizes))]
        capped |= over


def test_targets_cap_and_share_again(spark):
    rng = random.Random(4)
    for _ in range(6):
        sizes = [rng.choice([0, rng.randint(1, 10 ** rng.randint(1, 6))]) for _ in range(rng.randint(1, 12))]
        weights = [M.WEIGHTS[k % 3] for k in range(len(sizes))]
        df = spark.createDataFrame([(k, s, w) for k, (s, w) in enumerate(zip(sizes, weights, strict=True))], "k int, size long, weight long")
        got = [r["target"] for r in sorted(M.with_targets(df).collect(), key=lambda r: r["k"])]
        assert got == pytest.approx(water_level(sizes, weights)) and sum(got) == pytest.approx(sum(sizes))


def test_mix_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    got = [tuple(r) for r in M.op12_source_mixing(spark, SF_SMALL).select("doc_id", "size", "source_size", "target", "taken").collect()]
    want = [tuple(r) for r in con.execute(M.OP12_SQL).fetchall()]
    assert digest(got, range(5))[1] == digest(want, range(5))[1]


@pytest.mark.parametrize("sizes", [{}, {"block": 5, "shard_docs": 3}, {"block": 7, "shard_docs": 9, "weights": (1, 4)}])
def test_mix_edges(spark, sizes):
    rng = random.Random(6)
    rows = [(i, t, rng.choice(["b", "a", None, "é", "", "z"])) for i, t in H.edge_texts(seed=8, n=150)]
    rows += [(None, "x y z", "a"), (3, "x y", "b"), (3, "x y", "b"), (1000, "w " * 5000, "long"), (1001, None, "nothing"), (1002, "one", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS taken", "'q' AS quota", "3 AS _no", "4 AS `_h`")
    got = M.mix_sources(df, **sizes).collect()
    again = M.mix_sources(df.repartition(5), **sizes).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    words = collections.Counter((i, len(H.words(t))) for i, t, _ in rows)
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == words
    docs_of = collections.Counter(s for *_, s in rows)
    by_source, names = collections.Counter(), sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    for _, t, s in rows:
        by_source[s] += len(H.words(t))
    weights = sizes.get("weights", M.WEIGHTS)
    want = dict(zip(names, water_level([by_source[s] for s in names], [weights[k % len(weights)] for k in range(len(names))]), strict=True))
    block = sizes.get("block", M.BLOCK)
    taken = collections.defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    for s in names:
        assert by_source[s] == 0 or abs(taken[by_source[s], round(want[s], 6)] - want[s]) <= block * (1 + docs_of[s] / sizes.get("shard_docs", M.SHARD_DOCS) / 2)
    assert M.mix_sources(df.limit(0), **sizes).count() == 0


# ---------------------------------------------------------------- whitening


def brute_whiten(rows, k=16):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * np.float64(np.float32(c))) + 1000000 for c in v] for _, v in kept], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    cov = c.T @ c / n
    e, p = np.linalg.eigh(cov)
    e, p = e[::-1], p[:, ::-1]
    return [i for i, _ in kept], n, ((n * x - s) ** 2).sum(axis=1), ((n * x - s) / n) @ p[:, :k], e, cov


def check_whitened(got, rows, rank, k=16):
    ids, n, deviation, projected, e, _ = brute_whiten(rows, k)
    wide = min(rank, k)
    assert len(got) == len(ids) * wide
    if not got:
        return
    table = collections.defaultdict(list)
    for r in got:
        table[r["component"]].append(r)
    assert sorted(table) == list(range(1, wide + 1))
    for c, rs in table.items():
        assert {r["n"] for r in rs} == {n}
        assert sorted((repr(r["vec_id"]), r["deviation"]) for r in rs) == sorted((repr(i), int(d)) for i, d in zip(ids, deviation, strict=True))
        assert all(r["explained"] == pytest.approx(e[c - 1] / e.sum(), rel=1e-9) for r in rs)
        assert all(r["identity_error"] < 1e-9 for r in rs)
        if (c == 1 or e[c - 2] - e[c - 1] > 1e-6 * e[0]) and (c == len(e) or e[c - 1] - e[c] > 1e-6 * e[0]):  # else any basis will do
            want = projected[:, c - 1] / math.sqrt(e[c - 1])
            mine = {}
            for r in rs:
                mine.setdefault(repr(r["vec_id"]), []).append(r["whitened"])
            flat = np.array([mine[repr(i)].pop(0) if ids.count(i) == 1 else np.nan for i in ids])
            ok = ~np.isnan(flat)
            sign = np.sign((flat[ok] * want[ok]).sum())
            assert np.abs(sign * flat[ok] - want[ok]).max() < 1e-8


def test_whitening_query_matches_eigenvectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    check_whitened(Wh.op13_embedding_whitening(spark, SF_SMALL).collect(), rows, 64)


@pytest.mark.parametrize("case", ["edges", "rank", "equal values", "long"])
def test_whitening_edges(spark, case):
    rng = np.random.default_rng(5)
    d = {"edges": 6, "rank": 8, "equal values": 5, "long": 90}[case]
    data = rng.standard_normal((200, d)) * 3
    rank = d
    if case == "rank":  # two dimensions follow from the others, exactly
        data = np.floor(data * 64) / 64
        data[:, 6], data[:, 7] = data[:, 0], data[:, 1]
        rank = 6
    if case == "equal values":  # all directions alike
        data, rank = np.vstack([np.eye(d), -np.eye(d)]) * 2, d
    if case == "long":  # a steep spectrum: the process ends before the dimension
        data = data * 40 * 0.7 ** np.arange(d)
        rank = 16
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(data)]
    if case == "edges":
        rows += [(500, None), (501, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, [1.0] * 5), (505, []),
                 (None, rows[0][1]), (7, rows[7][1]), (7, rows[7][1]), (600, [-0.0, 0.0, 1e-30, -1e-30, 5.0, -5.0])]
        rows += [(700 + k, rows[3][1]) for k in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "2 AS component", "3 AS _id", "4 AS _x")
    good = [r for r in rows if r[0] not in (504, 505)] if case == "edges" else rows
    check_whitened(Wh.whitened(df).collect(), good, rank)


def test_whitening_without_deviation(spark):
    schema = "vec_id long, embedding array<float>"
    assert Wh.whitened(spark.createDataFrame([], schema)).count() == 0
    assert Wh.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    assert Wh.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    two = Wh.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], round(r["whitened"], 9)) for r in two) == [(1, 1, -1.0), (2, 1, 1.0)]
    huge = Wh.whitened(spark.createDataFrame([(1, [1e38, 2.0]), (2, [-1e38, 3.0]), (3, [0.0, 0.0])], schema)).collect()
    assert {r["vec_id"]: r["deviation"] for r in huge if r["component"] == 1} == {1: None, 2: None, 3: 320**2}
    assert all(math.isfinite(r["whitened"]) for r in huge)
