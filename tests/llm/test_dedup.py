"""Deduplication operators against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from episodic.llm import kernel as K
from episodic.llm.components import components
from episodic.llm.cross_polytope import buckets, near_vectors, op9_cross_polytope_dedup
from episodic.llm.exact_dedup import OP10_SQL, exact_classes, exact_dedup, op10_exact_dedup
from episodic.llm.fm_dedup import WaveletMatrix, op3_fm_index_dedup, repeated_words
from episodic.llm.minhash_dedup import dart_minhash, near_duplicates, op8_minhash_dedup, without_near_duplicates
from episodic.llm.suffix_dedup import op5_suffix_array_dedup, permuted_lcp, substring_report, suffix_array, without_repeats
from tests.conftest import SF_SMALL
from tests.llm import helpers as H


def test_suffix_array_and_permuted_lcp():
    rng = np.random.default_rng(0)
    for it in range(150):
        t = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 60)))
        t = np.append(np.ones(len(t)) if it % 7 == 0 else t, 0).astype(np.int16)
        rows = t.tolist()
        order = sorted(range(len(rows)), key=lambda i: rows[i:])
        sa = suffix_array(t)
        assert sa.tolist() == order
        exact, capped = permuted_lcp(t, sa), permuted_lcp(t, sa, 3)
        for a, b in zip(order[1:], order, strict=False):
            k = 0
            while max(a, b) + k < len(rows) and rows[a + k] == rows[b + k]:
                k += 1
            assert exact[a] == k and (capped[a] == k if k >= 3 else capped[a] < 3)


def test_wavelet_rank():
    rng = np.random.default_rng(0)
    for _ in range(20):
        s = rng.integers(0, int(rng.integers(1, 40)), int(rng.integers(1, 200)))
        w = WaveletMatrix(s, int(s.max()) + 1)
        at, c = rng.integers(0, len(s) + 1, 50), rng.choice(s, 50)
        assert w.rank(c, at).tolist() == [int((s[:a] == b).sum()) for a, b in zip(at, c, strict=True)]


def test_suffix_dedup_matches_brute_force(spark):
    want = H.repeated_bytes(H.rows_of(H.documents(spark)))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op5_suffix_array_dedup(spark, SF_SMALL).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_fm_dedup_matches_brute_force(spark):
    want = H.repeated_words(H.rows_of(H.documents(spark)))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op3_fm_index_dedup(spark, SF_SMALL).collect()}
    assert got == want and any(v[1] for v in want.values())


@pytest.mark.parametrize("sizes", [{}, {"hot": 5}, {"index_bytes": 300}])
def test_substring_edges(spark, sizes):
    """Hot keys filed by window and shards indexed in many turns give the same spans."""
    rows = H.edge_texts()
    df = H.frame(spark, rows)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_report(df, **sizes).collect()}
    assert got == H.repeated_bytes(rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in repeated_words(df, **sizes).collect()}
    assert got == H.repeated_words(rows)


def test_substring_repeated_rows_and_empty_table(spark):
    rows = [(1, "q" * 150), (1, "q" * 150), (2, "r" * 20 + "s" * 130), (None, "z" * 10)]
    df = H.frame(spark, rows)
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_report(df).collect())
    assert got == [(0, 0), (1, 149), (1, 149), (2, 129)]  # a row does not repeat its own twin, only itself
    cut = without_repeats(df)
    assert cut.columns == df.columns and cut.count() == 4
    assert substring_report(df.limit(0)).count() == 0 and repeated_words(df.limit(0)).count() == 0


@pytest.mark.parametrize("segment", [200, 333])
def test_substring_long_texts_in_segments(spark, segment):
    """Texts of many segments, with passages that start and end across segment borders."""
    rd = random.Random(segment)
    word = lambda: "".join(rd.choice("abcdé") for _ in range(rd.randint(1, 7)))
    shared = [" ".join(word() for _ in range(n)) for n in (60, 150, 400)]
    rows = [(k, " ".join(x for n in range(6) for x in (*[word() for _ in range(rd.randint(1, 250))], shared[(k + n) % 3]))) for k in range(6)]
    df = H.frame(spark, rows)
    want = H.repeated_bytes(rows)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_report(df, segment=segment).collect()}
    assert got == want and all(v[0] > 4 * segment for v in want.values())
    want = H.repeated_words(rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in repeated_words(df, segment=segment).collect()}
    assert got == want and all(v[0] > 2 * segment for v in want.values())


def test_without_repeats_keeps_characters_whole(spark):
    df = spark.createDataFrame([(1, "é" * 100), (2, "a" + "é" * 100), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in without_repeats(df).collect()}
    assert got[3] is None and set(got[1]) == {"é"} and set(got[2]) <= {"a", "é"}


def test_exact_dedup_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(con.sql(OP10_SQL).select(", ".join(cols)).fetchall())
    assert sorted(tuple(r) for r in op10_exact_dedup(spark, SF_SMALL).select(cols).collect()) == want


def test_exact_dedup_compares_content_under_colliding_digests(spark):
    rows = [(k, f"t{k % 7}") for k in range(60)] + [(60, None), (61, ""), (62, None), (5, "t5")]
    df = H.frame(spark, rows)
    weak = lambda t: F.hex(F.pmod(F.length(t), F.lit(2))).cast("binary")
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_classes(df, digest=weak).collect()}
    top, size = {}, {}
    for i, t in rows:
        top[t or ""], size[t or ""] = max(top.get(t or "", -1), i), size.get(t or "", 0) + 1
    assert got == {(i, top[t or ""], size[t or ""]) for i, t in rows}
    kept = exact_dedup(df, digest=weak)
    assert kept.columns == df.columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(i, t) for i, t in rows if top[t or ""] == i}
    assert exact_dedup(df.limit(0)).count() == 0 and exact_classes(df.limit(0)).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    sets = [dict(zip(rng.integers(0, 400, m).tolist(), rng.integers(1, 6, m).tolist(), strict=True)) for m in rng.integers(1, 300, 120)]
    text = np.concatenate([np.full(len(s), i) for i, s in enumerate(sets)])
    key = K.mix(np.concatenate([np.array(list(s), np.uint64) for s in sets]))
    sig = dart_minhash(text, key, np.concatenate([list(s.values()) for s in sets]), len(sets), 168)
    assert (sig != 0).all()
    off = []
    for a in range(0, 120, 3):
        for b in range(a + 1, 120, 7):
            every = set(sets[a]) | set(sets[b])
            j = sum(min(sets[a].get(x, 0), sets[b].get(x, 0)) for x in every) / sum(max(sets[a].get(x, 0), sets[b].get(x, 0)) for x in every)
            off.append((sig[a] == sig[b]).mean() - j)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05


def test_minhash_matches_brute_force(spark):
    want = H.near_components(H.rows_of(H.documents(spark)))
    got = {r["doc_id"]: r["component_id"] for r in op8_minhash_dedup(spark, SF_SMALL).collect()}
    assert got == want and any(k != v for k, v in want.items())


def test_minhash_chains_copies_and_edges(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[k:] + [f"x{j}" for j in range(k)])) for k in range(12)]  # neighbours are near, ends are not
    rows += [(k, " ".join(base)) for k in range(20, 40)] + [(50, None), (51, ""), (52, " \n"), (53, "one two"), (54, "one  two"), (55, "one")]
    got = {r["id"]: r["component_id"] for r in near_duplicates(H.frame(spark, rows)).collect()}
    assert got == H.near_components(rows)
    assert near_duplicates(H.frame(spark, rows).limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [tuple(map(int, rng.choice(80, 2, replace=False))) for _ in range(60)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == H.union({x for p in links for x in p}, links)


def _vector_links(rows, cosine=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(i, j) for k, (i, v) in enumerate(good) for j, w in good[k + 1 :]
             if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= cosine]
    comp = H.union({i for i, _ in rows}, links)
    return {i: (sum(i in p for p in links), comp[i]) for i, _ in rows}


def test_vectors_match_brute_force(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op9_cross_polytope_dedup(spark, SF_SMALL).collect()}
    assert got == _vector_links(rows)


def test_vectors_edges_and_planted(spark):
    rng = np.random.default_rng(5)
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 0.0]),
            (9, [-0.0, 1.0]), (10, [0.0, 5.0]), (11, [1.0, 0.0, 0.0]), (12, [float("inf"), 0.0])]
    base = rng.normal(size=(20, 48))
    for k in range(120):
        rows.append((100 + k, (base[k % 20] + rng.normal(size=48) * 0.2).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 AS id", "2 AS v")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).collect()}
    assert got == _vector_links(rows)
    assert near_vectors(df.limit(0)).count() == 0


def test_vector_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * r / np.linalg.norm(r, axis=1, keepdims=True)
    x, y = buckets(a), buckets(b)
    found = (x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)
    assert found.any(1).mean() >= 0.99


def test_equal_hashes_of_different_words_remove_nothing(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2^64."""
    flips = [bin(k).count("1") % 2 for k in range(1024)]
    a, b = ("".join("ab"[f ^ s] for f in flips) for s in (0, 1))
    shared = " ".join(f"w{k}" for k in range(49))
    rows = [(1, f"{shared} {a}"), (2, f"{shared} {b}"), (3, f"{shared} {a}")]
    got = {r["doc_id"]: r["n_removed"] for r in repeated_words(H.frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 50}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_report(H.frame(spark, rows)).collect()}
    assert got == H.repeated_bytes(rows)


@pytest.mark.parametrize("doubled", [True, False])
def test_repeated_rows_and_ids_of_the_substring_operators(spark, doubled):
    rows = H.rows_of(H.documents(spark).limit(60))
    df = H.frame(spark, rows)
    if doubled:  # every row twice: one document
        df = df.union(df)
        want = H.repeated_bytes(rows)
        got = [(r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in substring_report(df).collect()]
        assert len(got) == 2 * len(rows) and all(want[i] == v for i, v in got)
    else:  # one id with two texts: two rows out, both judged
        df = df.union(H.frame(spark, [(rows[0][0], "another text " * 30)]))
        assert substring_report(df).count() == len(rows) + 1 and repeated_words(df).count() == len(rows) + 1
        assert without_repeats(df).count() == len(rows) + 1


def test_near_rows_of_one_id_with_several_texts(spark):
    base = " ".join(f"word{k}" for k in range(80))
    rows = [(5, base), (5, "alone " * 30 + "in the world"), (2, base + " more"), (3, "nothing like it at all here"), (None, base), (None, base), (7, None), (7, "")]
    df = H.frame(spark, rows).selectExpr("*", "1 AS id", "2 AS `_key`", "3 AS component_id", "map(1, 2) AS m")
    got = sorted((r["id"] or -1, r["component_id"] or -1, r["kept"]) for r in near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (2, 2, True), (3, 3, True), (5, 2, False), (5, 5, True), (7, 7, True), (7, 7, True)]
    stay = without_near_duplicates(df)
    assert stay.columns == df.columns
    assert sorted((r["doc_id"] or -1, (r["text"] or "")[:5]) for r in stay.collect()) == [(-1, "word0"), (-1, "word0"), (2, "word0"), (3, "nothi"), (5, "alone"), (7, ""), (7, "")]
    assert without_near_duplicates(df.limit(0)).count() == 0
    twice = near_duplicates(df.union(df)).collect()
    assert len(twice) == 2 * len(rows)


def test_vectors_of_any_scale(spark):
    vectors = [(1, [1e200, 1.0]), (2, [1e200, 1.0]), (3, [1e-200, 0.0]), (4, [1e-200, 0.0]), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (None, [3.0, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {r["id"]: r["n_links"] for r in near_vectors(df).collect()}
    assert got == {1: 4, 2: 4, 3: 4, 4: 4, 5: 0, 6: 0, 7: 0, None: 4}


def test_near_copies_in_many_small_blocks(spark, monkeypatch):
    from episodic.llm import minhash_dedup as M

    monkeypatch.setattr(M, "BLOCK", 3)  # every two blocks of a bucket meet
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(45):  # copies with one to eight changed words: some linked, some just not
        text = list(base)
        for at in rng.sample(range(60), rng.randint(1, 8)):
            text[at] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(text)))
    got = {r["id"]: r["component_id"] for r in near_duplicates(H.frame(spark, rows)).collect()}
    assert got == H.near_components(rows)
