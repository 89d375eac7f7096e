"""Toxicity, tokenizing, packing, licences, URLs and the pipeline."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from episodic.llm import license_scan, packing, url_filter
from episodic.llm import sentencepiece_lattice as lattice
from episodic.llm.toxicity import op1_toxicity, score, train
from tests.conftest import SF_SMALL
from tests.llm import helpers as H

BPE_PATH, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_toxicity_on_held_out_rows(spark):
    sf = SF_SMALL.replace("0.001", "0.01")
    got = {r["doc_id"]: r for r in op1_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    held = [i for i in labels if got[i]["held_out"]]
    right = np.mean([got[i]["predicted"] == labels[i] for i in held])
    assert right >= 0.85  # about 300 labels train here
    known = [i for i in labels if not got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == labels[i] for i in known]) >= 0.95


def test_toxicity_edges(spark):
    docs = H.frame(spark, [(1, None), (2, ""), (3, "you awful thing " * 3000), (3, "fine words"), (4, "awful"), (5, "fine")])
    labels = spark.createDataFrame([(3, 1), (4, 1), (4, 0), (5, 0), (9, 1), (2, None)], "doc_id long, toxic int")
    model = train(docs, labels)
    assert model["n"] >= 3
    full = score(docs, model, carry=True)
    assert set(full.columns) == set(docs.columns) and full.count() == 6
    empty = [r["score"] for r in full.where("doc_id < 3").collect()]
    assert empty[0] == empty[1]
    assert train(docs, labels.limit(0))["n"] == 0 and score(docs.limit(0), model).count() == 0


def test_packing_ids_and_places(spark):
    docs = H.documents(spark)
    rows = [r.asDict() for r in packing.op4_best_fit_packing(spark, SF_SMALL).collect()]
    library = Tokenizer.from_file(BPE_PATH)
    want = {}
    for i, t in H.rows_of(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 4096):
            part = np.array(ids[at : at + 4096], "<u4")
            want[i, at // 4096] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    _gapless(rows)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 4096) + 2


def _gapless(rows, capacity=4096):
    end = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end.get(r["sequence_id"], 0)
        end[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(e <= capacity for e in end.values())


def test_packing_special_words_nulls_and_sequences(spark):
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b x<|endoftext|>y's"), (4, "İstanbul ΑΣ é́ ﬁ\x85q a\x1cb\x0bc"), (5, "It's 2,000 O'Neill WE'LL d'or " * 400), (5, "again")]
    df = H.frame(spark, rows)
    packed = packing.packed_documents(df, capacity=50, with_ids=True)
    got = [r.asDict() for r in packed.collect()]
    _gapless(got, 50)
    library = Tokenizer.from_file(BPE_PATH)
    for i, t in rows[:4]:
        ids = [x for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"]) for x in np.frombuffer(r["ids"], "<u4").tolist()]
        assert ids == library.encode(t or "", add_special_tokens=False).ids + [1]
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    assert sum(map(len, whole.values())) == 4 * sum(r["length"] for r in got)
    assert packing.packed_documents(df.limit(0)).count() == 0


def test_distinct_words_are_looked_up_once():
    """A part's words are cut without the interpreter: each distinct one is looked up once, with the library's ids."""
    words = ["the", "The", "the.", "THE,", "é", "É.", "ßa", "a.b", "It's", "d'", "we'll", "x1", "12.", "...", ".", "!?", "a!", "<|endoftext|>", "a<|", "ǅa", "ª.", "ʰa", "ИЯ.", "你好", "a\x1cb", "\x85", "a\u00a0b", "é́", "x" * 300 + ".", "“q”", "ŉ", "İ."]
    texts = [None, "", " ", *words, *(f"\t{w}\n \x0b{w} " for w in words), " ".join(words) * 50, "\x0c\r".join(reversed(words))]
    ids, asked = packing.WordIds(packing.read_spec(BPE_PATH)), []
    data, border = packing.ids_of(pa.array([t or "" for t in texts]), lambda w: asked.append(w) or ids[w])
    assert len(asked) == len(set(asked)) <= 2 * len(words) + 1
    library = Tokenizer.from_file(BPE_PATH)
    for k, t in enumerate(texts):
        assert np.frombuffer(data[border[k] : border[k + 1]].tobytes(), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(rng.uniform(3, 7), rng.uniform(0.3, 1.5), int(rng.integers(1, 3000))).astype(int), 1, 4096)
    values, counts = np.unique(lengths, return_counts=True)
    rows, bins = packing.plan(dict(zip(values.tolist(), counts.tolist(), strict=True)))
    placed = [{"sequence_id": b + k // per, "offset": off + k % per * n, "length": n} for n, _, c, b, per, off in rows for k in range(c)]
    assert sorted(r["length"] for r in placed) == sorted(lengths.tolist()) and {r["sequence_id"] for r in placed} == set(range(bins))
    _gapless(placed)
    large = [0] * bins
    for r in placed:
        large[r["sequence_id"]] += 3 * r["length"] > 4096
    assert max(large) <= 2
    assert bins <= max(-(-int(lengths.sum()) // 4096) * 1.25 + 1, sum(2 * n > 4096 for n in lengths) + 1 + lengths.sum() / 4096)


def test_sentencepiece_matches_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = H.rows_of(H.documents(spark))
    got = {r["doc_id"]: r for r in lattice.op2_sentencepiece(spark, SF_SMALL).collect()}
    for i, t in texts:
        ids = library.encode(t or "")
        assert (got[i]["n_ids"], got[i]["ids_crc32"], got[i]["round_trip"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)


def test_sentencepiece_edges_and_decoding(spark):
    texts = [None, "", " ", "a", "a  b ", " a\nb\n\nc", "\ta\t", "é ́", "\x00a", "ＡＢ ﬁ", "你好 世界", "<s>a</s>", "<0x41>", "    code" + " " * 37 + "x",
             "x" * 500 + " y", "ab" * 150, "😀 hi 😀", "hello world, a test 12345", "hello world, a test 12345"]
    model = lattice.read_model(PIECES)
    found = lattice.encode(H.frame(spark, list(enumerate(texts))), model)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r for r in lattice.decode(found, model).collect()}
    assert [got[i]["ids"] for i in range(len(texts))] == [library.encode(t or "") for t in texts]
    assert [got[i]["text"] for i in range(len(texts))] == [t or "" for t in texts]
    assert lattice.encode(H.frame(spark, [(1, "a")]).limit(0), model).count() == 0
    df = H.frame(spark, list(enumerate(texts)))
    twice = lattice.encode(df.union(df), model).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in twice) == sorted((i, got[i]["ids"]) for i in range(len(texts)) for _ in range(2))


def test_sentencepiece_moves_no_words(spark):
    """Encoding neither shuffles nor writes, and several blocks of odd words give the library's ids."""
    rd = random.Random(5)
    signs = ["e", "t", "th", "ing", " ", "  ", "é", "你", "😀", "\n", "\x00", "<0x41>", "ﬁ", "\u0301", "X" * 230, "▁", "Я", "0", ".,"]
    texts = ["".join(rd.choices(signs, k=rd.randint(0, 80))) for _ in range(300)]
    texts += [None, "", "".join(rd.choices("abehinrst ", k=(5 << 20) // 2)), "ab" * 99 + " " + "ab" * 100]
    model = lattice.read_model(PIECES)
    found = lattice.encode(H.frame(spark, list(enumerate(texts))).coalesce(1), model)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FileScan" not in plan and "MapInArrow" in plan
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: (r["ids"], r["crc"]) for r in found.collect()}
    assert all(got[i] == (library.encode(t or ""), zlib.crc32((t or "").encode())) for i, t in enumerate(texts))


def test_both_folds_on_random_models():
    """Column by column against one word at a time, with and without byte pieces, ties and unknown characters."""
    for seed in range(60):
        rd = random.Random(seed)
        score = {"".join(rd.choices("abc▁d", k=rd.randint(1, 5))): -rd.randint(1, 9) / 2 for _ in range(rd.randint(1, 25))}
        kind, low = rd.choice([lattice.UNIGRAM, lattice.BPE]), min(score.values()) - 10
        pieces = [("<unk>", 0.0, 2), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256 * (seed % 3 == 0))], *[(t, s, 1) for t, s in score.items()]]
        model = lattice.Model(b"".join([_field(1, _field(1, t.encode()) + b"\x15" + np.float32(s).tobytes() + bytes([0x18, k])) for t, s, k in pieces]
                                       + [_field(2, bytes([0x18, kind])), _field(3, _field(1, b"identity") + bytes([0x18, 1, 0x20, 0]))]))
        number, fold = {t: i for i, (t, _, k) in enumerate(pieces) if k == 1}, lattice.Lattice(model)

        def viterbi(word):
            table = [(0.0, [])]
            for e in range(1, len(word) + 1):
                ways = [(table[s][0] + score[word[s:e]], -s) for s in range(e) if word[s:e] in score]
                cost, s = max(ways + [(table[e - 1][0] + low, 1 - e)] * (word[e - 1] not in score))
                table.append((cost, table[-s][1] + [word[-s:e]]))
            return table[-1][1]

        def merges(word):
            parts = list(word)
            while ways := [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in score]:
                i = min(ways)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            return parts

        texts = ["".join(rd.choices("abc dé ", k=rd.randint(0, 30))) for _ in range(20)]
        for t, ids in zip(texts, fold.block(texts).to_pylist(), strict=True):
            marked = ("▁" + t.replace(" ", "▁")) if t else ""
            want = (viterbi if kind == lattice.UNIGRAM else merges)(marked)
            assert ids == [i for p in want for i in ([number[p]] if p in number else fold.byte_ids(p))]


def _field(number, payload):
    return bytes([number << 3 | 2, len(payload)]) + payload


def test_viterbi_fold_of_a_unigram_model(spark):
    def field(number, payload):
        return bytes([number << 3 | 2, len(payload)]) + payload

    pieces = [("<unk>", 0.0, 2), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("ba", -2.5, 1), ("aba", -6.0, 1), ("▁", -1.0, 1), ("▁a", -2.0, 1)]
    raw = b"".join(field(1, field(1, t.encode()) + b"\x15" + np.float32(s).tobytes() + bytes([0x18, k])) for t, s, k in pieces)
    raw += field(2, bytes([0x18, 1])) + field(3, field(1, b"identity") + bytes([0x18, 1, 0x20, 0]))
    model = lattice.Model(raw)
    assert model.kind == lattice.UNIGRAM
    score_of = {t: s for t, s, k in pieces if k == 1}
    low = min(score_of.values()) - 10

    def best(word):
        table = [(0.0, [])] + [(-1e9, [])] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(e):
                part = word[s:e]
                cost = score_of.get(part, low if e - s == 1 else None)
                if cost is not None and table[s][0] + cost > table[e][0]:
                    table[e] = (table[s][0] + cost, table[s][1] + [part])
        return table[-1][1]

    number = {t: i for i, (t, _, _) in enumerate(pieces)}
    texts = ["abab", "baab", "a b", "aabba", "acb", "abababa"]
    got = {r["doc_id"]: r["ids"] for r in lattice.encode(H.frame(spark, list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [number.get(p, 0) for p in best("▁" + t.replace(" ", "▁"))]


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "HTTP://", "x://EXAMPLE.com", "a\nb://WWW.Example.com/en/?x", "http://example.com/en/1", "http://a.example.com/en", "https://www.example.com/en/5?z",
            "ftp://q.net/es/a#b", "http://net/fr/", "http://notexample.com/en/", "http://xcom/", "http://h.org?p=/en/", "http://h.org#x/y", "http://É.COM/É?", "u://a://b/c"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("host", F.lit(0))
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u is not None and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
            host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert got[i]["verdict"] == (max(fits)[2] if fits else "block" if got[i]["score"] >= 0.75 else "allow")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_classifier_on_unseen_hosts(spark):
    bad = ["http://casino-vegas.test/a", "https://www.pills-cheap.test/en/3", "http://bets-free.test/", "https://adult-clips.test/x", "http://spamlinks.test/q"]
    good = ["http://zoology.test/a", "https://www.bakery.test/en/3", "http://observatory.test/", "https://schoolbooks.test/x", "http://rivers.test/q"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(bad + good)], "page_id int, url string")
    got = [r["score"] for r in url_filter.judge(pages).orderBy("page_id").collect()]
    assert min(got[:5]) > max(got[5:])


def test_licence_paragraphs(spark):
    rows = [(1, None), (2, ""), (3, "Some text.\n\nThis package is released under the MIT License, see below.\nMore text about nothing."),
            (4, 'Licensed under the Apache License, Version 2.0 (the "License")'), (4, "Licensed under CC BY-NC 4.0."), (5, "He got his driving license.\n" * 50),
            (6, "This work is licensed under the GNU General Public License, version 3.")]
    docs = H.documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(i + 10**6, t) for i, t in rows], "doc_id long, text string"))
    got = license_scan.licence_paragraphs(docs).where("confirmed AND id >= 1000000").collect()
    assert {(r["id"] - 10**6, r["paragraph"], r["family"]) for r in got} == {(3, 1, "mit"), (4, 0, "apache"), (4, 0, "cc-by-nc"), (6, 0, "gpl")}
    model = license_scan.train(license_scan.examples(docs))
    assert license_scan.licence_paragraphs(docs.limit(0), model).count() == 0


def test_licence_notices_amid_other_words(spark):
    """Every notice is found in a line of 0 to 500 other words, and two notices in one line."""
    docs = H.documents(spark).select("doc_id", "text")
    rd = random.Random(6)
    other = [f"{rd.choice('bdfgklmnprst')}{rd.choice('aeiou')}{rd.choice('bdfgklmnprst')}{k % 50}" for k in range(500)]
    cases = [(f, n, " ".join((*other[: n // 3], t, *other[n // 3 : n]))) for f, t in license_scan.NOTICES for n in (0, 3, 20, 40, 100, 500)]
    cases += [("proprietary", n, " ".join((*other[:n], "All rights reserved.", *other[:n]))) for n in (0, 10, 20, 250)]
    cases += [("cc-by-nc,mit", 150, " ".join(("Released under the MIT License.", *other[:150], "Licensed under CC BY-NC 4.0."))), ("", 500, " ".join(other))]
    rows = spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(cases)], "doc_id long, text string")
    model = license_scan.train(license_scan.examples(docs))
    for only in (True, False):
        got = {k: set() for k in range(len(cases))}
        for r in license_scan.licence_paragraphs(rows.repartition(8), model, confirmed_only=only).where("confirmed").collect():
            got[r["id"]].add(r["family"])
        wrong = [(f, n, ",".join(sorted(got[k])), t[:60]) for k, (f, n, t) in enumerate(cases) if ",".join(sorted(got[k])) != f]
        assert not wrong


def test_license_query_finds_the_planted_lines(spark):
    got = {r["doc_id"]: r["families"] for r in license_scan.op6_license_scan(spark, SF_SMALL).collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl",
             "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit"}
    for i, t in H.rows_of(H.documents(spark)):
        for line in set((t or "").split("\n")) & set(lines):
            assert lines[line] in got[i].split(",")


def test_pipeline_stages(spark):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        out = corpus_pipeline.written(out)
        assert out.columns == columns
        before, after = dict(H.rows_of(docs)), dict(H.rows_of(out))
        if name == "toxicity":
            bad = {r["doc_id"] for r in op1_toxicity(spark, SF_SMALL).where("predicted = 1").collect()}
            assert after == {i: t for i, t in before.items() if i not in bad}
        elif name == "exact_dedup":
            last = {t or "": i for i, t in sorted(before.items())}
            assert set(after) == set(last.values())
        elif name == "minhash_dedup":
            comp = H.near_components(list(before.items()))
            assert set(after) == {i for i, c in comp.items() if i == c}
        else:
            want = H.repeated_bytes(list(before.items()))
            assert set(after) == set(before)
            # spans are narrowed to whole characters: at most three bytes more stay on each side
            assert all(0 <= len((after[i] or "").encode()) - (n - gone) <= 6 * spans for i, (n, gone, spans, _) in want.items())
        docs = out
    last = [r.asDict() for r in corpus_pipeline.run(spark, SF_SMALL).collect()]
    assert {r["doc_id"] for r in last} == set(dict(H.rows_of(docs)))
    _gapless(last)
