from __future__ import annotations

import os
import random

import numpy as np
import pytest

from textloom.llm import langid, lattice, neighbours
from textloom.llm.queries import PIECES, tokenizer_path

WORDS = {"aa": "the of and to in is it that".split(), "bb": "der die und nicht mit von zu den".split()}


def corpus(n=120):
    rng = random.Random(1)
    return [(i, " ".join(rng.choice(WORDS["ab"[i % 2] * 2]) for _ in range(rng.randrange(8, 40))), "ab"[i % 2] * 2, "s") for i in range(n)]


def test_forward_sums_all_segmentations():
    vocabulary = lattice.load(tokenizer_path(PIECES))
    weight = np.random.default_rng(1).random(len(vocabulary) + 1)
    known = {t: i for i, t in enumerate(vocabulary.texts) if i > 2 and i not in set(vocabulary.byte_piece.tolist())}
    for unit in (b" there", "né 日".encode(), b"a", "é日x".encode()):
        chars = unit.decode()
        total = [1.0] + [0.0] * len(chars)
        for end in range(1, len(chars) + 1):
            for start in range(end):
                piece = known.get(chars[start:end].encode())
                if piece is not None and b" " not in chars[start:end].encode().lstrip(b" "):
                    total[end] += total[start] * weight[piece]
                elif end - start == 1:
                    total[end] += total[start] * weight[-1]
        net = lattice.build(vocabulary, np.frombuffer(unit, np.uint8), np.array([len(unit)]))
        assert np.isclose(lattice.forward(net, weight[net.piece])[0][net.last[0]], total[-1])


def log_sum(vocabulary, table, text):
    """Log of the sum over all segmentations of a whole text, one character after another; a piece has no space after
    another character."""
    raw = text.encode()
    known = {t: i for i, t in enumerate(vocabulary.texts) if i > 2 and i not in set(vocabulary.byte_piece.tolist()) and b" " not in t.lstrip(b" ")}
    total = [0.0] + [-np.inf] * len(raw)
    for at in range(len(raw)):
        if np.isfinite(total[at]):
            size = next(n for n in (1, 2, 3, 4) if at + n == len(raw) or raw[at + n] & 0xC0 != 0x80)
            for n in range(1, min(vocabulary.depth, len(raw) - at) + 1):
                p = table[known[raw[at : at + n]]] if raw[at : at + n] in known else table[-1] if n == size else None
                if p is not None:
                    total[at + n] = np.logaddexp(total[at + n], total[at] + p)
    return total[-1]


def test_whole_texts_are_scored_over_all_segmentations():
    vocabulary = lattice.load(tokenizer_path(PIECES))
    rng = np.random.default_rng(5)
    table = np.log(rng.random((len(vocabulary) + 1, 2)) / 1000)
    table[-1] = langid.BARE
    scorer = langid.Scorer(langid.Model(("a", "b"), table, tokenizer_path(PIECES)))
    some = "日本語のテキスト、空白なし。http://ex.org/a?b=c;\r\n    indented  twice\tthere"
    for text in ("", some, some * 20, "x" * 700 + "né日" * 300, " " * 500):
        raw, at = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
        starts, sizes, place, _ = langid.distinct_units(vocabulary, raw, at)
        got = scorer.scores(raw, starts, sizes)[place].sum(0)
        assert np.allclose(got, [log_sum(vocabulary, table[:, j], text) for j in (0, 1)], rtol=1e-9)


def test_windows_of_a_long_unit_change_nothing(monkeypatch):
    vocabulary = lattice.load(tokenizer_path(PIECES))
    table = np.log(np.random.default_rng(6).random((len(vocabulary) + 1, 2)) / 1000)
    raw = np.frombuffer(("né日本there" * 900).encode(), np.uint8)
    model = langid.Model(("a", "b"), table, tokenizer_path(PIECES))
    whole = langid.Scorer(model).scores(raw, np.array([0]), np.array([len(raw)]))
    monkeypatch.setattr(langid, "BLOCK_BYTES", 1000)
    assert np.allclose(langid.Scorer(model).scores(raw, np.array([0]), np.array([len(raw)])), whole, rtol=1e-12)


def test_expected_counts_equal_enumeration():
    """The expected uses of each piece: probability times the gradient of the log likelihood."""
    vocabulary = lattice.load(tokenizer_path(PIECES))
    probability = np.random.default_rng(7).random((len(vocabulary) + 1, 1)) / 1000
    for text in (" there", "x" * 150 + "there"):
        raw = np.frombuffer(text.encode(), np.uint8)
        net = lattice.build(vocabulary, raw, np.array([len(raw)]))
        expected = np.zeros(probability.shape)
        langid._expect(net, probability, np.ones((1, 1)), expected)
        table = np.log(probability[:, 0])
        table[-1] = langid.BARE
        base = log_sum(vocabulary, table, text)
        for i in np.unique(net.piece[net.piece >= 0])[:8]:
            up = table.copy()
            up[i] += 1e-6
            assert np.isclose(expected[i, 0], (log_sum(vocabulary, up, text) - base) / 1e-6, rtol=1e-3, atol=1e-7)
        size = np.array([len(vocabulary.texts[i]) for i in range(len(vocabulary))] + [0])
        assert np.isclose((expected[:, 0] * size).sum(), len(raw))


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no table")
    docs = spark.read.parquet(path)
    told = langid.predict(docs, langid.fit(docs, tokenizer_path(PIECES))).alias("p").join(docs.alias("d"), "doc_id").where(langid.held_out()).where("lang is not null and lang_pred != 'und'")
    rows = told.select("lang", "lang_pred").collect()
    assert len(rows) > 30 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.9 * len(rows)


def test_letters_are_letters(spark):
    model = langid.fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string"), tokenizer_path(PIECES), sample=60)
    odd = spark.createDataFrame([(1, "½ ² ① Ⅷ 12 %"), (1, "½ ² ① Ⅷ 12 %"), (None, "ª"), (2, "ñ"), (3, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["lang_pred"] == "und", r["score"] == 0) for r in langid.predict(odd, model).collect()) == [(0, False, False), (1, True, True), (1, True, True), (2, False, False), (3, True, True)]


def test_labels_are_bounded(spark):
    docs = spark.createDataFrame([(i, "a b", str(i)) for i in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(docs, tokenizer_path(PIECES), most_languages=5)


def test_languages_are_told(spark):
    rows = corpus() + [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "12 34 !!", "bb", "s"), (None, "der die und", None, "s"), (1003, "the of and " * 3000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'x' as lang_pred", "1 as score")
    model = langid.fit(docs, tokenizer_path(PIECES), sample=60)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert all(out[i][0] == lang for i, _, lang, _ in corpus()) and all(0 <= s <= 1 for _, s in out.values())
    assert out[1000] == out[1001] == out[1002] == ("und", 0.0) and out[None][0] == "bb" and out[1003][0] == "aa"


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string")
    wrong = docs.withColumn("lang", __import__("pyspark.sql.functions", fromlist=["x"]).expr("case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 'zz' else lang end"))
    a, b = (langid.fit(d, tokenizer_path(PIECES)) for d in (docs, wrong))
    assert a.languages == b.languages == ("aa", "bb") and (a.log_probability == b.log_probability).all()


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, tokenizer_path(PIECES))
    assert [tuple(r) for r in langid.predict(docs, model).collect()] == [(1, "und", 0.0)]
    assert langid.predict(docs.limit(0), model).collect() == []


def brute(ids, x, q, k):
    score = np.zeros(len(x))
    for d in range(x.shape[1]):
        score += x[q, d] * x[:, d]
    score[ids == ids[q]] = -np.inf
    order = np.lexsort((ids, -score))[:k]
    return [(int(ids[i]), float(score[i])) for i in order if np.isfinite(score[i])]


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 2
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16))).astype(np.float32)
    x[1000:1900] = x[1000]  # one vector makes a third of the rows
    ids = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, rank int")
    options = neighbours.Options(sample=1500, list_rows=25, block=256, query_block=32)
    rows = neighbours.search(df, 20, 20, options).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    queries = np.flatnonzero(ids % 20 == 0)
    wide = x.astype(np.float64)
    hits = [len({a for a, _ in got[int(ids[q])]} & {a for a, _ in brute(ids, wide, q, 20)}) / 20 for q in queries]
    assert len(got) == len(queries) and np.mean(hits) >= 0.9
    for q in queries:
        of = {int(i): s for i, s in brute(ids, wide, q, 3000)}
        mine = got[int(ids[q])]
        assert all(of[i] == s for i, s in mine) and mine == sorted(mine, key=lambda p: (-p[1], p[0]))


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [float("inf"), 0.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(df).collect())
    assert out == [(0, 1, 1, 0.5), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5)]
    assert neighbours.search(df.limit(0)).collect() == []


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    index = neighbours.Index(x, neighbours.centroid_graph(x, 24), np.arange(0, 400, 25), 1.0, 1, 1.0)
    q = rng.normal(size=(50, 8)).astype(np.float32)
    ids, far = neighbours.graph_search(index, q, 64)
    want = neighbours._distances(q, x)
    for i in range(50):
        assert len(set(ids[i].tolist())) == len(ids[i])
        assert np.mean(np.isin(np.argsort(want[i])[:20], ids[i])) >= 0.95 and np.allclose(far[i], want[i][ids[i]], rtol=1e-3, atol=1e-4)


def test_repeated_ids_and_short_lists(spark):
    """Sixty vectors of one vec_id take one place, and every query gets all it is due."""
    rng = np.random.default_rng(9)
    rows = [(1, v) for v in rng.normal(size=(60, 4)).tolist()] + [(i, v) for i, v in zip(range(2, 40), rng.normal(size=(38, 4)).tolist())] + [(0, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for options in (neighbours.Options(), neighbours.Options(list_rows=3, within=0.1, recall=0.1, replicas=1)):
        out = neighbours.search(df, options=options).collect()
        got = {q: [r for r in out if r["query_id"] == q] for q in (0, 20)}
        assert [len(x) for x in got.values()] == [20, 20] and all(len({r["vec_id"] for r in x}) == 20 for x in got.values())
        best = max(sum(a * 9.0 for a in v) for i, v in rows if i == 1)
        assert all(np.isclose(r["score"], best) for r in got[0] if r["vec_id"] == 1)
