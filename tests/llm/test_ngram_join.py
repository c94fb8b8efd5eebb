from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from textloom.llm import bytetext, components, ngram_join


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, k, percent):
    """doc_id -> (set size, least linked doc_id), over all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows)}


def near_copies(seed, groups=6, size=25, length=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows, doc_id = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                w = w[: rng.randrange(1, len(w))]
            if rng.random() < 0.2:
                w += passage
            rows.append((doc_id, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
            doc_id += 1
    return rows


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_words_and_shingles_follow_the_pattern():
    texts = [None, "", " \n", "a", "A b\x0bc\x85d", "é\tÉ  x"] + ["".join(random.Random(i).choice("ab É\n\t") for _ in range(i % 37)) for i in range(200)]
    raw, at = bytetext.text_bytes(pa.array(texts, pa.string()))
    starts, ends, first = bytetext.word_spans(raw, at)
    for i, t in enumerate(texts):
        got = [bytes(raw[a:b]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
        assert got == re.findall("[^\x20\x09-\x0d]+", t or "")
    hashes = bytetext.span_hashes(raw, starts, ends)
    of = {}
    for a, b, h in zip(starts, ends, hashes):
        assert of.setdefault(bytes(raw[a:b]), h) == h
    assert len(set(of.values())) == len(of)


def test_packed_values_come_back():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5000, dtype=np.uint64))
    assert (ngram_join._unpack(ngram_join._pack(values), len(values)) == values).all()


def test_components_equal_brute_force(spark):
    for seed, k, percent in ((1, 4, 85), (2, 5, 80), (3, 2, 60)):
        rows = near_copies(seed)
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert result(ngram_join.ngram_components(df, k, percent, table_bits=12, block=8)) == brute(rows, k, percent), (seed, k, percent)


def test_nulls_ties_and_short_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (6, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (8, "x" * 100000)]
    df = spark.createDataFrame(rows + [(None, "a b")], "doc_id bigint, text string").selectExpr("*", "1 as n", "'x' as node", "'y' as component_id")
    out = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df, table_bits=10).collect())
    assert out == [(-1, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 2, 6), (7, 2, 6), (7, 2, 6), (8, 1, 8)]


def test_links_equal_brute_force(spark):
    rows = near_copies(4, groups=4, size=25)
    rows += [(i + 1000, t) for i, t in rows[:10]] + [(2000, None), (2001, "a b")]
    sets = {i: frozenset(tuple(words(t)[j : j + 4]) for j in range(len(words(t)) - 3)) or frozenset([tuple(words(t))]) for i, t in rows if words(t)}
    least = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    want = {tuple(sorted((least[s], least[t]))) for s in least for t in least if s != t and 100 * len(s & t) >= 60 * len(s | t)}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [(r["a"], r["b"]) for r in ngram_join.class_links(df, 4, 60, table_bits=12, block=8, side=7).collect()]
    assert len(found) == len(set(found)) > 100 and set(found) == want
    out = {r["doc_id"]: r for r in ngram_join.ngram_links(df, 4, 60, table_bits=12, block=8, side=7).collect()}
    assert {i: r["n_links"] for i, r in out.items()} == {i: sum(least[sets[i]] in x for x in want) if i in sets else 0 for i, _ in rows}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == brute(rows, 4, 60)
    assert ngram_join.ngram_links(df.limit(0), table_bits=10).collect() == []


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    """With lists of any length counted as long, all groups that a pivot does not join go through clusters."""
    classified = ngram_join._classified
    for heavy, seed, k, percent in ((0, 5, 4, 85), (3, 6, 2, 60)):
        monkeypatch.setattr(ngram_join, "_classified", lambda *a, h=heavy, **b: classified(*a, **b | {"heavy": h, "side": 7}))
        rows = near_copies(seed, groups=4, size=30)
        assert result(ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id bigint, text string"), k, percent, table_bits=12, block=8)) == brute(rows, k, percent)


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(2)
    for _ in range(100):
        linked = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < 0.2
        rows, columns = ngram_join._forest(linked)
        want = {}
        for i in range(len(linked)):
            seen, todo = {i}, [i]
            while todo:
                x = todo.pop()
                new = {y for j in np.flatnonzero(linked[x]) for y in np.flatnonzero(linked[:, j]).tolist()} - seen
                seen |= new
                todo += new
            want[i] = min(seen)
        assert rows.tolist() == [want[i] for i in range(len(linked))]
        assert columns.tolist() == [want[int(np.flatnonzero(c)[0])] if c.any() else len(linked) for c in linked.T]


def test_ranges_are_cut_in_two_steps(spark):
    df = spark.createDataFrame(near_copies(3, groups=3, size=12), "doc_id bigint, text string")
    one = ngram_join.frequency_levels(df, 4, 16)
    two = ngram_join.frequency_levels(df, 4, 16, range_bytes=20, hop=3)
    assert one.any() and (one == two).all()
    assert not ngram_join.frequency_levels(df.limit(0), 4, 12).any()


def test_long_words_do_not_meet(spark):
    from test_tokens import thue_morse

    rows = [(1, thue_morse(4096)), (2, thue_morse(4096, True)), (3, thue_morse(4096)[:-1]), (4, thue_morse(4096).upper())]
    assert result(ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id bigint, text string"))) == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 1)}


def test_one_row_of_each_component_stays(spark):
    rows = [(1, "a b c d e f", "x", 1), (5, "A b c d e f", "x", 2), (5, "p q r s t u", "x", 3), (7, "p q r s t u", "z", 4), (7, "p q r s t u", "y", 4), (9, "v w x y z", "b", 1), (9, "v w x y z", "a", 1), (None, "a b c d e f", "n", 1), (None, "a b c d e f", "n", 1), (11, None, "c", 1), (11, "", "c", 1), (11, None, "c", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string, place int")
    got = sorted(((r["doc_id"] or 0, r["text"], r["key"], r["place"]) for r in ngram_join.one_of_each(df).collect()), key=str)
    assert got == sorted([(0, "a b c d e f", "n", 1), (0, "a b c d e f", "n", 1), (1, "a b c d e f", "x", 1), (11, None, "c", 1), (11, "", "c", 1), (5, "p q r s t u", "x", 3), (9, "v w x y z", "a", 1)], key=str)


def test_empty_table(spark):
    assert ngram_join.ngram_components(spark.createDataFrame([], "doc_id bigint, text string"), table_bits=10).collect() == []


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    out = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[50 + i] == 50 for i in range(30)) and out[100] == 50 and out[201] == 200
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_connected_components_of_chains_hubs_and_random_graphs(spark):
    rng = random.Random(3)
    chain = [((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)]
    hubs = [(0, i) for i in range(1, 60)] + [(200, i) for i in range(40, 120)]
    drawn = [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(280)]
    for edges in (chain, hubs, drawn, chain + hubs + drawn):
        root = {x: x for e in edges for x in e if e[0] != e[1]}
        while any(root[a] != root[b] for a, b in edges if a != b):
            for a, b in edges:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        out = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(out) == len(root) and {r["node"]: r["root"] for r in out} == root
