from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

from textloom.llm import chat, licenses, packing, quality, urlfilter


def measured(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if twice[x] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measurements(spark):
    rng = random.Random(2)
    texts = [None, "", "\n\n", "a b c d e a b c d e", "x " * 5000, "é ß\x0bq\n" * 3] + [" ".join(rng.choice("abé#") for _ in range(rng.randrange(60))) + "\n" * rng.randrange(3) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'clash' as n_words", "1 as _w", "2 as t", "3 as w", "4 as words", "5 as `S`", "6 as at")
    out = {r["doc_id"]: r for r in quality.apply_policy(quality.ledger(rows)).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        n, chars, symbols, dup, repeat = measured(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat), t
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n) and not (r["base_failed"] and r["kept"])
    assert quality.ledger(rows.limit(0)).collect() == []


def test_ablation_counts(spark):
    book = spark.createDataFrame([(0,), (1,), (1,), (3,), (16,), (32,)], "fail_bits long")
    out = {r["rule"]: (r["failed"], r["only"], r["kept_without"]) for r in quality.ablation(book, "v1").collect()}
    assert out["few_words"] == (3, 2, 4) and out["repeated_words"] == (1, 0, 2) and out["symbols"] == (1, 1, 3)


def test_rules_of_hosts(spark):
    urls = {"https://a.example.com/en/x": ("example.com/en/", "block"), "http://www.example.com/en/": ("www.example.com/en/", "allow"), "HTTP://X.NET/es/?q": ("net/es/", "block"), "http://x.net/ES/": (None, "allow"),
            "http://notexample.com/en/": ("com/", "allow"), "http://com/": ("com/", "allow"), "http://b.com": (None, "allow"), "no scheme": (None, "allow"), None: (None, "allow"), "x://net#/fr/": (None, "allow")}
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as root")
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(pages).collect()}
    assert [out[i] for i in range(len(urls))] == list(urls.values())


def test_aliases_take_decisions(spark):
    link = '<link href="{}" rel=canonical>'.format
    pages = [(1, "http://q.org/1", link("http://x.net/es/1")), (2, "http://q.org/2", '<META http-equiv="Refresh" content="0; URL=http://q.org/1">'), (3, "http://q.org/3", link("http://q.org/4")),
             (4, "http://q.org/4#f", link("http://a.com/")), (5, "http://q.org/5", link("http://q.org/4")), (6, "http://z.net/fr/6", link("http://q.org/4")), (7, "http://q.org/7", "x"), (7, "http://q.org/7", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r["page_id"]: r["verdict"] for r in urlfilter.judge(df).collect()}
    # 3, 4, 5 and 6 are one class with an allowed member, which goes before the blocked one; 6 has a rule of its own.
    assert out == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "allow"}
    logged = spark.createDataFrame([("http://q.org/7", "http://q.org/2")], "a string, b string")
    assert {r["page_id"]: r["verdict"] for r in urlfilter.judge(df, redirects=logged).collect()}[7] == "block"
    assert urlfilter.judge(df.limit(0)).collect() == []


def test_relative_and_repeated_aliases(spark):
    from urllib.parse import urljoin

    link = '<link rel="canonical" href="{}">'.format
    blocked = "http://x.net/es/1"
    pages = [(1, "http://q.org/1", link("//x.net/es/1")), (2, "http://x.net/d/2", link("/es/1")), (3, "http://x.net/d/e/3?q#f", link("../../es/./1")), (4, "http://q.org/4", link("http://q.org/four") + link(blocked)),
             (5, "http://x.net/5", '<meta http-equiv=refresh content="0; url=es/1">'), (6, "http://q.org/6", link("http://x.net/es/2?a=1&amp;b=2")), (7, "http://x.net/es/2?a=1&b=2", ""), (8, "http://q.org/8", link("http:&#47;&#x2F;x.net/es/1")),
             (9, "http://q.org/9", link("mailto:a")), (10, "http://x.net/10", link("?x")), (11, "http://q.org/11", link("#top"))]
    out = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [i for i in out if out[i] == "allow"] == [9, 10, 11]
    bases = ["http://h.org", "http://h.org/", "http://h.org/a/b?q=1", "https://h.org/a/b/"]
    targets = ["x", "./x", "../x", "../../../x", "..", ".", "x/..", "/x/../y/.", "//k.org/z", "?n", "x?n/../m", "/", "http://k.org/q"]
    df = spark.createDataFrame([(b, t) for b in bases for t in targets], "b string, t string")
    got = {(r["b"], r["t"]): r["u"] for r in df.withColumn("u", urlfilter.resolved(df.b, df.t)).collect()}
    assert got == {(b, t): urljoin(b, t) for b in bases for t in targets}
    # Empty segments stay, as in RFC 3986 (urljoin drops them).
    one = spark.createDataFrame([("http://h.org/c/d", "a//b")], "b string, t string")
    assert one.select(urlfilter.resolved(one.b, one.t)).first()[0] == "http://h.org/c/a//b"


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "␛1", "␛", "<s>", "[/INST][/INST]", "", None, "plain", "<s</s>>", "␛0␛2", "a\nb", "x" * 50000]
    rows = [(c, t, random.Random(c * 31 + t).choice(["user", "assistant", None, "[/INST]", "system"]), random.Random(c + t * 7).choice(nasty)) for c in range(80) for t in range(c % 6)]
    rows += [(None, 1, "user", "a"), (None, None, "assistant", "b"), (500, 1, "assistant", "y"), (500, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(out) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        r = out[c]
        assert r["exact"] and r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_licenses_equal_brute_force(spark):
    rng = random.Random(3)
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda t: {tuple(split(t)[i : i + 5]) for i in range(len(split(t)) - 4)}
    docs = [None, "", "one two", licenses.TEMPLATES[0][1]]
    for _ in range(60):
        body = []
        for _ in range(rng.randrange(4)):
            body += [rng.choice(["alpha", "beta", "the", "license"]) for _ in range(rng.randrange(30))]
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            if rng.random() < 0.3:
                notice[rng.randrange(len(notice))] = "changed"
            body += notice
        docs.append(" ".join(body))
    df = spark.createDataFrame(list(enumerate(docs)) + [(3, docs[3])], "doc_id long, text string").selectExpr("*", "'x' as license")
    got = {(r["doc_id"], r["license"]): r["n_shared"] for r in licenses.scan(df).collect()}
    want = {(i, name): len(grams(t) & grams(d)) for i, d in enumerate(docs) for name, t in licenses.TEMPLATES if 100 * len(grams(t) & grams(d)) >= 80 * len(grams(t))}
    assert got == want and len(want) > 20
    assert licenses.scan(df.limit(0)).collect() == []


def test_templates_from_a_table(spark):
    lines = spark.createDataFrame([("a", "one two three four five six"), ("b", "p q r"), ("c", " ".join(f"w{i}" for i in range(40)))], "license string, text string")
    half = " ".join(f"w{i}" for i in range(36))
    docs = spark.createDataFrame([(1, "x One, two three four five six y"), (2, half), (None, half), (3, half[:100]), (4, "p q r")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["license"], r["n_shared"], r["n_shingles"], r["first_word"]) for r in licenses.scan(docs, lines).collect())
    assert got == [(0, "c", 32, 36, 0), (1, "a", 2, 2, 1), (2, "c", 32, 36, 0)]


def test_short_and_long_urls(spark):
    pages = spark.createDataFrame([(1, "http://x.net/es/" + "a" * 200_000, "<p>" * 100_000), (2, "://", ""), (3, "", None)], "page_id long, url string, html string")
    assert {r["page_id"]: (r["verdict"], r["rule"]) for r in urlfilter.judge(pages).collect()} == {1: ("block", "net/es/"), 2: ("allow", None), 3: ("allow", None)}


def test_operators_leave_one_table_at_most(spark):
    from pathlib import Path

    from textloom.llm import neighbours, ngram_join, store

    folder = Path(store.shared_dir(spark).removeprefix("file://"))
    tables = lambda: {p.name for p in folder.iterdir()}
    before = tables()
    docs = spark.createDataFrame([(i, f"Released under the MIT License. a{i % 3} b c d e f") for i in range(9)], "doc_id bigint, text string")
    vectors = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    pages = spark.createDataFrame([(1, "http://q.org/1", '<link rel="canonical" href="http://x.net/es/1">')], "page_id long, url string, html string")
    made = [ngram_join.ngram_links(docs, table_bits=10), neighbours.search(vectors), urlfilter.judge(pages), licenses.scan(docs)]
    assert [df.count() for df in made] == [9, 60, 1, 9]
    assert len(tables() - before) == len(made)
    for df in made:
        store.drop(df)
    assert tables() == before


def test_no_short_template_is_missed(spark):
    """Templates of one shingle that open a text, between words that differ from text to text."""
    lines = tuple((f"line-{i}", f"u{i} v{i} w{i} x{i} y{i}") for i in range(40))
    docs = [f"{t} a{n[5:]}x{j} b{n[5:]}x{j} c{n[5:]}x{j} d{n[5:]}x{j}" for n, t in lines for j in range(10)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["license"]) for r in licenses.scan(df, lines).where("containment = 1").collect())
    assert got == [(i, lines[i // 10][0]) for i in range(len(docs))]


def padding(histogram, edges):
    return sum(n * (min(e for e in edges if e >= x) - x) for x, n in histogram.items())


def test_boundaries_are_optimal():
    rng = random.Random(5)
    for _ in range(200):
        histogram = {rng.randrange(1, 60): rng.randrange(1, 20) for _ in range(rng.randrange(1, 9))}
        k = rng.randrange(1, 5)
        edges = packing.optimal_boundaries(histogram, k)
        lengths = sorted(histogram)
        best = min(padding(histogram, [*c, lengths[-1]]) for m in range(min(k, len(lengths))) for c in combinations(lengths[:-1], m))
        assert len(edges) <= k and edges[-1] == lengths[-1] and padding(histogram, edges) == best
    assert packing.optimal_boundaries({}, 3) == []


def test_batches_keep_the_budget(spark):
    rng = random.Random(6)
    rows = [(i % 450, "é" * rng.choice([0, 3, 50, 400, 3000])) for i in range(500)] + [(None, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as bucket", "'y' as place")
    out = packing.pack(df, buckets=3, budget=1000, chunk=64).collect()
    assert len(out) == len(rows) and sorted(r["n_tokens"] for r in out) == sorted(len((t or "").encode()) + 1 for _, t in rows)
    batches = {}
    for r in out:
        assert r["padding"] == r["boundary"] - r["n_tokens"] >= 0
        batches.setdefault(r["batch_id"], []).append(r)
    for b in batches.values():
        assert len({r["boundary"] for r in b}) == 1 and sorted(r["slot"] for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0]["boundary"] <= 1000
    assert packing.pack(df.limit(0)).collect() == []
    assert sorted(str(r["text"]) for r in packing.pack(df, carry=("text",)).collect()) == sorted(str(t) for _, t in rows)


def test_rows_of_one_id_fill_many_chunks(spark):
    df = spark.range(20000).selectExpr("cast(null as bigint) as doc_id", "'x' as text")
    chunks = {}
    for r in packing.pack(df, chunk=64, budget=80).collect():
        chunk = r["batch_id"].split("-")[1]
        chunks[chunk] = chunks.get(chunk, 0) + 1
    assert len(chunks) > 250 and max(chunks.values()) < 150


def test_long_texts_are_batches_of_their_own(spark):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([10, 10, 999, 1000, 5000, 5000])], "doc_id long, text string")
    out = {r["doc_id"]: r for r in packing.pack(df, budget=1000, buckets=2).collect()}
    assert [out[i]["boundary"] for i in range(6)] == [16, 16, 1000, 1008, 5008, 5008]
    assert len({out[i]["batch_id"] for i in (3, 4, 5)}) == 3 and out[0]["batch_id"] == out[1]["batch_id"] and out[3]["bucket"] == 2
