from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import edits, text, vectors
from textloom.operators import alignment, markup, spans, spelling, synth, tagging
from textloom.plans import analyze, plugs
from textloom.sources import readers
from textloom.streaming import editing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("source", "tokens"), [
    ("https://a.eus/x", ["https", "a", "eus", "x"]), ("me@x.eus", ["me", "x", "eus"]), ("_u@x.eus", ["_u@x.eus"]), ("42koa 3,5.1", ["42", "koa", "3,5.1"]), ("", []),
])
def test_tokens(spark, source, tokens):
    assert one(spark, text.words(F.lit(source))) == tokens
    rows = spelling.tokens(spark.createDataFrame([(1, source)], "doc_id long, text string")).orderBy("pos").collect()
    assert [r["word"] for r in rows] == tokens and all(source[r["start"] : r["end"]] == r["word"] for r in rows)


def test_checkable_words(spark):
    df = spark.createDataFrame([(["42", "koa", "koako", "ETA", "a", "etxe", "--", "3", "etxeak"],)], "w array<string>")
    assert df.select(text.checkable("w")).first()[0] == ["koako", "etxe", "etxeak"]


@pytest.mark.parametrize(("source", "target", "cased"), [("ETXE", "mendi", "MENDI"), ("Etxe", "mendi", "Mendi"), ("eTxe", "mendi", "mendi"), ("E", "mendi", "Mendi"), ("42", "Mendi", "Mendi")])
def test_match_case(spark, source, target, cased):
    assert one(spark, text.match_case(F.lit(source), F.lit(target))) == cased


def test_edits(spark):
    word = "batzutan"
    variants = set(one(spark, edits.edits1(F.lit(word))))
    assert len(variants) == 747 and {"batzuetan", "batzuta", "abtzutan"} <= variants and word not in variants
    assert one(spark, edits.effective_distance(F.lit("etxe"), F.lit("exte"))) == 1
    assert one(spark, edits.effective_distance(F.lit("etxe"), F.lit("mendi"))) == 4


def test_candidates_equal_enumeration(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcñ'-") for _ in range(rng.randrange(2, 6)))
    known, typed = sorted({word() for _ in range(150)}), sorted({word() for _ in range(80)})
    lexicon = spark.createDataFrame([(w, i + 5) for i, w in enumerate(known)], "word string, freq long")
    got = {(r["typed"], r["cand"]) for r in spelling.candidate_pairs(spark.createDataFrame([(t,) for t in typed], "typed string"), lexicon).collect()}

    def variants(w):
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        out = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
        return out | {a + c + b[1:] for a, b in cuts if b for c in edits.ALPHABET} | {a + c + b for a, b in cuts for c in edits.ALPHABET}

    assert got == {(t, k) for t in typed for k in known if k != t and k in variants(t)}


def test_ranking_and_ties(spark):
    pool = spark.createDataFrame([("etxx", "etxe", 100, 1), ("etxx", "etx", 100, 1), ("etxx", "far", 0, 3), ("etxx", "near", 0, 1)], "typed string, cand string, freq long, ed int")
    assert [r["cand"] for r in spelling.rank_candidates(pool).orderBy("rank").collect()] == ["etx", "etxe", "near"]
    assert spelling.best_candidates(pool).first()["cand"] == "etx"


@pytest.mark.parametrize(("source", "plain", "headings"), [
    ("# Izenburua\ntestua", "Izenburua\ntestua", [(0, 9)]), ("a **b** _c_ ~~d~~ `e` *f*", "a b c d e f", []), ("[lotura](http://x) ![irudi](y) z", "lotura  z", []), ("```\nkodea\n```\nx", "x", []),
    ("> - aipua\n1. bat", "aipua\nbat", []), ('"a" b', "a b", []), ("## b", "b", [(0, 1)]), ("a\n---", "a\n", []), ("** a", "** a", []), ("", "", []),
])
def test_markdown(source, plain, headings):
    got, mapping, ranges = markup.strip_markdown(source)
    assert (got, ranges) == (plain, headings) and [source[i] for i in mapping] == list(got)


def test_html(spark):
    page = "<p>a &amp; b<!-- c --><br>d</p>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [r["plain"] for r in markup.with_html_text(df).orderBy("page_id").collect()] == ["a & bd", None]
    assert one(spark, text.strip_tags(F.lit(page))) == "a & bd"


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    return table


def test_alignment_tables():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        assert alignment.suffix_lengths(a, b).tolist() == lcs(a, b)


def test_diffs():
    assert alignment.diff_words("nire etxea", "Nire etxea") == [("replace", "nire", "Nire", 0, 4)]
    assert alignment.diff_words("a b c", "a x c") == [("replace", "b", "x", 2, 3)]
    assert alignment.diff_words("a", "a b") == [("insert", "", "b", 1, 1)]
    assert alignment.diff_words("a b", "a") == [("delete", "b", "", 2, 3)]
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice(["u", "v", "V", "w"]) for _ in range(rng.randrange(8))] for _ in range(2))
        script = alignment.diff_words(" ".join(a), " ".join(b))
        assert len(a) + sum(c[0] == "insert" for c in script) - sum(c[0] == "delete" for c in script) == len(b)


def test_constrained_rewrites():
    assert alignment.constrained("kaixo mundua", "Kaixo, mundua.") == ("Kaixo, mundua.", 1.0)
    assert alignment.constrained("esker mila", "ESKER beste") == ("esker mila", 0.5)
    assert alignment.constrained("eebb da", "EEBB da.") == ("EEBB da.", 1.0)
    assert alignment.constrained("nahi?", "nahi???...???") == ("nahi?", 1.0)
    assert alignment.constrained("", "x") == ("", 1.0)


def test_segments(spark):
    assert [tuple(s) for s in one(spark, text.segments(F.lit("A. B.\n\nC")))] == [("A.", "\n"), ("B.", "\n"), ("", "\n"), ("C", "")]
    long = " ".join(f"w{i}" for i in range(45))
    assert [len(s["text"].split()) for s in one(spark, text.segments(F.lit(long)))] == [20, 20, 5]
    assert one(spark, text.rejoined(text.segments(F.lit("A. B."), True))) == "A. B."


def test_overlaps_and_order(spark):
    rows = [(0, 5, "spelling"), (0, 9, "grammar"), (3, 4, "cappunct"), (9, 12, "spelling"), (9, 12, "grammar"), (11, 20, "grammar"), (12, 13, "grammar")]
    df = spark.createDataFrame([(rows,)], "s array<struct<from:int,to:int,category:string>>")
    done = df.select(spans.without_overlaps(spans.span_order("s")).alias("s")).first()["s"]
    assert [tuple(x) for x in done] == [(0, 9, "grammar"), (9, 12, "grammar"), (12, 13, "grammar")]


def test_edits_are_spliced(spark):
    df = spark.createDataFrame([("abc def", [(0, 3, "X"), (4, 7, "long")]), ("abc", [])], "text string, e array<struct<from:int,to:int,suggestion:string>>")
    assert [r[0] for r in df.select(spans.apply_edits("text", "e")).collect()] == ["X long", "abc"]


def test_labels_and_gates(spark):
    df = spark.createDataFrame([(["$START", "a", "b", "c"], ["$KEEP", "$DELETE", "$REPLACE_x y", "$APPEND_."])], "w array<string>, l array<string>")
    assert df.select(tagging.labelled_words("w", "l")).first()[0] == "x y c ."
    out = tagging.iterate(spark.createDataFrame([("a a",), (None,)], "text string"), lambda batch: [["$REPLACE_b" if w == "a" else "$KEEP" for w in ws] for ws in batch])
    assert [tuple(r) for r in out.collect()] == [("a a", "b b", 2), (None, None, 0)]


def test_vectors(spark):
    assert one(spark, vectors.argmax(vectors.softmax(F.array(F.lit(1000.0), F.lit(1001.0), F.lit(1001.0))))) == 1
    assert one(spark, vectors.percent(F.lit(1), F.lit(3))) == "33.3%" and one(spark, vectors.percent(F.lit(1), F.lit(0))) == "N/A"


def test_generator_and_typos(spark):
    def reference(seed, n):
        state = (seed + n * 0x6D2B79F5) & 0xFFFFFFFF
        t = (state ^ state >> 15) * (state | 1) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    for n in (1, 2, 77):
        assert one(spark, synth.draw(F.lit(42), n)) == reference(42, n)
    df = spark.createDataFrame([(i, "Etxea ederra da, benetan ederra.") for i in range(40)] + [(90, "a b"), (91, None)], "item_id long, text string")
    rows = synth.generate_typos(df).collect()
    assert rows and {r["item_id"] for r in rows} <= set(range(40))
    for r in rows:
        assert r["erroneous"] != r["correct"] and r["edits"][0]["typo"] in r["erroneous"]


def test_sources(spark, tmp_path):
    (tmp_path / "lex.tsv").write_text("Etxe\t10\nno tab\n\tx\nmendi\tabc\netxe\t12\n")
    assert {tuple(r) for r in readers.read_lexicon(spark, f"file://{tmp_path}/lex.tsv").collect()} == {("etxe", 12), ("mendi", 0)}
    (tmp_path / "list.txt").write_text("# c\nBat\tx\n\nbi\n")
    assert {r["word"] for r in readers.read_word_list(spark, f"file://{tmp_path}/list.txt").collect()} == {"bat", "bi"}
    assert one(spark, readers.clean_affixes(F.lit("A\nNEEDAFFIX x\nSFX a,1\nNEEDAFFIX y\n"))) == "A\nSFX a\nNEEDAFFIX y\n"
    (tmp_path / "m.f16").write_bytes(__import__("numpy").array([1.0, 2.0, 6e-8, 4.0], "<f2").tobytes())
    assert [len(r["vector"]) for r in readers.read_half_matrix(spark, f"file://{tmp_path}/m.f16", 2).collect()] == [2, 2]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "Nire.MD").write_text("# x")
    assert readers.import_documents(spark, f"file://{tmp_path}/d").first()["title"] == "Nire"
    docs = spark.createDataFrame([("a", "t", "c", 1, 2)], readers.DOCUMENT)
    readers.write_documents(docs, f"file://{tmp_path}/store")
    assert readers.read_documents(spark, f"file://{tmp_path}/store").collect() == docs.collect()


def test_analysis_with_plugs(spark):
    lexicon = spark.createDataFrame([("etxea", 50), ("ederra", 40), ("da", 30), ("nire", 60)], "word string, freq long")
    docs = spark.createDataFrame([(1, "# nire etxae\nnire etxea ederra da"), (2, " "), (3, None)], "doc_id long, content string")
    rows = analyze.analyze(docs, analyze.Engine(lexicon)).collect()
    assert [(r["doc_id"], r["original"], r["suggestion"], r["from"], r["to"]) for r in rows] == [(1, "etxae", "etxea", 7, 12)]
    caps = plugs.Rewriter(lambda: lambda texts: [t[:1].upper() + t[1:] for t in texts])
    rows = analyze.analyze(docs, analyze.Engine(lexicon, cap_punct=caps)).orderBy("from").collect()
    assert [(r["category"], r["suggestion"]) for r in rows] == [("cappunct", "Nire"), ("spelling", "etxea"), ("cappunct", "Nire")]


def test_editing(spark):
    events = [(1, 0.0, "a"), (1, 0.3, "b"), (1, 2.0, "c"), (2, 0.0, "x")]
    df = spark.createDataFrame(events, "doc_id long, t double, content string").select("doc_id", F.timestamp_millis((F.col("t") * 1000).cast("long")).alias("ts"), "content")
    want = {(1, "b", 2), (1, "c", 1), (2, "x", 1)}
    assert {(r["doc_id"], r["content"], r["edits"]) for r in editing.autosaves(df).collect()} == want
    assert {(r["doc_id"], r["content"], r["edits"]) for r in editing.autosaves_by_gaps(df, 0.6).collect()} == want
    log = [(1, 1, "add", "p"), (1, 2, "add", "q"), (1, 3, "accept", "p"), (1, 4, "dismiss", "p"), (2, 1, "add", "r"), (2, 2, "clear", None), (2, 3, "add", "s")]
    life = editing.lifecycle(spark.createDataFrame(log, "doc_id long, seq long, action string, sugg_id string"))
    assert {tuple(r) for r in life.collect()} == {(1, "p", "accepted"), (1, "q", "pending"), (2, "s", "pending")}


def test_lifecycle_streams(spark, tmp_path):
    log = [(1, 1, "add", "p"), (1, 2, "accept", "p"), (2, 1, "add", "r"), (2, 2, "clear", None)]
    schema = "doc_id long, seq long, action string, sugg_id string"
    spark.createDataFrame(log, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = editing.lifecycle_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("life").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("life").collect()} == {(1, "p", "pending", 1), (1, "p", "accepted", 2), (2, "r", "pending", 1), (2, "r", "cleared", 2)}


def test_accents_beyond_one_alphabet(spark):
    import unicodedata

    words = ["ãõåč Ǆ", "Việt Nam", "éa", "ÅŞž", "ñandú", "日本"]
    want = ["".join(c for c in unicodedata.normalize("NFD", w) if not 0x300 <= ord(c) <= 0x36F) for w in words]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(text.strip_accents("w")).collect()] == want


def test_text_sink_keeps_breaks(spark, tmp_path):
    rows = ["a\nb", "a\\nb", "\r\n\\", "", "\\\\n", "plain"]
    readers.write_text(spark.createDataFrame([(x,) for x in rows], "text string"), str(tmp_path / "t"))
    assert sorted(r["text"] for r in readers.read_text(spark, str(tmp_path / "t")).collect()) == sorted(rows)


def test_labels_fall_back(spark):
    from textloom.functions import labels

    catalog = spark.createDataFrame([("a.b", "eu", "x"), ("a.b", "es", "y")], "path string, lang string, label string")
    asked = spark.createDataFrame([("a.b", "es"), ("a.b", "fr"), ("c", "es")], "path string, lang string")
    assert sorted(r["label"] for r in labels.localized(asked, catalog).collect()) == ["c", "x", "y"]


def test_mean_vectors_leave_out_ids_beyond_the_matrix(spark):
    matrix = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [9.0, 9.0])], "id long, vector array<double>")
    pieces = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", -1), ("b", 2)], "k string, id long")
    assert [tuple(r) for r in spelling.mean_vectors(pieces, matrix, 2, "k").collect()] == [("a", [2.0, 3.0])]


def test_entry_hides_only_the_subpackages_own_absence():
    import __spark_entry__

    assert "lexicon_build" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
