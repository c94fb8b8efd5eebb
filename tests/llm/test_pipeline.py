from __future__ import annotations

import random

from test_native import measured
from test_ngram_join import brute, near_copies

import corpus_pipeline
from textloom.llm import langid, store
from textloom.llm.queries import PIECES, tokenizer_path


def test_stages_equal_brute_force(spark):
    rows = near_copies(9, groups=3, size=8) + [(500, "too short"), (501, "### %%% " * 30), (502, "same five words here now " * 20), (503, None)]
    docs = spark.createDataFrame([(i, t, random.Random(i).choice(["en", "fr"]), "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    (_, quality), (_, language), (_, near), (_, pack) = corpus_pipeline.STAGES
    kept = quality(spark, docs, "").cache()
    want = set()
    for i, t in rows:
        n, chars, symbols, _, repeat = measured(t)
        if n >= 10 and 100 * repeat <= 20 * n and 2 * chars >= 3 * n and chars <= 25 * n and 10 * symbols <= 3 * n:
            want.add(i)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want
    # Every row that is left is of one invented language, so the labels are noise; what is kept is what predict tells.
    told = language(spark, kept, "")
    model = langid.fit(kept, tokenizer_path(PIECES))
    sure = {r["doc_id"] for r in langid.predict(kept, model).collect() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.SURE}
    assert told.columns == docs.columns and {r["doc_id"] for r in told.collect()} == sure
    single = near(spark, kept, "").cache()
    text = dict(rows)
    of = brute([(i, text[i]) for i in sorted(want)], 5, 80)
    assert single.columns == docs.columns and sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, c in of.values()})
    assert {r["doc_id"] for r in pack(spark, single, "").collect()} == {c for _, c in of.values()}


def test_columns_and_rows_of_the_user_stay(spark):
    text = " ".join(f"word{i}" for i in range(30))
    other = " ".join(f"text{i}" for i in range(30))
    rows = [(1, text, "en", -99, 7, True), (5, text.upper(), "en", -99, 7, False), (5, other, "en", -99, 7, False), (None, text, "en", 1, 1, True), (8, None, "en", 1, 1, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, fail_bits int, kept boolean").selectExpr("*", "1 as _text", "2 as score", "3 as lang_pred", "4 as n_tokens")
    (_, quality), (_, language), (_, near), (_, pack) = corpus_pipeline.STAGES
    for stage, n in ((quality, 4), (language, 4), (near, 3)):
        now = stage(spark, docs, "")
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        out = sorted(map(str, now.collect()))
        assert set(out) <= set(map(str, docs.collect())) and len(out) == n
        docs = now
    assert len(pack(spark, docs, "").collect()) == 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").collect() == []


def test_the_whole_run_leaves_its_result_alone(spark, tmp_path):
    from pathlib import Path

    rng = random.Random(3)
    rows = near_copies(11, groups=4, size=10) + [(900 + i, " ".join(rng.choice("the of and to in is it that".split()) + str(rng.randrange(50)) for _ in range(80))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2], "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    folder = Path(store.shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()}
    out = corpus_pipeline.run(spark, str(tmp_path))
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, "").cache()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out.collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in step.collect())
    left = [p for p in folder.iterdir() if p.name not in before]
    assert sum("packing" in p.name for p in left) == 1 and len(left) <= 2  # its own, and the table of the stage called above
