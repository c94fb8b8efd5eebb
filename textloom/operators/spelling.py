"""Lexicon, detection of unknown words, candidates and their ranking.

Tables: docs (doc_id, text), lexicon (word, freq), candidates (typed, cand, ed, freq, score, rank).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import edits, text
from ..functions.planning import kept_apart

#: Words this frequent in the corpus count as known where no dictionary is given.
KNOWN = 5


def word_rows(docs: DataFrame, letters: str = text.LETTERS) -> DataFrame:
    """doc_id, word: a row for each token. Narrow: no shuffle."""
    return docs.select("doc_id", F.explode(text.words("text", letters)).alias("word"))


def tokens(docs: DataFrame, letters: str = text.LETTERS) -> DataFrame:
    """doc_id, pos, word, start, end: tokens with offsets, end-exclusive, in code points.

    Offsets are running sums over a document. One linear pass over each text in Arrow batches gives them where the
    document lies; a window over exploded tokens would shuffle and sort the corpus for the same numbers.
    """
    pattern = text.word_pattern(letters)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        find = re.compile(pattern, re.ASCII).finditer
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                owner, pos, found, start, end = [], [], [], [], []
                for j, t in enumerate(part.column("text").to_pylist()):
                    for k, m in enumerate(find(t or "")):
                        owner.append(j), pos.append(k), found.append(m[0]), start.append(m.start()), end.append(m.end())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(pos, pa.int32()), pa.array(found, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                                                 names=["doc_id", "pos", "word", "start", "end"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id bigint, pos int, word string, start int, end int")


def build_lexicon(docs: DataFrame, letters: str = text.LETTERS) -> DataFrame:
    """word, freq over lower-cased tokens; counted before the shuffle, so a word that fills the corpus is no hot key."""
    return word_rows(docs, letters).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("freq"))


def known_words(lexicon: DataFrame, least: int = KNOWN) -> DataFrame:
    return lexicon.where(F.col("freq") >= least)


def checked_words(docs: DataFrame, letters: str = text.LETTERS) -> DataFrame:
    """doc_id, word: tokens worth a look-up, as typed. The tokens are a column of their own first: each is judged by the
    one before it, which must not be found again for each of them."""
    found = docs.select("doc_id", kept_apart(text.words("text", letters)).alias("_w"))
    return found.select("doc_id", F.explode(text.checkable("_w")).alias("word"))


def unknown_words(docs: DataFrame, lexicon: DataFrame, letters: str = text.LETTERS) -> DataFrame:
    """doc_id, word, n: tokens worth a look-up whose lower case is not in the lexicon, counted by document. Equal words
    of a document are summed before the join; AQE splits what is left of frequent words."""
    typed = checked_words(docs, letters).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return typed.join(lexicon.select(F.col("word").alias("_known")), F.lower("word") == F.col("_known"), "left_anti")


def unknown_vocabulary(docs: DataFrame, lexicon: DataFrame, letters: str = text.LETTERS) -> DataFrame:
    """typed: the distinct lower-cased tokens worth a look-up that are not in the lexicon. Words are made distinct before
    anything else is done with them, so what is shuffled is the vocabulary of each task, not the corpus."""
    typed = checked_words(docs, letters).select(F.lower("word").alias("typed")).distinct()
    return typed.join(lexicon.select(F.col("word").alias("typed")), "typed", "left_anti")


def unknown_spans(docs: DataFrame, lexicon: DataFrame, letters: str = text.LETTERS) -> DataFrame:
    """doc_id, word, start, end of each unknown token worth a look-up."""
    found = tokens(docs, letters)
    before = F.lag("word").over(Window.partitionBy("doc_id").orderBy("pos"))
    found = found.withColumn("_before", before).where(text.is_checkable(F.col("word"), F.col("_before"))).drop("_before", "pos")
    return found.join(lexicon.select(F.col("word").alias("_known")), F.lower("word") == F.col("_known"), "left_anti")


def validity(words_: DataFrame, lexicon: DataFrame, accepts: DataFrame | None = None) -> DataFrame:
    """words_ (word) with `valid`: in the lexicon, or accepted by another engine (word, accepted, suggestion), whose
    first suggestion may also be the word itself. Where that engine says nothing, a word outside the lexicon is not
    valid; where it failed (accepted null), it is."""
    low = F.lower("word")
    known = lexicon.select(F.col("word").alias("_known")).distinct()
    out = words_.join(known, low == F.col("_known"), "left")
    if accepts is None:
        return out.withColumn("valid", F.col("_known").isNotNull()).drop("_known")
    theirs = accepts.select(F.col("word").alias("_w"), F.lit(True).alias("_asked"), "accepted", "suggestion")
    out = out.join(theirs, F.col("word") == F.col("_w"), "left")
    said = F.col("_asked").isNotNull() & (F.col("accepted").isNull() | F.col("accepted") | (F.lower("suggestion") == low))
    return out.withColumn("valid", F.col("_known").isNotNull() | F.coalesce(said, F.lit(False))).drop("_known", "_w", "_asked", "accepted", "suggestion")


def candidate_pairs(typed: DataFrame, lexicon: DataFrame, alphabet: str | None = edits.ALPHABET) -> DataFrame:
    """typed, cand, freq, ed=1: for distinct typed words (typed), all lexicon words one edit away, a swap of neighbours
    being one edit. alphabet: of letters that an edit may bring in; None: any.

    Symmetric deletion: both sides are keyed by themselves and by each deletion of one character, about as many rows
    as letters instead of hundreds of variants a word; whatever shares a key is verified.
    """
    keys = lambda w: F.explode(F.array_distinct(F.concat(F.array(w), edits.deletions(w))))
    left = typed.select(F.lower("typed").alias("typed")).distinct()
    left = left.select("typed", keys(F.col("typed")).alias("key"))
    right = lexicon.select(F.col("word").alias("cand"), "freq").select("cand", "freq", keys(F.col("cand")).alias("key"))
    one_edit = F.levenshtein("typed", "cand", 1) == 1
    if alphabet is not None:
        one_edit = one_edit & edits.brings_known_letter(F.col("typed"), F.col("cand"), alphabet)
    met = left.join(right, "key").where((F.col("typed") != F.col("cand")) & (F.abs(F.length("typed") - F.length("cand")) <= 1))
    met = met.where(one_edit | edits.is_swap("typed", "cand"))
    return met.select("typed", "cand", "freq").distinct().withColumn("ed", F.lit(1))


def candidate_pool(typed: DataFrame, lexicon: DataFrame, suggestions: DataFrame | None = None, alphabet: str | None = edits.ALPHABET) -> DataFrame:
    """typed, cand, freq, ed: the pairs one edit away and, lower-cased, what a suggester (typed, suggestion) offers,
    with frequency 0 for words outside the lexicon; the word itself is no candidate."""
    near = candidate_pairs(typed, lexicon, alphabet)
    if suggestions is None:
        return near
    offered = suggestions.select(F.lower("typed").alias("typed"), F.lower("suggestion").alias("cand")).where("cand != typed and cand != ''").distinct()
    offered = offered.join(near.select("typed", "cand"), ["typed", "cand"], "left_anti").join(lexicon.select(F.col("word").alias("cand"), "freq"), "cand", "left")
    offered = offered.select("typed", "cand", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq"), edits.effective_distance("typed", "cand").alias("ed"))
    return near.unionByName(offered)


def mean_vectors(pieces: DataFrame, matrix: DataFrame, size: int, key: str) -> DataFrame:
    """key, vector: the mean of the vectors (matrix: id, vector) of a key's pieces (key, id); ids from `size` on have no
    vector and do not count, and a key without any has no row. Sums are made by key and dimension before the shuffle."""
    met = pieces.where((F.col("id") >= 0) & (F.col("id") < size)).join(matrix.select("id", "vector"), "id")
    means = met.select(key, F.posexplode("vector").alias("d", "x")).groupBy(key, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("vector"))


def rank_candidates(pool: DataFrame, top: int | None = None) -> DataFrame:
    """typed, cand, ed, freq, score, rank: candidates that the corpus has or that are one edit away, best first; ties go
    to the word that comes first in the alphabet."""
    scored = pool.where("freq > 0 or ed = 1").withColumn("score", edits.candidate_score("freq", "ed"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("typed").orderBy(F.desc("score"), "cand")))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("typed", "cand", "ed", "freq", "score", "rank")


def best_candidates(pool: DataFrame) -> DataFrame:
    """The first candidate of each typed word, without a sort: a maximum of structs."""
    scored = pool.where("freq > 0 or ed = 1").withColumn("score", edits.candidate_score("freq", "ed"))
    return scored.groupBy("typed").agg(F.min_by(F.struct("cand", "score", "ed", "freq"), F.struct(-F.col("score"), "cand")).alias("b")).select("typed", "b.*")


def rerank(ranked: DataFrame, similarity: DataFrame, key: list[str]) -> DataFrame:
    """key, typed, cand, score, sim: the best by score and similarity together. ranked: candidates by key (a span in its
    text); similarity (key, cand, sim). Only the first five of a key with two or more take part; where nothing was
    scored, the first by score stays, with null sim."""
    window = Window.partitionBy(*key)
    few = ranked.withColumn("_n", F.count("*").over(window)).where(F.col("rank") <= edits.RERANKED)
    met = few.join(similarity, [*key, "cand"], "left").withColumn("sim", F.when(F.col("_n") >= 2, F.col("sim")))
    met = met.withColumn("_any", F.max(F.col("sim").isNotNull()).over(window))
    order = F.when(F.col("_any"), F.coalesce(edits.combined_score("score", "sim"), F.lit(float("-inf")))).otherwise(-F.col("rank").cast("double"))
    best = met.withColumn("_first", F.row_number().over(window.orderBy(order.desc(), "rank"))).where("_first = 1")
    return best.select(*key, *[c for c in ("typed", "cand", "score", "sim") if c not in key])
