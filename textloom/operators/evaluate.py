"""Evaluation metrics as aggregates; each is one row or one row a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import edits, text, vectors
from . import alignment, spelling


def _count(condition) -> F.Column:  # type: ignore[name-defined]
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def gold_ranks(cases: DataFrame, lexicon: DataFrame, alphabet: str | None = edits.ALPHABET) -> DataFrame:
    """cases (typo, word, ...) with detected (the typo is no known word), candidates (how many) and gold_rank of the
    right word among them, null if it is none of them."""
    ranked = spelling.rank_candidates(spelling.candidate_pairs(cases.select(F.lower("typo").alias("typed")), lexicon, alphabet))
    found = ranked.groupBy("typed").agg(F.count("*").alias("candidates"))
    out = cases.withColumn("typed", F.lower("typo")).withColumn("cand", F.lower("word"))
    known = lexicon.select(F.col("word").alias("typed"), F.lit(True).alias("_known"))
    out = out.join(known, "typed", "left").join(found, "typed", "left").join(ranked.select("typed", "cand", F.col("rank").alias("gold_rank")), ["typed", "cand"], "left")
    return out.withColumn("detected", F.col("_known").isNull()).withColumn("candidates", F.coalesce("candidates", F.lit(0))).drop("typed", "cand", "_known")


def spelling_metrics(ranks: DataFrame) -> DataFrame:
    out = ranks.agg(F.count("*").alias("total"), _count(F.col("detected")).alias("detected"), _count(F.col("candidates") > 0).alias("has_candidates"), _count(F.col("gold_rank").isNotNull()).alias("in_pool"),
                    _count(F.col("gold_rank") == 1).alias("top1"), _count(F.col("gold_rank") <= 5).alias("top5"))
    return out.withColumn("top1_rate", vectors.percent("top1", "total")).withColumn("top5_rate", vectors.percent("top5", "total"))


def recall_by_type(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("type").agg(F.count("*").alias("total"), _count(F.col("gold_rank") == 1).alias("top1"), _count(F.col("gold_rank").isNotNull()).alias("in_pool"))


def failures(ranks: DataFrame, most: int = 15) -> DataFrame:
    """The first misses by typo and word; a limit is what a sample is."""
    return ranks.where("gold_rank is null or gold_rank > 1").orderBy("typo", "word").limit(most)


def false_positive_metrics(sentences: DataFrame, lexicon: DataFrame, alphabet: str | None = edits.ALPHABET) -> DataFrame:
    """Over correct sentences (doc_id, text): words checked, those not known, and those that would be corrected."""
    typed = spelling.checked_words(sentences).groupBy(F.lower("word").alias("typed")).agg(F.count("*").alias("n"))
    unknown = typed.join(lexicon.select(F.col("word").alias("typed")), "typed", "left_anti")
    changed = spelling.candidate_pairs(unknown.select("typed"), lexicon, alphabet).select("typed").distinct().withColumn("_c", F.lit(True))
    marked = typed.join(unknown.select("typed", F.lit(True).alias("_u")), "typed", "left").join(changed, "typed", "left")
    out = marked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"), F.coalesce(F.sum(F.when(F.col("_u"), F.col("n"))), F.lit(0)).alias("false_detections"), F.coalesce(F.sum(F.when(F.col("_c"), F.col("n"))), F.lit(0)).alias("false_corrections"))
    return out.withColumn("detection_rate", vectors.percent("false_detections", "checked")).withColumn("correction_rate", vectors.percent("false_corrections", "checked"))


def grammar_baseline(pairs: DataFrame, lexicon: DataFrame, alphabet: str | None = edits.ALPHABET) -> DataFrame:
    """How many of the differing words of pairs (correct, erroneous) a spelling corrector would find and mend."""
    cases = alignment.positional_differences(pairs).select(F.col("erroneous_word").alias("typo"), F.col("correct_word").alias("word"))
    return gold_ranks(cases, lexicon, alphabet).agg(F.count("*").alias("total"), _count(F.col("detected")).alias("detected"), _count(F.col("gold_rank").isNotNull()).alias("in_pool"), _count(F.col("gold_rank") == 1).alias("top1"))


def exact_match(outputs: DataFrame) -> DataFrame:
    """outputs (source, target, output): cases, exact, changed, changed_right, changed_wrong."""
    changed = F.col("output") != F.col("source")
    right = F.col("output") == F.col("target")
    return outputs.agg(F.count("*").alias("cases"), _count(right).alias("exact"), _count(changed).alias("changed"), _count(changed & right).alias("changed_right"), _count(changed & ~right).alias("changed_wrong"))


def rerank_comparison(scores: DataFrame) -> DataFrame:
    """scores (case_id, cand, gold boolean, score, ours, theirs): per ranking, cases whose best candidate is right; cases
    on which ours and theirs agree; greatest and mean difference of their scores. Ties go to the smaller word."""
    best = lambda c: F.min_by(F.struct("cand", "gold"), F.struct(-F.col(c), "cand"))
    cases = scores.groupBy("case_id").agg(best("score").alias("a"), best("ours").alias("b"), best("theirs").alias("c"), F.max(F.abs(F.col("ours") - F.col("theirs"))).alias("most"), F.sum(F.abs(F.col("ours") - F.col("theirs"))).alias("sum"), F.count("*").alias("n"))
    return cases.agg(F.count("*").alias("cases"), _count(F.col("a.gold")).alias("first_tier"), _count(F.col("b.gold")).alias("ours"), _count(F.col("c.gold")).alias("theirs"), _count(F.col("b.cand") == F.col("c.cand")).alias("agree"),
                     F.max("most").alias("max_diff"), (F.sum("sum") / F.sum("n")).alias("mean_diff"))


def detection_scores(predictions: DataFrame, thresholds: list[float], beta: float = 0.5) -> DataFrame:
    """predictions (p, actual 0/1): for each threshold tp, fp, fn, precision, recall, f_beta, f1. The table is read once:
    each row is counted at all thresholds before the shuffle, of which there is one row a threshold and task."""
    at = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    said = F.col("p") >= F.col("threshold")
    out = predictions.select("p", "actual", at).groupBy("threshold").agg(_count(said & (F.col("actual") == 1)).alias("tp"), _count(said & (F.col("actual") == 0)).alias("fp"), _count(~said & (F.col("actual") == 1)).alias("fn"))
    out = out.withColumn("precision", F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))).withColumn("recall", F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0)))
    return out.withColumn("f_beta", vectors.f_beta("precision", "recall", beta)).withColumn("f1", vectors.f_beta("precision", "recall", 1.0))


def weight_sweep(scores: DataFrame, weights: list[float]) -> DataFrame:
    """scores (case_id, cand, gold, score, sim): for each weight, cases that score + weight * sim gets right, and how many
    it mends or spoils against the score alone."""
    w = F.explode(F.array(*(F.lit(float(x)) for x in weights))).alias("weight")
    rows = scores.select("*", w).withColumn("_t", F.col("score") + F.col("weight") * F.col("sim"))
    best = lambda c: F.min_by("gold", F.struct(-F.col(c), "cand"))
    cases = rows.groupBy("weight", "case_id").agg(best("_t").alias("now"), best("score").alias("before"))
    return cases.groupBy("weight").agg(F.count("*").alias("cases"), _count(F.col("now")).alias("right"), _count(F.col("now") & ~F.col("before")).alias("better"), _count(~F.col("now") & F.col("before")).alias("worse")).withColumn("net", F.col("better") - F.col("worse"))


def mean_match_rate(rates: DataFrame) -> DataFrame:
    """doc_id, match_rate: the mean of a document's segments, 1 without any."""
    return rates.groupBy("doc_id").agg(F.coalesce(F.avg("match_rate"), F.lit(1.0)).alias("match_rate"))


def document_stats(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text.word_stat("text").cast("long").alias("n_words"), text.char_stat("text").cast("long").alias("n_chars"))


def running_rank(ranked: DataFrame) -> DataFrame:
    """Candidates with the share of a typed word's total score that they and those before them hold."""
    w = Window.partitionBy("typed").orderBy("rank")
    total = F.sum("score").over(Window.partitionBy("typed"))
    return ranked.withColumn("share", F.sum("score").over(w) / total)
