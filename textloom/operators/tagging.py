"""Edit tagging around an injected model: alignment of subwords, gates, labels, edits, iteration.

logits: (doc_id, tok, word_id, labels array<double>, detect array<double>), one row a subword, word_id null for special
ones. The model itself is a plug (see plans.plugs); everything around it is here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import vectors

# Fixed values.
KEEP, DELETE, START = "$KEEP", "$DELETE", "$START"
PADDING, UNKNOWN = "<PAD>", "<OOV>"
REPLACE, APPEND = "$REPLACE_", "$APPEND_"
MIN_ERROR_PROBABILITY = 0.5
MIN_LABEL_PROBABILITY = 0.5
MOST_PASSES = 5
MOST_SUBWORDS = 128


def first_subwords(logits: DataFrame) -> DataFrame:
    """The rows of each word's first subword."""
    w = Window.partitionBy("doc_id").orderBy("tok")
    return logits.withColumn("_before", F.lag("word_id").over(w)).where("word_id is not null and (_before is null or _before != word_id)").drop("_before")


def probabilities(logits: DataFrame, incorrect: int = 1, keep_bias: float = 0.0, keep: int = 0) -> DataFrame:
    """logits with p (label probabilities, the keep label raised by its bias), label_id and p_label of the first
    greatest, and p_incorrect."""
    p = vectors.softmax("labels")
    biased = F.transform(p, lambda x, i: F.when(i == keep, x + keep_bias).otherwise(x))
    out = logits.withColumn("p", biased).withColumn("p_incorrect", F.get(vectors.softmax("detect"), F.lit(incorrect)))
    return out.withColumn("label_id", vectors.argmax("p")).withColumn("p_label", F.array_max("p"))


def gated(scored: DataFrame, min_error: float = MIN_ERROR_PROBABILITY, min_label: float = MIN_LABEL_PROBABILITY, keep: int = 0) -> DataFrame:
    """scored with `max_error` (of the document's first subwords) and label_id drawn to keep where the document's
    greatest error probability, or the label's own, is too small."""
    most = F.max("p_incorrect").over(Window.partitionBy("doc_id"))
    out = scored.withColumn("max_error", most)
    low = (F.col("max_error") < min_error) | (F.col("p_label") < min_label)
    return out.withColumn("label_id", F.when(low, keep).otherwise(F.col("label_id")))


def max_error(scored: DataFrame) -> DataFrame:
    """doc_id, max_error."""
    return scored.groupBy("doc_id").agg(F.max("p_incorrect").alias("max_error"))


def labelled_words(words: Column | str, labels: Column | str) -> Column:
    """The text after one pass: each word by its label, a missing label keeping it, joined by one space."""
    w = F.col(words) if isinstance(words, str) else words
    ls = F.col(labels) if isinstance(labels, str) else labels

    def one(word: Column, i: Column) -> Column:
        label = F.coalesce(F.get(ls, i), F.lit(KEEP))
        return F.when(label == DELETE, F.lit(None)).when(F.startswith(label, F.lit(REPLACE)), F.substr(label, F.lit(len(REPLACE) + 1))).when(
            F.startswith(label, F.lit(APPEND)), F.concat(word, F.lit(" "), F.substr(label, F.lit(len(APPEND) + 1)))).otherwise(word)

    edited = F.filter(F.transform(w, one), lambda x: x.isNotNull())
    without_start = F.filter(edited, lambda x: x != START)
    return F.array_join(F.transform(without_start, lambda x: F.when(F.startswith(x, F.lit(START + " ")), F.substr(x, F.lit(len(START) + 2))).otherwise(x)), " ")


def label_arrays(first: DataFrame, vocabulary: dict[int, str]) -> DataFrame:
    """doc_id, labels: of each document, by word. vocabulary: label by id; unknown ids keep the word."""
    names = F.create_map(*(F.lit(x) for kv in vocabulary.items() for x in kv)) if vocabulary else F.create_map(F.lit(-1), F.lit(KEEP))
    named = first.select("doc_id", "word_id", F.coalesce(F.try_element_at(names, F.col("label_id")), F.lit(KEEP)).alias("label"))
    listed = named.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word_id", "label"))).alias("_m"), F.max("word_id").alias("_n"))
    return listed.select("doc_id", F.transform(F.sequence(F.lit(0), F.col("_n")), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(KEEP))).alias("labels"))


def subword_ids(words: Column | str, pieces: Callable[[Column], Column], most: int = MOST_SUBWORDS) -> Column:
    """array<struct<piece, word_id>> of words cut into subwords by `pieces` (word -> array of strings), cut off after
    `most`; words beyond have no subword, hence no label."""
    w = F.col(words) if isinstance(words, str) else words
    return F.slice(F.flatten(F.transform(w, lambda x, i: F.transform(pieces(x), lambda p: F.struct(p.alias("piece"), i.alias("word_id"))))), 1, most)


def iterate(docs: DataFrame, tagger: Callable[[list[list[str]]], list[list[str]]], passes: int = MOST_PASSES) -> DataFrame:
    """docs (doc_id, text of punctuation-tokenised words) with `corrected` and `passes`: tagger (words -> labels, in
    batches) is applied until it changes nothing, `passes` times at most; each batch is iterated where it lies, as
    a loop over the whole table would write it `passes` times."""

    def apply(words: list[str], labels: list[str]) -> list[str]:
        out: list[str] = []
        for i, word in enumerate(words):
            label = labels[i] if i < len(labels) else KEEP
            if label == DELETE:
                continue
            if label.startswith(REPLACE):
                out.append(label[len(REPLACE):])
            elif label.startswith(APPEND):
                out += [word, label[len(APPEND):]]
            else:
                out.append(word)
        return " ".join(out).split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            now = [(t or "").split() for t in texts]
            count = [0] * len(now)
            live = [i for i, w in enumerate(now) if w]
            for _ in range(passes):
                if not live:
                    break
                found = tagger([now[i] for i in live])
                still = []
                for i, labels in zip(live, found):
                    new = apply(now[i], labels)
                    count[i] += 1
                    if new != now[i]:
                        now[i] = new
                        still.append(i)
                live = still
            done = [None if t is None else " ".join(w) for t, w in zip(texts, now)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.string()), pa.array(count, pa.int32())], names=[*batch.schema.names, "corrected", "passes"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("corrected", T.StringType()), T.StructField("passes", T.IntegerType())]))


def detections(scored: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, word, p_incorrect, start, end, pos of each word (doc_id, word_id, word, start, end) but the start mark."""
    met = scored.select("doc_id", "word_id", "p_incorrect").join(words, ["doc_id", "word_id"])
    return met.where(F.col("word") != START).select("doc_id", "word", "p_incorrect", "start", "end", F.col("word_id").alias("pos"))
