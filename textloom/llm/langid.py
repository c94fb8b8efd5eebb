"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A text's likelihood in a language is the
product over its units (see lattice.py) of the sum over all segmentations of the product of their pieces'
probabilities, which the forward algorithm gives; no single segmentation is preferred. The probabilities are fitted
by expectation maximisation over the same lattices, on a bounded sample of labelled documents: each round's expected
counts are summed by the executors, so the driver only ever holds the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import lattice
from .bytetext import distinct_spans, gather, lean, slices
from .store import drop, fresh, settle, small_batches

#: A character without a piece has this log probability in every language.
BARE = -16.0
#: Log probability by which each byte is scaled, so that sums of products stay near 1.
SCALE = 2.0
#: Bytes of units whose lattice is held at a time, and positions of a longer unit.
BLOCK_BYTES = 1 << 16
#: Units whose likelihoods a worker remembers.
REMEMBERED = 200_000
#: Parts of an expected count that are told apart; whole numbers have the same sum in any order.
UNITY = 1 << 20


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_probability: np.ndarray  # pieces and, last, the bare character, by language
    path: str


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def distinct_units(vocabulary: lattice.Vocabulary, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A start and size of each distinct unit, for each unit of the texts its place in them, and units before each text."""
    starts, first = lattice.units(vocabulary, raw, at)
    ends = np.append(starts[1:], len(raw))
    _, example, place = distinct_spans(raw, starts, ends)
    return starts[example], (ends - starts)[example], place, first


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of spans of at most BLOCK_BYTES together, or of one span."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_BYTES, "right")))
        yield i, j
        i = j


def fit(docs: DataFrame, path: str, sample: int = 2000, rounds: int = 3, smoothing: float = 0.5, most_languages: int = 256) -> Model:
    """Learns from text and non-null lang of documents that are not held out, and from nothing else.

    sample: at most so many documents in all, evenly over the languages (all of a language with fewer), those with the
    least hashes of doc_id and text, then by doc_id; rounds: of expectation maximisation. A table with more than
    most_languages values of lang is refused, as the model is as large as pieces by languages. Without labels nothing is
    learned; null texts are not labelled documents.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"lang has more than {most_languages} values")
    if not counts:
        return Model((), np.zeros((0, 0)), path)
    languages = tuple(sorted(counts))
    share = max(1, sample // len(languages))
    # First a chance by hash that leaves some more than the share; then the least hashes. Spark keeps `share` rows of a
    # language in each task before it deals them out, so rows that repeat are no burden.
    chance = F.create_map(*(F.lit(v) for x in languages for v in (x, min(1.0, 2 * (share + 50) / counts[x]))))
    drawn = known.withColumn("h", F.xxhash64("doc_id", "text", F.lit("langid")))
    drawn = drawn.where(F.pmod("h", F.lit(1 << 40)) <= F.element_at(chance, F.col("lang")) * (1 << 40))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    drawn = drawn.withColumn("place", place).where(F.col("place") <= share)
    drawn = settle(drawn.select(F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int").alias("lang"), "text").repartition(max(1, min(16, sample // 100))), "labelled")
    width = len(lattice.load(path)) + 1
    probability = np.full((width, len(languages)), 1.0 / width)
    for _ in range(rounds):
        expected = np.zeros((width, len(languages)))
        found = drawn.mapInArrow(lean(_counting(path, probability)), "piece int, lang int, n bigint").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        expected[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy() / UNITY
        expected[-1] = 0
        probability = (expected + smoothing) / (expected + smoothing).sum(0)
    table = np.log(probability)
    table[-1] = BARE
    drop(drawn)
    return Model(languages, table, path)


def _counting(path: str, probability: np.ndarray):
    """How often each piece is expected in the segmentations of texts, by language, in parts of UNITY."""
    k = probability.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = lattice.load(path)
        expected = np.zeros(probability.shape)
        for batch in batches:
            for part, raw, at in slices(batch, "text"):
                if not len(raw):
                    continue
                starts, sizes, place, first = distinct_units(vocabulary, raw, at)
                lang = np.repeat(part.column("lang").to_numpy() - 1, np.diff(first))
                weights = np.bincount(place * k + lang, minlength=len(sizes) * k).reshape(-1, k).astype(float)
                for i, j in _blocks(sizes):
                    _expect(lattice.build(vocabulary, gather(raw, starts[i:j], sizes[i:j]), sizes[i:j]), probability, weights[i:j], expected)
        piece, lang = np.nonzero(expected)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(piece, pa.int32()), "lang": pa.array(lang, pa.int32()), "n": pa.array(np.rint(expected[piece, lang] * UNITY).astype(np.int64))})

    return run


def _expect(net: lattice.Lattice, probability: np.ndarray, weights: np.ndarray, expected: np.ndarray) -> None:
    """Adds to `expected` how often each piece occurs in a segmentation of the units, which occur `weights` times."""
    reverse, order = lattice.mirrored(net)
    arc = np.where((net.piece >= 0)[:, None], probability[net.piece], np.exp(BARE)) * np.exp(SCALE * (net.target - net.source))[:, None]
    (ahead, lead), (behind, trail) = lattice.forward(net, arc), lattice.forward(reverse, arc[order])
    unit = np.searchsorted(net.first, net.source, "right") - 1
    end, back = net.last[unit], int(net.last[-1]) - net.target
    share = ahead[net.source] * arc * behind[back] / ahead[end] * np.exp(lead[net.source] + trail[back] - lead[end]) * weights[unit]
    for k in range(expected.shape[1]):
        expected[:, k] += np.bincount(np.where(net.piece >= 0, net.piece, len(expected) - 1), share[:, k], len(expected))


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of the Unicode categories of letters (L*)."""
    return text is not None and any(c.isalpha() for c in text)


class Scorer:
    """Log likelihoods of units by language, of which the latest REMEMBERED or more are kept."""

    def __init__(self, model: Model) -> None:
        self.vocabulary, self.table = lattice.load(model.path), np.exp(model.log_probability)
        self.rows: dict[bytes, int] = {}
        self.values = np.zeros((0, self.table.shape[1]))

    def scores(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        body = raw.tobytes()
        names = [body[s : s + z] for s, z in zip(starts.tolist(), sizes.tolist())]
        if len(self.values) > REMEMBERED:
            self.rows, self.values = {}, self.values[:0]
        spot = np.fromiter((self.rows.get(x, -1) for x in names), np.int64, len(names))
        new = np.flatnonzero(spot < 0)
        if len(new):
            spot[new] = len(self.values) + np.arange(len(new))
            self.values = np.concatenate((self.values, self._fresh(raw, starts[new], sizes[new])))
            self.rows.update((names[i], s) for i, s in zip(new.tolist(), spot[new].tolist()) if len(names[i]) <= 64)
        return self.values[spot]

    def _fresh(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.empty((len(starts), self.table.shape[1]))
        short = np.flatnonzero(sizes <= BLOCK_BYTES)
        for i, j in _blocks(sizes[short]):
            at = short[i:j]
            net = lattice.build(self.vocabulary, gather(raw, starts[at], sizes[at]), sizes[at])
            total, factor = lattice.forward(net, self.table[net.piece] * np.exp(SCALE * (net.target - net.source))[:, None])
            out[at] = np.log(total[net.last]) + factor[net.last] - SCALE * sizes[at, None]
        for i in np.flatnonzero(sizes > BLOCK_BYTES).tolist():
            out[i] = self._long(raw[starts[i] : starts[i] + sizes[i]])
        return out

    def _long(self, raw: np.ndarray) -> np.ndarray:
        """Of one unit of any length, window by window: the sums at the first positions of a window are carried over."""
        reach, k = self.vocabulary.depth, self.table.shape[1]
        carried, factor, at = np.ones((1, k)), np.zeros(k), 0
        while at < len(raw):
            size = min(BLOCK_BYTES, len(raw) - at)
            stop = min(len(raw), at + size + reach)
            net = lattice.build(self.vocabulary, raw[at:stop], np.array([stop - at]))
            weight = self.table[net.piece] * np.exp(SCALE * (net.target - net.source))[:, None]
            total = np.zeros((stop - at + 1, k))
            total[: len(carried)] = carried
            scaled = 0
            for o in range(size):
                if o >= scaled + lattice.RESCALE:
                    most = total[o : o + reach + 1].max(0)
                    total[o : o + reach + 1] /= most  # nothing is reached beyond
                    factor, scaled = factor + np.log(most), o
                i, j = net.step[o], net.step[o + 1]
                if i < j:
                    total[net.target[i:j]] += total[o] * weight[i:j]
            most = total[size : size + reach + 1].max(0)
            carried, factor, at = total[size : size + reach + 1] / most, factor + np.log(most), at + size
        return np.log(carried[0]) + factor - SCALE * len(raw)


def judged(docs: DataFrame, model: Model) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: lang_pred and score as in `predict`, under names that docs does not
    have. No row moves: each is told where it lies."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lang, sure = fresh(docs.columns, "lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(sure, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.languages)
        scorer = Scorer(model) if k else None
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            for part, raw, at in slices(batch, "text"):
                ok = np.array([has_letter(t) for t in part.column("text").to_pylist()], bool)
                n = part.num_rows
                best, found = np.full(n, k), np.zeros(n)
                if scorer and ok.any():
                    starts, sizes, place, first = distinct_units(scorer.vocabulary, raw, at)
                    values = scorer.scores(raw, starts, sizes)
                    owner = np.repeat(np.arange(n), np.diff(first))
                    sums = np.stack([np.bincount(owner, values[place, j], n) for j in range(k)], 1)
                    sums = (sums - sums.max(1, keepdims=True)) / np.sqrt(np.maximum(1, np.diff(first)))[:, None]
                    best = np.where(ok, sums.argmax(1), k)
                    found = np.where(ok, 1.0 / np.exp(sums).sum(1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best], pa.string()), pa.array(found)], names=[*part.schema.names, lang, sure])

    return docs.mapInArrow(lean(run), schema), lang, sure


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id, lang_pred, score, a row for each of docs. lang_pred is `und` with score 0 if text is null, empty or
    has no letter (Unicode categories L*), or if nothing was learned; else the likeliest language (ties: the least) and its
    posterior probability, with equal priors and the log likelihood divided by the root of the number of units (as
    neighbouring units depend on each other). Whole texts are scored, of any length; lang and source are not read, nor is
    doc_id, so null and repeated ones are told like others, and equal texts alike. Other columns are ignored, whatever
    their names; an empty table gives no rows. A worker holds some 100 bytes for each byte of the longest text.
    """
    out, lang, sure = judged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", F.col(lang).alias("lang_pred"), F.col(sure).alias("score"))
