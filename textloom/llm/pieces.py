"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text's segmentation into the pieces of a fixed vocabulary is drawn with the probability that a unigram model over
those pieces gives it: the forward pass sums the weights of all segmentations up to each position, the backward pass
draws, from the end, the piece that ends where the last one began. Draws are hashes of seed, row key, unit and step,
so a row's segmentation depends on nothing but its key and text.

A byte-pair vocabulary has merge ranks but no probabilities; a piece of rank r has weight (r + 2) ** -alpha, the shape
that piece frequencies have. alpha: 0 draws among all segmentations alike, large values draw the likeliest.
A character without a piece is written as its byte pieces. No dummy prefix is added and no space is dropped, so the
text is the pieces' texts in a row, whatever was drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lattice
from .bytetext import U64, gather, lean, mix64, slices
from .langid import distinct_units
from .store import small_batches

#: Log weight of a character without a piece.
BARE = -20.0
SCALE = 2.0


def _weights(vocabulary: lattice.Vocabulary, alpha: float) -> np.ndarray:
    """By piece and, last, for the bare character."""
    return np.append((np.arange(len(vocabulary)) + 2.0) ** -alpha, np.exp(BARE))


def sample_ids(vocabulary: lattice.Vocabulary, weight: np.ndarray, raw: np.ndarray, at: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts in a row, and the number before each text (len+1). keys: uint64, by text."""
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    starts, sizes, place, first = distinct_units(vocabulary, raw, at)
    body = gather(raw, starts, sizes)
    net = lattice.build(vocabulary, body, sizes)
    total, factor = lattice.forward(net, weight[net.piece] * np.exp(SCALE * (net.target - net.source)))
    # For each position, the arcs that end there and the draws below which each is taken.
    order = np.lexsort((net.source, net.target))
    source, target, piece = net.source[order], net.target[order], net.piece[order]
    share = total[source] * weight[piece] * np.exp(SCALE * (target - source) + factor[source] - factor[target]) / total[target]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    upto = share.copy()
    for r in range(1, int(rank.max()) + 1):
        k = np.flatnonzero(rank == r)
        upto[k] += upto[k - 1]
    is_last = np.append(target[1:] != target[:-1], True)
    limit = np.where(is_last, 1 << 32, np.minimum(upto * (1 << 32), (1 << 32) - 1).astype(np.int64)).astype(U64)
    limits = np.maximum.accumulate((target.astype(U64) << U64(32)) + limit)

    n = len(place)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(first))
    state = mix64(keys[owner] + mix64(U64(seed) + (np.arange(n) - first[:-1][owner]).astype(U64)))
    where, begin, live = net.last[place], net.first[place], np.arange(n)
    arcs, holders = [], []
    while len(live):
        state = mix64(state + U64(0x9E3779B97F4A7C15))
        arc = np.searchsorted(limits, (where.astype(U64) << U64(32)) + (state >> U64(32)), "right")
        arcs.append(arc), holders.append(live)
        where = source[arc]
        more = where > begin
        live, where, begin, state = live[more], where[more], begin[more], state[more]
    drawn, holder = np.concatenate(arcs), np.concatenate(holders)
    step = np.repeat(np.arange(len(arcs)), [len(h) for h in holders])
    ends = np.cumsum(np.bincount(holder, minlength=n))
    chosen = np.empty(len(drawn), np.int64)
    chosen[ends[holder] - 1 - step] = drawn
    ids = piece[chosen]
    before = np.concatenate(([0], ends))[first]
    bare = np.flatnonzero(ids < 0)
    if len(bare):  # each stands for its character's bytes
        unit = np.searchsorted(net.first, source, "right") - 1
        wide = np.ones(len(ids), np.int64)
        wide[bare] = (target - source)[chosen[bare]]
        done = np.cumsum(wide)
        out = np.repeat(ids, wide)
        spots = np.flatnonzero(out < 0)
        within = spots - np.repeat((done - wide)[bare], wide[bare])
        out[spots] = vocabulary.byte_piece[body[np.repeat((source - unit)[chosen[bare]], wide[bare]) + within]]
        ids, before = out, np.concatenate(([0], done))[before]
    return ids.astype(np.int32), before


def decode_ids(vocabulary: lattice.Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes that ids stand for."""
    table = b"".join(vocabulary.texts)
    size = np.fromiter(map(len, vocabulary.texts), np.int64, len(vocabulary))
    return gather(np.frombuffer(table, np.uint8), (np.cumsum(size) - size)[ids], size[ids])


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", seed: int = 0, alpha: float = 1.0, ids: bool = True) -> DataFrame:
    """One row a row of docs: the key, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers),
    lossless (the ids decode to the text; checked for every row) and, if asked for, piece_ids.

    model: path of a SentencePiece model file on every machine. A null or empty text has no ids, and decodes to the
    empty text. A null key is drawn for as 0. Rows with equal key and text are drawn alike. Whole texts are encoded, of any
    length, over all segmentations; a worker holds some 150 bytes for each byte of the longest text. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = lattice.load(model)
        weight = _weights(vocabulary, alpha)
        for batch in batches:
            for part, raw, at in slices(batch, "text"):
                keys = mix64(part.column("key").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
                out, before = sample_ids(vocabulary, weight, raw, at, keys, seed)
                back = decode_ids(vocabulary, out)
                size = np.fromiter(map(len, vocabulary.texts), np.int64, len(vocabulary))[out]
                ends = np.concatenate(([0], np.cumsum(size)))[before]
                same = np.array_equal(ends, at) and np.array_equal(back, raw)
                exact = [True] * part.num_rows if same else [bytes(back[ends[i] : ends[i + 1]]) == bytes(raw[at[i] : at[i + 1]]) for i in range(part.num_rows)]
                body = memoryview(out.astype("<u4").tobytes())
                lists = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(out if ids else out[:0])) if ids else pa.nulls(part.num_rows, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.diff(before)), pa.array([zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(before[:-1].tolist(), before[1:].tolist())], pa.int64()), pa.array(exact, pa.bool_()), lists],
                                                 names=["key", "n_pieces", "ids_crc32", "lossless", "piece_ids"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    out = rows.mapInArrow(lean(run), "key bigint, n_pieces bigint, ids_crc32 bigint, lossless boolean, piece_ids array<int>")
    return out.select(F.col("key").alias(key), "n_pieces", "ids_crc32", "lossless", *(["piece_ids"] if ids else []))


def decode(rows: DataFrame, model: str, column: str = "piece_ids") -> DataFrame:
    """rows and `text`, decoded from their ids; null ids give a null text."""
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "text"), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = lattice.load(model)
        for batch in batches:
            texts = [None if x is None else decode_ids(vocabulary, np.array(x, np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return (rows.drop("text") if "text" in rows.columns else rows).mapInArrow(run, schema)
