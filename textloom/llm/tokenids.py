"""Whole documents as token ids in compressed shards, written and read back.

Documents are range-partitioned by doc_id and sorted, so the ids of all documents form one sequence in ascending
doc_id order; each partition is tokenised and compressed where it lies, in shards of bounded size (repair.py), and
written by Spark's own committed Parquet writer with one payload a row: a lost executor repeats its tasks, and no
reader ever sees half a shard.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import repair
from .bytetext import distinct_spans, folded, gather, lean, slices, word_spans
from .store import small_batches, text_bytes

SHARD_SCHEMA = "part int, seq int, doc_ids array<bigint>, n_ids bigint, payload binary"
#: ASCII letters; the bytes of Latin-1 letters after C3; ASCII marks without the apostrophe, which starts tokens of its own.
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b == 39)]] = True


class WordEncoder:
    """Ids of a text by its words, each distinct word encoded once by the tokenizers library.

    For tokenizers that lower-case, drop white space and never join across it: a text's ids are its words' ids in a
    row. A word's case is folded first (A-Z only), and ASCII marks after a plain letter are cut off as a word of their
    own, because the tokenizer's own pattern cuts there; both make fewer distinct words. Words of a-z alone are given to
    the library's model directly, which skips its normaliser and pattern, as neither changes them. A word that holds <|,
    with which the tokenizer's control strings begin, goes to the library as it stands. Words are told apart by their bytes.
    """

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.most = most
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.keys, self.starts, self.sizes, self.word_starts, self.word_sizes = np.zeros(0, np.uint64), none, none, none, none
        self.ids, self.words = np.zeros(0, np.uint16), np.zeros(0, np.uint8)

    def _spans(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes as they are compared, starts and ends of what is encoded on its own, and their number before each text."""
        plain = folded(raw)
        starts, ends, first = word_spans(raw, at)
        cut = ends.copy()
        live = np.arange(len(ends))
        while len(live):
            live = live[(cut[live] - 1 > starts[live])]
            live = live[_MARK[plain[cut[live] - 1]]]
            cut[live] -= 1
        before = plain[cut - 1] if len(cut) else plain[:0]
        latin = np.zeros(len(cut), bool)
        two = np.flatnonzero((before >= 0x80) & (cut - 2 >= starts))
        latin[two] = (plain[cut[two] - 2] == 0xC3) & (before[two] != 0x97) & (before[two] != 0xB7)
        split = (cut < ends) & (_LOWER[before] | latin)
        for i in np.unique(np.searchsorted(starts, np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124)), "right") - 1).tolist():
            split[i] = False
            plain[starts[i] : ends[i]] = raw[starts[i] : ends[i]]
        cut[~split] = ends[~split]
        n = 1 + split.astype(np.int64)
        end_at = np.cumsum(n)
        s, e = np.empty(int(end_at[-1]) if len(n) else 0, np.int64), np.empty(int(end_at[-1]) if len(n) else 0, np.int64)
        s[end_at - n], e[end_at - n] = starts, cut
        s[end_at[split] - 1], e[end_at[split] - 1] = cut[split], ends[split]
        return plain, s, e, np.concatenate(([0], end_at))[first]

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number before each text (len+1)."""
        plain, starts, ends, first = self._spans(raw, at)
        keys, example, place = distinct_spans(plain, starts, ends)
        begin, size, pool = self._looked_up(plain, keys, starts[example], ends[example])
        begin, size = begin[place], size[place]
        done = np.cumsum(size)
        ids = pool[np.repeat(begin - (done - size), size) + np.arange(int(done[-1]) if len(done) else 0)]
        return ids, np.concatenate(([0], done))[first]

    def _looked_up(self, plain: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of some distinct words where its ids begin in a pool, and how many they are; and the pool."""
        spot = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[spot] != keys if len(self.keys) else np.ones(len(keys), bool)
        old, sizes = np.flatnonzero(~new), ends - starts
        same = np.array_equal(sizes[old], self.word_sizes[spot[old]]) and np.array_equal(gather(plain, starts[old], sizes[old]), gather(self.words, self.word_starts[spot[old]], sizes[old]))
        if not same or len(keys) > 1 and (np.sort(keys)[1:] == np.sort(keys)[:-1]).any():
            return self._encoded(plain, starts, ends)  # two words of one hash: nothing is remembered
        if new.any():
            if len(self.keys) > self.most:  # a cache: what it forgets is encoded again
                self._forget()
                new[:] = True
            self._learn(plain, keys[new], starts[new], ends[new])
            spot = np.searchsorted(self.keys, keys)
        return self.starts[spot], self.sizes[spot], self.ids

    def _encoded(self, plain: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odd = np.concatenate(([0], np.cumsum(~_LOWER[plain])))
        lower = odd[ends] == odd[starts]
        body = plain.tobytes()
        words = [body[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
        found: list[list[int]] = [[]] * len(words)
        tokenize = self.model.tokenize
        for i in np.flatnonzero(lower).tolist():
            found[i] = [t.id for t in tokenize(words[i].decode())]
        rest = np.flatnonzero(~lower).tolist()
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for j, e in zip(part, self.tokenizer.encode_batch_fast([words[j].decode("utf-8", "replace") for j in part], add_special_tokens=False)):
                found[j] = e.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.cumsum(sizes) - sizes, sizes, np.fromiter((x for f in found for x in f), np.uint16, int(sizes.sum()))

    def _learn(self, plain: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        begins, sizes, ids = self._encoded(plain, starts, ends)
        word_sizes = ends - starts
        keys = np.append(self.keys, keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.sizes = keys[order], np.append(self.starts, begins + len(self.ids))[order], np.append(self.sizes, sizes)[order]
        self.word_starts, self.word_sizes = np.append(self.word_starts, np.cumsum(word_sizes) - word_sizes + len(self.words))[order], np.append(self.word_sizes, word_sizes)[order]
        self.ids, self.words = np.append(self.ids, ids), np.append(self.words, gather(plain, starts, word_sizes))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process, kept between its tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, shard_ids: int = 2_000_000) -> DataFrame:
    """docs (doc_id, text) -> one row a shard (SHARD_SCHEMA), shards and their documents in ascending doc_id order.

    A null or empty text is its end id alone; null doc_ids come first; rows that repeat a doc_id are separate documents,
    in the order of a hash of their texts, then of the texts. Rows are dealt out by doc_id, that hash and their place, so
    rows that repeat a doc_id, or are equal, fill as many partitions as their number asks for; docs must be read in a
    stable order, as a table is. A document longer than a shard has a shard for itself, whole. Other columns are ignored,
    whatever their names; no rows give no shards.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = text_bytes(rows)
    parts = max(1, size // (24 << 20), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (4 << 20)))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(parts, "doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        words = encoder(tokenizer)
        width = words.tokenizer.get_vocab_size(with_added_tokens=True)
        doc_ids: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        n, seq = 0, 0

        def shard() -> pa.RecordBatch:
            ids = np.concatenate(held)
            payload = repair.write_shard(ids, np.concatenate(sizes), width)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())],
                                              names=["part", "seq", "doc_ids", "n_ids", "payload"])

        for batch in batches:
            for rows, raw, at in slices(batch, "text"):
                ids, before = words.encode(raw, at)
                lengths = np.diff(before) + 1
                out = np.full(len(ids) + len(lengths), end_id, np.int32)
                ends = np.cumsum(lengths) - 1
                inner = np.ones(len(out), bool)
                inner[ends] = False
                out[inner] = ids
                held.append(out), sizes.append(lengths)
                doc_ids += rows.column("doc_id").to_pylist()
                n += len(out)
                if n >= shard_ids:
                    yield shard()
                    doc_ids, held, sizes, n, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield shard()

    small_batches(docs.sparkSession)
    return ordered.mapInArrow(lean(write), SHARD_SCHEMA)


#: Parts whose totals one task sums.
TOGETHER = 4096


def _placed(shards: DataFrame) -> DataFrame:
    """shards with `before`: the ids of all shards before each. Totals are summed by part and by TOGETHER parts first, so no
    task sees more than the totals of so many parts, or of one part's shards."""
    own = shards.select("part", "seq", "n_ids", F.expr(f"part div {TOGETHER}").alias("g"))
    earlier = lambda key, *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = own.groupBy("g", "part").agg(F.sum("n_ids").alias("n"))
    groups = parts.groupBy("g").agg(F.sum("n").alias("n"))
    groups = groups.select("g", earlier("g").alias("of_groups"))
    parts = parts.select("g", "part", earlier("part", "g").alias("of_parts"))
    own = own.withColumnRenamed("n_ids", "n").select("part", "seq", earlier("seq", "part").alias("of_shards"))
    before = own.join(parts, "part").join(groups, "g").select("part", "seq", F.expr("of_groups + of_parts + of_shards").alias("before"))
    return shards.join(before, ["part", "seq"])


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of written shards, decoded from their payloads. start counts
    the ids of all documents before it. No shards give no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = repair.Shard(batch.column("payload")[i].as_py())
                ids = shard.all().astype("<u4")
                first = shard.ends - shard.lengths
                body = memoryview(ids.tobytes())
                crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(first.tolist(), shard.ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(first + batch.column("before")[i].as_py()), pa.array(shard.lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(shards).select("doc_ids", "payload", "before").mapInArrow(lean(read), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_some(shards: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id, token_ids of the documents with one of doc_ids, by random access: only shards that hold one are read, and of
    those only the blocks of symbols that cover it are expanded."""
    wanted = set(doc_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = repair.Shard(batch.column("payload")[i].as_py())
                at = [(d, shard.document(j)) for j, d in enumerate(batch.column("doc_ids")[i].as_py()) if d in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in at], pa.int64()), pa.array([x.tolist() for _, x in at], pa.list_(pa.int32()))], names=["doc_id", "token_ids"])

    some = shards.where(F.arrays_overlap("doc_ids", F.array(*(F.lit(x).cast("bigint") for x in sorted(wanted)))))
    return some.select("doc_ids", "payload").mapInArrow(read, "doc_id bigint, token_ids array<int>")
