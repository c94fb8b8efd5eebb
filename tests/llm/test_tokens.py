from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import bytetext, lattice, pieces, repair, tokenids
from textloom.llm.queries import PIECES, tokenizer_path

TEXTS = [None, "", "a", "The the THE, the.", "don't 'tis we'll 12 3.5!", "é́ ß été, naïve— x", "tabs\tand\nlines\r\n", "日本語 text 😀😀", "a▁b ▁ c", "<|endoftext|> x", "hello<|endoftext|>X<|STARTOFTEXT|>, a<|startoftext|>b <|endoftext |> <|", "x" * 5000, "  two  spaces  "]


def encoded(texts):
    raw, at = bytetext.text_bytes(pa.array(texts, pa.string()))
    ids, before = tokenids.WordEncoder(tokenizer_path("word_bpe_49k.json")).encode(raw, at)
    return [ids[before[i] : before[i + 1]].tolist() for i in range(len(texts))]


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("aB é'.,-!?1 \n") for _ in range(rng.randrange(60))) for _ in range(500)]
    for text, got in zip(texts, encoded(texts)):
        assert got == whole.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 60000])
def test_repair_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.concatenate((rng.zipf(1.3, n) % 500, np.full(n // 3, 7), np.tile([1, 2, 3], n // 9))).astype(np.int32)
    lengths = np.diff(np.sort(np.concatenate(([0, len(ids)], rng.integers(0, len(ids) + 1, 20)))))
    shard = repair.Shard(repair.write_shard(ids, lengths, 500, most=64, least=4))
    assert (shard.all() == ids).all()
    ends = np.cumsum(lengths)
    for i in range(len(lengths)):
        assert (shard.document(i) == ids[ends[i] - lengths[i] : ends[i]]).all()
    if n == 60000:
        assert len(shard.rules) > 10 and shard.symbols < 0.8 * len(ids)


def test_shards_read_back(spark):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choice(["alpha", "beta", "Gamma,"]) for _ in range(rng.randrange(50)))) for i in range(60)] + [(3, "again"), (None, "nobody")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as part", "2 as payload")
    out = tokenids.read_documents(tokenids.encode_shards(docs, tokenizer_path("word_bpe_49k.json"), shard_ids=150)).collect()
    out.sort(key=lambda r: r["start"])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in out] == [d for d, _ in order]
    both = [i for i, (d, _) in enumerate(order) if d == 3]
    if out[both[0]]["n_tokens"] != len(encoded([order[both[0]][1]])[0]) + 1:  # rows that repeat a doc_id are ordered by a hash
        order[both[0]], order[both[1]] = order[both[1]], order[both[0]]
    start = 0
    for r, (_, text), ids in zip(out, order, encoded([t for _, t in order])):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes())), text
        start += len(ids) + 1


def test_documents_by_random_access(spark):
    rows = [(i, f"alpha beta {i} gamma " * (i % 50)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    shards = tokenids.encode_shards(docs, tokenizer_path("word_bpe_49k.json"), shard_ids=2000).cache()
    got = {r["doc_id"]: r["token_ids"] for r in tokenids.read_some(shards, [0, 7, 299, 4000]).collect()}
    assert got == {i: [*ids, 1] for i, ids in zip((0, 7, 299), encoded([rows[i][1] for i in (0, 7, 299)]))}


def thue_morse(n, flip=False):
    out = b"a"
    while len(out) < n:
        out += bytes(b ^ 3 for b in out)
    return (bytes(b ^ 3 for b in out) if flip else out)[:n].decode()


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    one, other = thue_morse(2048), thue_morse(2048, True)
    raw, at = bytetext.text_bytes(pa.array([one, other]))
    a, b = bytetext.span_hashes(raw, at[:-1], at[1:])
    assert one != other and a != b
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = [whole.encode(t, add_special_tokens=False).ids for t in (one, other, "a b, a")]
    assert encoded([one, other, "a b, a"]) == want
    monkeypatch.setattr(bytetext, "span_hashes", lambda raw, starts, ends, chunks=None: np.zeros(len(starts), np.uint64))
    raw, at = bytetext.text_bytes(pa.array([one, other, "a b, a"]))
    words = tokenids.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    for _ in range(2):
        ids, before = words.encode(raw, at)
        assert [ids[before[i] : before[i + 1]].tolist() for i in range(3)] == want


def test_rounds_go_on_to_the_end():
    ids = np.tile(np.arange(64), 500).astype(np.int32)
    symbols, rules = repair.compress(ids, 100, saving=0)
    assert len(symbols) <= 500 and (repair.expand(symbols, rules, 100) == ids).all()
    shard = repair.Shard(repair.write_shard(ids, np.array([len(ids)]), 100))
    assert (shard.expand == repair.expansion_lengths(shard.rules, 100)).all() and (shard.slice(777, 9001) == ids[777:9001]).all()


def test_no_documents_no_shards(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokenids.read_documents(tokenids.encode_shards(docs, tokenizer_path("word_bpe_49k.json"))).collect() == []


def all_segmentations(vocabulary, unit):
    """(ids, weight) of each segmentation, by trying every piece everywhere."""
    weight = pieces._weights(vocabulary, 1.0)
    by_text = {t: i for i, t in enumerate(vocabulary.texts) if i not in set(vocabulary.byte_piece.tolist())}
    out = []

    def walk(at, ids, w):
        if at == len(unit):
            out.append((tuple(ids), w))
            return
        for end in range(at + 1, len(unit) + 1):
            i = by_text.get(unit[at:end])
            if i is not None and i > 2:
                walk(end, [*ids, i], w * weight[i])

    walk(0, [], 1.0)
    return out


def test_samples_follow_the_lattice():
    vocabulary = lattice.load(tokenizer_path(PIECES))
    unit = b" there"
    known = all_segmentations(vocabulary, unit)
    total = sum(w for _, w in known)
    raw = np.frombuffer(unit * 20000, np.uint8)
    at = np.arange(20001) * len(unit)
    keys = bytetext.mix64(np.arange(20000, dtype=np.uint64))
    ids, before = pieces.sample_ids(vocabulary, pieces._weights(vocabulary, 1.0), raw, at, keys, 3)
    seen = {}
    for i in range(20000):
        x = tuple(ids[before[i] : before[i + 1]].tolist())
        seen[x] = seen.get(x, 0) + 1
    assert set(seen) <= {x for x, _ in known}
    for x, w in known:
        p = w / total
        assert abs(seen.get(x, 0) / 20000 - p) < 5 * (p * (1 - p) / 20000) ** 0.5 + 1e-4, x


def test_pieces_round_trip_and_repeat(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "nobody"), (5, "Alpha beta.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as piece_ids", "'y' as key")
    one = pieces.encode(docs, tokenizer_path(PIECES), seed=1)
    a = sorted(one.collect(), key=str)
    b = sorted(pieces.encode(docs.repartition(3), tokenizer_path(PIECES), seed=1).collect(), key=str)
    assert a == b and all(r["lossless"] for r in a)
    assert a != sorted(pieces.encode(docs, tokenizer_path(PIECES), seed=2).collect(), key=str)
    back = sorted((r["text"] for r in pieces.decode(one, tokenizer_path(PIECES)).collect()), key=str)
    assert back == sorted((t or "" for _, t in rows), key=str)
    assert pieces.encode(docs.limit(0), tokenizer_path(PIECES)).collect() == []
