"""Token ids in Re-Pair compressed shards.

A shard's id sequence is shortened by rounds: each round counts all neighbouring pairs, gives the most frequent ones a
nonterminal each and replaces them throughout, until no pair occurs `least` times or a round takes less than a `saving`-th
part of the symbols away. Pairs of one round are chosen so that no symbol is the right half of
one and the left half of another, hence no two occurrences overlap, except in runs of one symbol, of which every
second place is replaced. Rules and the number of ids that each stands for are stored, so the ids of one document are
decoded from the symbols that cover them, without the rest of the shard.

File format (little-endian), one payload a shard:
    magic "TLRP2\\0", uint32: width of an id (first nonterminal), rules, documents, symbols, bits a symbol; uint64: ids
    rules     uint32 left, uint32 right of each nonterminal, halves before wholes
    expand    uint32 ids that each nonterminal stands for
    lengths   uint32 ids in each document
    checks    uint64 ids before every BLOCK-th symbol, for random access
    symbols   packed with `bits` bits each, lowest bit first
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"TLRP2\0"
HEAD = "<6sIIIIIQ"
BLOCK = 1024
#: Cells in which pairs are first counted; only pairs of the fullest cells are counted exactly.
CELLS = 1 << 20


def _pairs_of(seq: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pairs, as left << 32 | right, and their counts, in falling order."""
    key = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:].astype(np.uint64)
    cell = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32)
    counts = np.bincount(cell, minlength=CELLS)
    limit = max(least, int(np.partition(counts, -most)[-most]) if most < CELLS else least)
    pairs, n = np.unique(key[(counts >= limit)[cell]], return_counts=True)
    order = np.lexsort((pairs, -n))[:most]
    order = order[n[order] >= least]
    return pairs[order], n[order]


def compress(ids: np.ndarray, width: int, saving: int = 50, most: int = 4096, least: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (int64) and rules (n, 2) of an id sequence. Ids are below width; rule k makes symbol width + k. A round
    replaces at most `most` pairs; saving 0: until no pair is left that occurs `least` times."""
    seq, rules = ids.astype(np.int64), []
    size = 2 * len(seq)
    while len(seq) >= 2 and (size - len(seq)) * saving >= size * (saving > 0):
        size = len(seq)
        pairs, _ = _pairs_of(seq, most, least)
        lefts, rights, chosen = set(), set(), []
        for p in pairs.tolist():
            a, b = p >> 32, p & 0xFFFFFFFF
            if a in rights or b in lefts or (a == b and (a in lefts or b in rights)):
                continue
            lefts.add(a), rights.add(b), chosen.append(p)
            if a == b:  # as both halves it may meet no other pair
                rights.add(a), lefts.add(b)
        if not chosen:
            break
        base = width + len(rules)
        rules += [(p >> 32, p & 0xFFFFFFFF) for p in chosen]
        keys = np.array(chosen, np.uint64)
        order = np.argsort(keys)
        top = base + 1
        is_left = np.zeros(top, bool)
        is_left[(keys >> np.uint64(32)).astype(np.int64)] = True
        is_right = np.zeros(top, bool)
        is_right[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(is_left[seq[:-1]] & is_right[seq[1:]])
        key = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1].astype(np.uint64)
        place = np.minimum(np.searchsorted(keys[order], key), len(keys) - 1)
        hit = keys[order][place] == key
        at, symbol = at[hit], base + order[place[hit]]
        # In a run of one symbol places follow each other: keep the first, third, ... of a run.
        if len(at):
            run = np.concatenate(([0], np.cumsum(np.diff(at) != 1)))
            rank = np.arange(len(at)) - np.searchsorted(run, run)
            at, symbol = at[rank % 2 == 0], symbol[rank % 2 == 0]
        seq[at] = symbol
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
    return seq, np.array(rules, np.int64).reshape(-1, 2)


def expansion_lengths(rules: np.ndarray, width: int) -> np.ndarray:
    """Ids that each nonterminal stands for. A rule's halves come before it."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - width] if a >= width else 1) + (out[b - width] if b >= width else 1))
    return np.array(out, np.int64)


def _sizes(symbols: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Ids that each symbol stands for, by the lengths of the nonterminals."""
    return np.append(lengths, 1)[np.where(symbols >= width, symbols - width, len(lengths))]


def expand(symbols: np.ndarray, rules: np.ndarray, width: int) -> np.ndarray:
    """The ids that symbols stand for: each pass opens every nonterminal once."""
    while len(symbols) and int(symbols.max()) >= width:
        deep = symbols >= width
        size = np.where(deep, 2, 1)
        end = np.cumsum(size)
        out = np.empty(int(end[-1]), np.int64)
        out[end - size] = np.where(deep, rules[np.maximum(symbols - width, 0), 0] if len(rules) else symbols, symbols)
        out[end[deep] - 1] = rules[symbols[deep] - width, 1]
        symbols = out
    return symbols


def _pack_bits(values: np.ndarray, bits: int) -> bytes:
    out = []
    for i in range(0, len(values), 1 << 18):  # a multiple of 8 values ends on a byte
        part = values[i : i + (1 << 18)].astype("<u4").view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(part, axis=1, bitorder="little")[:, :bits].reshape(-1), bitorder="little").tobytes())
    return b"".join(out)


def _unpack_bits(data: memoryview, start: int, n: int, bits: int) -> np.ndarray:
    """Symbols start to start + n."""
    out = np.empty(n, np.int64)
    first = start // 8 * 8
    for i in range(first, start + n, 1 << 18):
        m = min(1 << 18, start + n - i)
        lo = i * bits // 8
        raw = np.frombuffer(data[lo : lo + (m * bits + 7) // 8], np.uint8)
        flat = np.unpackbits(raw, bitorder="little")[: m * bits].reshape(m, bits)
        word = np.packbits(np.pad(flat, ((0, 0), (0, 32 - bits))), axis=1, bitorder="little").view("<u4").reshape(-1)
        skip = max(0, start - i)
        out[i + skip - start : i + m - start] = word[skip:]
    return out


def write_shard(ids: np.ndarray, lengths: np.ndarray, width: int, **options: int) -> bytes:
    symbols, rules = compress(ids, width, **options)
    bits = max(1, (width + len(rules) - 1).bit_length())
    expand = expansion_lengths(rules, width)
    checks = np.concatenate(([0], np.cumsum(_sizes(symbols, expand, width))))[:-1:BLOCK] if len(symbols) else np.zeros(0, np.int64)
    return b"".join([struct.pack(HEAD, MAGIC, width, len(rules), len(lengths), len(symbols), bits, len(ids)), rules.astype("<u4").tobytes(), expand.astype("<u4").tobytes(),
                     lengths.astype("<u4").tobytes(), checks.astype("<u8").tobytes(), _pack_bits(symbols, bits)])


class Shard:
    """Reads a shard's payload."""

    def __init__(self, payload: bytes) -> None:
        magic, self.width, n_rules, self.documents, self.symbols, self.bits, self.ids = struct.unpack_from(HEAD, payload)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize(HEAD)
        self.rules = np.frombuffer(payload, "<u4", 2 * n_rules, at).astype(np.int64).reshape(-1, 2)
        at += 8 * n_rules
        self.expand = np.frombuffer(payload, "<u4", n_rules, at).astype(np.int64)
        at += 4 * n_rules
        self.lengths = np.frombuffer(payload, "<u4", self.documents, at).astype(np.int64)
        at += 4 * self.documents
        blocks = -(-self.symbols // BLOCK)
        self.checks = np.frombuffer(payload, "<u8", blocks, at).astype(np.int64)
        self.stream = memoryview(payload)[at + 8 * blocks :]
        self.ends = np.cumsum(self.lengths)

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the shard: only the blocks of symbols that cover them are opened."""
        if lo >= hi:
            return np.zeros(0, np.int64)
        first = int(np.searchsorted(self.checks, lo, "right")) - 1
        last = int(np.searchsorted(self.checks, hi - 1, "right"))
        symbols = _unpack_bits(self.stream, first * BLOCK, min(self.symbols, last * BLOCK) - first * BLOCK, self.bits)
        # Of the blocks' symbols only those that cover the range are expanded, by the lengths that are stored.
        ends = int(self.checks[first]) + np.cumsum(_sizes(symbols, self.expand, self.width))
        i, j = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi, "left")) + 1
        skip = lo - (int(ends[i - 1]) if i else int(self.checks[first]))
        return expand(symbols[i:j], self.rules, self.width)[skip : skip + hi - lo]

    def document(self, i: int) -> np.ndarray:
        return self.slice(int(self.ends[i] - self.lengths[i]), int(self.ends[i]))

    def all(self) -> np.ndarray:
        return self.slice(0, self.ids)
