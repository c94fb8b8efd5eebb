"""The lattice of all segmentations of a text into the pieces of a fixed public vocabulary, in numpy.

A vocabulary is a SentencePiece model file. Its space mark counts as the space it stands for, so pieces are matched on
the bytes of the text itself. A text is cut into units where no piece of the vocabulary can cross (`units`), so the
lattice of a text is the product of its units' lattices, and equal units share one. Units have any length: a run
without such a place, like a text in Chinese or an address, is one unit. A character that no piece matches is one arc for
itself, which stands for its byte pieces.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Positions after which the sums of a longer unit are scaled anew.
RESCALE = 64


@dataclass(frozen=True)
class Vocabulary:
    """children: node * 256 + byte -> node or 0, for the first `inner` nodes, which have any; piece: node -> piece id or -1;
    texts: by piece id; alone: bytes that stand in no piece of several bytes; depth: bytes of the longest piece."""

    children: np.ndarray
    inner: int
    piece: np.ndarray
    texts: tuple[bytes, ...]
    byte_piece: np.ndarray
    alone: np.ndarray
    depth: int

    def __len__(self) -> int:
        return len(self.texts)


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """The pieces of a SentencePiece model file with byte fallback. Control pieces match nothing, nor does a piece with a
    space after another character (units are cut there); pieces of several spaces do."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, byte_piece = [], np.full(256, -1, np.int32)
    nodes: dict[tuple[int, int], int] = {}
    ends: dict[int, int] = {}
    alone = np.zeros(256, bool)
    alone[:128] = True
    alone[32] = False
    depth = 4  # a character without a piece
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            byte_piece[int(text[3:5], 16)] = i
            texts.append(bytes([int(text[3:5], 16)]))
            continue
        raw = text.replace("▁", " ").encode()
        texts.append(raw)
        if model.is_control(i) or model.is_unknown(i) or not raw or b" " in raw.lstrip(b" "):
            continue
        at = 0
        for b in raw:
            at = nodes.setdefault((at, b), len(nodes) + 1)
        ends.setdefault(at, i)
        depth = max(depth, len(raw))
        if len(raw) > 1:
            alone[list(raw)] = False
    # Nodes with children come first, so that the others need no room for them.
    parents = sorted({at for at, _ in nodes} | {0})
    number = np.zeros(len(nodes) + 1, np.int64)
    number[parents] = np.arange(len(parents))
    rest = np.setdiff1d(np.arange(len(nodes) + 1), parents)
    number[rest] = len(parents) + np.arange(len(rest))
    children = np.zeros(len(parents) * 256, np.uint16 if len(nodes) < 65535 else np.uint32)
    for (at, b), to in nodes.items():
        children[number[at] * 256 + b] = number[to]
    piece = np.full(len(nodes) + 1, -1, np.int32)
    for at, i in ends.items():
        piece[number[at]] = i
    return Vocabulary(children, len(parents), piece, tuple(texts), byte_piece, alone, depth)


def units(vocabulary: Vocabulary, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units start, and for each text the number of units before it (len+1). A unit starts at a text's start, at the
    first space of a run of spaces, and at and after a byte that stands in no piece but its own."""
    begin = np.zeros(len(raw) + 1, bool)
    space, alone = raw == 32, vocabulary.alone[raw]
    begin[:-1] = alone | space
    begin[1:-1] &= ~(space[1:] & space[:-1])
    begin[1:] |= alone
    begin[at[:-1][at[:-1] < at[1:]]] = True
    starts = np.flatnonzero(begin[:-1])
    return starts, np.searchsorted(starts, at)


@dataclass
class Lattice:
    """Arcs of many units laid one after another. Positions count bytes over all units and one more for each unit's
    end; arcs are ordered by their start's offset in its unit, then by position."""

    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray  # -1: a character without a piece
    step: np.ndarray  # arcs whose start has offset o: step[o] to step[o + 1]
    first: np.ndarray  # position of each unit's start
    last: np.ndarray  # and end
    reach: int  # bytes of the longest arc


def build(vocabulary: Vocabulary, raw: np.ndarray, sizes: np.ndarray) -> Lattice:
    """The lattice of units given as their joint bytes and sizes (each at least 1)."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(raw)) - begins[owner]
    heads = np.flatnonzero(raw & 0xC0 != 0x80)
    # Broken UTF-8 cannot come from Spark, but a unit's first byte must be reachable.
    if len(heads) and (raw[begins] & 0xC0 == 0x80).any():
        heads = np.union1d(heads, begins)
    stop = ends[owner]
    sources, targets, pieces = [], [], []
    node = np.zeros(len(heads), np.int64)
    where, active = heads, heads
    single = np.zeros(len(raw), bool)  # heads whose first character is a piece
    nexts = np.append(heads[1:], len(raw))
    after = np.zeros(len(raw), np.int64)
    after[heads] = np.minimum(nexts, stop[heads])
    for _ in range(vocabulary.depth):
        node = vocabulary.children[node * 256 + raw[where]].astype(np.int64)
        keep = node > 0
        node, where, active = node[keep], where[keep] + 1, active[keep]
        found = vocabulary.piece[node]
        hit = found >= 0
        sources.append(active[hit]), targets.append(where[hit]), pieces.append(found[hit])
        single[active[hit][where[hit] == after[active[hit]]]] = True
        keep = (where < stop[active]) & (node < vocabulary.inner)
        node, where, active = node[keep], where[keep], active[keep]
        if not len(active):
            break
    bare = heads[~single[heads]]
    sources.append(bare), targets.append(after[bare]), pieces.append(np.full(len(bare), -1, np.int32))
    source, target, piece = map(np.concatenate, (sources, targets, pieces))
    order = np.lexsort((target, source, offset[source])) if len(source) else np.zeros(0, np.int64)
    source, target, piece = source[order], target[order], piece[order]
    most = int(sizes.max()) if len(sizes) else 0
    step = np.searchsorted(offset[source], np.arange(most + 1)) if len(source) else np.zeros(most + 1, np.int64)
    unit = owner[source]
    return Lattice(source + unit, target + unit, piece, step, begins + np.arange(len(sizes)), ends + np.arange(len(sizes)), max(vocabulary.depth, int((target - source).max()) if len(source) else 0))


def mirrored(net: Lattice) -> tuple[Lattice, np.ndarray]:
    """The lattice read from its end, and the order in which it has the arcs; position p is the last one less p."""
    top = int(net.last[-1])
    source, target = top - net.target, top - net.source
    first, last = (top - net.last)[::-1], (top - net.first)[::-1]
    offset = source - first[np.searchsorted(first, source, "right") - 1]
    order = np.lexsort((target, source, offset))
    step = np.searchsorted(offset[order], np.arange(int((last - first).max()) + 1))
    return Lattice(source[order], target[order], net.piece[order], step, first, last, net.reach), order


def forward(lattice: Lattice, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the summed weight of all segmentations of what stands before it in its unit, as a number and the
    logarithm of a factor to it (0 but in units longer than RESCALE, whose sums would leave the range of numbers). weight:
    of each arc, of shape (arcs,) or (arcs, columns). Sums are taken in one order for a unit, whatever stands beside it."""
    total = np.zeros((int(lattice.last[-1]) + 1 if len(lattice.last) else 0, *weight.shape[1:]))
    factor = np.zeros_like(total)
    total[lattice.first] = 1.0
    sizes = lattice.last - lattice.first
    width = np.arange(RESCALE + lattice.reach + 1)
    for o in range(len(lattice.step) - 1):
        if o and o % RESCALE == 0:
            long = np.flatnonzero(sizes > o)
            at = np.minimum(lattice.first[long, None] + o + width, lattice.last[long, None])
            # What is reached so far lies within an arc's length; the factor is laid ahead to where it is next renewed.
            most = total[at].max(1)
            now = factor[at[:, 0]] + np.log(most)
            total[at] /= most[:, None]
            factor[at] = now[:, None]
        i, j = lattice.step[o], lattice.step[o + 1]
        if i < j:
            source, target = lattice.source[i:j], lattice.target[i:j]
            # Arcs of one start end in different places, and units share none: no target comes twice in a step.
            total[target] += total[source] * weight[i:j]
    return total, factor
