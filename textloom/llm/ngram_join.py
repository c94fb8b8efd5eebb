"""N-gram Jaccard join: a grouped prefix join over the sets of word shingles of whole documents.

Every step is exact whatever the data; what follows only decides how much work it takes.

1. *Order.* All shingles are put in one global order: by a coarse document frequency, then by hash. The frequencies
   are counted over all documents: each task sends its distinct shingle hashes, cut into hash ranges and
   compressed, and each range yields one slice of a table of one-byte levels (8 log2 of the largest frequency in a cell;
   0: no shingle of that cell is in two documents). There are as many ranges as the texts need for each to be counted in
   bounded memory; beyond 2^HOP_BITS of them they are cut in two steps. The table follows the corpus up to
   `most_table_bits`, as it is broadcast; beyond that cells are shared, which costs candidates, never links.
2. *Prefixes.* A link needs an overlap of t(n) = ceil(threshold * n) for either size n, so two linked sets share at
   least min(`common`, t) of the first n - t + `common` shingles in that order. Only those are dealt out, and of
   those only the ones that can occur in another document.
3. *Groups.* Documents with equal sets are one class; classes with equal size and equal prefix are one group. Groups
   are paired by a shingle that stands in both prefixes as early as the pair's two sizes and the overlap that they
   need demand, counted with the shingles that no other document can hold; then they are expanded to their classes
   and verified on full sets.
4. *Large groups of copies.* For components no group's pairs are listed while they can be avoided. First each class is
   verified against one pivot (the group's, or that of the prefix shingles it shares most): a number of pairs that
   grows with the rows. The links give components. What can still link are groups in different components. Where a
   shingle's list holds at most HEAVY groups of a size, its pairs are listed, against the fewer side, and verified. Groups
   that meet in longer lists (near copies that differ by almost as much as they may) are put into clusters, and each
   cluster's classes are compared in blocks, as for links, which yield a spanning forest each and no pairs. Nothing is
   lost, since a pair inside a component cannot change it.
5. *Verification* sends the text of each document to the pivot's blocks (at most `block` partners for each), so no
   key, however frequent, is gathered in one task.
6. *Links.* All links lie inside components, whose classes are compared in blocks by set size; see `_links`. The work
   grows with the square of a component's classes, as the links do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import U64, lean, mix64, release, shingle_sets, slices
from .components import connected_components
from .store import among, drop, fresh, kept, scratch, settle, small_batches, text_bytes, whole

#: Bits of a shingle's hash that are counted.
COUNTED_BITS = 48
#: Hashes that a task gathers before it sends them.
FLUSH = 1_000_000
#: Bytes of text whose shingles make a range of hashes, and bits of ranges that are cut in one step.
RANGE_BYTES = 8 << 20
HOP_BITS = 12
#: Groups of one size in a shingle's list up to which their pairs are listed; HEAVY * HEAVY pairs of classes of two groups.
HEAVY = 64
#: The table of levels is at most so large, whatever the corpus.
MOST_TABLE_BITS = 25


def _pack(values: np.ndarray) -> bytes:
    """Ascending uint64 values: the number of byte planes of their differences, and those compressed."""
    gaps = np.diff(values, prepend=U64(0))
    planes = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    flat = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T[:planes])
    return bytes([planes]) + pa.compress(flat.tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int) -> np.ndarray:
    planes = blob[0]
    flat = pa.decompress(blob[1:], decompressed_size=planes * n, codec="zstd", asbytes=True)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :planes] = np.frombuffer(flat, np.uint8).reshape(planes, n).T
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=U64)


_SENT = "part int, n int, keys binary, counts binary"


def _cut(values: np.ndarray, counts: np.ndarray, bits: int, lo: int, hi: int) -> pa.RecordBatch:
    """Ascending counted hashes as rows of the ranges lo to hi of 2^bits."""
    cuts = np.searchsorted(values, np.arange(lo, hi + 1, dtype=U64) << U64(COUNTED_BITS - bits))
    rows = [(lo + r, cuts[r], cuts[r + 1]) for r in range(hi - lo) if cuts[r] < cuts[r + 1]]
    return pa.RecordBatch.from_pydict({
        "part": pa.array([r for r, _, _ in rows], pa.int32()), "n": pa.array([int(j - i) for _, i, j in rows], pa.int32()),
        "keys": pa.array([_pack(values[i:j]) for _, i, j in rows], pa.binary()),
        "counts": pa.array([pa.compress(np.minimum(counts[i:j], 65535).astype("<u2").tobytes(), codec="zstd", asbytes=True) for _, i, j in rows], pa.binary())})


def _merged(ns: list[int], keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of some rows, ascending, and their summed counts."""
    values = np.concatenate([_unpack(b, n) for b, n in zip(keys, ns)])
    sums = np.concatenate([np.frombuffer(pa.decompress(b, decompressed_size=2 * n, codec="zstd", asbytes=True), "<u2") for b, n in zip(counts, ns)])
    order = np.argsort(values)
    values, sums = values[order], sums[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.add.reduceat(sums, first)


def frequency_levels(docs: DataFrame, k: int, table_bits: int, range_bytes: int = RANGE_BYTES, hop: int = HOP_BITS) -> np.ndarray:
    """The table of levels: a uint8 for each value of the highest `table_bits` bits of a shingle's hash."""
    range_bits = min(table_bits, max(4, (text_bytes(docs) // range_bytes).bit_length()))
    first_bits = min(hop, range_bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held) >> U64(64 - COUNTED_BITS), return_counts=True)
            return _cut(values, counts, first_bits, 0, 1 << first_bits)

        for batch in batches:
            for _, raw, at in slices(batch, "text"):
                held += (sets := shingle_sets(raw, at, k))
                n += sum(map(len, sets))
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by part: each part's hashes, some at a time, cut into its finer ranges."""
        part, held, n, wide = -1, [], 0, range_bits - first_bits

        def flush() -> pa.RecordBatch:
            values, counts = _merged(*map(list, zip(*held)))
            return _cut(values, counts, range_bits, part << wide, (part + 1) << wide)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "keys", "counts"))):
                if held and (row[0] != part or n >= FLUSH):
                    yield flush()
                    held, n = [], 0
                part = row[0]
                held.append(row[1:])
                n += row[1]
        if held:
            yield flush()

    def level(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values, counts = _merged(table["n"].to_pylist(), table["keys"].to_pylist(), table["counts"].to_pylist())
        values, counts = values[counts >= 2], counts[counts >= 2]
        levels = np.minimum(8 * np.log2(counts), 255).astype(np.uint8)
        slice_ = np.zeros(1 << (table_bits - range_bits), np.uint8)
        np.maximum.at(slice_, ((values >> U64(COUNTED_BITS - table_bits)) & U64(len(slice_) - 1)).astype(np.int64), levels)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([pa.compress(slice_.tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    sent = docs.select("text").mapInArrow(lean(send), _SENT)
    if range_bits > first_bits:
        sent = sent.repartition("part").sortWithinPartitions("part").mapInArrow(lean(again), _SENT)
    out = np.zeros(1 << table_bits, np.uint8)
    width = 1 << (table_bits - range_bits)
    for row in sent.groupBy("part").applyInArrow(level, "part int, levels binary").toLocalIterator():
        out[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(pa.decompress(bytes(row["levels"]), decompressed_size=width, codec="zstd", asbytes=True), np.uint8)
    return out


def _digest(values: np.ndarray) -> bytes:
    """16 bytes that stand for a sequence of hashes and its length."""
    n = np.arange(len(values), dtype=U64)
    a = mix64(values + mix64(n + U64(1))).sum(dtype=U64)
    b = mix64(values * U64(0xD6E8FEB86659FD93) + mix64(n + U64(77))).sum(dtype=U64)
    return mix64(np.array([a, b], U64) + U64(len(values))).tobytes()


def document_prefixes(docs: DataFrame, table: Broadcast, k: int, percent: int, common: int) -> DataFrame:
    """doc_id, th (hash of the text), n (set size), shareable (how many of the set may be in two documents), node (digest of the set), prefix
    (digest of the whole prefix and of shareable, null without shingles), tokens (the shareable hashes of the prefix, 8
    bytes each; null where there are too few shareable ones for any link)."""
    shift = U64(64 - int(table.value.size).bit_length() + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = table.value
        for batch in batches:
            for part, raw, at in slices(batch, "text"):
                n, shareable, node, prefix, tokens = [], [], [], [], []
                for s in shingle_sets(raw, at, k):
                    n.append(len(s))
                    if not len(s):
                        shareable.append(0), node.append(None), prefix.append(None), tokens.append(None)
                        continue
                    need = -(-percent * len(s) // 100)
                    of = level[(s >> shift).astype(np.int64)]
                    shareable.append(int(np.count_nonzero(of)))
                    first = np.argsort(of, kind="stable")[: len(s) - need + common]
                    node.append(_digest(s))
                    prefix.append(_digest(np.append(s[first], np.array([len(s), shareable[-1]], U64))))
                    tokens.append(s[first][of[first] > 0].tobytes() if shareable[-1] >= need else None)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "th": part.column("th"), "n": pa.array(n, pa.int64()), "shareable": pa.array(shareable, pa.int64()), "node": pa.array(node, pa.binary()), "prefix": pa.array(prefix, pa.binary()), "tokens": pa.array(tokens, pa.binary())})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(lean(scan), "doc_id bigint, th bigint, n bigint, shareable bigint, node binary, prefix binary, tokens binary")


def _explode_tokens(rows: DataFrame) -> DataFrame:
    """gid, n, v (shareable), tokens -> token, gid, n, v, i (the token's place among the shareable ones)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                blobs = part.column("tokens").to_pylist()
                sizes = np.array([len(b) // 8 for b in blobs], np.int64)
                at = pa.array(np.repeat(np.arange(len(blobs)), sizes))
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(blobs), np.int64)), part.column("gid").take(at), part.column("n").take(at), part.column("v").take(at), pa.array(place)], names=["token", "gid", "n", "v", "i"])

    return rows.select("gid", "n", "v", "tokens").mapInArrow(lean(explode), "token bigint, gid binary, n bigint, v bigint, i bigint")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """Of distinct pairs (a, a_id, b, b_id) of nodes and a document of each, those (a, b) that link."""
    ids = pairs.selectExpr("a as node", "a_id as doc_id").union(pairs.selectExpr("b as node", "b_id as doc_id")).distinct()
    texts = settle(among(docs.select("doc_id", "text"), ids).join(ids, "doc_id").select("node", "text"), "suspects")
    blocks = pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {block}) as int)").alias("blocks"))
    dealt = pairs.select("a", "b").join(blocks, "a").withColumn("salt", F.expr("cast(pmod(xxhash64(b), blocks) as int)")).drop("blocks")
    home = dealt.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").select(F.col("a").alias("home"), F.col("salt").alias("part"), F.col("text").alias("home_text"))
    away = dealt.join(texts.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("a"), F.col("salt").alias("salt"), "b", "text")

    def sets_of(table: pa.Table, name: str, text: str) -> Iterator[tuple[bytes, np.ndarray]]:
        """Of rows that repeat a doc_id, only those with the node's own set count."""
        for batch in table.combine_chunks().to_batches():
            for part, raw, at in slices(batch, text):
                for node, s in zip(part.column(name).to_pylist(), shingle_sets(raw, at, k)):
                    if _digest(s) == node:
                        yield node, s

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        own = next(sets_of(left, "home", "home_text"), None)
        linked = {}
        if own is not None:
            for node, s in sets_of(right, "b", "text"):
                at = np.searchsorted(own[1], s)
                both = int((own[1][np.minimum(at, len(own[1]) - 1)] == s).sum())
                if 100 * both >= percent * (len(s) + len(own[1]) - both):
                    linked[node] = own[0]
        return pa.table({"a": pa.array(linked.values(), pa.binary()), "b": pa.array(linked.keys(), pa.binary())})

    return home.groupBy("home", "part").cogroup(away.groupBy("a", "salt")).applyInArrow(verify, "a binary, b binary")


def _cell(percent: int) -> str:
    """SQL of a number by set size n: of two sizes that can link, the numbers are equal or neighbours."""
    return f"cast(floor(ln(n) / (1.0001D * ln(100D / {percent}))) as int)" if percent < 100 else "cast(2 * n as int)"


def _classified(docs: DataFrame, k: int, percent: int, common: int, table_bits: int | None, block: int, side: int = 256, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """The rows of `document_prefixes`, and the classes: node, n, rep, comp (the class's component)."""
    if table_bits is None:
        table_bits = min(MOST_TABLE_BITS, max(16, (text_bytes(docs) // 16).bit_length()))
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, k, table_bits))
    rows = settle(document_prefixes(docs, table, k, percent, common), "prefixes")
    table.destroy()  # the rows are settled: no later job, repeated or not, needs it
    release()
    classes = settle(rows.where("node is not null and doc_id is not null").groupBy("node", "n", "shareable", "prefix").agg(F.min("doc_id").alias("rep")), "classes")
    groups = classes.groupBy("prefix").agg(F.min("rep").alias("grep"), F.count("*").alias("members"))
    heads = classes.join(groups, "prefix").where("rep = grep").groupBy("prefix", "n", "shareable").agg(F.min("node").alias("pivot"), F.min("grep").alias("grep"), F.max("members").alias("members"))
    heads = settle(heads.select(F.col("prefix").alias("gid"), "n", F.col("shareable").alias("v"), "pivot", "grep", "members"), "groups")
    tokens = rows.where("length(tokens) > 0").select(F.col("prefix").alias("gid"), F.col("doc_id").alias("grep"), "tokens").join(heads.select("gid", "grep", "n", "v"), ["gid", "grep"]).dropDuplicates(["gid"])
    listed = _explode_tokens(tokens)
    # The head of a shingle's list is the document with the least of its own: where copies of one text differ, that text.
    own = F.struct((F.col("n") - F.col("v")).alias("own"), "gid")
    shared = listed.groupBy("token").agg(F.count("*").alias("f"), F.min(own).alias("head")).where("f > 1").select("token", F.col("head.gid").alias("head"))
    # Settled first: a join of two plain tables is one that Spark can split at a frequent key.
    postings = settle(listed.join(settle(shared, "shared"), "token").select("token", "gid", "n", "v", "i", "head"), "postings")

    # Each class against one pivot.
    inside = classes.join(heads.where("members > 1").select(F.col("gid").alias("prefix"), "pivot", "grep"), "prefix").where("node != pivot")
    inside = inside.select(F.col("pivot").alias("a"), F.col("grep").alias("a_id"), F.col("node").alias("b"), F.col("rep").alias("b_id"))
    stars = postings.where("gid != head").groupBy("gid", "head").agg(F.count("*").alias("c")).groupBy("gid").agg(F.max(F.struct("c", "head")).alias("best")).select("gid", F.col("best.head").alias("head"))
    one, other = heads.select(F.col("gid").alias("head"), F.col("pivot").alias("a"), F.col("grep").alias("a_id"), F.col("n").alias("n1"), F.col("v").alias("v1")), heads.select("gid", F.col("pivot").alias("b"), F.col("grep").alias("b_id"), F.col("n").alias("n2"), F.col("v").alias("v2"))
    # What two sets share is at most what either can share.
    least_shared = f"(({percent} * (n1 + n2) + {99 + percent}) div {100 + percent})"
    fits = f"least(v1, v2) >= {least_shared}"
    across = stars.join(one, "head").join(other, "gid").where(fits).select("a", "a_id", "b", "b_id")
    links = settle(verified(settle(inside.union(across), "stars"), docs, k, percent, block), "links")

    def labelled(found: DataFrame) -> DataFrame:
        roots = connected_components(found)
        return classes.join(roots.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").withColumn("comp", F.coalesce("root", "node")).drop("at", "root")

    # What is left: pairs of groups whose ends are in different components.
    now = settle(labelled(links), "components")
    state = now.groupBy("prefix").agg(F.min("comp").alias("comp"), (F.min("comp") != F.max("comp")).alias("mixed"), F.count("*").alias("members")).withColumnRenamed("prefix", "gid")
    lists = postings.select("token", "gid", "n", "v", "i").join(state, "gid")
    counts = lists.groupBy("token", "comp").agg(F.count("*").alias("c"), F.max("mixed").alias("mixed"))
    lists_of = counts.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("major"), F.count("*").alias("comps"), F.max("mixed").alias("any")).where("comps > 1 or any").select("token", F.col("major.comp").alias("major"))
    lists = settle(lists.join(settle(lists_of, "list-heads"), "token").withColumn("cell", F.expr(_cell(percent))), "lists")
    drop(postings)
    # Only sizes that can link meet, so a frequent shingle's list is not compared as a whole.
    near = "explode(sequence(cell - 1, cell + 1)) as cell"
    long = settle(lists.groupBy("token", "cell").agg(F.count("*").alias("c")).where(F.col("c") > heavy).select("token", "cell"), "long-lists")
    left = lists.where("comp != major or mixed").selectExpr("token", near, "gid as g1", "n as n1", "v as v1", "i as i1", "comp as c1", "mixed as m1", "members as k1")
    right = lists.join(long, ["token", "cell"], "left_anti").selectExpr("token", "cell", "gid as g2", "n as n2", "v as v2", "i as i2", "comp as c2", "mixed as m2", "members as k2", "comp = major and not mixed as big")
    # The first shingle that two linked sets share stands among the first n - least_shared + 1 of each; the n - v
    # that no other document holds come before all others.
    early = f"i1 <= v1 - {least_shared} and i2 <= v2 - {least_shared}"
    met = left.join(right, ["token", "cell"]).where(f"g1 != g2 and (big or g1 < g2) and (c1 != c2 or m1 or m2) and {early}")
    met = met.select(F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2"), F.expr("k1 * k2").alias("k")).distinct()
    met = settle(met.union(state.where("mixed").selectExpr("gid as g1", "gid as g2", "members * members as k")), "met")
    # Groups of long lists, and those with too many classes to list their pairs, if there are any.
    hub = lambda *x: F.encode(F.concat_ws("/", *x), "UTF-8").alias("b")
    through = lists.selectExpr("gid", "token", near).join(long, ["token", "cell"]).select(F.col("gid").alias("a"), hub("token", "cell"))
    wide = met.where(f"k > {heavy * heavy}")
    any_ = not long.isEmpty() or not wide.isEmpty()
    edges = settle(through.union(wide.where("g1 != g2").selectExpr("g1 as a", "g2 as b")).union(wide.where("g1 = g2").select(F.col("g1").alias("a"), hub(F.hex("g1")))).distinct(), "meeting") if any_ else None
    forest = None
    if edges is not None:
        clusters = connected_components(edges).select(F.col("node").alias("prefix"), F.col("root").alias("comp"))
        forest = settle(_links(docs, now.drop("comp").join(clusters, "prefix"), k, percent, side, "forest"), "forest")
    met = met.where(f"k <= {heavy * heavy}").select("g1", "g2")
    one, other = (now.selectExpr(f"prefix as g{i}", f"node as {x}", f"rep as {x}_id", f"comp as {x}_comp") for i, x in ((1, "a"), (2, "b")))
    rest = met.join(one, "g1").join(other, "g2").where("a_comp != b_comp and (g1 != g2 or a < b)").select("a", "a_id", "b", "b_id").distinct()
    rest = settle(rest, "pairs")
    if forest is not None or not rest.isEmpty():
        links = now.select("node", "comp").where("node != comp").selectExpr("node as a", "comp as b").union(verified(rest, docs, k, percent, block))
        now = labelled(settle(links if forest is None else links.union(forest), "links"))
    return rows, now


def _plain(docs: DataFrame, percent: int, common: int) -> DataFrame:
    if not 0 < percent <= 100 or common < 1:
        raise ValueError("percent must be in 1..100, common at least 1")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _named(rows: DataFrame, now: DataFrame, *more: str) -> DataFrame:
    least = now.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = now.join(least, "comp").select(F.col("node").alias("at"), "component_id", F.col("rep").alias("class_id"), *more)
    own = rows.join(named, (F.col("node") == F.col("at")) & F.col("doc_id").isNotNull(), "left")
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in more))


def ngram_components(docs: DataFrame, k: int = 4, percent: int = 85, common: int = 3, table_bits: int | None = None, block: int = 128) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, class_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z lower-cased; a document's set holds its distinct
    k-word shingles, or its whole word sequence if that is shorter. Documents link at a Jaccard similarity of
    percent/100 or more. component_id: the least doc_id reachable by links, class_id: the least with an equal set.

    Null, empty or wordless text: n_shingles 0, linked with nothing (component_id and class_id are its own doc_id).
    Null doc_id: n_shingles is counted, but the row has no identity to link by, so both ids are null. Repeated
    doc_id: each row is judged by its own text; its component is that of its text. Other columns are ignored.
    """
    with scratch(docs.sparkSession):
        return kept(_named(*_classified(_plain(docs, percent, common), k, percent, common, table_bits, block)), "components")


def one_of_each(docs: DataFrame, k: int = 4, percent: int = 85, common: int = 3, table_bits: int | None = None, block: int = 128) -> DataFrame:
    """docs' rows, with all their columns, one of each component: the one with the least doc_id, then the least hash of its
    text. Of rows that repeat a doc_id each is judged by its own text; of those that repeat the text as well the first
    stays, by their other columns as JSON. A row without words is a component for itself; rows without doc_id have none and
    all stay."""
    with scratch(docs.sparkSession):
        rows, now = _classified(_plain(docs, percent, common), k, percent, common, table_bits, block)
        own = rows.where("doc_id is not null").join(now.select(F.col("node").alias("at"), "comp"), F.col("node") == F.col("at"), "left")
        alone = F.concat(F.lit("-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("th").cast("string")).cast("binary")
        first = kept(own.groupBy(F.coalesce("comp", alone).alias("c")).agg(F.min(F.struct("doc_id", "th")).alias("f")).select("f.doc_id", "f.th"), "first")
    key, hash_, whole_, place = fresh(docs.columns, "key", "hash", "whole", "place")
    others = F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c != "text")))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias(key), F.xxhash64(F.col("text").cast("string")).alias(hash_), whole(docs).alias(whole_), others.alias(place))
    met = keyed.join(first.toDF(key, hash_), [key, hash_], "left_semi")
    best = met.groupBy(key, hash_).agg(F.min_by(whole_, place).alias(whole_)).select(f"{whole_}.*")
    return best.union(docs.where("doc_id is null"))


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of left shares with each of right."""
    out = np.zeros((len(left), len(right)), np.int64)
    values = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Owners and columns of the values that both sides hold, by column."""
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(values, flat)
        held = values[np.minimum(at, len(values) - 1)] == flat
        order = np.argsort(at[held], kind="stable")
        return owner[held][order], at[held][order]

    if not len(values):
        return out
    (l_own, l_at), (r_own, r_at) = places(left), places(right)
    for i in range(0, len(values), 4096):
        sides = []
        for own, at, n in ((l_own, l_at, len(left)), (r_own, r_at, len(right))):
            x, y = np.searchsorted(at, [i, i + 4096])
            side = np.zeros((n, 4096), np.float32)
            side[own[x:y], at[x:y] - i] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a table of links the least row that links lead to; the number of rows where there is none."""
    n = len(linked)
    rows = np.arange(n)
    while True:
        columns = np.where(linked, rows[:, None], n).min(0, initial=n)
        low = np.minimum(rows, np.where(linked, columns, n).min(1, initial=n))
        if (low == rows).all():
            return rows, columns
        rows = low


def _links(docs: DataFrame, now: DataFrame, k: int, percent: int, side: int, what: str) -> DataFrame:
    """All links between classes. what: `count` for node and n_links (a row for each block that has links), `pairs` for a and b
    by rep, `forest` for a and b by node, which connect what links connect, but are not all of them, nor always links.

    Links stay inside components, so each component's classes are compared with each other: they are cut by set size into
    cells, so that linked sizes are in one cell or in two next to each other, and a cell by hash into parts of about `side`
    classes and a million shingles. Each pair of parts is one unit of work; a text is sent once to each unit of its part.
    """
    schema = {"count": "node binary, n_links bigint", "pairs": "a bigint, b bigint", "forest": "a binary, b binary"}[what]
    if percent == 100:  # different sets cannot link
        return docs.sparkSession.createDataFrame([], schema)
    several = now.groupBy("comp").agg(F.count("*").alias("c")).where("c > 1").select("comp")
    cells = now.join(several, "comp").select("node", "rep", "n", "comp", F.expr(_cell(percent)).alias("cell"))
    parts = settle(cells.groupBy("comp", "cell").agg(F.expr(f"cast(ceil(greatest(count(*) / {side}, sum(n) / 1000000)) as int)").alias("parts")), "cells")
    near = parts.join(parts.selectExpr("comp", "cell - 1 as cell", "parts as above"), ["comp", "cell"], "left").join(parts.selectExpr("comp", "cell + 1 as cell", "parts as below"), ["comp", "cell"], "left")
    ids = cells.select("node", F.col("rep").alias("doc_id"), "comp", "cell").join(near, ["comp", "cell"])
    texts = settle(among(docs, ids).join(ids, "doc_id").withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)")), "linkable")
    same, next_ = "sequence(part, parts - 1)", "sequence(0, above - 1)"
    left = texts.selectExpr("comp", "cell", "part", f"explode({same}) as other", "false as up", "node", "doc_id", "text").union(
        texts.where("above is not null").selectExpr("comp", "cell", "part", f"explode({next_}) as other", "true as up", "node", "doc_id", "text"))
    right = texts.where("part > 0").selectExpr("comp", "cell", "explode(sequence(0, part - 1)) as part", "part as other", "false as up", "node", "doc_id", "text").union(
        texts.where("below is not null").selectExpr("comp", "cell - 1 as cell", "explode(sequence(0, below - 1)) as part", "part as other", "true as up", "node", "doc_id", "text"))

    def sets_of(table: pa.Table) -> tuple[list[bytes], list[int], list[np.ndarray]]:
        """Each node once; of rows that repeat a doc_id, only those with the node's own set count."""
        found = {}
        for batch in table.combine_chunks().to_batches():
            for part, raw, at in slices(batch, "text"):
                for node, doc_id, s in zip(part.column("node").to_pylist(), part.column("doc_id").to_pylist(), shingle_sets(raw, at, k)):
                    if node not in found and _digest(s) == node:
                        found[node] = doc_id, s
        return list(found), [x for x, _ in found.values()], [s for _, s in found.values()]

    def compare(key: tuple[pa.Scalar, ...], one: pa.Table, two: pa.Table) -> pa.Table:
        own = not key[4].as_py() and key[2].as_py() == key[3].as_py()
        nodes, ids, sets = sets_of(one)
        nodes2, ids2, sets2 = (nodes, ids, sets) if own else sets_of(two)
        linked = np.zeros((len(sets), len(sets2)), bool)
        if sets and sets2:
            both = _shared_counts(sets, sets2)
            n, n2 = (np.array([len(s) for s in x], np.int64) for x in (sets, sets2))
            linked = 100 * both >= percent * (n[:, None] + n2 - both)
        if own:
            np.fill_diagonal(linked, False)
        if what == "forest":
            rows, columns = _forest(linked)
            a = [(nodes[j], x) for x, j in zip(nodes, rows.tolist())] + [(nodes[j], x) for x, j in zip(nodes2, columns.tolist()) if j < len(nodes)]
            a = [(x, y) for x, y in a if x != y]
            return pa.table({"a": pa.array([x for x, _ in a], pa.binary()), "b": pa.array([y for _, y in a], pa.binary())})
        if what == "count":
            counts = linked.sum(1) if own else np.concatenate((linked.sum(1), linked.sum(0)))
            names = nodes if own else nodes + nodes2
            some = np.flatnonzero(counts)
            return pa.table({"node": pa.array([names[i] for i in some], pa.binary()), "n_links": pa.array(counts[some], pa.int64())})
        i, j = np.nonzero(np.triu(linked) if own else linked)
        a, b = np.array(ids, np.int64)[i], np.array(ids2, np.int64)[j]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    key = ["comp", "cell", "part", "other", "up"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, schema)


def ngram_links(docs: DataFrame, k: int = 4, percent: int = 85, common: int = 3, table_bits: int | None = None, block: int = 128, side: int = 256) -> DataFrame:
    """`ngram_components` and n_links: to how many other classes (different sets) the row's class links directly. Copies
    share one class, so they count once and add no link; 0 where there is no set or no doc_id."""
    docs = _plain(docs, percent, common)
    with scratch(docs.sparkSession):
        rows, now = _classified(docs, k, percent, common, table_bits, block, side)
        found = _links(docs, now, k, percent, side, "count").groupBy("node").agg(F.sum("n_links").alias("n_links"))
        return kept(_named(rows, now.join(found, "node", "left"), "n_links"), "links")


def class_links(docs: DataFrame, k: int = 4, percent: int = 85, common: int = 3, table_bits: int | None = None, block: int = 128, side: int = 256) -> DataFrame:
    """(a, b) for each link between different classes, by their class_id, a <= b (equal only where a repeated doc_id
    names two classes); membership is `ngram_components`'s."""
    docs = _plain(docs, percent, common)
    with scratch(docs.sparkSession):
        return kept(_links(docs, _classified(docs, k, percent, common, table_bits, block, side)[1], k, percent, side, "pairs"), "class-links")
