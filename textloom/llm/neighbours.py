"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Index. Vectors get one more component, so that all have the largest norm; the nearest by distance are then the largest
by inner product. Centroids come from a bounded sample, split by k-means until no list of the sample is over its
share, so lists are balanced. Centroids are searched by a graph in memory (each joined to its nearest ones, greedy
search with a beam). Every vector goes to its nearest centroid's list, and a boundary vector also to others whose
distance is within a ratio of the least.

Search. A query takes the lists of the centroids within a distance ratio of the nearest, and is compared with every
vector there. How many lists and which ratio is fitted: queries from the sample are answered by brute force over the
sample, and both are the least that reach the shares `recall` and `within` of their neighbours. Lists and their queries are cut into blocks of bounded size,
whatever a list's size, and each block gives its best; those are merged by query. A query whose lists hold fewer
neighbours than it is due is compared with all lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytetext import lean
from .store import drop, kept, scratch, settle

#: Lists of a query that are compared first.
TIER = 2


@dataclass(frozen=True)
class Options:
    """sample: most vectors that reach the driver, about. list_rows: wished for in a list, while there are at most
    `most_lists`, and four vectors of the sample for each. degree, beam: of the graph; the beam grows with the lists that a
    query takes. replicas, boundary: most lists of a vector, and the ratio of squared distances up to which a list is
    its. recall, within: the shares of neighbours that the fitted number of lists and distance ratio reach on the sample;
    held: queries to fit them on.
    block: most rows of a block."""

    sample: int = 40_000
    list_rows: int = 200
    most_lists: int = 10_000
    degree: int = 24
    beam: int = 64
    replicas: int = 4
    boundary: float = 1.15
    recall: float = 0.95
    within: float = 0.99
    held: int = 256
    block: int = 4096
    query_block: int = 512


@dataclass(frozen=True)
class Index:
    """Centroids (float32), the graph's neighbours by centroid, entry points, the norm to which vectors are lifted, and the
    number of lists that a query takes at most and ratio of squared distances (beyond what any vector must have) for them."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    norm: float
    probes: int
    ratio: float


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Places of x's rows among at most k means."""
    means = x[rng.choice(len(x), k, replace=False)]
    place = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        place = ((means**2).sum(1) - 2 * x @ means.T).argmin(1)
        sums = np.zeros_like(means, dtype=np.float64)
        np.add.at(sums, place, x)
        n = np.bincount(place, minlength=k)
        means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], means).astype(np.float32)
    return place


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Means of parts of x, none of which has more than len(x) / lists rows unless its rows are equal."""
    rng = np.random.default_rng(seed)
    most = max(1, -(-len(x) // lists))
    done, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        part = x[rows]
        if len(rows) <= most or (part == part[0]).all():
            done.append(part.mean(0, dtype=np.float64).astype(np.float32))
            continue
        place = _kmeans(part, min(16, -(-len(rows) // most), len(rows)), rng)
        parts = [rows[place == j] for j in np.unique(place)]
        if len(parts) == 1:  # nearly equal rows: cut along the widest component
            order = np.argsort(part[:, part.var(0).argmax()], kind="stable")
            parts = [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        open_ += parts
    return np.unique(np.stack(done), axis=0)


def centroid_graph(centroids: np.ndarray, degree: int, seed: int = 7) -> np.ndarray:
    """Each centroid's nearest ones and, for long ways, a few at random; its own number fills what is left."""
    n = len(centroids)
    near = min(max(1, degree * 3 // 4), n - 1)
    links = np.tile(np.arange(n)[:, None], (1, degree)).astype(np.int32)
    norms = (centroids**2).sum(1)
    for i in range(0, n, 1024):
        d = norms - 2 * centroids[i : i + 1024] @ centroids.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        if near:
            links[i : i + 1024, :near] = np.argpartition(d, near - 1, 1)[:, :near]
    links[:, near:] = np.random.default_rng(seed).integers(0, n, (n, degree - near))
    return links


def graph_search(index: Index, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x up to `beam` centroids and their squared distances, nearest first (inf where fewer), by
    greedy search on the graph from the entry points; all rows step together."""
    n, beam = len(x), min(beam, len(index.centroids))
    norms = (index.centroids.astype(np.float64) ** 2).sum(1)

    def distance(ids: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) ** 2).sum(1)[:, None] + norms[ids] - 2 * np.einsum("qd,qkd->qk", x, index.centroids[ids], optimize=False)

    ids = np.tile(index.entries, (n, 1))
    far = distance(ids)
    opened = np.zeros((n, len(index.centroids)), bool)
    seen = np.zeros((n, len(index.centroids)), bool)
    seen[np.arange(n)[:, None], ids] = True
    rows = np.arange(n)[:, None]
    while True:
        order = np.argsort(far, 1, kind="stable")[:, :beam]
        ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        waiting = ~opened[rows, ids] & np.isfinite(far)
        if not waiting.any():
            return ids, np.maximum(far, 0)
        # The four nearest that are not opened yet are opened together.
        pick = np.argsort(~waiting, 1, kind="stable")[:, :4]
        heads = np.take_along_axis(ids, pick, 1)
        real = np.take_along_axis(waiting, pick, 1)
        of, nth = np.nonzero(real)
        opened[of, heads[of, nth]] = True
        # Where fewer are waiting, a head stands for its own links: they are seen, and hide no other's.
        new = np.where(real[:, :, None], index.links[heads], heads[:, :, None]).reshape(n, -1)
        fresh = ~seen[rows, new]
        # Of centroids met twice in one step, the first counts.
        by = np.argsort(new, 1, kind="stable")
        again = np.zeros(new.shape, bool)
        sorted_ = np.take_along_axis(new, by, 1)
        np.put_along_axis(again, by[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
        fresh &= ~again
        seen[rows, new] = True
        d = np.where(fresh, distance(new), np.inf)
        ids, far = np.concatenate((ids, new), 1), np.concatenate((far, d), 1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of rows that take part: an id, all components finite, one not zero, and
    as many components as most rows have (ties: the smaller number)."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)"
    rows = rows.where("vec_id is not null and embedding is not null").where(finite)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0]["d"] if sizes else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(rows: DataFrame, options: Options, k: int = 20) -> Index | None:
    """The index of usable rows, from a sample of them by a hash of vec_id; None without rows."""
    stats = rows.agg(F.count("*").alias("n"), F.max(F.expr("aggregate(embedding, 0D, (a, x) -> a + x * x)")).alias("m")).first()
    if not stats["n"]:
        return None
    share = min(1.0, options.sample / stats["n"])
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", "embedding", F.lit("ann")), F.lit(1 << 40)) < int(share * (1 << 40))) if share < 1 else rows
    x = _matrix(drawn.orderBy("vec_id", "embedding").select("embedding").toArrow()["embedding"])
    if not len(x):
        x = _matrix(rows.limit(1).toArrow()["embedding"])
    lists = int(min(options.most_lists, max(1, stats["n"] // options.list_rows), max(1, len(x) // 4)))
    centroids = balanced_centroids(lifted(x, stats["m"]), lists)
    entries = np.unique(np.linspace(0, len(centroids) - 1, min(16, len(centroids))).astype(np.int64))
    probes, ratio = fitted_reach(x, centroids, float(stats["m"]), max(1, round(k * share)), options)
    return Index(centroids, centroid_graph(centroids, options.degree), entries, float(stats["m"]), probes, ratio)


def _distances(y: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    c = centroids.astype(np.float64)
    return np.maximum(0.0, (y.astype(np.float64) ** 2).sum(1)[:, None] + (c**2).sum(1) - 2 * y @ c.T)


def unavoidable(x: np.ndarray, norm: float) -> np.ndarray:
    """Of queries, the squared distance that any vector has at least, as all lie on one sphere."""
    return np.maximum(0.0, np.sqrt(norm) - np.sqrt((x**2).sum(1)))[:, None] ** 2


def fitted_reach(x: np.ndarray, centroids: np.ndarray, norm: float, k: int, options: Options) -> tuple[int, float]:
    """Among how many lists, and within which ratio, enough of the k nearest of some rows of the sample x, in it, have one of
    theirs. k is less than asked for where x is a part of the table, as its rows are that much farther apart."""
    rng = np.random.default_rng(11)
    distinct = np.unique(x, axis=0, return_index=True)[1]
    queries = np.sort(rng.choice(distinct, min(options.held, len(distinct)), replace=False))
    ranks, ratios = [], []
    for q in queries.tolist():
        score = x @ x[q]
        score[q] = -np.inf
        top = np.argpartition(-score, min(k, len(x) - 1) - 1)[:k] if len(x) > 1 else np.zeros(0, np.int64)
        if not len(top):
            continue
        far = _distances(lifted(x[top], norm), centroids)
        order = np.argsort(far, 1, kind="stable")[:, : options.replicas]
        near = np.take_along_axis(far, order, 1)
        own = np.pad(x[q : q + 1], ((0, 0), (0, 1)))
        mine = _distances(own, centroids)[0] - unavoidable(x[q : q + 1], norm)[0]
        asked = np.where((np.arange(order.shape[1]) < 1) | (near <= options.boundary * near[:, :1]), mine[order], np.inf).min(1)
        ranks.append((mine < asked[:, None]).sum(1) + 1)
        ratios.append(asked / max(mine.min(), 1e-12))
    if not ranks:
        return 1, 1.0
    return int(np.ceil(np.quantile(np.concatenate(ranks), options.recall))), float(np.quantile(np.concatenate(ratios), options.within))


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(0.0, norm - (x**2).sum(1)))[:, None]), 1).astype(np.float32)


def _best(vectors: pa.Table, asking: pa.Table, k: int) -> pa.Table:
    """Of each asking vector the k best other vec_ids of a block, ties to the smaller one, without those under its `floor`."""
    out = ([], [], [])
    if vectors.num_rows and asking.num_rows:
        v, ids = _matrix(vectors["embedding"]), vectors["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        v, ids = v[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        columns = np.ascontiguousarray(v.T)
        for i in range(0, asking.num_rows, 64):
            part = asking.slice(i, 64)
            q, q_ids, floor = _matrix(part["embedding"]), part["vec_id"].to_numpy(), part["floor"].to_numpy()
            score = np.zeros((len(q), len(v)))
            for d in range(v.shape[1]):  # component by component, so that equal vectors get equal scores
                score += q[:, d, None] * columns[d]
            if len(first) < len(ids):  # a vec_id with several vectors counts with its best
                score = np.maximum.reduceat(score, first, axis=1)
            own = ids[first]
            score[q_ids[:, None] == own] = -np.inf
            limit = -np.partition(-score, k - 1, 1)[:, k - 1] if len(own) > k else np.full(len(q), -np.inf)
            limit = np.maximum(limit, floor)
            for j in range(len(q)):
                t = np.flatnonzero((score[j] >= limit[j]) & np.isfinite(score[j]))
                t = t[np.argsort(-score[j][t], kind="stable")][:k]
                out[0].append(np.full(len(t), q_ids[j])), out[1].append(own[t]), out[2].append(score[j][t])
    a, b, c = (np.concatenate(x) if x else np.zeros(0) for x in out)
    return pa.table({"query_id": pa.array(a.astype(np.int64)), "vec_id": pa.array(b.astype(np.int64)), "score": pa.array(c.astype(np.float64))})


def search(vectors: DataFrame, divisor: int = 20, k: int = 20, options: Options = Options()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each vec_id divisible by `divisor`, the k best found of all other
    vec_ids, by largest inner product in double precision (summed in the order of the components); ties go to the
    smaller vec_id, and a table of fewer candidates gives fewer rows, else each query gets k.

    Rows whose vector is null, zero, of another size or holds null, NaN or infinite components, or that have no
    vec_id, take no part. Rows that repeat a vec_id count as one: as a query the least of their vectors, as a
    candidate the best. Extra columns are ignored, whatever their names; an empty table gives no rows.
    """
    with scratch(vectors.sparkSession):
        return kept(_search(vectors, divisor, k, options), "neighbours")


def _search(vectors: DataFrame, divisor: int, k: int, options: Options) -> DataFrame:
    spark = vectors.sparkSession
    rows = settle(usable(vectors).distinct(), "vectors")
    index = fit(rows, options, k)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shared = spark.sparkContext.broadcast(index)

    def assign(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            step = max(64, min(1024, (1 << 25) // len(index.centroids)))
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    x = _matrix(part.column("embedding"))
                    if query:
                        ids, far = graph_search(index, np.pad(x, ((0, 0), (0, 1))).astype(np.float32), max(options.beam, index.probes * 5 // 4))
                        ids, far = ids[:, : index.probes], far[:, : index.probes]
                        least, ratio = unavoidable(x, index.norm), index.ratio
                    else:
                        ids, far = graph_search(index, lifted(x, index.norm), 8 * options.replicas)
                        ids, far = ids[:, : options.replicas], far[:, : options.replicas]
                        least, ratio = 0.0, options.boundary
                    keep = np.isfinite(far) & ((np.arange(far.shape[1]) < 1) | (far - least <= ratio * (far[:, :1] - least) + 1e-12))
                    at = pa.array(np.repeat(np.arange(len(x)), keep.sum(1)))
                    place = np.broadcast_to(np.arange(keep.shape[1], dtype=np.int32), keep.shape)[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[keep].astype(np.int32)), pa.array(place), part.column("vec_id").take(at), part.column("embedding").take(at)], names=["list", "place", "vec_id", "embedding"])

        return run

    posting = "list int, place int, vec_id bigint, embedding array<double>"
    lists = settle(rows.mapInArrow(lean(assign(False)), posting).drop("place"), "lists")
    sizes = settle(lists.groupBy("list").agg(F.expr(f"cast(ceil(count(*) / {options.block}) as int)").alias("blocks")), "sizes")
    queries = settle(rows.where(f"vec_id % {divisor} = 0").groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")

    def compared(asked: DataFrame) -> DataFrame:
        """query_id, vec_id, score of each block's best; asked has a `floor` under which nothing counts."""
        counts = asked.groupBy("list").agg(F.expr(f"cast(ceil(count(*) / {options.query_block}) as int)").alias("q_blocks"))
        plan = settle(sizes.join(counts, "list"), "blocks")
        left = lists.join(plan, "list").withColumn("block", F.expr("cast(pmod(xxhash64(vec_id), blocks) as int)")).withColumn("q_block", F.explode(F.expr("sequence(0, q_blocks - 1)")))
        right = asked.join(plan, "list").withColumn("q_block", F.expr("cast(pmod(xxhash64(vec_id), q_blocks) as int)")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        met = left.select(*(F.col(c).alias(c) for c in ("list", "block", "q_block", "vec_id", "embedding"))).groupBy("list", "block", "q_block").cogroup(
            right.select(F.col("list").alias("l"), F.col("block").alias("b"), F.col("q_block").alias("q"), F.col("vec_id").alias("vec_id"), F.col("embedding").alias("embedding"), F.col("floor").alias("floor")).groupBy("l", "b", "q"))
        return met.applyInArrow(lambda a, b: _best(a, b, k), "query_id bigint, vec_id bigint, score double")

    asked = settle(queries.mapInArrow(lean(assign(True)), posting), "asked")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def best_of(found: DataFrame) -> DataFrame:
        merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return merged.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")

    # Nearest lists first, four times as many each time: what is under the k-th best so far cannot be among the k best.
    none = F.lit(float("-inf"))
    found, start, end = None, 0, TIER
    while start < index.probes:
        part = asked.where(f"place >= {start} and place < {end}")
        if found is None:
            found = settle(best_of(compared(part.withColumn("floor", none))), "found")
        else:
            floors = found.where(f"rank = {k}").select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
            more = compared(settle(part.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", none)), "further"))
            before, found = found, settle(best_of(found.select("query_id", "vec_id", "score").union(more)), "found")
            drop(before)
        start, end = end, 4 * end
    due = min(k, rows.select("vec_id").distinct().count() - 1)
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(f"n >= {due}").select(F.col("query_id").alias("vec_id"))
    short = settle(queries.join(full, "vec_id", "left_anti"), "short")
    if due <= 0 or short.isEmpty():
        return found
    every = short.select(F.explode(F.sequence(F.lit(0), F.lit(len(index.centroids) - 1))).alias("list"), "vec_id", "embedding").withColumn("floor", none)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").union(best_of(compared(every)))
