"""Packing into optimal length buckets.

The histogram of lengths is summed over all documents; a dynamic program over it chooses the bucket boundaries that
leave the least padding; inside a bucket, batches take as many documents as the token budget holds at the bucket's
boundary. The histogram has one row for each padded length up to the budget, so its size depends on `budget` and
`multiple`, not on the documents.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def byte_length(text: str = "text") -> Column:
    """Tokens of a byte-level model: the UTF-8 bytes and one end token; 1 for a null text."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def optimal_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most `buckets` ascending boundaries, the last the greatest length, for which the sum over documents of
    (boundary - length) is least; a length belongs to the first boundary that is not below it.

    best_k(j) = min over i of best_{k-1}(i) + length_j * (count_j - count_i) - (tokens_j - tokens_i), with prefix sums.
    For a fixed j this is a minimum of lines in length_j whose slopes -count_i fall with i, so a hull that only drops
    lines gives each k in linear time. Integers throughout; ties go to fewer buckets.
    """
    lengths = sorted(x for x, n in histogram.items() if n)
    if not lengths:
        return []
    count, tokens = [0], [0]
    for x in lengths:
        count.append(count[-1] + histogram[x])
        tokens.append(tokens[-1] + histogram[x] * x)
    n = len(lengths)
    best = [lengths[j] * count[j + 1] - tokens[j + 1] for j in range(n)]  # one bucket for lengths 0..j
    back: list[list[int]] = []
    for _ in range(1, min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i: the bucket starts after length i
        head, now, via = 0, [], []
        for j in range(n):
            if j:
                i = j - 1
                m, b = -count[i + 1], best[i] + tokens[i + 1]
                while len(hull) - head >= 2 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, b, i))
            x = lengths[j]
            while len(hull) - head >= 2 and hull[head][0] * x + hull[head][1] >= hull[head + 1][0] * x + hull[head + 1][1]:
                head += 1
            value = best[j]
            chosen = -1
            if hull and (other := hull[head][0] * x + hull[head][1] + x * count[j + 1] - tokens[j + 1]) < value:
                value, chosen = other, hull[head][2]
            now.append(value), via.append(chosen)
        back.append([v if v >= 0 else -1 for v in via])
        if now[-1] == best[-1]:
            back.pop()
            break
        best = now
    out, j = [lengths[-1]], n - 1
    for via in reversed(back):
        if via[j] >= 0:
            j = via[j]
            out.append(lengths[j])
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 16, budget: int = 65536, multiple: int = 8, chunk: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a row of docs: doc_id, n_tokens, bucket, boundary (padded length), batch_id, slot, padding (longs), and the
    columns of docs that `carry` names.

    n_tokens: `length`, by default byte_length(); it is rounded up to `multiple` first, the rounding counting as
    padding. A batch is the documents of one bucket with one batch_id; it holds at most budget // boundary of them. A
    document longer than the budget is a batch for itself, whole, padded to the multiple alone, in a bucket after the others;
    the histogram that the driver gets has one row for each padded length up to the budget, whatever the data.

    A bucket is dealt out into chunks of about `chunk` documents by a hash of doc_id, length and the row's place in the
    table, so rows that repeat a doc_id, or have none, fill as many chunks as others; batches form inside a chunk, by doc_id,
    at the price of one unfilled batch a chunk. docs must be read in a stable order, as a table is; laid out anew, it is
    packed anew. A null text is one end token. No rows give no rows.
    """
    n = byte_length() if length is None else length.cast("long")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)).cast("long").alias("n_tokens"), *(F.col(f"`{c}`") for c in carry))
    rows = rows.withColumn("padded", F.expr(f"cast((n_tokens + {multiple - 1}) div {multiple} * {multiple} as long)"))
    sums = rows.groupBy(F.when(F.col("padded") <= budget, F.col("padded")).otherwise(0).alias("padded")).agg(F.count("*").alias("n"))
    histogram = {r["padded"]: r["n"] for r in sums.toLocalIterator()}
    long = histogram.pop(0, 0)
    edges = optimal_boundaries(histogram, buckets)
    filled = [0] * len(edges) + [long]
    for x, m in histogram.items():
        filled[bisect_left(edges, x)] += m
    chunks = F.array(*(F.lit(max(1, -(-m // chunk))).cast("long") for m in filled))
    rows = rows.withColumn("bucket", sum((F.when(F.col("padded") > x, 1).otherwise(0) for x in edges), F.lit(0)).cast("long"))
    rows = rows.withColumn("boundary", F.coalesce(F.get(F.array(*(F.lit(x).cast("long") for x in edges)).cast("array<bigint>"), F.col("bucket").cast("int")), F.col("padded")))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "n_tokens", F.monotonically_increasing_id()), F.get(chunks, F.col("bucket").cast("int"))))
    place = F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("doc_id", "n_tokens")) - 1
    rows = rows.withColumn("place", place.cast("long")).withColumn("room", F.expr(f"greatest(1L, {budget} div boundary)"))
    return rows.select("doc_id", "n_tokens", "bucket", "boundary", F.concat_ws("-", "bucket", "chunk", F.expr("place div room")).alias("batch_id"),
        (F.col("place") % F.col("room")).cast("long").alias("slot"), (F.col("boundary") - F.col("n_tokens")).alias("padding"), *(F.col(f"`{c}`") for c in carry))
