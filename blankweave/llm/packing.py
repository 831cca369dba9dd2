"""Batches of documents of like length, with optimal bucket boundaries.

The lengths of all documents are counted in a histogram with a cell for every length that
occurs, which the driver reads: n different lengths need texts of n * n / 2 tokens together,
so 16 TB of words hold at most some 2 million. Dynamic programming over the cells finds the
boundaries with the least padding of all choices, in whole numbers. As the cost of a cell is
a line over its length, the best line of each round comes from their lower envelope, and a
round takes time linear in the cells. In a bucket a batch takes as many documents as fit the
token budget at the bucket's padded length. A bucket is numbered in parts of about PART_ROWS
rows, so none is gathered in one task; each part may leave one batch unfilled.

Lengths are words unless ``length`` gives another column, such as the count of tokens that
``bpe.encode_documents`` returns.

Defined results: null or empty text, or a null length, has 0 tokens and lies in the first bucket; a document
longer than the budget is a batch of its own; ties in length are ordered by doc_id; rows of
a repeated doc_id with different texts, and rows without doc_id, spread over the parts;
repeated rows each take a slot; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import shared

BUCKETS, BUDGET, PART_ROWS = 8, 32768, 50_000


def token_count(text: str = "text") -> Column:
    """Words between blanks, tabs and line ends."""
    return F.regexp_count(shared.text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def boundaries(lengths: list[int], counts: list[int], most: int = BUCKETS) -> list[int]:
    """At most ``most`` bucket boundaries out of ``lengths`` (ascending) that minimise the padding of all documents."""
    n = len(lengths)
    if not n:
        return []
    docs = [0, *accumulate(counts)]
    # cost[j]: padded tokens of the cells 0..j-1; what the texts hold themselves is the same for all choices.
    cost, back = [0, *(length * d for length, d in zip(lengths, docs[1:], strict=True))], []
    for _ in range(min(most, n) - 1):
        cost, come = _one_more(lengths, docs, cost)
        back.append(come)
    chosen, j = [], n
    for come in reversed(back):
        if j:
            chosen.append(lengths[j - 1])
            j = come[j]
    if j:
        chosen.append(lengths[j - 1])
    return chosen[::-1]


def _one_more(lengths: list[int], docs: list[int], cost: list[int]) -> tuple[list[int], list[int]]:
    """Costs with one more bucket, and the number of cells before the last one: the least of cost[i] + length * (docs[j] - docs[i]).

    Over the length, cell i is a line of slope -docs[i] and height cost[i]. Slopes fall and lengths grow, so the
    lines that are best somewhere form a queue, whose first one is left behind for good once the second is as low.
    """
    new, come, queue = [0], [0], deque()
    for j, length in enumerate(lengths, 1):
        i = j - 1
        while len(queue) > 1:
            a, b = queue[-2], queue[-1]
            # b is best nowhere if line i meets a no later than b does.
            if (cost[i] - cost[a]) * (docs[b] - docs[a]) > (cost[b] - cost[a]) * (docs[i] - docs[a]):
                break
            queue.pop()
        queue.append(i)
        while len(queue) > 1 and cost[queue[1]] - length * docs[queue[1]] <= cost[queue[0]] - length * docs[queue[0]]:
            queue.popleft()
        new.append(cost[queue[0]] + length * (docs[j] - docs[queue[0]]))
        come.append(queue[0])
    return new, come


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, n_tokens, bucket, batch_id, slot, padding) of every row; ``bucket`` is the padded length of its batch."""
    number = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    sized = shared.cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (token_count() if length is None else F.coalesce(length.cast("long"), F.lit(0))).alias("n_tokens"),
            F.xxhash64("doc_id", *(c for c in ("text",) if c in docs.columns), number).alias("spread"),
        ),
        "lengths",
    )
    histogram = sized.groupBy("n_tokens").agg(F.count("*").alias("docs")).orderBy("n_tokens").collect()
    bounds = boundaries([r["n_tokens"] for r in histogram], [r["docs"] for r in histogram], buckets)
    held = dict.fromkeys(bounds, 0)
    for r in histogram:
        held[bounds[bisect_left(bounds, r["n_tokens"])]] += r["docs"]
    layout = docs.sparkSession.createDataFrame(
        [(b, i, max(1, -(-held[b] // part_rows)), max(1, budget // max(1, b))) for i, b in enumerate(bounds)],
        shared.fields(("bucket", T.LongType()), ("number", T.LongType()), ("parts", T.LongType()), ("capacity", T.LongType())),
    )
    limits = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    placed = sized.withColumn("bucket", F.array_min(F.filter(limits, lambda b: b >= F.col("n_tokens"))))
    dealt = placed.join(layout, "bucket").withColumn("part", F.expr("pmod(spread, parts)"))
    rank = F.row_number().over(W.partitionBy("bucket", "part").orderBy("n_tokens", "doc_id")) - 1
    return dealt.withColumn("rank", rank).select(
        "doc_id", "n_tokens", "bucket",
        F.concat_ws("-", "number", "part", F.expr("cast(rank div capacity as bigint)")).alias("batch_id"),
        F.expr("cast(rank % capacity as bigint)").alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )
