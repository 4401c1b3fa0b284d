"""Best-fit packing into bins of several permitted lengths (operator 10).

The plan needs only the histogram of piece lengths, which has at most as many
rows as the largest capacity, whatever the corpus: best-fit decreasing runs on
it with whole groups of equal bins at a time.  Spark then numbers the pieces
of each length (two levels, no large window) and joins each to its run of the
plan, which gives its bin and offset.

Opening: a length that fits no open bin opens the capacity with the least
cost.  A bin of capacity c costs ``c + c*c / ATTENTION + OVERHEAD`` (linear
work, attention, and a fixed part per sequence), so neither the shortest nor
the longest is always best; space that shorter pieces can still fill is
credited at the bin's price per token.  At the end each bin is downsized to the
least capacity that holds its contents.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.common import number_rows, ready, slices_for, written
from auditlens.llm.tokenizing import DEFAULT_TOKENIZER, encoder, tokenizer_path

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence beyond its length, and the length at which attention costs as much as the rest.
OVERHEAD, ATTENTION = 32, 16_384


def bin_cost(capacity: int, overhead: int = OVERHEAD) -> float:
    return capacity + capacity * capacity / ATTENTION + overhead


@dataclass
class _Bins:
    first: int      # bin ids first .. first + count - 1
    count: int
    capacity: int
    used: int


def plan_bins(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD):
    """Best-fit decreasing over {length: count}.

    Returns (runs, bins): runs are (length, first rank, ranks, per bin, first
    bin, offset): the piece with rank r of a length goes to bin
    ``first bin + (r - first rank) // per bin``; bins are (first, count, capacity).
    """
    caps = sorted(capacities)
    spaces: list[int] = []               # distinct free spaces, ascending
    by_space: dict[int, list[_Bins]] = {}
    full: list[_Bins] = []
    runs, next_bin = [], 0
    shorter = sum(length * n for length, n in histogram.items())

    def put(b: _Bins):
        space = b.capacity - b.used
        if not space:
            full.append(b)
            return
        if space not in by_space:
            bisect.insort(spaces, space)
            by_space[space] = []
        by_space[space].append(b)

    def fill(b: _Bins, length: int, rank: int, n: int) -> int:
        """Put up to n pieces into the bins of b; returns how many."""
        per = (b.capacity - b.used) // length
        whole = min(b.count, n // per)
        done = whole * per
        if whole:
            runs.append((length, rank, done, per, b.first, b.used))
            put(_Bins(b.first, whole, b.capacity, b.used + per * length))
        rest = min(n - done, per) if whole < b.count else 0
        if rest:
            runs.append((length, rank + done, rest, rest, b.first + whole, b.used))
            put(_Bins(b.first + whole, 1, b.capacity, b.used + rest * length))
        left = b.count - whole - (rest > 0)
        if left:
            put(_Bins(b.first + b.count - left, left, b.capacity, b.used))
        return done + rest

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        shorter -= length * n
        while rank < n:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                b = by_space[space].pop()
                if not by_space[space]:
                    del by_space[space], spaces[at]
                rank += fill(b, length, rank, n - rank)
                continue
            left = n - rank

            def cost(c, length=length, left=left):
                per = c // length
                count = -(-left // per)
                waste = count * c - left * length
                return bin_cost(c, overhead) * (count - min(waste, shorter) / c), -c

            c = min((x for x in caps if x >= length), key=cost)
            count = -(-left // (c // length))
            rank += fill(_Bins(next_bin, count, c, 0), length, rank, left)
            next_bin += count
    bins = full + [b for group in by_space.values() for b in group]
    fitted = [(b.first, b.count, next(c for c in caps if c >= b.used)) for b in bins]
    return runs, sorted(fitted)


def _cut(runs, bins):
    """Runs cut where the capacity of their bins changes: rows (length, lo, hi, per, bin, offset, capacity)."""
    starts, out = [b[0] for b in bins], []
    for length, rank, n, per, first, offset in runs:
        at, bin_, k = rank, first, bisect.bisect_right(starts, first) - 1
        while at < rank + n:
            stop = bins[k][0] + bins[k][1]
            hi = min(rank + n, at + (stop - bin_) * per)
            if out and out[-1][0] == length and out[-1][2] == at and out[-1][3] == per and out[-1][5:] == (offset, bins[k][2]) \
                    and out[-1][4] + (at - out[-1][1]) // per == bin_ and (at - out[-1][1]) % per == 0:
                out[-1] = (*out[-1][:2], hi, *out[-1][3:])
            else:
                out.append((length, at, hi, per, bin_, offset, bins[k][2]))
            at, bin_, k = hi, stop, k + 1
    return out


def token_lengths(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER):
    """Column: ids of the whole text plus one end id (null or empty text: 1)."""
    ready(docs.sparkSession)
    where = tokenizer_path(tokenizer)

    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(where)
        for column in batches:
            yield pa.array(enc.count(column) + 1, pa.int64())

    lengths.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(lengths, "long")(F.col("text"))


def pack(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """(node, doc_id, piece, start, n_tokens, bin, capacity, offset): every piece of every row in one bin.

    ``lengths`` has a unique ``node``, ``doc_id`` and ``n_tokens`` (at least
    1).  A row longer than the largest capacity is cut into pieces of that
    size; the last piece holds the rest.
    """
    spark, top = lengths.sparkSession, max(capacities)
    pieces = (lengths.withColumn("piece", F.explode(F.expr(f"sequence(0L, (n_tokens - 1) div {top})")))
              .select("node", "doc_id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.expr(f"n_tokens - piece * {top}")).alias("n_tokens")))
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most `top` rows
    rows = _cut(*plan_bins(histogram, capacities, overhead))
    plan = spark.createDataFrame(rows, "n_tokens long, lo long, hi long, per long, first long, offset long, capacity int")
    ranked = number_rows(pieces, ["n_tokens"], F.struct("node", "piece"), slices_for(sum(histogram.values())), "rank")
    # the plan's size follows the capacities, not the corpus
    return (ranked.join(F.broadcast(plan), "n_tokens").where("rank >= lo AND rank < hi")
            .select("node", "doc_id", "piece", "start", "n_tokens", F.expr("first + (rank - lo) div per").alias("bin"), "capacity",
                    F.expr("offset + (rank - lo) % per * n_tokens").alias("offset")))


def pack_documents(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """``pack`` over documents, without ``node``; lengths are the tokenizer's ids plus an end id.

    Null or empty texts are one end id.  Rows are told apart by position, so
    repeated rows and null ids each get their place.  An empty table gives an
    empty result.  Only doc_id and text are read.
    """
    base = written(docs.select(F.monotonically_increasing_id().alias("node"), "doc_id", token_lengths(docs, tokenizer).alias("n_tokens")), "lengths")
    return pack(base, capacities, overhead).drop("node")
