"""Best-fit packing of token sequences into bins of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Permitted sequence lengths, and what a sequence costs besides its length.
CAPACITIES, OVERHEAD = (512, 1024, 2048, 4096), 32
#: Documents packed together.
SHARD_DOCS = 2048


def _size_to_open(waiting: list[int], end: int, length: int, capacities: tuple[int, ...], overhead: int) -> int:
    """The capacity with the least cost for each token, were the new bin filled greedily from what waits below ``end``."""
    best = None
    for capacity in capacities:
        left, hi = capacity - length, end
        if left < 0:
            continue
        while left and (hi := bisect_right(waiting, left, 0, hi)):
            hi -= 1
            left -= waiting[hi]
        cost = (capacity + overhead) / (capacity - left)
        if best is None or cost < best[0]:
            best = cost, capacity
    return best[1]


def pack_shard(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces (item, piece, length, bin, capacity, offset) of items of the given lengths.

    Items longer than the largest capacity fill bins of their own; what is left of them is
    packed with the others, longest first, each into the open bin with the least room that
    holds it. If none does, a bin of the least-cost size opens. Finally every bin shrinks to the
    smallest capacity that holds its contents.
    """
    largest = max(capacities)
    pieces, bins, rest = [], [], []
    for item, n in enumerate(lengths):
        full, left = divmod(n, largest)
        for piece in range(full):
            pieces.append([item, piece, largest, len(bins), 0])
            bins.append(largest)
        if left:
            rest.append((left, item, full))
    rest.sort(key=lambda x: (x[0], -x[1]))
    waiting = [x[0] for x in rest]
    room: list[tuple[int, int]] = []  # (room left, bin) of open bins, in order
    sizes = {}
    for end in range(len(rest) - 1, -1, -1):
        length, item, piece = rest[end]
        at = bisect_left(room, (length, -1))
        if at < len(room):
            left, number = room.pop(at)
        else:
            number = len(bins)
            sizes[number] = left = _size_to_open(waiting, end, length, capacities, overhead)
            bins.append(0)
        pieces.append([item, piece, length, number, bins[number]])
        bins[number] += length
        if left > length:
            insort(room, (left - length, number))
    fitting = sorted(capacities)
    return [(item, piece, n, number, fitting[bisect_left(fitting, bins[number])], offset) for item, piece, n, number, offset in pieces]


def pack(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, id_col: str = "doc_id", tokens_col: str = "n_tokens", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``doc_id, piece, n_tokens, bin_id, capacity, offset`` for each piece of each document.

    Documents are dealt by hash to shards of about ``shard_docs``; shards are packed on their
    own, so a task holds a shard's lengths only, and each leaves a few bins open at most. Rows of an id that has more than
    a shard of them are dealt one by one. A
    document longer than the largest capacity is split into pieces. A bin is named by its shard
    and number.

    Null, zero or negative lengths take no room: one row with 0 tokens and no bin. Rows without an id and
    repeated rows are packed like others. An empty table gives no rows; other columns are not
    read.
    """
    rows = written(lengths.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens")))
    shards = max(1, -(-rows.count() // shard_docs))
    often = rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("_often")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > shard_docs).select("_often")
    place = F.xxhash64("_place")
    key = F.when(F.col("doc_id").isNull() | F.col("_often").isNotNull(), place).otherwise(F.xxhash64("doc_id"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        ids, n, shard = group["doc_id"].to_pylist(), group["n_tokens"].to_pylist(), group["shard"][0].as_py()
        packed = pack_shard(n, capacities, overhead)
        out = [(ids[i], piece, size, f"{shard}-{number}", capacity, offset) for i, piece, size, number, capacity, offset in packed]
        out += [(i, 0, 0, None, None, None) for i, size in zip(ids, n) if not size]
        columns = list(zip(*out))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "n_tokens", "bin_id", "capacity", "offset"])

    # at most one id for each shard's rows, so the table is small
    known = rows.withColumn("_place", F.monotonically_increasing_id()).join(F.broadcast(often), F.col("doc_id") == F.col("_often"), "left")
    dealt = known.select("doc_id", "n_tokens", F.pmod(key, F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece int, n_tokens long, bin_id string, capacity int, offset int")
