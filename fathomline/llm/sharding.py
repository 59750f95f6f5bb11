"""Sharding by minimax contiguous partition.

Rows with equal keys form one atomic group. Groups stand in the order of a 64-bit hash of their key. The smallest
shard capacity for which a greedy pass needs no more than the given shards is found by binary search, and the order is
cut there. Groups larger than an even share get a shard of their own first, so that the rest stays even.

The driver never holds all groups: it holds sums over hash ranges. A range in which some cut may fall is refined into
smaller ranges, until those ranges hold few groups, which are then fetched. Everything else is a filter or a sum.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

from pyspark.sql import DataFrame, Window, functions as F

from .common import saved

#: Hash ranges of the first histogram, and how many groups are fetched at most before ranges are refined instead.
FIRST_BITS, MORE_BITS, FETCH = 14, 6, 100_000


def greedy(sizes: list[int], capacity: int) -> list[int]:
    """Start of each shard when every shard takes as many whole items as fit. Needs capacity >= max(sizes)."""
    ends, cuts, base, i = list(accumulate(sizes)), [], 0, 0
    while i < len(sizes):
        cuts.append(i)
        i = bisect.bisect_right(ends, base + capacity, i)
        base = ends[i - 1]
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity for which greedy() needs at most `shards` shards."""
    if not sizes:
        return 0
    lo, hi = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        if len(greedy(sizes, mid)) <= shards:
            hi = mid
        else:
            lo = mid + 1
    return lo


def _places(items: list[tuple], capacity: int, shards: int, fluid: bool) -> list[int]:
    """Prefix sums at which a greedy pass cuts; fluid: ranges can be cut anywhere, so no cut comes later than these."""
    total = sum(x[2] for x in items)
    if fluid:
        return [min(total, capacity * k) for k in range(1, shards)]
    ends, out, base, i = list(accumulate(x[2] for x in items)), [], 0, 0
    for _ in range(shards - 1):
        i = bisect.bisect_right(ends, base + capacity, i)
        base = ends[i - 1] if i else 0
        out.append(base)
    return out


def minimax_cuts(groups: DataFrame, shards: int, giants: list[int] = ()) -> list[int]:
    """Lowest order value of each shard after the first. groups: (place long >= 0 of 63 bits, bytes long)."""
    rest = groups.where(~F.col("place").isin(list(giants))) if giants else groups
    bits, parts = FIRST_BITS, None
    hist = lambda g, b: [tuple(r) for r in g.groupBy(F.shiftright("place", 63 - b).alias("r")).agg(F.lit(b).alias("b"), F.sum("bytes").alias("s"), F.max("bytes").alias("m"), F.count("*").alias("n")).collect()]
    # items: (first place, bits or None for one group, bytes, largest group, groups)
    items = sorted((r << (63 - b), b, s, m, n) for r, b, s, m, n in hist(rest, bits))
    while items:
        largest, total = max(x[3] for x in items), sum(x[2] for x in items)
        low = max(largest, -(-total // shards))
        high = smallest_capacity([x[2] for x in items], shards)
        late, early, edge, at = _places(items, high, shards, True), _places(items, low, shards, False), [], 0
        for k, x in enumerate(items):
            if x[4] > 1 and any(at - x[3] <= hi and lo <= at + x[2] for lo, hi in zip(early, late, strict=True)):
                edge.append(k)
            at += x[2]
        if not edge:
            break
        # ranges of one length are joined by the leading bits of the place: a hash join with at most 2 ** FIRST_BITS rows
        inside = None
        for b in sorted({items[k][1] for k in edge}):
            picked = groups.sparkSession.createDataFrame([(items[k][0] >> (63 - b),) for k in edge if items[k][1] == b], "r long")
            part = rest.withColumn("r", F.shiftright("place", 63 - b)).join(F.broadcast(picked), "r", "left_semi").drop("r")
            inside = part if inside is None else inside.unionByName(part)
        # places are hashes, so that a range of the last few bits holds a group or two
        if sum(items[k][4] for k in edge) <= FETCH or bits + MORE_BITS > 62:
            parts = [(p, None, s, s, 1) for p, s in inside.select("place", "bytes").collect()]
        else:
            bits += MORE_BITS
            parts = [(r << (63 - b), b, s, m, n) for r, b, s, m, n in hist(inside, bits)]
        gone = set(edge)
        items = sorted([x for k, x in enumerate(items) if k not in gone] + parts)
    sizes = [x[2] for x in items]
    cuts = greedy(sizes, smallest_capacity(sizes, shards)) if items else []
    return [items[k][0] for k in cuts[1:]]


def shard(docs: DataFrame, shards: int = 24, overhead: int = 8, slot_rows: int = 4096) -> DataFrame:
    """Law `bytes`: sizes of shards near equal, equal texts together.

    docs: (doc_id, text, ...); size is the UTF-8 length (null: 0) plus `overhead`. Returns doc_id, size, text_crc32, law,
    shard, slot (gapless from 0 in each shard), grown_shard (null). Null ids and repeated rows keep one row each; null and
    empty texts form one group; an empty table gives no rows. `slot_rows`: about so many rows are numbered in one task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = saved(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 1).alias("place"),
        )
    )
    groups = saved(rows.groupBy("place").agg(F.sum("size").alias("bytes")))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    giants: list[int] = []
    spare = total
    while len(giants) < shards - 1:  # at most shards - 1 of them can exceed an even share
        share = spare / (shards - len(giants))
        more = [tuple(r) for r in groups.where((F.col("bytes") > share) & ~F.col("place").isin(giants)).orderBy(F.desc("bytes"), "place").limit(1).collect()]
        if not more:
            break
        giants.append(more[0][0])
        spare -= more[0][1]
    cuts = minimax_cuts(groups, shards - len(giants), giants)
    spark = docs.sparkSession
    if giants:
        g = spark.createDataFrame([(p, k) for k, p in enumerate(giants)], "place long, own int")
        rows = rows.join(F.broadcast(g), "place", "left")  # fewer than `shards` rows
    else:
        rows = rows.withColumn("own", F.lit(None).cast("int"))
    at = F.lit(len(giants))
    for c in cuts:
        at = at + F.when(F.col("place") >= F.lit(c), 1).otherwise(0)
    buckets = max(1, n // (slot_rows * shards) * 2)
    rows = rows.select("doc_id", "size", "text_crc32", "place", F.coalesce("own", at).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "place"), F.lit(buckets)).alias("bucket"))
    count = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = count.select("shard", "bucket", before.alias("first"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "place")) - 1
    out = rows.withColumn("own", own).join(first, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("own")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
