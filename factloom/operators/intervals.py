"""Overlapping and gapped integer intervals, by canonical dyadic blocks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from factloom.functions.ids import DAY_BITS

#: A shard of the domain spans 2 ** SHARD_BITS days; blocks that are larger form one more shard of an entity.
SHARD_BITS = 11
LEAVES = 1 << DAY_BITS


def dyadic_blocks(first: Column, last: Column) -> Column:
    """The canonical decomposition of the closed integer interval as node numbers of the binary tree over 2 ** DAY_BITS
    leaves: root 1, leaf d is LEAVES + d, the parent of n is n >> 1."""
    left, right = (first + F.lit(LEAVES)).cast("long"), (last + F.lit(LEAVES + 1)).cast("long")

    def at(k: Column) -> Column:
        lo = F.call_function("shiftright", left - 1, k) + F.lit(1).cast("long")
        hi = F.call_function("shiftright", right, k)
        return F.array_compact(F.array(F.when((lo < hi) & (lo % 2 == 1), lo), F.when((lo < hi) & (hi % 2 == 1), hi - 1)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(DAY_BITS)), at))


def ancestors_of_day(day: Column) -> Column:
    """All tree nodes that cover the day, from the leaf to the root."""
    return F.transform(F.sequence(F.lit(0), F.lit(DAY_BITS)), lambda k: F.call_function("shiftright", (day + F.lit(LEAVES)).cast("long"), k))


def merge_blocks(group: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, first, end) of the maximal runs of each group's blocks; end is exclusive. group must ascend."""
    height = DAY_BITS + 1 - np.frexp(node.astype(np.float64))[1]
    start = (node << height) - LEAVES
    end = start + (np.int64(1) << height)
    order = np.lexsort((-height, start, group))
    group, node, height, end = group[order], node[order], height[order], end[order]
    # Blocks nest or lie apart, so one whose end does not exceed all ends before it in its group has an ancestor there.
    reach = group * (2 * LEAVES) + end
    before = np.concatenate(([-1], np.maximum.accumulate(reach)[:-1])) if len(reach) else reach
    keep = reach > before
    group, node, height = group[keep], node[keep], height[keep]
    for level in range(DAY_BITS):
        at = np.flatnonzero(height == level)
        if not len(at):
            continue
        at = at[np.lexsort((node[at], group[at]))]
        left = np.flatnonzero((node[at][:-1] % 2 == 0) & (node[at][1:] == node[at][:-1] + 1) & (group[at][1:] == group[at][:-1]))
        if len(left):
            node[at[left]] >>= 1
            height[at[left]] += 1
            stays = np.ones(len(node), bool)
            stays[at[left + 1]] = False
            group, node, height = group[stays], node[stays], height[stays]
    start = (node << height) - LEAVES
    end = start + (np.int64(1) << height)
    order = np.lexsort((start, group))
    group, start, end = group[order], start[order], end[order]
    if not len(group):
        return group, start, end
    begins = np.concatenate(([True], (group[1:] != group[:-1]) | (start[1:] != end[:-1])))
    ends = np.concatenate((begins[1:], [True]))
    return group[begins], start[begins], end[ends]


def _merge_batches(batches):
    for batch in batches:
        lists = batch.column("blocks")
        group = np.repeat(np.arange(len(lists), dtype=np.int64), np.diff(lists.offsets.to_numpy()))
        group, start, end = merge_blocks(group, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("entity").take(pa.array(group)), pa.array(start), pa.array(end)], names=["entity", "first", "end"])


def merged_periods(intervals: DataFrame) -> DataFrame:
    """(entity, first, end): the maximal runs of days covered by any of an entity's closed intervals; end is exclusive.

    intervals(entity string, first, last): day numbers in [0, 2 ** DAY_BITS). Rows with a null or with last < first are
    left out; repeated rows change nothing.

    Each interval becomes at most 2 * DAY_BITS dyadic blocks. Blocks are collected by entity and shard of the domain with
    map-side sets; a shard has fewer than 2 ** (SHARD_BITS + 1) distinct blocks whatever the number of intervals, so an
    entity with a third of all rows is spread over its shards and each stays small. Within a shard covered blocks go and
    sibling pairs rise; what is left of all shards is coalesced in a streaming pass in order of days.
    """
    valid = intervals.where(F.col("entity").isNotNull() & (F.col("first") <= F.col("last"))).select("entity", F.explode(dyadic_blocks(F.col("first"), F.col("last"))).alias("block"))
    depth = F.lit(DAY_BITS) - F.floor(F.log2(F.col("block"))).cast("int")
    above = F.lit(SHARD_BITS) - depth
    shard = F.when(above >= 0, F.call_function("shiftright", F.col("block"), above)).otherwise(F.lit(0).cast("long"))
    sets = valid.groupBy("entity", shard.alias("shard")).agg(F.collect_set("block").alias("blocks"))
    runs = sets.select("entity", "blocks").mapInArrow(_merge_batches, "entity string, first long, end long")
    order = W.partitionBy("entity").orderBy("first", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = runs.withColumn("fresh", F.when(reach.isNull() | (F.col("first") > reach), 1).otherwise(0))
    return marked.withColumn("run", F.sum("fresh").over(order)).groupBy("entity", "run").agg(F.min("first").alias("first"), F.max("end").alias("end")).select("entity", "first", "end")


def periods_and_gaps(intervals: DataFrame) -> DataFrame:
    """(entity, span_kind, first, end): ``merged_periods`` as ``period`` and the days between two of them as ``gap``."""
    p = merged_periods(intervals)
    before = F.lag("end").over(W.partitionBy("entity").orderBy("first"))
    both = F.array_compact(
        F.array(
            F.struct(F.lit("period").alias("span_kind"), F.col("first"), F.col("end")),
            F.when(F.col("before").isNotNull(), F.struct(F.lit("gap").alias("span_kind"), F.col("before").alias("first"), F.col("first").alias("end"))),
        )
    )
    return p.withColumn("before", before).select("entity", F.inline(both))
