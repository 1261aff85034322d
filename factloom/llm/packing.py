"""Containers of fixed capacity filled by the sum-of-squares rule."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from factloom.scratch import cut, release

PACKED = "doc_id string, part int, size long, copy long, bin long, room long"


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, room left in each bin).

    N[g] is the number of open bins with room g. Each item in turn, largest first, goes where the sum of N[g] ** 2 becomes
    least: to an open bin of some room, or to a new one. Full bins leave the sum. Of equal choices the tightest wins.
    """
    sizes = np.asarray(sizes, np.int64)
    count = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(sizes), np.int64)
    room: list[int] = []
    never = np.iinfo(np.int64).max
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        # Change of the sum for room g: N[g] falls by one and N[g - s] rises by one, unless the bin is then full.
        change = np.where(count[s:] > 0, 2 * (count[: capacity + 1 - s] - count[s:]) + 2, never)
        if count[s]:
            change[0] = 1 - 2 * count[s]
        at = int(np.argmin(change))
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        if fresh < change[at]:
            b, left = len(room), capacity - s
            room.append(left)
        else:
            b, left = stacks[s + at].pop(), at
            count[s + at] -= 1
            room[b] = left
        if left:
            stacks[left].append(b)
            count[left] += 1
        bins[i] = b
    return bins, np.array(room, np.int64)


def _pack_group(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part", "copy"], kind="stable")
        bins, room = sum_of_squares(pdf["size"].to_numpy(), capacity)
        return pdf[["doc_id", "part", "size", "copy"]].assign(bin=bins, room=room[bins] if len(bins) else bins)

    return run


def pack(sizes: DataFrame, *, capacity: int = 2048, shard_items: int = 100_000, tail_share: float = 0.02) -> DataFrame:
    """(doc_id, part, token_from, token_to, container_id): where each document of sizes(doc_id, n_tokens) lies.

    A document longer than ``capacity`` is split into full parts and a rest, others are never split. Documents without
    tokens need no container and give no row; null sizes likewise. A repeated doc_id is packed as often as it is given,
    each copy in containers of its own name; a null doc_id is a document like others.

    Documents are dealt by a hash of their id into shards of about ``shard_items`` pieces, each packed alone by the
    sum-of-squares rule, so only ids and sizes are shuffled, and a task holds one shard. Bins that a shard leaves with more
    than ``tail_share`` of their room are emptied and their pieces packed once more, all shards together, in as many
    shards as their number needs. Copies of one id are dealt like others.
    The result, one kept table, depends on ids and sizes alone, but for which of several copies lies where.
    """
    asked = sizes.where(F.col("n_tokens") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n"))
    whole = F.floor(F.col("n") / capacity).cast("int")
    parts = asked.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.when(F.col("n") % capacity == 0, whole - 1).otherwise(whole))).alias("part"))
    size = F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("part") * capacity)
    given = cut(parts.select("doc_id", "part", size.alias("size"), F.monotonically_increasing_id().alias("row")), rest=F.count_if(F.col("size") < capacity))
    # Copies of a document, be they a third of all rows, are told apart by their row; all other pieces by id and part alone.
    again = given.groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("id"), F.col("part").alias("at"), F.lit(True).alias("again"))
    pieces = given.join(again, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("part") == F.col("at")), "left").select("doc_id", "part", "size", F.when(F.col("again"), F.col("row")).alias("copy"))
    # Full pieces fill a container each and take no part in the search.
    known = F.concat(F.lit("f"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("."), F.col("part"), F.coalesce(F.concat(F.lit("."), F.col("copy")), F.lit("")))
    full = pieces.where(F.col("size") == capacity).select("doc_id", "part", "size", known.alias("container_id"))
    rest = pieces.where(F.col("size") < capacity)

    def packed(items: DataFrame, n: int) -> DataFrame:
        shards = max(1, -(-n // shard_items))
        # Numbers beside nulls would become floating point in Python.
        dealt = items.select(F.pmod(F.xxhash64("doc_id", "part", "copy"), F.lit(shards)).alias("shard"), F.col("doc_id").cast("string").alias("doc_id"), "part", "size", F.coalesce("copy", F.lit(-1)).alias("copy"))
        out = dealt.groupBy("shard").applyInPandas(_with_shard(capacity), "shard long, " + PACKED)
        return out.withColumns({"doc_id": F.col("doc_id").cast("long"), "copy": F.nullif("copy", F.lit(-1))})

    loose = F.col("room") > F.lit(int(capacity * tail_share))
    first = cut(packed(rest, given.measured["rest"]), loose=F.count_if(loose))
    second = packed(first.where(loose).select("doc_id", "part", "size", "copy"), first.measured["loose"])

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("doc_id", "part", "size", F.concat(F.lit(prefix), F.col("shard"), F.lit("."), F.col("bin")).alias("container_id"))

    out = full.unionByName(named(first.where(~loose), "s")).unionByName(named(second, "t"))
    begin = F.col("part").cast("long") * capacity
    kept = cut(out.select("doc_id", "part", begin.alias("token_from"), (begin + F.col("size")).alias("token_to"), "container_id"))
    release(given, first)
    return kept


def _with_shard(capacity: int):
    one = _pack_group(capacity)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = one(pdf)
        out.insert(0, "shard", key[0])
        return out

    return run


def audit(packed: DataFrame, sizes: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """(doc_id, covered, within_capacity, split_only_if_longer) of each document of sizes(doc_id, n_tokens) that has tokens:
    whether its parts hold each token exactly once, whether all their containers keep to the capacity, and whether it is split
    no more than its length demands. Repeated and null ids count as one document of their sum."""
    bins = packed.groupBy("container_id").agg((F.sum(F.col("token_to") - F.col("token_from")) <= capacity).alias("fits"))
    parts = packed.join(bins, "container_id").groupBy("doc_id").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("held"), F.count_distinct("part", "token_from", "token_to").alias("parts"), F.bool_and("fits").alias("fits"))
    n = sizes.where(F.col("n_tokens") > 0).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("longest")).withColumnRenamed("doc_id", "id")
    both = n.join(parts, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return both.select(
        F.col("id").alias("doc_id"), F.coalesce(F.col("held") == F.col("n"), F.lit(False)).alias("covered"), F.coalesce("fits", F.lit(False)).alias("within_capacity"), F.coalesce(F.col("parts") <= F.ceil(F.col("longest") / capacity), F.lit(False)).alias("split_only_if_longer")
    )


def fill(packed: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """(containers, tokens, unused_share): how full the containers of ``pack`` are."""
    bins = packed.groupBy("container_id").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("used"))
    total = bins.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"))
    return total.select("containers", "tokens", F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).otherwise(0.0).alias("unused_share"))
