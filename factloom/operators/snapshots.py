"""What changed between consecutive full listings, by invertible Bloom lookup tables."""

import struct

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from factloom.scratch import cut, release

#: Three hash functions; each owns one sub-table of a power of two cells, addressed by 21 bits of a hash of key and value:
#: the old and the new value of a changed key must not meet in all their cells.
HASHES, BITS = 3, 21
DIGEST = -1


def _chain(*values: int) -> int:
    """What Spark's xxhash64 gives for these longs: each column seeds the next, the first seed is 42."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def peel(cells: dict[int, list[int]], width: int) -> list[tuple[int, int, int, int]] | None:
    """The signed entries (sign, key, key2, value) of a subtracted table, or None where it is too small.

    cells: cell number to [count, key, key2, value, check], all sums or exclusive ors; cell DIGEST holds the digest of
    the two bucket contents, against which the entries are verified.
    """
    digest = cells.pop(DIGEST, [0, 0, 0, 0, 0])
    todo, found = list(cells), []
    while todo:
        cell = cells.get(todo.pop())
        if cell is None or abs(cell[0]) != 1 or _chain(cell[1], cell[2], cell[3]) != cell[4]:
            continue
        sign, key, key2, value, check = cell
        found.append((sign, key, key2, value))
        place = _chain(key2, value, key) & 0xFFFFFFFFFFFFFFFF
        for j in range(HASHES):
            at = j * width + ((place >> (BITS * j)) & (width - 1))
            other = cells.setdefault(at, [0, 0, 0, 0, 0])
            other[0] -= sign
            other[1] ^= key
            other[2] ^= key2
            other[3] ^= value
            other[4] ^= check
            if not any(other):
                del cells[at]
            else:
                todo.append(at)
    if cells:
        return None
    total = [0, 0, 0, 0, 0]
    for sign, key, key2, value in found:
        total = [total[0] + sign, total[1] ^ key, total[2] ^ key2, total[3] ^ value, total[4] ^ _chain(value, key2, key)]
    return found if total == digest else None


def _peel_group(width: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cells = {int(r[0]): [int(x) for x in r[1:]] for r in pdf[["cell", "n", "k1", "k2", "v", "c"]].itertuples(index=False)}
        found = peel(cells, width)
        rows = [(key[0], key[1], 0, 0, 0, 0, True)] if found is None else [(key[0], key[1], *e, False) for e in found]
        return pd.DataFrame(rows, columns=["pair", "bucket", "sign", "k1", "k2", "v", "failed"])

    return run


PEELED = "pair int, bucket long, sign int, k1 long, k2 long, v long, failed boolean"


def _tables(rows: DataFrame, width: int) -> DataFrame:
    """Per snapshot and bucket the non-empty cells of its table, plus its digest."""
    places = [F.lit(j * width).cast("long") + F.shiftrightunsigned(F.xxhash64("k2", "v", "k1"), BITS * j).bitwiseAND(F.lit(width - 1).cast("long")) for j in range(HASHES)]
    at = F.array(*[F.struct(p.alias("cell"), F.col("check").alias("c")) for p in places], F.struct(F.lit(DIGEST).cast("long").alias("cell"), F.xxhash64("v", "k2", "k1").alias("c")))
    return (
        rows.withColumn("check", F.xxhash64("k1", "k2", "v"))
        .select("snap", "bucket", "k1", "k2", "v", F.inline(at))
        .groupBy("snap", "bucket", "cell")
        .agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(x).alias(x) for x in ("k1", "k2", "v", "c")])
    )


def _subtracted(tables: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cells of the later table less the earlier one, for each pair; cells that cancel out are gone."""
    t = tables.join(pairs, tables.snap.eqNullSafe(pairs.of))
    return (
        t.groupBy("pair", "bucket", "cell")
        .agg(F.sum(F.col("n") * F.col("sign")).alias("n"), *[F.bit_xor(x).alias(x) for x in ("k1", "k2", "v", "c")])
        .where((F.col("n") != 0) | (F.col("k1") != 0) | (F.col("k2") != 0) | (F.col("v") != 0) | (F.col("c") != 0))
    )


def snapshot_changes(rows: DataFrame, *, snapshot: str, key: str, values: dict[str, Column], delivered: str, bucket_rows: int = 4096, changed_share: float = 0.1) -> DataFrame:
    """(snapshot, key, change_kind) of every key added, removed or changed since the preceding snapshot that exists.

    values: the compared values by name; null equals null and differs from any value. Of several rows of a key in one
    snapshot the one with the latest ``delivered`` counts; among equal times the greatest values. Rows with a null
    snapshot or key are no part of any listing. The first snapshot has no predecessor and gives no row.

    Each listing is cut into hash buckets of about ``bucket_rows`` keys, and each bucket into one invertible lookup table
    per snapshot. Tables of neighbours are subtracted, what remains is peeled into pairs of key and value hashes, and the
    pairs are verified against digests of both buckets. A bucket with more changes than its table holds fails and is
    built anew, four times as large, until all are solved. Key hashes have 128 bits.

    Rows are shuffled once, to find the latest of each key, with map-side maxima. The comparison then shuffles cells of tables,
    whose number follows the changes expected and not the rows, and the changed hashes are named by a join with the kept keys, of
    which the changed side is the small one. The result is one kept table of the changes; those made on the way are deleted.
    """
    names = list(values)
    latest = (
        rows.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull())
        .select(F.col(snapshot).cast("int").alias("snap"), F.col(key).alias("key"), F.struct(F.col(delivered).alias("_at"), *[values[n].alias(n) for n in names]).alias("row"))
        .groupBy("snap", "key")
        .agg(F.max("row").alias("row"))
    )
    # A null must not hash like a neighbour's value, so each value says whether it is there.
    parts = [x for n in names for x in (F.col(f"row.{n}").isNull(), F.col(f"row.{n}"))]
    hashed = cut(latest.select("snap", "key", F.xxhash64("key").alias("k1"), F.xxhash64("key", F.lit("second")).alias("k2"), F.xxhash64(*parts).alias("v")))
    sizes = cut(hashed.groupBy("snap").agg(F.count(F.lit(1)).alias("n")))
    most = sizes.agg(F.max("n")).first()[0] or 0
    buckets = max(1, -(-most // bucket_rows))
    # One row per snapshot: the frame below spans only those.
    follows = sizes.select("snap", F.lag("snap").over(W.partitionBy(F.lit(0)).orderBy("snap")).alias("before")).where(F.col("before").isNotNull())
    pairs = cut(follows.select(F.col("snap").alias("pair"), F.inline(F.array(F.struct(F.col("snap").alias("of"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("of"), F.lit(-1).alias("sign"))))))
    placed = hashed.select("snap", "k1", "k2", "v", F.pmod("k1", F.lit(buckets)).alias("bucket"))

    per_bucket = 2 * changed_share * min(bucket_rows, max(most, 1))
    width = 16
    while width * HASHES < 1.6 * per_bucket and width < 1 << BITS:
        width *= 2
    solved, tables, again = [], [hashed, sizes, pairs], None
    while True:
        if again is not None:
            redo = again.join(pairs, "pair").select("bucket", F.col("of").alias("snap")).distinct()
            part = placed.join(redo, ["snap", "bucket"], "left_semi")
        else:
            part = placed
        cells = _subtracted(_tables(part, width), pairs)
        if again is not None:
            cells = cells.join(again, ["pair", "bucket"], "left_semi")
        peeled = cut(cells.groupBy("pair", "bucket").applyInPandas(_peel_group(width), PEELED))
        tables.append(peeled)
        solved.append(peeled.where(~F.col("failed")))
        again = peeled.where("failed").select("pair", "bucket")
        if again.isEmpty():
            break
        if width << 2 > 1 << BITS:
            raise ValueError(f"buckets of {bucket_rows} keys do not peel; choose smaller ones")
        width *= 4

    found = solved[0]
    for more in solved[1:]:
        found = found.unionByName(more)
    kinds = found.groupBy("pair", "k1", "k2").agg(F.max("sign").alias("most"), F.min("sign").alias("least"))
    kinds = kinds.select(
        "pair", "k1", "k2", F.when(F.col("most") != F.col("least"), "changed").when(F.col("most") == 1, "added").otherwise("removed").alias("change_kind")
    )
    # A removed key is named by the earlier listing, any other by the later one.
    named = kinds.join(pairs, "pair").where((F.col("change_kind") == "removed") == (F.col("sign") == -1))
    named = named.join(hashed.select(F.col("snap").alias("of"), "k1", "k2", "key"), ["of", "k1", "k2"]).select(F.col("pair").alias(snapshot), F.col("key").alias(key), "change_kind")
    kept = cut(named)
    release(*tables)
    return kept
