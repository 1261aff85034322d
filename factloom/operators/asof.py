"""Attributes of an entity as they were known at an event's time."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from factloom.scratch import cut, release

#: A time in microseconds falls into a slot of 2 ** SLOT (about 72 minutes); a crowded slot is cut into 2 ** (SLOT - FINE)
#: ticks of about a second.
SLOT, FINE = 32, 20
#: A task merges the shards it was dealt in blocks of about so many rows.
BLOCK_ROWS = 1 << 16
SHARD = ["entity", "lane", "shard", "salt"]


def known_versions(events: DataFrame, revisions: DataFrame, *, shard_rows: int | None = None, lane_versions: int = 50_000) -> DataFrame:
    """(event_id, version_id, revision_no): versions in force on an event's day as recorded by the event's time.

    events(event_id, entity, day, at); revisions(entity, version_id, revision_no, valid struct<first, last>, recorded).
    Of each version the revision with the highest number among those recorded at or before ``at`` counts (of equal
    numbers the one recorded last, then the one whose interval is greater); it is a case if ``valid`` is not null and
    holds ``day``. Nulls in any joined column make no case; repeated rows give one. Distinct rows.

    Every entity's time is cut into shards of at most ``shard_rows`` rows (four times what entities have on the mean, between 32
    and 100,000, where not given), or of as many rows as it has versions or a 1,024th of its rows (up to 100,000) if those are
    more, so that neither carry-in nor the number of shards outweighs the rows themselves; there is no limit to the number of shards, and an entity
    of one shard takes the same path. Cuts come from counts by slots of time, and by ticks within crowded slots; events
    of a tick that is crowded itself are dealt over salts, each with all of the tick's revisions. A shard gets the best
    earlier revision of every version as carry-in, a running maximum over shards, so it is complete by itself. An entity with
    more than ``lane_versions`` versions is dealt by version into lanes that each see all its events. Each shard is then
    merged alone: see ``merge_shards``. What stays in one shard whatever its size are revisions of one version within a tick.
    """
    present = lambda df, *names: df.where(~F.greatest(*[F.col(n).isNull() for n in names]))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("at")
    e = present(events, "event_id", "entity", "day", "at").select("entity", F.lit(True).alias("is_event"), micros("at"), "event_id", F.col("day").cast("long").alias("first"))
    r = present(revisions, "entity", "version_id", "revision_no", "recorded").select(
        "entity", F.lit(False).alias("is_event"), micros("recorded"), "version_id", "revision_no", F.col("valid.first").cast("long").alias("first"), F.col("valid.last").cast("long").alias("last")
    )
    slot = F.shiftright("at", SLOT)
    rows = e.unionByName(r, allowMissingColumns=True).withColumn("slot", slot)
    slots = _slots(rows, shard_rows, lane_versions)

    crowded = slots.where(F.col("tick") >= 0).select("entity", "slot", F.lit(True).alias("crowded")).distinct()
    tick = F.when(F.col("crowded"), _tick()).otherwise(-1)
    placed = rows.join(crowded, ["entity", "slot"], "left").withColumn("tick", tick).join(slots, ["entity", "slot", "tick"], "left")
    number = {c: F.coalesce(c, F.lit(d)) for c, d in (("shard", 0), ("shards", 1), ("salts", 1), ("lanes", 1))}
    placed = placed.drop("slot", "tick", "crowded").withColumns(number)

    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    revised = placed.where(~F.col("is_event")).withColumn("lane", F.pmod(F.xxhash64("version_id"), F.col("lanes")).cast("int"))
    best = F.struct("revision_no", "at", "first", "last")
    # Of a version only shards in which it was revised are rows here; its best so far is carried to all shards up to the next.
    w = W.partitionBy("entity", "lane", "version_id").orderBy("shard")
    ranked = revised.where(F.col("shards") > 1).groupBy("entity", "lane", "version_id", "shards", "shard").agg(F.max(best).alias("best"))
    ranked = ranked.withColumns({"best": F.max("best").over(w), "to": F.coalesce(F.lead("shard").over(w), F.col("shards") - 1)}).where(F.col("to") > F.col("shard"))
    salted = slots.where(F.col("salts") > 1).select("entity", "shard", "salts").distinct()
    carried = ranked.select("entity", "lane", "version_id", F.explode(F.sequence(F.col("shard") + 1, F.col("to"))).alias("shard"), "best.*").join(salted, ["entity", "shard"], "left")
    carried = carried.withColumns({"is_event": F.lit(False), "salts": F.coalesce("salts", F.lit(1))})

    asked = placed.where("is_event").withColumn("salt", F.pmod(F.xxhash64("event_id", "at", "first"), F.col("salts")).cast("int")).withColumn("lane", each("lanes"))
    columns = [*SHARD, "is_event", "at", "first", "last", "event_id", "version_id", "revision_no"]
    known = revised.unionByName(carried, allowMissingColumns=True).withColumn("salt", each("salts"))
    dealt = asked.select(columns).unionByName(known.select(columns)).repartition(*SHARD).sortWithinPartitions(*SHARD)
    kinds = ", ".join(f"{n} {dealt.schema[n].dataType.simpleString()}" for n in ("event_id", "version_id", "revision_no"))
    return dealt.mapInArrow(_merge_batches, kinds).distinct()


def _tick() -> Column:
    return F.shiftright("at", FINE).bitwiseAND(F.lit((1 << (SLOT - FINE)) - 1)).cast("int")


def _slots(rows: DataFrame, shard_rows: int | None, lane_versions: int) -> DataFrame:
    """(entity, slot, tick, shard, shards, salts, lanes) of entities with more than one shard, a kept table; tick is -1 but for
    crowded slots.

    An entity's slots are at most those of its span of time, and a slot's ticks 4,096, whatever the number of rows.
    """
    n = F.count(F.lit(1))
    sizes = cut(rows.groupBy("entity").agg(n.alias("n"), F.approx_count_distinct("version_id").alias("versions")), mean=F.avg("n"))
    if shard_rows is None:
        shard_rows = min(100_000, max(32, int(4 * (sizes.measured["mean"] or 0))))
    most = F.greatest(F.lit(shard_rows), F.least(F.col("versions"), F.lit(lane_versions)), F.least(F.floor(F.col("n") / 1024), F.lit(100_000)))
    # Half a shard is the quantum: a shard holds the slots that begin within one, and the last of them may be as large again.
    large = sizes.where(F.col("n") > most).select("entity", F.ceil(most / 2).alias("quantum"), F.greatest(F.lit(1), F.ceil(F.col("versions") / lane_versions)).cast("int").alias("lanes"))
    counts = rows.join(large, "entity").groupBy("entity", "slot", "quantum", "lanes").agg(n.alias("n"))
    crowded = counts.where(F.col("n") > F.col("quantum")).select("entity", "slot", "quantum")
    ticks = rows.join(crowded, ["entity", "slot"]).groupBy("entity", "slot", "quantum", _tick().alias("tick")).agg(n.alias("n"))
    by_tick = W.partitionBy("entity", "slot").orderBy("tick")
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ticks = ticks.withColumn("step", F.floor(ahead(by_tick) / F.col("quantum"))).withColumn("part", F.dense_rank().over(W.partitionBy("entity", "slot").orderBy("step")) - 1)
    salts = F.ceil(F.sum("n").over(W.partitionBy("entity", "slot", "part")) / (2 * F.col("quantum"))).cast("int")
    ticks = ticks.select("entity", "slot", "tick", "part", salts.alias("salts"))
    parts = ticks.groupBy("entity", "slot").agg((F.max("part") + 1).alias("parts"))

    w = W.partitionBy("entity").orderBy("slot")
    steps = counts.join(parts, ["entity", "slot"], "left").withColumn("step", F.floor(ahead(w) / F.col("quantum")))
    before = F.lag("step").over(w)
    opens = before.isNull() | (F.col("step") > before) | F.lag("parts").over(w).isNotNull()
    fresh = steps.withColumn("fresh", F.coalesce("parts", F.when(opens, 1).otherwise(0)))
    upto, all_ = F.sum("fresh").over(w), F.sum("fresh").over(W.partitionBy("entity"))
    numbered = fresh.select("entity", "slot", "lanes", "parts", (upto - F.coalesce("parts", F.lit(1))).cast("int").alias("base"), all_.cast("int").alias("shards"))
    light = numbered.where(F.col("parts").isNull()).select("entity", "slot", F.lit(-1).alias("tick"), F.col("base").alias("shard"), "shards", F.lit(1).alias("salts"), "lanes")
    heavy = numbered.where(F.col("parts").isNotNull()).join(ticks, ["entity", "slot"]).select("entity", "slot", "tick", (F.col("base") + F.col("part")).alias("shard"), "shards", "salts", "lanes")
    kept = cut(light.unionByName(heavy))
    release(sizes)
    return kept


def _starts(batch: pa.Table) -> np.ndarray:
    """Which rows differ from the row before them in the shard they belong to; the first row does."""
    fresh = np.zeros(batch.num_rows, bool)
    fresh[:1] = True
    for name in SHARD:
        c = batch.column(name)
        fresh[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return fresh


def merge_shards(shard: np.ndarray, is_event: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, valid: np.ndarray, version: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(event row, revision row) of every case in shards that ascend; events have their day in ``first``.

    A revision is the known one of its version from its recording until a better one is recorded. A shard's events in order of
    day form the leaves of a tree; a known revision's interval is a run of leaves, thus a few nodes, and in each node,
    in order of time, the events of its known span are again one run, found by binary search. So the work is that of sorting,
    plus one step a case; pairs that are none are never made.
    """
    events, revs = np.flatnonzero(is_event), np.flatnonzero(~is_event)
    none = np.zeros(0, np.int64)
    if not len(events) or not len(revs):
        return none, none
    times, tick = np.unique(at, return_inverse=True)
    owner = np.unique(np.stack((shard[revs], version[revs])), axis=1, return_inverse=True)[1]
    a, b, ok = np.where(valid[revs], first[revs], 0), np.where(valid[revs], last[revs], 0), valid[revs]
    order = np.lexsort((-b, -a, ~ok, -at[revs], -number[revs], owner))
    revs, owner, a, b, ok = revs[order], owner[order], a[order], b[order], ok[order]
    # Better revisions stand before; owners ascend, so the earliest time among them is a running minimum that starts anew.
    span = len(times) + 1
    low = np.minimum.accumulate(tick[revs] - owner * span) + owner * span
    until = np.concatenate(([span], low[:-1]))
    until[np.concatenate(([True], owner[1:] != owner[:-1]))] = span
    known = ok & (tick[revs] < until)
    revs, a, b, until = revs[known], a[known], b[known], until[known]

    days, day = np.unique(first[events], return_inverse=True)
    order = np.lexsort((day, shard[events]))
    events, leaf_key = events[order], (shard[events] * (len(days) + 1) + day)[order]
    own = shard[revs] * (len(days) + 1)
    lo = np.searchsorted(leaf_key, own + np.searchsorted(days, a, "left"), "left")
    hi = np.searchsorted(leaf_key, own + np.searchsorted(days, b, "right"), "left")
    leaf, when = np.arange(len(events)), tick[events]
    found_e, found_r, level, mine = [none], [none], 0, np.arange(len(revs))
    while True:
        some = lo < hi
        lo, hi, mine = lo[some], hi[some], mine[some]
        if not len(mine):
            break
        key = (leaf >> level) * span + when
        order = np.argsort(key)
        key = key[order]
        for node, odd in ((lo, lo & 1 == 1), (hi - 1, hi & 1 == 1)):
            m = mine[odd]
            begin = np.searchsorted(key, node[odd] * span + tick[revs[m]], "left")
            n = np.maximum(np.searchsorted(key, node[odd] * span + until[m], "left") - begin, 0)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found_e.append(events[order[np.repeat(begin, n) + within]])
            found_r.append(revs[np.repeat(m, n)])
        lo, hi, level = (lo + 1) >> 1, hi >> 1, level + 1
    return np.concatenate(found_e), np.concatenate(found_r)


def _merge(t: pa.Table) -> pa.RecordBatch:
    ints = lambda c: pc.fill_null(t.column(c).cast(pa.int64()), 0).to_numpy()
    code = t.column("version_id").combine_chunks().dictionary_encode().indices
    e, r = merge_shards(
        np.cumsum(_starts(t)), t.column("is_event").to_numpy(), ints("at"), ints("first"), ints("last"), t.column("last").is_valid().to_numpy(), pc.fill_null(code, 0).to_numpy(zero_copy_only=False).astype(np.int64), ints("revision_no")
    )
    out = pa.Table.from_arrays([t.column("event_id").take(pa.array(e)), t.column("version_id").take(pa.array(r)), t.column("revision_no").take(pa.array(r))], names=["event_id", "version_id", "revision_no"])
    return out.combine_chunks()


def _merge_batches(batches):
    held, rows, wanted = [], 0, BLOCK_ROWS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= wanted:
            t = pa.Table.from_batches(held).combine_chunks()
            at = int(np.flatnonzero(_starts(t))[-1])
            yield from _merge(t.slice(0, at)).to_batches()
            held = t.slice(at).to_batches()
            rows -= at
            wanted = max(BLOCK_ROWS, 2 * rows)
    if rows:
        yield from _merge(pa.Table.from_batches(held).combine_chunks()).to_batches()
