import random
from datetime import datetime as T, timedelta as D

from factloom.functions.ids import OPEN_DAY, closed_interval
from factloom.operators.asof import SLOT, _slots, known_versions
from factloom.operators.intervals import merged_periods, periods_and_gaps
from pyspark.sql import functions as F

I = "entity string, first long, last long"


def brute(rows):
    by = {}
    for e, a, b in rows:
        if e is not None and a is not None and b is not None and a <= b:
            by.setdefault(e, []).append((a, b + 1))
    out = set()
    for e, spans in by.items():
        runs = []
        for a, b in sorted(spans):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        out |= {(e, a, b) for a, b in runs}
    return out


def test_periods_against_brute_force(spark):
    rnd, rows = random.Random(3), []
    for e in "abcd":
        for _ in range(60):
            a = rnd.choice([rnd.randrange(3000), rnd.randrange(OPEN_DAY)])
            rows.append((e, a, min(OPEN_DAY, a + rnd.choice([0, 0, 1, 5, 300, 9000, -1]))))
    rows += [("hot", a, a) for a in range(0, 9000, 2)] + [("hot", a, a) for a in range(1, 4000, 2)]
    rows += [("e", 5, OPEN_DAY), ("e", 0, 4), ("f", 0, OPEN_DAY), ("g", 7, 7), ("g", 7, 7), (None, 1, 2), ("h", None, 2), ("h", 1, None)]
    df = spark.createDataFrame(rows, I).withColumn("block", F.lit("clash"))
    assert {tuple(r) for r in merged_periods(df).collect()} == brute(rows)
    spans = [tuple(r) for r in periods_and_gaps(df).where("entity = 'hot' and end < 4010").collect()]
    assert ("hot", "period", 4002, 4003) in spans and ("hot", "gap", 4001, 4002) in spans
    assert merged_periods(spark.createDataFrame([], I)).count() == 0


def test_dates(spark):
    rows = [("2024-02-29", None), ("2023-02-29", None), ("2024-2-3", None), (None, "2024-01-01"), ("2024-01-02", "2024-01-01"), ("2024-01-01\n", None), ("0001-01-01", "9999-12-31"), ("20240101", "x"), ("0000-01-01", None)]
    got = [r.i and tuple(r.i) for r in spark.createDataFrame(rows, "a string, b string").select(closed_interval(F.col("a"), F.col("b")).alias("i")).collect()]
    assert got == [(738944, OPEN_DAY), None, None, None, None, None, (0, 3652058), None, None]


def _slots_of(events, revisions, shard_rows):
    rows = events.select("entity", "at", F.lit(None).cast("string").alias("version_id")).unionByName(revisions.select("entity", F.col("recorded").alias("at"), "version_id"))
    rows = rows.dropna(subset=["entity", "at"]).withColumn("at", F.unix_micros("at"))
    return _slots(rows.withColumn("slot", F.shiftright("at", SLOT)), shard_rows, 10**6)


def test_a_hot_entity_is_cut_into_shards_without_limit(spark):
    rows = spark.range(10_000_000).select(F.lit("hot").alias("entity"), F.timestamp_micros(F.when(F.col("id") % 3 == 0, 10**15 + F.col("id") * 7).otherwise(F.col("id") * 10**7)).alias("at"), F.lit(None).cast("string").alias("version_id"))
    counted = rows.withColumn("at", F.unix_micros("at")).withColumn("slot", F.shiftright("at", SLOT))
    slots = _slots(counted, 20_000, 10**6)
    tick = F.shiftright("at", 20).bitwiseAND(4095)
    big = slots.where("tick >= 0").select("slot", F.lit(True).alias("big")).distinct()
    sizes = counted.join(big, "slot", "left").withColumn("tick", F.when(F.col("big"), tick).otherwise(-1)).join(slots, ["entity", "slot", "tick"]).groupBy("shard", "salts").agg(F.count("*").alias("n"), F.max("shards").alias("k")).collect()
    assert sum(r.n for r in sizes) == 10_000_000 and len(sizes) == sizes[0].k > 500
    assert all(r.n <= 20_000 * r.salts for r in sizes)


def test_known_versions_hot_and_cold_agree_with_brute_force(spark):
    rnd = random.Random(5)
    t0 = T(2020, 1, 1)
    revs, events = [], []
    for e, n in (("hot", 150), ("cold", 12)):
        for _ in range(n):
            a = rnd.randrange(1000)
            valid = rnd.choice([None, (a, a + rnd.randrange(400)), (a, a + 50), (a, OPEN_DAY)])
            revs.append((e, f"{e}{rnd.randrange(n // 4)}", rnd.randrange(4), valid, t0 + D(hours=rnd.randrange(300))))
        events += [(f"{e}-{i}", e, rnd.randrange(1400), t0 + D(hours=rnd.randrange(320))) for i in range(n)]
    events += [("x", "none", 5, t0), ("y", "hot", None, t0), ("z", "hot", 5, None), (None, "hot", 5, t0), events[0]]
    revs += [revs[0], (None, "v", 1, (0, 9), t0), ("hot", None, 1, (0, 9), t0), ("hot", "v", None, (0, 9), t0)]
    want = set()
    for i, e, day, at in events:
        best = {}
        for f, v, no, valid, rec in revs:
            if None in (i, e, day, at, v, no) or f != e or rec > at:
                continue
            k = (no, rec, valid is not None, valid or ())
            if v not in best or k > best[v]:
                best[v] = k
        want |= {(i, v, k[0]) for v, k in best.items() if k[2] and k[3][0] <= day <= k[3][1]}
    E = spark.createDataFrame(events, "event_id string, entity string, day long, at timestamp").withColumn("valid", F.lit("clash"))
    R = spark.createDataFrame(revs, "entity string, version_id string, revision_no int, valid struct<first: long, last: long>, recorded timestamp").withColumn("at", F.lit("clash"))
    for rows, lanes in ((1, 10**6), (20, 10**6), (32, 7), (10**6, 10**6), (None, 50_000)):
        got = known_versions(E, R, shard_rows=rows, lane_versions=lanes).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    # All rows in one tick: its events are dealt over salts.
    burst = [(e, v, no, valid, t0 + D(microseconds=i)) for i, (e, v, no, valid, _) in enumerate(revs)]
    asked = [(i, e, day, t0 + D(seconds=0.5)) for i, e, day, at in events]
    B, Q = spark.createDataFrame(burst, R.drop("at").schema), spark.createDataFrame(asked, E.drop("valid").schema)
    assert {tuple(r) for r in known_versions(Q, B, shard_rows=4, lane_versions=5).collect()} == {tuple(r) for r in known_versions(Q, B, shard_rows=10**6).collect()}
    placed = _slots_of(Q, B, 20)
    assert placed.where("salts > 1").count() > 0
    assert known_versions(E.limit(0), R).count() == 0
