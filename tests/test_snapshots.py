import random
from datetime import datetime as T, timedelta as D

import pytest
from factloom.operators.snapshots import snapshot_changes
from pyspark.sql import functions as F

S = "snap int, key string, h string, n long, at timestamp"


def run(df, **k):
    return {tuple(r) for r in snapshot_changes(df, snapshot="snap", key="key", values={"h": F.lower("h"), "n": F.col("n")}, delivered="at", **k).collect()}


def brute(rows):
    last = {}
    for s, k, h, n, at in rows:
        if s is not None and k is not None:
            v = (at is not None, at or 0, h is not None and h.lower() or "", n or 0)
            if (s, k) not in last or v > last[s, k][0]:
                last[s, k] = (v, (h and h.lower(), n))
    snaps = sorted({s for s, _ in last})
    out = set()
    for a, b in zip(snaps, snaps[1:]):
        old, new = ({k: v[1] for (s, k), v in last.items() if s == x} for x in (a, b))
        out |= {(b, k, "added") for k in new.keys() - old.keys()} | {(b, k, "removed") for k in old.keys() - new.keys()}
        out |= {(b, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    return out


@pytest.mark.parametrize("churn", [0.02, 0.9])
def test_against_brute_force_with_small_tables_that_must_grow(spark, churn):
    rnd, rows, state = random.Random(7), [], {f"k{i}": ("Ab", i) for i in range(300)}
    for s in (1, 2, 5):
        for k in list(state):
            if rnd.random() < churn:
                state[k] = rnd.choice([("aB", 1), (None, 1), ("x", None), (None, None), ("x", rnd.randrange(9))])
            if rnd.random() < churn / 3:
                del state[k]
        state[f"new{s}"] = ("n", s)
        for i, (k, (h, n)) in enumerate(state.items()):
            rows.append((s, k, h, n, T(2024, 1, 2) + D(seconds=i)))
            if i % 7 == 0:
                rows += [(s, k, "old", 0, T(2024, 1, 1)), rows[-1]]
    rows += [(None, "z", "h", 1, T(2024, 1, 1)), (3, None, "h", 1, T(2024, 1, 1))]
    df = spark.createDataFrame(rows, S).withColumn("bucket", F.lit("clash"))
    assert run(df, bucket_rows=64, changed_share=0.01) == brute(rows)


def test_empty_and_single(spark):
    assert run(spark.createDataFrame([], S)) == set()
    assert run(spark.createDataFrame([(1, "a", "h", 1, T(2024, 1, 1))], S)) == set()
