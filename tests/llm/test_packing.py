import random
from collections import defaultdict

import numpy as np
from factloom.llm.packing import fill, pack, sum_of_squares
from factloom.llm.tokens import token_counts


def test_rule_against_brute_force():
    rnd = random.Random(1)
    sizes = [rnd.randrange(1, 20) for _ in range(200)]
    bins, room = sum_of_squares(np.array(sizes), 20)
    used = defaultdict(int)
    rooms: list[int] = []
    where = {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s, best = sizes[i], None

        def cost(r):
            n = defaultdict(int)
            for x in r:
                n[x] += 1
            return sum(c * c for g, c in n.items() if g)

        options = [(cost(rooms[:b] + [rooms[b] - s] + rooms[b + 1 :]), g, b) for g in sorted(set(rooms)) if g >= s for b in [rooms.index(g)]]
        options.append((cost(rooms + [20 - s]), 99, len(rooms)))
        _, _, b = min(options)
        if b == len(rooms):
            rooms.append(20)
        rooms[b] -= s
        where[i] = b
    assert sorted(rooms) == sorted(room.tolist())
    for i, b in enumerate(bins):
        used[b] += sizes[i]
    assert all(used[b] + room[b] == 20 for b in used)


def test_whole_and_within_capacity_in_many_shards(spark):
    rnd = random.Random(4)
    sizes = {i: rnd.choice([rnd.randrange(1, 400), rnd.randrange(1, 90)]) for i in range(3000)} | {3000: 0, 3001: 100, 3002: 1050, 3003: 200}
    df = spark.createDataFrame([*sizes.items(), (4000, None)], "doc_id long, n_tokens long").selectExpr("*", "'x' AS part", "1 AS size")
    for shard in (200, 10**6):
        out = pack(df, capacity=100, shard_items=shard)
        rows = out.collect()
        parts, load = defaultdict(list), defaultdict(int)
        for r in rows:
            parts[r.doc_id].append((r.part, r.token_from, r.token_to))
            load[r.container_id] += r.token_to - r.token_from
        assert max(load.values()) <= 100
        for d, n in sizes.items():
            want = [(k, 100 * k, min(100 * k + 100, n)) for k in range(-(-n // 100))]
            assert sorted(parts[d]) == want
        assert fill(out, capacity=100).first().unused_share < 0.03
        assert sorted(map(tuple, rows)) == sorted(map(tuple, pack(df.repartition(5), capacity=100, shard_items=shard).collect()))
    assert pack(df.limit(0)).count() == 0 and fill(pack(df.limit(0))).first().containers == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "劳动" * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert got[1] == 3 and got[2] == got[3] == 0 and got[4] > 10_000


def test_copies_and_null_ids_have_containers_of_their_own(spark):
    df = spark.createDataFrame([(1, 200), (1, 200), (1, 100), (None, 100), (None, 130)], "doc_id long, n_tokens long")
    rows = pack(df, capacity=100).collect()
    load = defaultdict(int)
    for r in rows:
        load[r.container_id] += r.token_to - r.token_from
    assert None not in load and sorted(load.values()) == [30] + [100] * 7
    assert len({r.container_id for r in rows if r.doc_id == 1}) == 5 and all(r.container_id.startswith("f1.") for r in rows if r.doc_id == 1)
    assert sum(r.doc_id is None for r in rows) == 3
    big = [(None, 30)] + [(2**60 + i, 30 + i % 50) for i in range(50)] + [(7, 40)] * 200
    rows = pack(spark.createDataFrame(big, df.schema), capacity=100, shard_items=60).collect()
    assert sorted(((r.doc_id, r.token_to) for r in rows), key=repr) == sorted(big, key=repr)
    load = defaultdict(int)
    for r in rows:
        load[r.container_id] += r.token_to
    assert max(load.values()) <= 100
