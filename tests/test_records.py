import random
from collections import Counter, defaultdict
from datetime import datetime as T, timedelta as D
from decimal import ROUND_HALF_UP, Decimal

from factloom.operators import conflicts, folds, integrity, versions
from factloom.operators.diffing import line_operations, overlapping_operations, text_differences
from factloom.operators.findings import collect_findings, finding, guided, report
from pyspark.sql import functions as F


def test_references_and_identifiers(spark):
    c = spark.createDataFrame([(1, "a"), (2, None), (3, "z"), (4, "a")], "id int, k string").withColumn("x", F.lit(1))
    p = spark.createDataFrame([("a",), ("a",), (None,)], "k string").withColumn("x", F.lit(2))
    assert sorted(r.id for r in integrity.dangling(c, p, ["k"]).collect()) == [2, 3]
    assert integrity.dangling(c, p.limit(0), ["k"]).count() == 4
    assert [(r.id, r.occurrence) for r in integrity.repeated_rows(c, ["k"], [F.col("id")]).collect()] == [(4, 2)]
    assert [tuple(r) for r in integrity.repeated_values(c, ["k"]).collect()] == [("a", 2)]
    assert sorted(map(tuple, integrity.copies(c, "k", "id").collect())) == [(1, 1, 2), (4, 1, 2)]
    assert sorted(r.id for r in integrity.outside_vocabulary(c, "k", ["a"]).collect()) == [2, 3]
    s = integrity.storage_summary(spark.createDataFrame([("h", 5), ("h", 5), ("g", 2)], "h string, n long"), "h", "n").first()
    assert tuple(s) == (12, 7, 2) and tuple(integrity.storage_summary(c.limit(0), "k", "id").first()) == (0, 0, 0)


def test_decimal_sums(spark):
    rnd = random.Random(1)
    rows = [[f"{rnd.randrange(-10**6, 10**6) / 10**k:.{k}f}" for k in (rnd.randrange(6) for _ in range(rnd.randrange(1, 9)))] for _ in range(60)] + [["0.005"], ["-0.005", "0.01"], []]
    bad = [["1", "x"], ["1", None], None, ["1e3"]]
    got = [r.y for r in spark.createDataFrame([(x,) for x in rows + bad], "a array<string>").select(integrity.running_decimal_sums(F.col("a")).alias("y")).collect()]
    for values, y in zip(rows, got):
        total, steps = Decimal(0), []
        for v in values:
            total += Decimal(v)
            steps.append(str(total.quantize(Decimal("0.01"), ROUND_HALF_UP)).replace("-0.00", "0.00"))
        assert list(y.steps) == steps and y.result == (steps[-1] if steps else "0.00")
    assert got[len(rows) :] == [None] * 4


def test_changes(spark):
    a = spark.createDataFrame([("k1", "1"), ("k2", None), ("k3", "3"), ("k4", None)], "k string, v string")
    b = spark.createDataFrame([("k1", "1"), ("k2", "2"), ("k5", None), ("k4", None)], "k string, v string")
    assert {tuple(r) for r in integrity.changed_keys(a, b, "k", "v").collect()} == {("k2", "changed"), ("k3", "removed"), ("k5", "added")}
    rows = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "x", "q"), ("a", 3, "y", None), ("b", 2, "x", "x")], "id string, n int, f string, g string")
    assert [r.changed for r in integrity.changed_fields(rows, ["id"], ["n"], ["g", "f"]).orderBy("id", "n").collect()] == ["", "g", "f,g", ""]
    t = T(2024, 1, 1)
    revs = spark.createDataFrame([("a", 1, t), ("a", 3, t), ("a", 4, t - D(1)), ("b", 2, t)], "id string, n int, t timestamp")
    assert {(r.id, r.n, r.code) for r in integrity.revision_breaks(revs, ["id"], "n", "t").collect()} == {("a", 3, "PREDECESSOR_MISSING"), ("a", 4, "TIME_DECREASES"), ("b", 2, "PREDECESSOR_MISSING")}


def test_sets(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "x"), ("c", None), ("c", "other")], "g string, v string")
    assert {tuple(r) for r in integrity.covers(rows, ["g"], "v", ["y", "x"]).collect()} == {("a", "", True), ("b", "y", False), ("c", "x,y", False)}
    assert {tuple(r) for r in integrity.strictest(rows, ["g"], "v", ["y", "x", "z"]).collect()} == {("a", "y"), ("b", "x"), ("c", "z")}


def test_conflicts_against_pairs(spark):
    rnd = random.Random(2)
    views = [(i, rnd.choice("gh"), rnd.choice(["1", "2", "3", None])) for i in range(80)] + [(99, "alone", "1")]
    df = spark.createDataFrame(views, "id int, g string, v string").withColumn("_v", F.lit("clash"))
    got = {r.id: r.conflicts for r in conflicts.value_conflicts(df, ["g"], "v").collect()}
    want = {i: n for i, g, v in views if (n := sum(h == g and w != v for _, h, w in views))}
    assert got == want
    pairs = {r.g: r.conflict_pairs for r in conflicts.conflict_classes(df, ["g"], "v").collect()}
    assert pairs == {g: sum(n for i, h, _ in views if h == g and (n := want.get(i))) // 2 for g in "gh"}


def test_timeline_against_pairs(spark):
    rnd = random.Random(3)
    roles = ["EMPLOYMENT_START", "EMPLOYMENT_END", "TERMINATION", "NONE", None]
    views = [(i, rnd.choice("gh"), rnd.choice(roles), T(2024, 1, rnd.randrange(1, 12)) if rnd.random() < 0.9 else None) for i in range(150)]
    df = spark.createDataFrame(views, "id int, g string, role string, at timestamp")
    got = {(r.id, r.code): r.conflicts for r in conflicts.timeline_conflicts(df, "g", "id", "role", "at").collect()}
    want = Counter()
    for i, g, r, t in views:
        for _, h, s, u in views:
            if g == h and t and u and u < t:
                for a, b, code in ((roles[0], roles[1], "TIMELINE_ORDER_CONFLICT"), (roles[2], roles[1], "TERMINATION_AFTER_END"), (roles[0], roles[2], "TERMINATION_BEFORE_START")):
                    want[i, code] += r == a and s == b
    assert got == {k: n for k, n in want.items() if n}


def test_version_graphs(spark):
    edges = [("g", "a", "b"), ("g", "b", "c"), ("h", "a", "b"), ("h", "b", "a"), ("h", "a", "b"), ("i", "x", "x"), ("i", None, "x"), ("j", "a", "zz")] + [("big", f"n{i}", f"n{i + 1}") for i in range(20)]
    e = spark.createDataFrame(edges, "graph string, source string, target string")
    n = spark.createDataFrame([(g, x) for g in "ghij" for x in "abcx"], "graph string, node string")
    assert {r.graph: r.circular for r in versions.graph_circles(e, max_edges=10).collect()} == {"g": False, "h": True, "i": True, "j": False, "big": None}
    found = {(r.graph, r.source, r.code[19:]) for r in versions.edge_findings(e.where("graph <> 'big'").dropna(), n).collect()}
    assert found == {("h", "a", "DUPLICATE_EDGE"), ("i", "x", "SELF_REFERENCE"), ("j", "a", "VERSION_UNKNOWN")}
    assert versions.graph_circles(e.limit(0)).count() == 0
    ev = spark.createDataFrame([("1", "d", 5), ("2", "d", 50), ("3", "d", None), ("4", "none", 5)], "event_id string, entity string, day long")
    vs = spark.createDataFrame([("d", "v1", (0, 9)), ("d", "v2", (5, 5)), ("d", "v3", None), ("d", "v4", (50, 4194303))], "entity string, version_id string, valid struct<first: long, last: long>")
    assert {tuple(r) for r in versions.versions_on(ev, vs).collect()} == {("1", 2, "MULTIPLE_CANDIDATES"), ("2", 1, "UNIQUE_CANDIDATE"), ("3", 0, "NO_CANDIDATE"), ("4", 0, "NO_CANDIDATE")}


def test_circles_of_graphs_too_large_to_gather(spark, monkeypatch):
    monkeypatch.setattr(versions, "MAX_EDGES", 10)
    chain = lambda g, n: [(g, f"{i:03d}", f"{i + 1:03d}") for i in range(n)]
    dense = [("dense", f"{i:02d}", f"{j:02d}") for i in range(12) for j in range(i)]
    edges = chain("line", 60) + chain("ring", 60) + [("ring", "060", "000")] + chain("tailed", 40) + [("tailed", "030", "020")] + chain("self", 40) + [("self", "030", "030")]
    edges += [("tree", f"{i // 3:03d}", f"{i:03d}") for i in range(1, 60)] + dense + [(g.replace("dense", "woven"), s, t) for g, s, t in dense] + [("woven", "03", "07"), ("few", "a", "b"), ("pair", "a", "b"), ("pair", "b", "a")]
    e = spark.createDataFrame(edges + edges[:50] + [("line", None, "000")], "graph string, source string, target string")
    got = {r.graph: (r.edges, r.circular) for r in versions.graph_circles(e).collect()}
    assert got["line"] == (60, False) and got["ring"] == (61, True)
    assert {g: c for g, (_, c) in got.items()} == {"line": False, "ring": True, "tailed": True, "self": True, "tree": False, "dense": False, "woven": True, "few": False, "pair": True}


def test_folds_against_plain_loops(spark):
    rnd = random.Random(4)
    asks = [(k, i, rnd.randrange(400) + i * 10) for i in range(200) for k in [rnd.randrange(4)]]
    want, last = {}, {}
    for k, i, t in asks:
        if k in last and t < last[k]:
            want[i] = "CLOCK_ROLLBACK"
        elif k in last and t - last[k] < 100:
            want[i] = "INTERVAL_NOT_ELAPSED"
        else:
            want[i], last[k] = "ACCEPTED", t
    df = spark.createDataFrame(asks + [(None, 999, 1), (1, 998, None)], "key long, request_id long, at_us long")
    assert {r.request_id: r.decision for r in folds.reservations(df, min_interval_us=100).collect()} == want
    assert set(want.values()) == {"ACCEPTED", "CLOCK_ROLLBACK", "INTERVAL_NOT_ELAPSED"} and folds.reservations(df.limit(0), min_interval_us=1).count() == 0

    runs = spark.createDataFrame([(1, 0, folds.UNCHANGED), (1, 24, None), (1, 48, None), (1, 72, folds.UNAVAILABLE), (1, 96, folds.CHANGED), (2, 0, None)], "key long, run_at long, technical string")
    states = folds.monitor_states(runs, interval=48, retry=24, window=3, budget=1)
    got = [(r.key, r.run_at, r.execution, r.next_due, r.failures, r.exhausted, r.last_checked) for r in states.orderBy("key", "run_at").collect()]
    assert got == [
        (1, 0, "CHECKED", 48, 0, False, 0),
        (1, 24, "CARRIED_FORWARD_NOT_DUE", 48, 0, False, 0),
        (1, 48, "MISSED_DUE_CHECK", 72, 1, False, 0),
        (1, 72, "CHECKED", 96, 2, True, 72),
        (1, 96, "CHECKED", 144, 2, True, 96),
        (2, 0, "MISSED_DUE_CHECK", 24, 1, False, None),
    ]
    raised = folds.alerts(states, urgency=F.when(F.col("key") == 1, "HIGH"))
    assert sorted((r.run_at, r.code[13:], r.severity) for r in raised.where("key = 1").collect()) == [
        (48, "CHECK_MISSED", "HIGH"), (72, "CHECK_UNAVAILABLE", "HIGH"), (72, "ERROR_BUDGET_EXHAUSTED", "HIGH"), (96, "CHANGE_DETECTED", "CRITICAL"), (96, "ERROR_BUDGET_EXHAUSTED", "HIGH")
    ]
    assert {r.run_at: r.overall[:4] for r in folds.overall(states).collect()} == {0: "WARN", 24: "HEAL", 48: "WARN", 72: "CRIT", 96: "CRIT"}
    rolled = folds.rolling_failures(spark.createDataFrame([(1, i, o) for i, o in enumerate(["MISSED", "SUCCESS", "UNAVAILABLE", "MISSED"])], "key int, run_at int, outcome string"), window=3, budget=1)
    assert [(r.failures, r.exhausted) for r in rolled.orderBy("run_at").collect()] == [(1, False), (1, False), (2, True), (2, True)]


def test_differences(spark):
    old, new = "a\nb\nc\r\n", "a\nx\ny\nc\r\nd"
    assert line_operations(old, new) == [("REPLACE", 1, 2, 1, 3, "b\n", "x\ny\n"), ("INSERT", 3, 3, 4, 5, "", "d")]
    rows = [("1", old, new), ("2", old, old), ("3", None, "z"), ("4", "x" * (1 << 20) + "y", "")]
    out = text_differences(spark.createDataFrame(rows, "diff_id string, old_text string, new_text string").withColumn("tag", F.lit("clash")))
    got = defaultdict(list)
    for r in out.orderBy("idx").collect():
        got[r.diff_id].append((r.idx, r.tag))
    assert got == {"1": [(0, "REPLACE"), (1, "INSERT")], "3": [(0, "INSERT")], "4": [(-1, "REFUSED")]}
    assert overlapping_operations(out).count() == 0
    twice = out.where("diff_id = '1' and idx = 0").unionByName(out.where("diff_id = '1' and idx = 0").withColumn("idx", F.lit(1)))
    assert [r.idx for r in overlapping_operations(twice).collect()] == [1]


def test_findings_and_report(spark):
    rows = spark.createDataFrame([("p", 1, None), ("p", 2, "x"), ("q", 1, "x"), ("r", 1, "y")], "pkg string, idx int, v string")
    path = F.format_string("$.v[%d]", F.col("idx"))
    found = collect_findings(
        finding(rows, F.col("v") == "x", record_id=F.col("pkg"), code="X", path=path, severity="P0"), finding(rows, F.col("v").isNull(), record_id=F.col("pkg"), code="NULL", path=path, message=F.lit("m"))
    )
    got = {r.record_id: (r.allowed, r.findings, r.p0_findings, r.codes) for r in report(found, rows.select(F.col("pkg").alias("record_id"))).collect()}
    assert got == {"p": (False, 2, 1, "NULL:1,X:1"), "q": (False, 1, 1, "X:1"), "r": (True, 0, 0, "")}
    told = guided(found, spark.createDataFrame([("X", "信息", "fix")], "code string, message_zh string, remediation string"), "默认", "look")
    assert {(r.code, r.message_zh, r.remediation) for r in told.collect()} == {("X", "信息", "fix"), ("NULL", "默认", "look")}


def test_bindings_and_allowlist(spark):
    b = spark.createDataFrame([("s", "v1", "1"), ("s", "v2", None), ("s", "v3", "3"), ("s", "v9", "1"), ("s", None, "1")], "s string, k string, x string")
    t = spark.createDataFrame([("v1", "1", "clash"), ("v2", None, "clash"), ("v3", "4", "clash")], "k string, x string, s string")
    assert {(r.k, r.code) for r in integrity.binding_breaks(b, t, ["k"], ["x"]).collect()} == {("v3", "BINDING_MISMATCH"), ("v9", "TARGET_MISSING"), (None, "TARGET_MISSING")}
    registry = spark.createDataFrame([("P", "a.test"), ("P", "a.test"), ("Q", "b.test")], "publisher string, host string")
    rows = spark.createDataFrame([(1, "P", "https://A.test/x"), (2, "P", "https://b.test/"), (3, "R", "https://a.test/"), (4, None, "https://a.test/"), (5, "Q", "http://b.test/"), (6, "Q", None)], "id int, p string, u string")
    got = {(r.id, r.code) for r in integrity.allowlist_findings(rows, registry, publisher="p", url="u").collect()}
    assert got == {(2, "TARGET_NOT_ALLOWLISTED"), (3, "PUBLISHER_NOT_REGISTERED"), (4, "PUBLISHER_NOT_REGISTERED"), (5, "TARGET_NOT_ALLOWLISTED"), (6, "TARGET_NOT_ALLOWLISTED")}
