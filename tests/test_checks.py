import json
import random

import pytest
from factloom.functions.canonical import canonical, nesting, snapshot_id, strict_value, text_snapshot
from factloom.functions.schema import schema_findings
from factloom.operators import conflicts, folds, integrity, versions
from factloom.operators.diffing import unified_diffs
from factloom.sources import manifest as M
from pyspark.sql import functions as F


def test_text_snapshots_are_those_of_the_canonical_form(spark):
    import hashlib

    values = ["", "a", "\"q\" \\ /", "\\u001F", "\\\\u001F", "".join(map(chr, range(32))), "\x7f\u2028é漢😀", "\x1f\\\x0b", None]
    rows = spark.createDataFrame([(i, v, "k") for i, v in enumerate(values)], "i int, v string, w string")
    got = {r.i: r.h for r in rows.select("i", text_snapshot(zeta=F.col("v"), alpha=F.col("w")).alias("h")).collect()}
    assert got == {i: hashlib.sha256(canonical({"zeta": v, "alpha": "k"}).encode()).hexdigest() for i, v in enumerate(values)}
    assert snapshot_id("X", {"zeta": "", "alpha": "k"}) == "X-" + got[0][:24].upper()


def test_nesting_against_a_walk():
    rnd = random.Random(1)

    def walk(text):
        depth = most = 0
        quoted = skip = False
        for ch in text:
            if quoted:
                skip, quoted = (not skip and ch == "\\"), not (ch == '"' and not skip)
            elif ch == '"':
                quoted, skip = True, False
            elif ch in "[{":
                depth += 1
                most = max(most, depth)
            elif ch in "]}":
                depth = max(0, depth - 1)
        return most

    for _ in range(3000):
        text = "".join(rnd.choice('[]{}"\\a\n') for _ in range(rnd.randrange(14)))
        assert nesting(text) == walk(text), text
    assert nesting('"' + "\\\"[" * 200_000) == 0 and nesting("[" * 1000) == 1000


def test_strict_values_and_schema(spark):
    assert [strict_value(t)[1] for t in ("1", "{", '{"a":1,"a":2}', "[NaN]", None, "[" * 101)] == [None, "INVALID_JSON", "DUPLICATE_KEY", "INVALID_CONSTANT", "UNREADABLE", "TOO_DEEPLY_NESTED"]
    rows = spark.createDataFrame([("a", '{"k":1,"k":2}'), ("b", '{"k":NaN}'), ("c", '{"k":1}'), ("d", None)], "record_id string, text string")
    found = schema_findings(rows, {"type": "object", "properties": {"k": {"type": "integer"}}}).collect()
    assert {(r.record_id, r.path, r.keyword) for r in found} == {("a", "$", "json"), ("b", "$", "json"), ("d", "$", "json")}


def test_unified_diffs(spark):
    rows = [(1, "a", "x\ny\n", "b", "x\nz\n"), (2, None, None, None, ""), (3, "a", "q" * (1 << 20) + "q", "b", "")]
    got = {r.diff_id: r.unified_diff for r in unified_diffs(spark.createDataFrame(rows, "diff_id int, old_name string, old_text string, new_name string, new_text string")).collect()}
    assert got == {"1": "--- a\n+++ b\n@@ -1,2 +1,2 @@\n x\n-y\n+z\n", "2": "", "3": None}


def test_relationships_of_files(spark):
    rows = [("r1", "c1", "f1"), ("r2", "c1", "f2"), ("r3", "c2", "f1"), ("r4", None, None), ("r5", None, None)]
    df = spark.createDataFrame(rows, "raw_id string, content_sha256 string, filesystem_identity_sha256 string")
    got = {(r.relationship_type, r.identity_sha256, r.raw_id) for r in M.relationships(df).collect()}
    assert got == {("DUPLICATE_CONTENT", "c1", "r1"), ("DUPLICATE_CONTENT", "c1", "r2"), ("HARDLINK_CANDIDATE", "f1", "r1"), ("HARDLINK_CANDIDATE", "f1", "r3")}
    assert M.relationships(df.limit(0)).count() == 0
    kinds = spark.createDataFrame([(".gif", "image/png"), (".docx", "text/plain"), (".TXT", "text/plain"), (None, "x"), (".gz", None)], "e string, m string")
    assert [r.x for r in kinds.select(M.extension_mismatch(F.col("e"), F.col("m")).alias("x")).collect()] == [True, False, False, False, False]


def test_combinations_predecessors_and_limits(spark):
    rows = spark.createDataFrame([("A", "x"), ("A", None), (None, "x"), ("B", "y"), ("B", "x")], "p string, q string")
    assert {tuple(r) for r in integrity.outside_combinations(rows, ["p", "q"], [("A", "x"), ("B", "y"), ("A", None)]).collect()} == {(None, "x"), ("B", "x")}
    chain = spark.createDataFrame([("k", 1, "a", None), ("k", 2, "b", "a"), ("k", 3, "c", "a"), ("m", 1, "z", "y")], "k string, n int, own string, declared string")
    assert {(r.k, r.n) for r in integrity.predecessor_breaks(chain, ["k"], "n", ["own"], ["declared"]).collect()} == {("k", 3), ("m", 1)}
    views = spark.range(300).select(F.lit("g").alias("g"), (F.col("id") % 2).alias("v"))
    classes = conflicts.conflict_classes(views, ["g"], "v")
    assert [tuple(r) for r in conflicts.conflict_refusal(classes).collect()] == [("FACT_ANALYSIS_CONFLICT_LIMIT_EXCEEDED", 22_500)]
    assert conflicts.conflict_refusal(classes, most=22_500).count() == 0 and conflicts.conflict_refusal(classes.limit(0)).count() == 0


def test_lists_keys_and_first_violations(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", None), ("z", 2)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("y", None), ("w", 3)], "k string, v int")
    assert {tuple(r) for r in integrity.list_differences(a, b).collect()} == {("x", 1, "ONLY_DECLARED", 1), ("z", 2, "ONLY_DECLARED", 1), ("w", 3, "ONLY_DERIVED", 1)}
    assert integrity.list_differences(a.limit(0), b.limit(0)).count() == 0
    found = integrity.first_violation(a, [("ONE", F.col("v") == 1), ("NOT_Y", F.col("k") != "y")])
    assert sorted((r.k, r.code) for r in found.collect()) == [("x", "ONE"), ("x", "ONE"), ("z", "NOT_Y")]
    errors = integrity.key_errors(a, b.where("k != 'y'"), "k", [], unknown="U", duplicate="D")
    assert {tuple(r) for r in errors.collect()} == {("x", "D"), ("y", "U"), ("z", "U")}


def test_sets_chains_and_unresolved(spark):
    a = spark.createDataFrame([("g", 1), ("g", 1), ("g", None), ("h", 2)], "g string, v int")
    b = spark.createDataFrame([("g", 1), ("h", 3), ("i", 4)], "g string, v int")
    assert {tuple(r) for r in integrity.compared_sets(a, b, ["g"], "v").collect()} == {("g", 1, 0, 0, True), ("h", 0, 1, 1, False), ("i", 0, 0, 1, False)}
    assert {tuple(r) for r in integrity.unresolved(a, ["g"], "v", [1]).collect()} == {("g", True), ("h", True)}
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "i int, k string")
    first = spark.createDataFrame([("x", 10), ("y", 20)], "k string, n int")
    second = spark.createDataFrame([(10,)], "n int")
    assert {(r.i, r.code) for r in integrity.chain_breaks(rows, [("A", first, ["k"]), ("B", second, ["n"])]).collect()} == {(2, "B"), (3, "A"), (4, "A")}
    assert integrity.chain_breaks(rows.limit(0), [("A", first, ["k"])]).count() == 0


def test_freeze_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("b", 2, "x"), (None, 3, "y")], "fetch_id string, n int, t string")
    for _ in range(2):
        M.freeze(rows, str(tmp_path / "s"))
    M.freeze(spark.createDataFrame([("c", 4, None), ("b", 9, "z")], rows.schema), str(tmp_path / "s"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "s")).collect())) == [("a", 1, None), ("b", 2, "x"), ("c", 4, None)]


def test_purposes(spark):
    registry = spark.createDataFrame([("P", "h.test", ["RULE"])], "publisher string, host string, permitted_purposes array<string>")
    rows = spark.createDataFrame([(1, "P", "https://h.test/a", "RULE"), (2, "P", "https://h.test/a", "CASE"), (3, "Q", "https://h.test", "RULE"), (4, "P", "https://x.test", "RULE"), (5, "P", None, None)], "i int, publisher string, url string, purpose string")
    got = {r.i: r.code for r in integrity.allowlist_findings(rows, registry, publisher="publisher", url="url", purpose="purpose").collect()}
    assert got == {2: "PURPOSE_NOT_PERMITTED", 3: "PUBLISHER_NOT_REGISTERED", 4: "TARGET_NOT_ALLOWLISTED", 5: "PURPOSE_NOT_PERMITTED"}


@pytest.mark.parametrize("closes", [True, False])
def test_only_some_kinds_of_edges_must_close_no_circle(spark, closes):
    n = 1500
    edges = [("g", f"n{i}", f"n{i + 1}", "AMENDS") for i in range(n)] + [("g", f"n{n}", "n0", "REPEALS" if closes else "CONFLICTS_WITH"), ("h", "a", "a", "CONFLICTS_WITH")]
    df = spark.createDataFrame(edges, "graph string, source string, target string, kind string")
    got = {r.graph: (r.edges, r.circular) for r in versions.graph_circles(df, kinds=versions.ACYCLIC).collect()}
    assert got == {"g": (n + closes, closes), "h": (0, False)}


def test_rules_by_source(spark):
    runs = spark.createDataFrame([(k, t, None if t else folds.UNCHANGED) for k in (1, 2, 3) for t in (0, 24, 48, 72)], "key long, run_at long, technical string")
    rules = spark.createDataFrame([(1, 24, 24, 2, 1), (2, 72, None, 5, 0)], "key long, interval int, retry int, window int, budget int")
    got = {(r.key, r.run_at): (r.execution[:7], r.failures, r.exhausted) for r in folds.monitor_states(runs, rules, interval=48, retry=24, window=7, budget=3).collect()}
    assert [got[1, t] for t in (24, 48, 72)] == [("MISSED_", 1, False), ("MISSED_", 2, True), ("MISSED_", 2, True)]
    assert [got[2, t] for t in (24, 48, 72)] == [("CARRIED", 0, False), ("CARRIED", 0, False), ("MISSED_", 1, True)]
    assert [got[3, t][0] for t in (24, 48, 72)] == ["CARRIED", "MISSED_", "MISSED_"]
    assert json.dumps(sorted({r.run_at: r.overall for r in folds.overall(folds.monitor_states(runs, rules, interval=48, retry=24, window=7, budget=3)).collect()}.items()))
