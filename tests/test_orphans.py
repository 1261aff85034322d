from datetime import datetime as T

from factloom.functions.ids import normal_id
from factloom.operators.orphans import orphan_references, orphans_by_period
from pyspark.sql import functions as F

C = "ref_field string, record_id string, target string, scope string, key string, at timestamp"
P = "target string, scope string, key string, at timestamp, until timestamp"


def t(day):
    return T(2024, 1, day)


def test_kinds_nulls_ties_and_repeats(spark):
    children = spark.createDataFrame(
        [
            ("f.e", "F1", "e", "p", "A", t(5)),
            ("f.e", "F1", "e", "p", "A", t(5)),
            ("f.e", "F1", "e", "p", "GONE", t(5)),
            ("f.e", "F1", "e", "p", "LATE", t(5)),
            ("f.e", "F2", "e", "p", "DEL", t(5)),
            ("f.e", "F3", "e", "p", "DEL", t(4)),
            ("f.e", "F4", "e", "q", "A", t(5)),
            ("f.e", "F5", "e", None, "A", t(5)),
            ("f.e", "F6", "e", "p", None, t(5)),
            ("f.e", "F7", "e", "p", "LATE", None),
            ("f.e", "F8", "e", "p", "BOTH", t(5)),
            ("f.e", "F9", "x", "p", "A", t(5)),
        ],
        C,
    ).withColumn("until", F.lit("clash"))
    parents = spark.createDataFrame(
        [
            ("e", "p", "A", t(5), None),
            ("e", "p", "A", t(9), None),
            ("e", "p", "LATE", t(6), None),
            ("e", "p", "DEL", t(1), None),
            ("e", "p", "DEL", t(2), t(5)),
            ("e", "p", "BOTH", t(7), t(3)),
            ("e", None, "A", t(1), None),
            ("e", "p", "UNUSED", t(1), None),
        ],
        P,
    ).withColumn("record_id", F.lit("clash"))
    out = orphan_references(children, parents)
    got = sorted((r.record_id, r.key, r.orphan_kind) for r in out.collect())
    assert got == sorted(
        [("F1", "GONE", "missing"), ("F1", "LATE", "late"), ("F2", "DEL", "deleted"), ("F4", "A", "missing"), ("F5", "A", "missing"), ("F8", "BOTH", "late"), ("F8", "BOTH", "deleted"), ("F9", "A", "missing")]
    )
    counts = {(r.period, r.orphan_kind): r.orphans for r in orphans_by_period(out).collect()}
    assert counts == {("2024-01", "missing"): 4, ("2024-01", "late"): 2, ("2024-01", "deleted"): 2}


def test_empty(spark):
    assert orphan_references(spark.createDataFrame([], C), spark.createDataFrame([], P)).count() == 0


def test_ids_lose_white_space_of_any_sort(spark):
    odd = ["　rule-1 ", "\tRULE-1\n", " rule-1\x1c", " 　", "", None]
    got = [r.x for r in spark.createDataFrame([(x,) for x in odd], "a string").select(normal_id(F.col("a")).alias("x")).collect()]
    assert got == ["RULE-1", "RULE-1", "RULE-1", None, None, None]
