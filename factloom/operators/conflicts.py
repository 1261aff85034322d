"""Conflicts between structured views, without listing the pairs of a group.

A conflict is a pair of views. For each view the number of its conflicting partners is what any of these operators gives;
their sum over views of one side is the number of pairs. Groups of equal values stand as classes, so a dimension with n
views costs n rows, not n squared.
"""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W


def value_conflicts(views: DataFrame, group: list[str], value: str) -> DataFrame:
    """Views with ``conflicts``: how many views of the same group have another value. Null is a value like any other.
    Only views with a conflict are given. Two aggregations with map-side sums and a join back; no group in one task."""
    classes = views.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_same"))
    totals = classes.groupBy(*group).agg(F.sum("_same").alias("_all"), F.count(F.lit(1)).alias("_values")).where(F.col("_values") > 1)
    both = classes.join(totals, group).select(*group, F.col(value).alias("_v"), (F.col("_all") - F.col("_same")).alias("conflicts"))
    v, b = views.alias("v"), both.alias("b")
    on = F.col(f"v.{value}").eqNullSafe(F.col("b._v"))
    for g in group:
        on = on & (F.col(f"v.{g}") == F.col(f"b.{g}"))
    return v.join(b, on).select("v.*", "b.conflicts")


def conflict_classes(views: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, distinct_values, n_views, conflict_pairs) of every group with more than one value."""
    classes = views.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    totals = classes.groupBy(*group).agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("n_views"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return totals.where(F.col("distinct_values") > 1).select(*group, "distinct_values", "n_views", F.expr("(n_views * n_views - squares) div 2").alias("conflict_pairs"))


def conflict_refusal(classes: DataFrame, *, most: int = 10_000) -> DataFrame:
    """(code, conflicts): one row where the pairs of ``conflict_classes`` are more than ``most`` together; the whole analysis is then
    refused, none of its conflicts dropped."""
    total = classes.agg(F.coalesce(F.sum("conflict_pairs"), F.lit(0)).alias("conflicts"))
    return total.where(F.col("conflicts") > most).select(F.lit("FACT_ANALYSIS_CONFLICT_LIMIT_EXCEEDED").alias("code"), "conflicts")


def order_conflicts(left: DataFrame, right: DataFrame, group: str, left_id: str, at: str) -> DataFrame:
    """(group, left_id, at, conflicts): for each left view the number of right views of its group that lie before it.

    Every left with every right of which it is the later: counted by running totals in order of the timestamp ``at`` rather
    than joined. Equal times are no conflict; rows without a group or time make none. Totals run within a day, and over the
    days of a group, so a group with a third of all rows is sorted in as many tasks as it has days.
    """
    marks = right.where(F.col(at).isNotNull()).groupBy(group, at).agg(F.count(F.lit(1)).alias("_n")).select(group, F.col(at).alias("_at"), F.lit(None).alias("_id"), "_n", F.lit(1).alias("_late"))
    asks = left.where(F.col(at).isNotNull()).select(group, F.col(at).alias("_at"), F.col(left_id).alias("_id"), F.lit(0).cast("long").alias("_n"), F.lit(0).alias("_late"))
    rows = asks.unionByName(marks).where(F.col(group).isNotNull()).withColumn("_day", F.to_date("_at"))
    days = rows.groupBy(group, "_day").agg(F.sum("_n").alias("_of_day"))
    before = F.sum("_of_day").over(W.partitionBy(group).orderBy("_day").rowsBetween(W.unboundedPreceding, -1))
    days = days.select(group, "_day", F.coalesce(before, F.lit(0)).alias("_before"))
    # At one time the asking views come first: what happens at the same time is not before.
    w = W.partitionBy(group, "_day").orderBy("_at", "_late").rowsBetween(W.unboundedPreceding, 0)
    counted = rows.withColumn("_within", F.sum("_n").over(w)).where(F.col("_late") == 0).join(days, [group, "_day"])
    counted = counted.withColumn("conflicts", F.col("_within") + F.col("_before")).where(F.col("conflicts") > 0)
    return counted.select(group, F.col("_id").alias(left_id), F.col("_at").alias(at), "conflicts")


def timeline_conflicts(views: DataFrame, group: str, view_id: str, role: str, at: str) -> DataFrame:
    """(group, view_id, code, conflicts) of views whose timeline role contradicts others of the group: a start after ends,
    a termination before starts or after ends."""
    starts, ends, terminations = (views.where(F.col(role) == r) for r in ("EMPLOYMENT_START", "EMPLOYMENT_END", "TERMINATION"))

    def named(df: DataFrame, code: str) -> DataFrame:
        return df.select(group, view_id, F.lit(code).alias("code"), "conflicts")

    return (
        named(order_conflicts(starts, ends, group, view_id, at), "TIMELINE_ORDER_CONFLICT")
        .unionByName(named(order_conflicts(terminations, ends, group, view_id, at), "TERMINATION_AFTER_END"))
        .unionByName(named(order_conflicts(starts, terminations, group, view_id, at), "TERMINATION_BEFORE_START"))
    )
