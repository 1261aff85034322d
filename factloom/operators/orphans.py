"""References whose target is missing, came later, or was deleted before."""

from pyspark.sql import DataFrame, functions as F

KEY = ("target", "scope", "key")


def orphan_references(children: DataFrame, parents: DataFrame) -> DataFrame:
    """One row per reference that had no target when it was made.

    children(ref_field, record_id, target, scope, key, at): one row per reference; ``at`` is the referring record's time.
    parents(target, scope, key, at, until): rows of the records that may be named; several rows of a key are one record
    that begins with its earliest ``at`` and ends with its earliest ``until``.

    Result: ref_field, record_id, key, at, orphan_kind, distinct. ``missing``: no such target in the scope; ``late``: the
    target begins after ``at``; ``deleted``: the target ends at or before ``at``. A reference can be late and deleted.
    Null times compare as unknown and make neither. A null scope holds no targets. Rows with a null key are no references.

    Parent and child keys are united in long form and grouped once with map-side partial sums, so a key named by a third
    of all rows costs one summary row per map task. Only groups with an orphan go on to the join with the references,
    which streams; adaptive execution splits a skewed key there.
    """
    refs = children.where(F.col("key").isNotNull()).select("ref_field", "record_id", *KEY, "at")
    long = refs.select(*KEY, F.lit(False).alias("is_parent"), "at", F.lit(None).cast("timestamp").alias("until")).unionByName(
        parents.where(F.col("key").isNotNull() & F.col("scope").isNotNull()).select(*KEY, F.lit(True).alias("is_parent"), "at", F.col("until").cast("timestamp").alias("until"))
    )
    child_at = F.when(~F.col("is_parent"), F.col("at"))
    groups = long.groupBy(*KEY).agg(
        F.max("is_parent").alias("found"),
        F.min("is_parent").alias("only_parent"),
        F.min(F.when(F.col("is_parent"), F.col("at"))).alias("begins"),
        F.min("until").alias("ends"),
        F.min(child_at).alias("first_use"),
        F.max(child_at).alias("last_use"),
    )
    suspect = groups.where(
        ~F.col("only_parent") & (~F.col("found") | F.coalesce(F.col("begins") > F.col("first_use"), F.lit(False)) | F.coalesce(F.col("ends") <= F.col("last_use"), F.lit(False)))
    ).select(*KEY, "found", "begins", "ends")
    r, s = refs.alias("r"), suspect.alias("s")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in KEY]
    kinds = F.array_compact(
        F.array(
            F.when(~F.col("s.found"), "missing"),
            F.when(F.col("s.begins") > F.col("r.at"), "late"),
            F.when(F.col("s.ends") <= F.col("r.at"), "deleted"),
        )
    )
    found = r.join(s, same[0] & same[1] & same[2]).select("r.ref_field", "r.record_id", "r.key", "r.at", F.explode(kinds).alias("orphan_kind"))
    # Orphans are few beside references, so repeated ones go here rather than before the shuffles.
    return found.distinct()


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Orphans counted per referring field, month of the referring record (UTC; '' without a time) and kind."""
    utc = F.to_utc_timestamp("at", F.current_timezone())
    period = F.coalesce(F.date_format(utc, "yyyy-MM"), F.lit("")).alias("period")
    return orphans.groupBy("ref_field", period, "orphan_kind").agg(F.count(F.lit(1)).alias("orphans"))
