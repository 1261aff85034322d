"""Integrity rules over record collections: identifiers, references, sets, and recomputed decimals."""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W


def dangling(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children whose key is in no parent; null keys dangle. A left anti join on the distinct parent keys."""
    return children.join(parents.select(*keys).distinct(), keys, "left_anti")


def repeated_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The second and later rows of each key in the given order; rows with a null key are no repetition."""
    known = rows.where(~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)))
    return known.withColumn("occurrence", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("occurrence") > 1)


def repeated_values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each key that occurs more than once, with its count."""
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)


def copies(rows: DataFrame, identity: str, member: str) -> DataFrame:
    """(member, class_id, copies) for members of classes of equal identity with more than one member; the class is named by
    its least member. A class's members stay rows, so a class of any size is never one value."""
    classes = rows.groupBy(identity).agg(F.min(member).alias("class_id"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    return rows.join(classes, identity).select(member, "class_id", "copies")


def storage_summary(rows: DataFrame, identity: str, size: str) -> DataFrame:
    """Logical bytes of all rows, stored bytes and number of distinct contents."""
    per = rows.groupBy(identity).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("size"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(total(F.col("n") * F.col("size")).alias("logical_bytes"), total(F.col("size")).alias("stored_bytes"), F.count(F.lit(1)).alias("unique_objects"))


def outside_vocabulary(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is not one of those allowed; null is not allowed."""
    return rows.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))


def running_decimal_sums(inputs: Column) -> Column:
    """struct(result, steps): running totals of an array of decimal texts, each rounded half up to two places from the
    unrounded total; null where the array is null or an input is no decimal text or too long for 38 digits."""
    from factloom.functions.scalars import is_decimal_text

    number = F.transform(inputs, lambda x: F.when(is_decimal_text(x), x.try_cast("decimal(38,10)")))
    start = F.struct(F.lit(0).cast("decimal(38,10)").alias("sum"), F.array().cast("array<string>").alias("steps"))

    def step(acc, x):
        total = (acc["sum"] + x).cast("decimal(38,10)")
        return F.struct(total.alias("sum"), F.concat(acc["steps"], F.array(F.round(total, 2).cast("decimal(38,2)").cast("string"))).alias("steps"))

    def finish(acc):
        return F.struct(F.round(acc["sum"], 2).cast("decimal(38,2)").cast("string").alias("result"), acc["steps"].alias("steps"))

    return F.when(F.forall(number, lambda x: x.isNotNull()), F.aggregate(number, start, step, finish))


def changed_keys(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): keys added, removed or with another value; null equals null. Each side has a key once."""
    a, b = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_was")), new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_is"))
    both = a.join(b, key, "full_outer").where(F.col("_was").isNull() | F.col("_is").isNull() | ~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(key, F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").otherwise("changed").alias("change"))


def changed_fields(rows: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Rows with ``changed``: the sorted names of the fields that differ from the key's preceding row, '' for the first."""
    w = W.partitionBy(*key).orderBy(*order)
    first = F.row_number().over(w) == 1
    names = F.array_compact(F.array(*[F.when(~F.lag(f).over(w).eqNullSafe(F.col(f)), F.lit(f)) for f in sorted(fields)]))
    return rows.withColumn("changed", F.when(first, "").otherwise(F.array_join(names, ",")))


def revision_breaks(rows: DataFrame, key: list[str], number: str, recorded: str) -> DataFrame:
    """Revisions that do not follow their predecessor: number not one more, or recorded before it. A key's first revision
    must have number 1."""
    w = W.partitionBy(*key).orderBy(number, recorded)
    before, when = F.lag(number).over(w), F.lag(recorded).over(w)
    code = F.when(before.isNull() & (F.col(number) != 1), "PREDECESSOR_MISSING").when(F.col(number) != before + 1, "PREDECESSOR_MISSING").when(F.col(recorded) < when, "TIME_DECREASES")
    return rows.withColumn("code", code).where(F.col("code").isNotNull())


def covers(rows: DataFrame, group: list[str], value: str, required: list[str]) -> DataFrame:
    """(group, missing, complete): which required values each group lacks, as a sorted text; relational division. A group's
    set holds at most the required values."""
    have = F.collect_set(F.when(F.col(value).isin(required), F.col(value)))
    lacking = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), F.col("have")))
    return rows.groupBy(*group).agg(have.alias("have")).select(*group, F.array_join(lacking, ",").alias("missing"), (F.size(lacking) == 0).alias("complete"))


def strictest(rows: DataFrame, group: list[str], decision: str, priority: list[str]) -> DataFrame:
    """(group, decision): of a group's decisions the one that stands first in ``priority``; others count as the last."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(decision)), F.lit(0))
    worst = F.min(F.when(rank > 0, rank).otherwise(len(priority)))
    return rows.groupBy(*group).agg(F.element_at(F.array(*[F.lit(p) for p in priority]), worst.cast("int")).alias(decision))


def unresolved(rows: DataFrame, group: list[str], decision: str, agreed: list[str]) -> DataFrame:
    """(group, unresolved): whether any decision of a group is none of those agreed; null is none."""
    return rows.groupBy(*group).agg(F.bool_or(~F.coalesce(F.col(decision).isin(agreed), F.lit(False))).alias("unresolved"))


def compared_sets(left: DataFrame, right: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, common, only_left, only_right, same): how the sets of values of each group compare; null values are none. Two
    aggregations with map-side sums; a group's values are never gathered."""
    tagged = left.select(*group, value, F.lit(True).alias("_l"), F.lit(False).alias("_r")).unionByName(right.select(*group, value, F.lit(False).alias("_l"), F.lit(True).alias("_r")))
    once = tagged.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.bool_or("_l").alias("_l"), F.bool_or("_r").alias("_r"))
    count = lambda c: F.count_if(c)
    out = once.groupBy(*group).agg(count(F.col("_l") & F.col("_r")).alias("common"), count(~F.col("_r")).alias("only_left"), count(~F.col("_l")).alias("only_right"))
    return out.withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def chain_breaks(rows: DataFrame, steps: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """Rows with ``code``: that of the first step of a chain of lookups that fails. A step (code, target, key) looks its key up in a
    target, where it occurs once, and adds the target's other columns, by which later steps go on; null keys fail."""
    out, code = rows, None
    for i, (name, target, key) in enumerate(steps):
        out = out.join(target.withColumn(f"_found{i}", F.lit(True)), key, "left")
        broken = F.col(f"_found{i}").isNull()
        code = F.when(broken, name) if code is None else code.when(broken, name)
    return out.withColumn("code", code).where(F.col("code").isNotNull()).select(*rows.columns, "code")


def binding_breaks(bindings: DataFrame, targets: DataFrame, key: list[str], bound: list[str]) -> DataFrame:
    """Bindings with ``code``: TARGET_MISSING where no target has the key, BINDING_MISMATCH where the target's bound fields
    differ; null equals null. A binding holds only where key and fields agree. Each target key occurs once."""
    t = targets.select(*key, F.struct(*bound).alias("_there"), F.lit(True).alias("_known"))
    code = F.when(F.col("_known").isNull(), "TARGET_MISSING").when(~F.col("_there").eqNullSafe(F.struct(*bound)), "BINDING_MISMATCH")
    return bindings.join(t, key, "left").withColumn("code", code).where(F.col("code").isNotNull()).drop("_there", "_known")


def list_differences(declared: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows with ``code`` and ``rows`` that two lists of the same columns do not have equally often: ONLY_DECLARED or ONLY_DERIVED, and
    how many there are too many. Null equals null. One aggregation of signed counts with map-side sums, no join; the order of
    the lists counts if their columns have the position."""
    columns = declared.columns
    both = declared.select(*columns, F.lit(1).alias("_sign")).unionByName(derived.select(*columns, F.lit(-1).alias("_sign")))
    over = both.groupBy(*columns).agg(F.sum("_sign").alias("_over")).where(F.col("_over") != 0)
    return over.select(*columns, F.when(F.col("_over") > 0, "ONLY_DECLARED").otherwise("ONLY_DERIVED").alias("code"), F.abs("_over").alias("rows"))


def first_violation(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows with ``code``: that of the first rule whose condition is true; null is not true. Rows that break none are left out."""
    code = F.coalesce(*[F.when(broken, code) for code, broken in rules])
    return rows.withColumn("code", code).where(F.col("code").isNotNull())


def key_errors(rows: DataFrame, known: DataFrame, key: str, scope: list[str], *, unknown: str, duplicate: str) -> DataFrame:
    """(scope, key, code): keys of rows that ``known`` has not, and known keys given more than once in a scope."""
    counted = rows.groupBy(*scope, key).agg(F.count(F.lit(1)).alias("_n"))
    there = known.where(F.col(key).isNotNull()).select(key, F.lit(True).alias("_known")).distinct()
    code = F.when(F.col("_known").isNull(), unknown).when(F.col("_n") > 1, duplicate)
    return counted.join(there, key, "left").withColumn("code", code).where(F.col("code").isNotNull()).select(*scope, key, "code")


def outside_combinations(rows: DataFrame, columns: list[str], allowed: list[tuple]) -> DataFrame:
    """Rows whose values of some columns are together none of the combinations allowed; null equals null."""
    listed = F.lit(False)
    for values in allowed:
        same = F.lit(True)
        for c, v in zip(columns, values):
            same = same & F.col(c).eqNullSafe(F.lit(v))
        listed = listed | same
    return rows.where(~listed)


def predecessor_breaks(rows: DataFrame, key: list[str], number: str, own: list[str], declared: list[str]) -> DataFrame:
    """Rows with ``code`` PREDECESSOR_MISMATCH whose declared values differ from their key's row before in order of number;
    a first row must declare nulls. Two windows' worth of one sort; equal numbers follow in order of their own values."""
    w = W.partitionBy(*key).orderBy(number, *own)
    broken = F.lit(False)
    for o, d in zip(own, declared):
        broken = broken | ~F.lag(o).over(w).eqNullSafe(F.col(d))
    return rows.withColumn("_broken", broken).where("_broken").drop("_broken").withColumn("code", F.lit("PREDECESSOR_MISMATCH"))


def allowlist_findings(rows: DataFrame, registry: DataFrame, *, publisher: str, url: str, purpose: str | None = None) -> DataFrame:
    """Rows with ``code``: PUBLISHER_NOT_REGISTERED, PURPOSE_NOT_PERMITTED or TARGET_NOT_ALLOWLISTED, the first that holds where the
    URL may not be fetched from one of the publisher's hosts. registry(publisher, host), a host once per publisher, in lower
    case; with ``purpose``, the column of the rows that names one, also permitted_purposes, an array."""
    from factloom.functions.scalars import url_host

    permits = F.flatten(F.collect_set("permitted_purposes")) if purpose else F.array().cast("array<string>")
    known = registry.groupBy(F.col("publisher").alias(publisher)).agg(permits.alias("_permits")) if purpose else registry.select(F.col("publisher").alias(publisher), permits.alias("_permits")).distinct()
    pairs = registry.select(F.col("publisher").alias(publisher), F.col("host").alias("_host")).distinct().withColumn("_listed", F.lit(True))
    joined = rows.withColumn("_host", url_host(F.col(url))).join(known, publisher, "left").join(pairs, [publisher, "_host"], "left")
    code = F.when(F.col("_permits").isNull(), "PUBLISHER_NOT_REGISTERED")
    if purpose:
        code = code.when(~F.coalesce(F.array_contains("_permits", F.col(purpose)), F.lit(False)), "PURPOSE_NOT_PERMITTED")
    code = code.when(F.col("_listed").isNull(), "TARGET_NOT_ALLOWLISTED")
    return joined.withColumn("code", code).where(F.col("code").isNotNull()).select(*rows.columns, "code")
