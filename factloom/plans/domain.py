"""Queries p1 to p5 over the domain tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions.ids import closed_interval, day_number, normal_id, real_date, DAY_OFFSET, OPEN_DAY
from factloom.operators.asof import known_versions
from factloom.operators.hierarchy import descendants, hierarchy
from factloom.operators.intervals import periods_and_gaps
from factloom.operators.orphans import orphan_references, orphans_by_period
from factloom.operators.snapshots import snapshot_changes
from factloom.sources.tables import table

#: referring table, its id, its reference column, the table referred to and its id.
REFERENCES = (
    ("facts", "fact_id", "evidence_ids", "evidence", "evidence_id"),
    ("statements", "statement_id", "fact_ids", "facts", "fact_id"),
    ("statements", "statement_id", "rule_ids", "legal_rules", "rule_id"),
    ("statements", "statement_id", "calculation_ids", "calculations", "calculation_id"),
)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    children = parents = None
    for source, own in dict.fromkeys((r[0], r[1]) for r in REFERENCES):
        rows = table(spark, d, source)
        # The time of a record is that of its row, but for the few with several rows.
        several = rows.groupBy("package_id", F.col(own).alias("record_id")).agg(F.min("recorded_at").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
        ids = lambda c: F.array_compact(F.array_distinct(F.transform(c, normal_id)))
        named = [F.struct(F.lit(f"{source}.{c}").alias("ref_field"), F.lit(target).alias("target"), ids(F.col(c)).alias("ids")) for s, _, c, target, _ in REFERENCES if s == source]
        # References travel to their record's time as one row of arrays and part only there.
        refs = rows.select("package_id", F.col(own).alias("record_id"), "recorded_at", F.array(*named).alias("named"))
        r, b = refs.alias("r"), several.alias("b")
        one = r.join(b, F.col("r.package_id").eqNullSafe(F.col("b.package_id")) & (F.col("r.record_id") == F.col("b.record_id")), "left").select(
            F.coalesce("r.record_id", F.lit("")).alias("record_id"), F.col("r.package_id").alias("scope"), F.coalesce("b.earliest", "r.recorded_at").alias("at"), F.inline("r.named")
        )
        one = one.select("ref_field", "record_id", "target", "scope", F.explode("ids").alias("key"), "at")
        children = one if children is None else children.unionByName(one)
    for target, own in dict.fromkeys((r[3], r[4]) for r in REFERENCES):
        one = table(spark, d, target).select(F.lit(target).alias("target"), F.col("package_id").alias("scope"), normal_id(F.col(own)).alias("key"), F.col("recorded_at").alias("at"), F.col("deleted_at").alias("until"))
        parents = one if parents is None else parents.unionByName(one)
    return orphan_references(children, parents)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_field", "record_id", F.col("key").alias("ref_id"), "orphan_kind").distinct()


def p1_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_period(_orphans(spark, d))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    values = {"content_sha256": F.lower("content_sha256"), "size_bytes": F.col("size_bytes")}
    return snapshot_changes(table(spark, d, "raw_files"), snapshot="snapshot_no", key="raw_id", values=values, delivered="delivered_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d)


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).groupBy("snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("n"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "legal_rules").select("rule_id", "supersedes")
    nodes = rules.select(normal_id(F.col("rule_id")).alias("node"))
    edges = rules.select(normal_id(F.col("rule_id")).alias("parent"), F.explode("supersedes").alias("child")).select(normal_id(F.col("child")).alias("node"), "parent").distinct()
    return hierarchy(nodes, edges)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select(F.col("node").alias("rule_id"), F.col("root").alias("root_rule_id"), "depth")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select(F.col("node").alias("rule_id"), F.array_join("path", "/").alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_tree(spark, d)).select(F.col("node").alias("rule_id"), F.col("descendant").alias("descendant_id"), "distance")


def _date_text(day) -> F.Column:
    return F.date_format(F.date_from_unix_date((day - F.lit(DAY_OFFSET)).cast("int")), "yyyy-MM-dd")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "legal_version")
    row = F.struct("revision_no", "recorded_at", "document_id", F.col("effective_from_candidate").alias("a"), F.col("effective_to_candidate").alias("b"))
    last = v.where(F.col("version_id").isNotNull()).groupBy("version_id").agg(F.max(row).alias("r"))
    valid = last.select(F.col("r.document_id").alias("entity"), closed_interval(F.col("r.a"), F.col("r.b")).alias("i")).where(F.col("i").isNotNull()).select("entity", "i.first", "i.last")
    spans = periods_and_gaps(valid)
    to = F.when(F.col("end") > F.lit(OPEN_DAY), "open").otherwise(_date_text(F.col("end") - 1))
    return spans.select(F.col("entity").alias("document_id"), "span_kind", _date_text(F.col("first")).alias("span_from"), to.alias("span_to"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    s, v = table(spark, d, "historical_selection"), table(spark, d, "legal_version")
    events = s.select(F.col("selection_id").alias("event_id"), F.col("document_id").alias("entity"), day_number(real_date(F.col("event_date"))).alias("day"), F.col("selected_at").alias("at"))
    revisions = v.select(F.col("document_id").alias("entity"), "version_id", "revision_no", closed_interval(F.col("effective_from_candidate"), F.col("effective_to_candidate")).alias("valid"), F.col("recorded_at").alias("recorded"))
    return known_versions(events, revisions).select(F.col("event_id").alias("selection_id"), "version_id", "revision_no")


QUERIES = {f.__name__: f for f in (p1_found, p1_by_period, p2_found, p2_counts, p3_found, p3_paths, p3_descendants, p4_found, p5_found)}
from factloom.plans.domain_sql import SQL  # noqa: E402, F401
