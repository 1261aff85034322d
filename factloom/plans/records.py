"""Queries of the record-integrity operators over the driver's tables; each runs over its whole tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions import scalars as S
from factloom.functions.canonical import jcs, json_snapshot, strict_json_code
from factloom.functions.ids import closed_interval, day_number, normal_id, real_date
from factloom.operators import conflicts, folds, integrity, versions
from factloom.operators.diffing import text_differences
from factloom.operators.findings import collect_findings, finding, report
from factloom.sources import manifest as M
from factloom.functions.schema import schema_findings
from factloom.sources.parsers import bound_anchors, parsed
from factloom.scratch import folder
from factloom.sources.tables import table, table_stream
from factloom.streaming import folds as stream_folds

FACT_STATUSES = ["USER_ASSERTED", "EVIDENCE_LINKED", "DISPUTED"]
CALCULATION = {"formula_id": "SUM_DECIMAL_INPUTS", "calculator_version": "1.0.0", "rounding_policy": "HALF_UP_2"}
HOUR_US = 3_600_000_000


# Files and copies.


def _listing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return M.manifest(docs, F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.encode("text", "UTF-8"))


def manifest_raw_ids(spark: SparkSession, d: str) -> DataFrame:
    return _listing(spark, d).select("raw_id", "relative_path", "path_sha256", "content_sha256", "size_bytes")


def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.summary(_listing(spark, d))


def manifest_limits(spark: SparkSession, d: str) -> DataFrame:
    return M.limit_findings(_listing(spark, d), max_files=500, max_file_bytes=20_000, max_total_bytes=1 << 40)


def media_sniff(spark: SparkSession, d: str) -> DataFrame:
    return _listing(spark, d).groupBy("detected_media_type", "extension_media_type_mismatch").agg(F.count(F.lit(1)).alias("files"))


def duplicate_content_members(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("identity"))
    return integrity.copies(docs, "identity", "doc_id")


def duplicate_content_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("identity_sha256"))
    return integrity.repeated_values(docs, ["identity_sha256"])


def workspace_dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    return integrity.storage_summary(_listing(spark, d), "content_sha256", "size_bytes")


# References, identifiers, vocabularies.


def dangling_raw_files(spark: SparkSession, d: str) -> DataFrame:
    e, r = table(spark, d, "evidence"), table(spark, d, "raw_files")
    return integrity.dangling(e.select("package_id", "evidence_id", "raw_id").distinct(), r, ["package_id", "raw_id"])


def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"))
    known = table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    return integrity.dangling(lines, known, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))


def _id_findings(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for t, own in (("facts", "fact_id"), ("evidence", "evidence_id"), ("calculations", "calculation_id"), ("legal_rules", "rule_id"), ("statements", "statement_id")):
        rows = table(spark, d, t).select("package_id", "idx", F.col(own).alias("id"), "recorded_at")
        again = integrity.repeated_rows(rows.where(F.col("package_id").isNotNull()), ["package_id", "id"], [F.col("idx"), F.col("recorded_at")])
        path = F.format_string(f"$.{t}[%d]", F.col("idx"))
        parts.append(finding(again, F.lit(True), record_id=F.col("package_id"), code="DUPLICATE_ID", path=path, message=F.col("id")))
        parts.append(finding(rows, F.col("id").isNull() | (F.col("id") == ""), record_id=F.col("package_id"), code="ID_MISSING", path=path))
    return collect_findings(*parts)


def duplicate_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return _id_findings(spark, d)


def duplicate_values(spark: SparkSession, d: str) -> DataFrame:
    return integrity.repeated_values(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def missing_identifiers(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "facts").select("fact_id", F.posexplode("evidence_ids").alias("pos", "id"))
    return ids.where(normal_id(F.col("id")).isNull()).select("fact_id", "pos", F.col("id").isNull().alias("is_null"))


def vocab_violations(spark: SparkSession, d: str) -> DataFrame:
    orders = integrity.outside_vocabulary(table(spark, d, "orders"), "o_orderstatus", ["F", "O"]).select(F.lit("orders").alias("source"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("value"))
    facts = integrity.outside_vocabulary(table(spark, d, "facts"), "status", FACT_STATUSES).select(F.lit("facts").alias("source"), F.col("fact_id").alias("id"), F.col("status").alias("value"))
    return orders.unionByName(facts)


def sha256_shape(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_files")
    return r.where(~S.is_sha256(F.col("content_sha256"))).select("snapshot_no", "raw_id", F.col("content_sha256").isNull().alias("hash_null"))


def path_safety(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_files").select("relative_path", F.concat(F.lit("../"), F.col("relative_path")).alias("up"), F.concat(F.lit("/"), F.col("relative_path")).alias("root"))
    safe = [F.sum(S.is_safe_relative_path(F.col(c)).cast("int")).alias(f"{c}_safe") for c in ("relative_path", "up", "root")]
    return r.agg(F.count(F.lit(1)).alias("paths"), *safe)


def date_interval_invalid(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "legal_version").select("version_id", "revision_no", F.col("effective_from_candidate").alias("a"), F.col("effective_to_candidate").alias("b")).distinct()
    a, b = real_date(F.col("a")), real_date(F.col("b"))
    code = F.when(F.col("a").isNull(), "DATE_MISSING").when(a.isNull() | (F.col("b").isNotNull() & b.isNull()), "DATE_FORMAT_INVALID").when(b < a, "DATE_INTERVAL_INVALID")
    return v.select("version_id", "revision_no", code.alias("code")).where(F.col("code").isNotNull())


def utc_times(spark: SparkSession, d: str) -> DataFrame:
    text = F.date_format(F.to_utc_timestamp("recorded_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    f = table(spark, d, "facts").select("fact_id", "idx", text.alias("t"), F.col("recorded_at"))
    later = S.add_hours(S.utc_timestamp(F.col("t")), F.lit(48))
    return f.select("fact_id", "idx", F.unix_micros(later).alias("due_us"), S.utc_timestamp(F.regexp_replace("t", "Z$", "+00:00")).isNull().alias("offset_refused"))


# Decimals.


def decimal_text_validity(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "calculations").select("calculation_id", "idx", F.explode(F.concat(F.array("result"), F.coalesce("input_values", F.array().cast("array<string>")))).alias("value"))
    return c.groupBy("calculation_id").agg(F.count(F.lit(1)).alias("n_values"), F.sum(S.is_decimal_text(F.col("value")).cast("int")).alias("n_decimals"), F.sum(S.is_amount_cny(F.col("value")).cast("int")).alias("n_amounts"))


def _recomputed(spark: SparkSession, d: str) -> DataFrame:
    supported = F.lit(True)
    for k, v in CALCULATION.items():
        supported = supported & (F.col(k) == v)
    c = table(spark, d, "calculations").withColumn("again", F.when(supported, integrity.running_decimal_sums(F.col("input_values"))))
    return c.select("calculation_id", "idx", F.col("result").alias("declared"), F.col("again.result").alias("recomputed"), F.array_join("again.steps", ";").alias("steps")).distinct()


def sum_decimal_recompute(spark: SparkSession, d: str) -> DataFrame:
    return _recomputed(spark, d).select("calculation_id", "idx", "recomputed", "steps")


def calc_result_mismatch(spark: SparkSession, d: str) -> DataFrame:
    c = _recomputed(spark, d).where(F.col("recomputed").isNotNull() & ~F.col("declared").eqNullSafe(F.col("recomputed")))
    return c.select("calculation_id", "idx", "declared", "recomputed")


# Conflicts and changes.


def value_conflicts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey")
    return conflicts.value_conflicts(lines, ["l_orderkey"], "l_returnflag")


def value_conflict_classes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_files").where(F.col("snapshot_no").isNotNull() & F.col("raw_id").isNotNull())
    return conflicts.conflict_classes(r.select("snapshot_no", "raw_id", F.lower("content_sha256").alias("h")), ["snapshot_no", "raw_id"], "h")


def semantic_kind_conflicts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "event_id")
    return conflicts.value_conflicts(e, ["user_id", "day"], "event_type")


def timeline_conflicts(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("event_type") == "signup", "EMPLOYMENT_START").when(F.col("event_type") == "purchase", "EMPLOYMENT_END").when(F.col("event_type") == "error", "TERMINATION")
    views = table(spark, d, "events").select("user_id", "event_id", role.alias("role"), "ts")
    return conflicts.timeline_conflicts(views, "user_id", "event_id", "role", "ts")


def _revisions(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "legal_version").where(F.col("version_id").isNotNull() & F.col("revision_no").isNotNull())
    return v.select("version_id", "revision_no", "recorded_at", "document_id", "content_sha256", "publication_date", "effective_from_candidate", "effective_to_candidate").distinct()


def changed_keys(spark: SparkSession, d: str) -> DataFrame:
    v = _revisions(spark, d)
    old = v.where(F.col("revision_no") == 1).groupBy("version_id").agg(F.max("content_sha256").alias("h"))
    new = v.where(F.col("revision_no") == 2).groupBy("version_id").agg(F.max("content_sha256").alias("h"))
    return integrity.changed_keys(old, new, "version_id", "h")


def dependency_change_kinds(spark: SparkSession, d: str) -> DataFrame:
    fields = ["content_sha256", "publication_date", "effective_from_candidate", "effective_to_candidate"]
    return integrity.changed_fields(_revisions(spark, d), ["version_id"], ["revision_no", "recorded_at"], fields).select("version_id", "revision_no", "changed")


def revision_chain_check(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_files").where(F.col("raw_id").isNotNull() & F.col("snapshot_no").isNotNull())
    last = r.groupBy("raw_id", "snapshot_no").agg(F.max("delivered_at").alias("delivered_at"))
    return integrity.revision_breaks(last, ["raw_id"], "snapshot_no", "delivered_at").select("raw_id", "snapshot_no", "code")


# Versions and graphs.


def historical_version_select(spark: SparkSession, d: str) -> DataFrame:
    v = _revisions(spark, d).groupBy("version_id").agg(F.max(F.struct("revision_no", "recorded_at", "document_id", F.col("effective_from_candidate").alias("a"), F.col("effective_to_candidate").alias("b"))).alias("r"))
    latest = v.select(F.col("r.document_id").alias("entity"), "version_id", closed_interval(F.col("r.a"), F.col("r.b")).alias("valid"))
    s = table(spark, d, "historical_selection").select(F.col("selection_id").alias("event_id"), F.col("document_id").alias("entity"), day_number(real_date(F.col("event_date"))).alias("day")).distinct()
    return versions.versions_on(s, latest).withColumnRenamed("event_id", "selection_id")


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = table(spark, d, "legal_rules")
    edges = r.select(F.col("package_id").alias("graph"), normal_id(F.col("rule_id")).alias("source"), F.explode("supersedes").alias("t")).select("graph", "source", normal_id(F.col("t")).alias("target"))
    return edges.dropna(), r.select(F.col("package_id").alias("graph"), normal_id(F.col("rule_id")).alias("node")).distinct()


def version_graph_cycle(spark: SparkSession, d: str) -> DataFrame:
    edges, _ = _edges(spark, d)
    return versions.graph_circles(edges)


def edge_checks(spark: SparkSession, d: str) -> DataFrame:
    return versions.edge_findings(*_edges(spark, d))


def relation_conflict(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "legal_rules").select("rule_id", "idx", "recorded_at", F.array_distinct(F.transform(F.coalesce("supersedes", F.array().cast("array<string>")), normal_id)).alias("below"), F.array(normal_id(F.col("superseded_by"))).alias("above"), normal_id(F.col("rule_id")).alias("own"))
    both = F.size(F.array_compact(F.array_intersect("below", "above"))) > 0
    own = F.array_contains("below", F.col("own")) | F.coalesce(F.col("above")[0] == F.col("own"), F.lit(False))
    return r.select("rule_id", "idx", both.alias("both_ways"), F.coalesce(own, F.lit(False)).alias("itself")).where("both_ways OR itself").distinct()


# Monitoring.


def freshness_status(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    r = table(spark, d, "raw_files").where(F.col("raw_id").isNotNull()).groupBy("raw_id", "snapshot_no").agg(F.max(F.struct("delivered_at", F.lower("content_sha256").alias("h"))).alias("r"))
    w = W.partitionBy("raw_id").orderBy("snapshot_no")
    r = r.withColumns({"base": F.lag("r.h").over(w), "since": F.lag("r.delivered_at").over(w)}).where(F.col("since").isNotNull())
    hours = (F.unix_micros("r.delivered_at") - F.unix_micros("since")) / HOUR_US
    return r.select("raw_id", "snapshot_no", S.freshness(F.col("r.h").isNull(), F.col("base"), F.col("r.h"), hours, F.lit(24 * 30.5)).alias("status"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """A run per user and day of any event; a check was made where the user has one that day, its status by the day's last."""
    e = table(spark, d, "events").where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select("user_id", F.date_trunc("day", "ts").alias("day"), "event_id", "event_type")
    last = e.groupBy("user_id", "day").agg(F.max(F.struct("event_id", "event_type")).alias("e"))
    t = F.col("e.event_type")
    status = F.when(t == "error", folds.UNAVAILABLE).when(t == "signup", folds.CHANGED).when(t == "view", folds.STALE).otherwise(folds.UNCHANGED)
    hour = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / HOUR_US).cast("long")
    checks = last.select(F.col("user_id").alias("key"), hour("day").alias("run_at"), status.alias("technical"))
    # The days are few; each user is checked on each of them.
    grid = checks.select("key").distinct().select("key", F.explode(F.sequence(*[F.lit(x) for x in _span(checks)], F.lit(24).cast("long"))).alias("run_at"))
    return grid.join(checks, ["key", "run_at"], "left")


def _span(checks: DataFrame) -> tuple[int, int]:
    lo, hi = checks.agg(F.min("run_at"), F.max("run_at")).first()
    return (lo, hi) if lo is not None else (0, 0)


MONITOR = {"interval": 48, "retry": 24, "window": 7, "budget": 3}


def _states(spark: SparkSession, d: str) -> DataFrame:
    return folds.monitor_states(_runs(spark, d), **MONITOR)


def monitor_fold(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).select("key", "run_at", "execution", "technical", "next_due", "failures", "exhausted")


def monitor_alerts(spark: SparkSession, d: str) -> DataFrame:
    return folds.alerts(_states(spark, d)).groupBy("run_at", "code", "severity").agg(F.count(F.lit(1)).alias("alerts"))


def monitor_overall(spark: SparkSession, d: str) -> DataFrame:
    return folds.overall(_states(spark, d))


def error_budget_rolling(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("run_at"), F.when(F.col("event_type") == "error", "UNAVAILABLE").otherwise("SUCCESS").alias("outcome"))
    return folds.rolling_failures(runs, window=10, budget=3)


def rate_limit_reservations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return folds.reservations(e, min_interval_us=6 * HOUR_US).select("key", "request_id", "decision")


def _drained(build, source: DataFrame) -> DataFrame:
    """What a streaming operator gives for all rows that are there now, with state and output in the shared folder."""
    path, fs = folder(source.sparkSession)
    fs.deleteOnExit(path)
    out = build(source)
    query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return source.sparkSession.read.schema(out.schema).parquet(f"{path}/out")


def stream_reservations(spark: SparkSession, d: str) -> DataFrame:
    e = table_stream(spark, d, "events")
    asked = e.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select(F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return _drained(lambda s: stream_folds.reservations(s, min_interval_us=6 * HOUR_US), asked).select("key", "request_id", "decision")


# Reviews, sets and anchors.


def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "facts").where(F.col("package_id").isNotNull())
    return integrity.strictest(f, ["package_id"], "status", ["DISPUTED", "USER_ASSERTED", "EVIDENCE_LINKED"])


def set_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "anchors").where(F.col("parse_id").isNotNull())
    return integrity.covers(c, ["parse_id"], "kind", ["TEXT_LINE", "DOCX_PARAGRAPH", "CSV_CELL", "XLSX_CELL", "EMAIL_HEADER", "EMAIL_TEXT_LINE"])


def anchor_replay(spark: SparkSession, d: str) -> DataFrame:
    bound = table(spark, d, "fact_candidate").select("parse_id", "fact_candidate_id", F.posexplode("anchor_ids").alias("pos", "anchor_id")).distinct()
    known = table(spark, d, "anchors").groupBy("parse_id", "anchor_id").agg(F.max(F.struct("kind", "coordinate")).alias("a"))
    j = bound.join(known, ["parse_id", "anchor_id"], "left")
    return j.select("fact_candidate_id", "pos", "anchor_id", F.coalesce("a.kind", F.lit("MISSING")).alias("kind"), F.coalesce("a.coordinate", F.lit("")).alias("coordinate"))


def anchor_hashes(spark: SparkSession, d: str) -> DataFrame:
    actual = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    a = table(spark, d, "anchors").select("kind", "text_sha256", (F.lower("text_sha256") == actual).alias("same"))
    return a.groupBy("kind").agg(F.count(F.lit(1)).alias("anchors"), F.sum(F.col("same").cast("int")).alias("matching"), F.sum(F.col("text_sha256").isNull().cast("int")).alias("without_hash"))


def host_allowlist(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "legal_version").select("document_id", "source_url").distinct()
    host = S.url_host(F.col("source_url"))
    # Of each document's source the host's number tells the publisher; only even hosts are reviewed.
    rows = v.withColumn("publisher", F.concat(F.lit("P"), F.regexp_extract(host, r"^rules-([0-9]+)", 1)))
    registry = rows.where(host.rlike(r"^rules-[0-9]*[02468]\.")).select("publisher", host.alias("host")).distinct()
    return integrity.allowlist_findings(rows, registry, publisher="publisher", url="source_url").select("document_id", "source_url", "code")


def candidate_binding(spark: SparkSession, d: str) -> DataFrame:
    fields = ["effective_from_candidate", "effective_to_candidate"]
    bound = table(spark, d, "historical_selection").select("selection_id", F.inline("candidates")).distinct()
    v = _revisions(spark, d).groupBy("version_id").agg(F.min(F.struct("revision_no", "recorded_at", *fields)).alias("r")).select("version_id", *[F.col(f"r.{f}").alias(f) for f in fields])
    return integrity.binding_breaks(bound, v, ["version_id"], fields).select("selection_id", "version_id", "code")


def sorted_references(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "facts").where(F.col("evidence_ids").isNotNull())
    ids = F.array_compact("evidence_ids")
    return f.groupBy("status").agg(F.count(F.lit(1)).alias("facts"), F.sum(S.is_sorted(ids).cast("int")).alias("ascending"), F.sum(S.is_sorted(ids, unique=True).cast("int")).alias("ascending_once"))


def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    rule = {"type": "object", "additionalProperties": False, "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 79}}}
    e = table(spark, d, "events").select(F.col("event_id").alias("record_id"), F.when(F.col("event_id") % 9 == 0, F.regexp_replace("props", "k", "q")).otherwise(F.col("props")).alias("text"))
    return schema_findings(e, rule).groupBy("path", "keyword").agg(F.count(F.lit(1)).alias("records"))


def bound_text_anchors(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("raw_id"), F.lit("a.txt").alias("name"), F.encode("text", "UTF-8").alias("content"))
    files = docs.select(F.lit("WORKSPACE-1").alias("workspace_id"), "raw_id", F.sha2("content", 256).alias("content_sha256"))
    return bound_anchors(parsed(docs.withColumnRenamed("raw_id", "file_id")), files).select(F.col("file_id").cast("long").alias("doc_id"), "idx", "anchor_id")


def host_multi_owner(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "legal_version").select("document_id", S.url_host(F.col("source_url")).alias("host")).where(F.col("host").isNotNull())
    return v.groupBy("host").agg(F.count_distinct("document_id").alias("owners")).where(F.col("owners") > 1)


def text_line_anchors(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(S.text_lines(F.col("text"))).alias("i", "line"))
    return docs.select("doc_id", F.concat(F.lit("line:"), F.col("i") + 1).alias("coordinate"), F.sha2(F.encode("line", "UTF-8"), 256).alias("text_sha256"))


def parsed_documents(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.concat("source", F.when(F.col("doc_id") % 50 == 7, ".bin").otherwise(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    a = parsed(files).groupBy("file_id", "detected_format", "refusal_code").agg(F.sum(F.when(F.col("idx") > 0, 1).otherwise(0)).alias("anchors"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))
    return a.select(F.col("file_id").cast("long").alias("doc_id"), "detected_format", F.coalesce("refusal_code", F.lit("")).alias("refusal_code"), "anchors", "characters")


def csv_cell_anchors(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), F.concat(F.lit('"'), F.col("n_name"), F.lit(', ""'), F.lit('"')), F.col("n_regionkey").cast("string"))
    files = n.select(F.col("n_nationkey").alias("file_id"), F.lit("x.csv").alias("name"), F.encode(line, "UTF-8").alias("content"))
    return parsed(files).select(F.col("file_id").cast("int").alias("n_nationkey"), "coordinate", "text", "refusal_code")


def text_diff_ops(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("diff_id"), F.col("text").alias("old_text"), F.regexp_replace("text", r"\n\s*\n", "\n").alias("new_text"))
    return text_differences(docs).groupBy("diff_id", "tag").agg(F.count(F.lit(1)).alias("operations"), F.sum(F.col("from_end_line") - F.col("from_start_line")).alias("removed"), F.sum(F.col("to_end_line") - F.col("to_start_line")).alias("added"))


# JSON.


def jcs_snapshot(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "legal_version").select("version_id", "revision_no", "document_id", "content_sha256").distinct()
    text = F.to_json(F.struct("version_id", "revision_no", "document_id", "content_sha256"), {"ignoreNullFields": "false"})
    return v.select("version_id", "revision_no", json_snapshot(text).alias("snapshot_sha256"))


def jcs_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("props").alias("p"))
    return e.select("event_id", F.coalesce(jcs(F.col("p")), F.lit("")).alias("canonical"))


def strict_json_input(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    broken = F.when(F.col("event_id") % 7 == 1, F.concat(F.lit('{"a":1,"a":'), p, F.lit("}"))).when(F.col("event_id") % 7 == 2, F.lit('{"a":NaN}')).when(F.col("event_id") % 7 == 3, F.concat(F.lit("["), p, F.lit("]")))
    broken = broken.when(F.col("event_id") % 7 == 4, F.concat(p, F.lit("}"))).when(F.col("event_id") % 7 == 5, F.concat(F.repeat(F.lit("["), 101), F.repeat(F.lit("]"), 101))).when(F.col("event_id") % 7 == 6, F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 1000), F.lit('"}')))
    e = table(spark, d, "events").select("event_id", F.coalesce(broken, p).alias("t"))
    return e.select("event_id", strict_json_code(900)(F.col("t")).alias("code"))


# The whole report.


def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    facts, ev = table(spark, d, "facts"), table(spark, d, "evidence")
    calc = table(spark, d, "calculations").withColumn("again", integrity.running_decimal_sums(F.col("input_values")))
    st = table(spark, d, "statements")
    at = lambda t: F.format_string(f"$.{t}[%d]", F.col("idx"))
    pkg = F.col("package_id")
    none = lambda c: F.coalesce(F.size(F.filter(c, lambda x: normal_id(x).isNotNull())) < 1, F.lit(True))
    rules = table(spark, d, "legal_rules")
    a, b = real_date(F.col("effective_from")), real_date(F.col("effective_to"))
    parts = [
        _id_findings(spark, d),
        finding(facts, none("evidence_ids") & (F.col("status") == "EVIDENCE_LINKED"), record_id=pkg, code="FACT_EVIDENCE_MISSING", path=at("facts"), severity="P0"),
        finding(st, none("fact_ids"), record_id=pkg, code="STATEMENT_FACTS_MISSING", path=at("statements")),
        finding(st, none("rule_ids"), record_id=pkg, code="STATEMENT_RULES_MISSING", path=at("statements")),
        finding(st, F.coalesce(F.trim("text"), F.lit("")) == "", record_id=pkg, code="STATEMENT_TEXT_MISSING", path=at("statements")),
        finding(ev, F.col("location").isNull(), record_id=pkg, code="EVIDENCE_LOCATION_MISSING", path=at("evidence")),
        finding(calc, ~S.is_decimal_text(F.col("result")), record_id=pkg, code="CALCULATION_RESULT_INVALID", path=at("calculations")),
        finding(calc, S.is_decimal_text(F.col("result")) & (F.col("formula_id") == CALCULATION["formula_id"]) & (F.col("again.result") != F.col("result")), record_id=pkg, code="CALCULATION_RESULT_MISMATCH", path=at("calculations"), severity="P0"),
        finding(rules, a.isNull() | (F.col("effective_to").isNotNull() & b.isNull()), record_id=pkg, code="DATE_FORMAT_INVALID", path=at("legal_rules")),
        finding(rules, b < a, record_id=pkg, code="DATE_INTERVAL_INVALID", path=at("legal_rules")),
    ]
    records = facts.select(pkg.alias("record_id")).unionByName(ev.select(pkg.alias("record_id"))).where(F.col("record_id").isNotNull())
    return report(collect_findings(*parts).where(F.col("record_id").isNotNull()), records).drop("submission_ready", "legal_review_required", "exit_code")


QUERIES = {
    f.__name__: f
    for f in (
        manifest_raw_ids, manifest_summary, manifest_limits, media_sniff, duplicate_content_members, duplicate_content_groups, workspace_dedup_summary,
        dangling_raw_files, dangling_refs, duplicate_identifiers, duplicate_values, missing_identifiers, vocab_violations, sha256_shape, path_safety, date_interval_invalid, utc_times,
        decimal_text_validity, sum_decimal_recompute, calc_result_mismatch,
        value_conflicts, value_conflict_classes, semantic_kind_conflicts, timeline_conflicts, changed_keys, dependency_change_kinds, revision_chain_check,
        historical_version_select, version_graph_cycle, edge_checks, relation_conflict,
        freshness_status, monitor_fold, monitor_alerts, monitor_overall, error_budget_rolling, rate_limit_reservations, stream_reservations,
        status_rollup, set_coverage, anchor_replay, anchor_hashes, host_allowlist, host_multi_owner, candidate_binding, sorted_references, schema_violations, bound_text_anchors, text_line_anchors, parsed_documents, csv_cell_anchors, text_diff_ops,
        jcs_snapshot, jcs_events, strict_json_input, integrity_report,
    )
}
from factloom.plans.records_sql import SQL  # noqa: E402, F401
