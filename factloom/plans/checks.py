"""Further queries of the record operators: kinds, rules by source, identities, combinations, and files of every format."""

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BinaryType

from factloom.functions import scalars as S
from factloom.functions.canonical import jcs, json_snapshot
from factloom.functions.ids import closed_interval, day_number, normal_id, real_date
from factloom.operators import conflicts, folds, integrity, versions
from factloom.operators.diffing import text_differences
from factloom.operators.findings import collect_findings, finding, report
from factloom.plans.records import MONITOR, _edges, _id_findings, _runs
from factloom.sources import manifest as M
from factloom.sources.parsers import parsed
from factloom.sources.tables import table


# Graphs and files.


def _typed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges within one province supersede; those between provinces stand for conflicts."""
    edges, _ = _edges(spark, d)
    place = table(spark, d, "legal_rules").groupBy(F.col("package_id").alias("graph"), normal_id(F.col("rule_id")).alias("source")).agg(F.min("jurisdiction.province").alias("province"))
    there = place.select("graph", F.col("source").alias("target"), F.col("province").alias("other"))
    both = edges.join(place, ["graph", "source"], "left").join(there, ["graph", "target"], "left")
    return both.select("graph", "source", "target", F.when(F.col("province").eqNullSafe(F.col("other")), "SUPERSEDES").otherwise("CONFLICTS_WITH").alias("kind"))


def typed_graph_cycle(spark: SparkSession, d: str) -> DataFrame:
    return versions.graph_circles(_typed_edges(spark, d), kinds=versions.ACYCLIC)


def typed_edge_checks(spark: SparkSession, d: str) -> DataFrame:
    _, nodes = _edges(spark, d)
    return versions.edge_findings(_typed_edges(spark, d), nodes)


def media_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Listed files whose flag is not what extension and detected type give."""
    r = table(spark, d, "raw_files").withColumn("again", M.extension_mismatch(F.col("extension"), F.col("detected_media_type")))
    return r.groupBy("extension", "detected_media_type", "extension_media_type_mismatch", "again").agg(F.count(F.lit(1)).alias("files"))


def file_relationships(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    listed = M.manifest(docs, path, F.encode("text", "UTF-8"), modified_at=F.col("created_at"), identity=S.filesystem_identity(F.col("source"), F.col("n_chars")))
    return M.relationships(listed)


def file_times(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("x/"), F.col("doc_id").cast("string"), F.when(F.col("n_chars") > 500, ".GIF").otherwise(".md"))
    return M.manifest(docs, path, F.encode("text", "UTF-8"), modified_at=F.col("created_at")).select("relative_path", "extension", "extension_media_type_mismatch", "modified_at_ns")


# Monitoring by source.


def _definitions(runs: DataFrame) -> DataFrame:
    """Rules that differ from source to source; every seventh source has none of its own."""
    k = F.col("key")
    own = runs.select("key").distinct().where(k % 7 != 0)
    return own.select("key", (24 * (1 + k % 3)).alias("interval"), (12 * (1 + k % 2)).alias("retry"), (3 + k % 5).alias("window"), (1 + k % 3).alias("budget"))


def _urgency() -> F.Column:
    return F.when(F.col("key") % 3 == 0, "CRITICAL").when(F.col("key") % 3 == 1, "HIGH").otherwise("ROUTINE")


def _states_by_source(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d)
    return folds.monitor_states(runs, _definitions(runs), **MONITOR)


def monitor_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _states_by_source(spark, d).select("key", "run_at", "execution", "technical", "next_due", "failures", "exhausted")


def monitor_alert_ids(spark: SparkSession, d: str) -> DataFrame:
    raised = folds.alerts(_states_by_source(spark, d), urgency=_urgency())
    at = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.col("run_at") * 3600), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    check = F.concat(F.lit("CHK-"), F.col("key").cast("string"), F.lit("-"), F.col("run_at").cast("string"))
    named = folds.identified(raised, evaluated_at=at, source=F.concat(F.lit("SRC-"), F.col("key").cast("string")), check_id=check, check_sha256=F.sha2(check, 256))
    return named.select("key", "run_at", "code", "severity", "alert_id")


# Bindings and combinations.


def candidate_matrix(spark: SparkSession, d: str) -> DataFrame:
    allowed = [("EXTRACTED", "NOT_HUMAN_CONFIRMED"), ("USER_ANNOTATED", "USER_CONFIRMED_UNAUTHENTICATED"), ("ADJUDICATED", "DOCUMENT_PASSAGE_CLASSIFIED_UNAUTHENTICATED")]
    return integrity.outside_combinations(table(spark, d, "fact_candidate"), ["provenance_state", "confirmation_status"], allowed).select("fact_candidate_id", "provenance_state", "confirmation_status").distinct()


def exact_anchor_text(spark: SparkSession, d: str) -> DataFrame:
    """Transcriptions that are not, to the letter, the text of their one anchor."""
    c = table(spark, d, "fact_candidate").where(F.col("provenance_state").isin("EXTRACTED", "ADJUDICATED")).select("fact_candidate_id", "parse_id", "assertion_text", F.size("anchor_ids").alias("anchors"), F.col("anchor_ids")[0].alias("anchor_id")).distinct()
    a = table(spark, d, "anchors").groupBy("parse_id", "anchor_id").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("a"))
    same = (F.col("anchors") == 1) & F.col("assertion_text").eqNullSafe(F.col("a.text"))
    return c.join(a, ["parse_id", "anchor_id"], "left").where(~same).select("fact_candidate_id", "anchors", F.col("a").isNotNull().alias("anchor_known"))


def predecessor_check(spark: SparkSession, d: str) -> DataFrame:
    """Revisions that name their version's first content as their predecessor's, though another came between."""
    v = table(spark, d, "legal_version").where(F.col("version_id").isNotNull() & F.col("revision_no").isNotNull()).select("version_id", "revision_no", "content_sha256").distinct()
    w = W.partitionBy("version_id").orderBy("revision_no", "content_sha256")
    v = v.withColumns({"own": F.coalesce("content_sha256", F.lit("")), "declared": F.when(F.row_number().over(w) > 1, F.coalesce(F.first("content_sha256").over(w), F.lit("")))})
    return integrity.predecessor_breaks(v, ["version_id"], "revision_no", ["own"], ["declared"]).select("version_id", "revision_no", "code")


def allowlist_purposes(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "legal_version").select("document_id", "source_url", "status").distinct()
    host = S.url_host(F.col("source_url"))
    number = F.regexp_extract(host, r"^rules-([0-9]+)", 1)
    rows = v.withColumns({"publisher": F.concat(F.lit("P"), number), "purpose": F.when(F.length("document_id") % 2 == 0, "CASE").otherwise("RULE")})
    permitted = F.when(number.cast("int") % 3 == 0, F.array(F.lit("CASE"), F.lit("RULE"))).otherwise(F.array(F.lit("NEWS")))
    registry = rows.where(host.isNotNull() & (number.cast("int") % 5 != 1)).select("publisher", host.alias("host"), permitted.alias("permitted_purposes")).distinct()
    return integrity.allowlist_findings(rows, registry, publisher="publisher", url="source_url", purpose="purpose").select("document_id", "source_url", "code").distinct()


def conflict_limit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("user_id").isNotNull())
    return conflicts.conflict_refusal(conflicts.conflict_classes(e, ["user_id"], "event_type"))


def report_exit_codes(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "facts").select(F.col("package_id").alias("record_id")).where("record_id IS NOT NULL")
    return report(_id_findings(spark, d), records).select("record_id", "exit_code")


def text_diff_append(spark: SparkSession, d: str) -> DataFrame:
    """The one difference between a text and the same with a further line."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("diff_id"), F.concat("text", F.lit("\n")).alias("old_text"), F.concat("text", F.lit("\nEND OF THE TEXT\n")).alias("new_text"))
    return text_differences(docs).select(F.col("diff_id").cast("long").alias("doc_id"), "tag", "from_start_line", "from_end_line", "to_start_line", "to_end_line", "removed_text", "added_text")


# Declared against derived.


def superseded_differences(spark: SparkSession, d: str) -> DataFrame:
    """Links that superseded_by declares against those that supersedes gives, within a package."""
    r = table(spark, d, "legal_rules").select(F.col("package_id").alias("graph"), normal_id(F.col("rule_id")).alias("rule"), "supersedes", normal_id(F.col("superseded_by")).alias("by"))
    declared = r.select("graph", F.col("rule").alias("older"), F.col("by").alias("newer")).dropna().distinct()
    derived = r.select("graph", "rule", F.explode("supersedes").alias("x")).select("graph", normal_id(F.col("x")).alias("older"), F.col("rule").alias("newer")).dropna().distinct()
    return integrity.list_differences(declared, derived)


def selection_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of what a selection declares: whether its candidates ascend without repetition, its status is that of their number, and
    each covers the event's day; the first that does not hold."""
    c = F.coalesce("candidates", F.array())
    ids = F.transform(c, lambda x: x["version_id"])
    day = day_number(real_date(F.col("event_date")))
    span = lambda x: closed_interval(x["effective_from_candidate"], x["effective_to_candidate"])
    covered = F.forall(c, lambda x: F.coalesce((span(x)["first"] <= day) & (day <= span(x)["last"]), F.lit(False)))
    s = table(spark, d, "historical_selection").where(F.col("candidates").isNotNull())
    rules = [("CANDIDATES_NOT_SORTED", ~S.is_sorted(ids, unique=True)), ("STATUS_MISMATCH", ~F.col("selection_status").eqNullSafe(S.candidate_status(F.size("candidates")))), ("EVENT_NOT_COVERED", ~covered), ("VALID", F.lit(True))]
    return integrity.first_violation(s, rules).groupBy("code").agg(F.count(F.lit(1)).alias("selections"))


def raw_file_checks(spark: SparkSession, d: str) -> DataFrame:
    """One finding a listed file, whichever of its fields is wrong first."""
    r = table(spark, d, "raw_files")
    suffix = F.lower(F.regexp_extract("relative_path", r"[^/](\.[^./]+)\z", 1))
    rules = [
        ("PATH_UNSAFE", ~S.is_portable_path(F.col("relative_path"))),
        ("RAW_ID_INVALID", ~F.coalesce(F.col("raw_id").rlike(r"^RAW-[0-9a-f]{64}\z"), F.lit(False))),
        ("HASH_INVALID", ~S.is_sha256(F.col("content_sha256"))),
        ("EXTENSION_MISMATCH", ~F.col("extension").eqNullSafe(suffix)),
        ("MEDIA_FLAG_MISMATCH", F.col("extension_media_type_mismatch") != M.extension_mismatch(F.col("extension"), F.col("detected_media_type"))),
    ]
    return integrity.first_violation(r, rules).select("snapshot_no", "package_id", "raw_id", "idx", "code").distinct()


def object_paths(spark: SparkSession, d: str) -> DataFrame:
    """Contents of the listings and where a store keeps them."""
    r = table(spark, d, "raw_files").where(S.is_sha256(F.col("content_sha256")))
    return r.groupBy(F.lower("content_sha256").alias("content_sha256")).agg(F.count(F.lit(1)).alias("files")).withColumn("object_path", S.object_path(F.col("content_sha256")))


def fact_findings(spark: SparkSession, d: str) -> DataFrame:
    """Up to three findings a fact, each rule by itself."""
    f = table(spark, d, "facts")
    path = F.format_string("facts[%d]", F.col("idx"))
    named = F.coalesce(F.size(F.filter("evidence_ids", lambda x: normal_id(x).isNotNull())), F.lit(0))
    rules = [
        ("FACT_STATUS_NOT_ALLOWED", ~F.coalesce(F.col("status").isin("USER_ASSERTED", "DISPUTED"), F.lit(False))),
        ("FACT_EVIDENCE_MISSING", (F.col("status") == "EVIDENCE_LINKED") & (named == 0)),
        ("FACT_SUMMARY_MISSING", F.coalesce(F.trim("summary"), F.lit("")) == ""),
    ]
    found = collect_findings(*[finding(f, when, record_id=F.col("package_id"), code=code, path=path) for code, when in rules])
    return found.groupBy("record_id", "code", "path").agg(F.count(F.lit(1)).alias("rows"))


def freshness_checks(spark: SparkSession, d: str) -> DataFrame:
    """Observations that are missing or not later than their baseline, the preceding delivery of the file."""
    r = table(spark, d, "raw_files").where(F.col("raw_id").isNotNull()).groupBy("raw_id", "snapshot_no").agg(F.max(F.struct("delivered_at", F.lower("content_sha256").alias("h"))).alias("r"))
    r = r.withColumn("base", F.lag("r.delivered_at").over(W.partitionBy("raw_id").orderBy("snapshot_no"))).where(F.col("base").isNotNull())
    rules = [("OBSERVATION_MISSING", F.col("r.h").isNull()), ("OBSERVATION_NOT_LATER", F.col("r.delivered_at") <= F.col("base"))]
    return integrity.first_violation(r, rules).select("raw_id", "snapshot_no", "code")


def check_errors(spark: SparkSession, d: str) -> DataFrame:
    """Checks of a day that name a user no customer stands for, or the same user twice."""
    e = table(spark, d, "events").where(F.col("event_type") == "error").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id")
    known = table(spark, d, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("user_id"))
    return integrity.key_errors(e, known, "user_id", ["day"], unknown="LEGAL_MONITOR_CHECK_SOURCE_UNKNOWN", duplicate="LEGAL_MONITOR_CHECK_DUPLICATE")


def unresolved_packages(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "facts").where(F.col("package_id").isNotNull())
    return integrity.unresolved(f, ["package_id"], "status", ["EVIDENCE_LINKED", "USER_ASSERTED"])


def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Evidence that a package's facts name against the evidence it has."""
    named = table(spark, d, "facts").select("package_id", F.explode("evidence_ids").alias("x")).select("package_id", normal_id(F.col("x")).alias("id"))
    known = table(spark, d, "evidence").select("package_id", normal_id(F.col("evidence_id")).alias("id"))
    return integrity.compared_sets(named.where("package_id IS NOT NULL"), known.where("package_id IS NOT NULL"), ["package_id"], "id")


def unused_evidence(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "facts").select("package_id", F.explode("evidence_ids").alias("x")).select("package_id", normal_id(F.col("x")).alias("id"))
    known = table(spark, d, "evidence").select("package_id", normal_id(F.col("evidence_id")).alias("id")).dropna().distinct()
    return integrity.dangling(known, used, ["package_id", "id"])


def anchor_chain(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose first anchor is not in their parse, whose anchor has no hash, or whose hash is not that of their assertion."""
    c = table(spark, d, "fact_candidate").select("fact_candidate_id", "parse_id", F.col("anchor_ids")[0].alias("anchor_id"), F.sha2(F.encode(F.coalesce("assertion_text", F.lit("")), "UTF-8"), 256).alias("assertion")).distinct()
    a = table(spark, d, "anchors").groupBy("parse_id", "anchor_id").agg(F.max(F.lower("text_sha256")).alias("hash"))
    hashes = a.where(F.col("hash").isNotNull()).select("parse_id", "anchor_id", "hash")
    bound = hashes.select("parse_id", "anchor_id", F.col("hash").alias("assertion"))
    steps = [("ANCHOR_MISSING", a.select("parse_id", "anchor_id"), ["parse_id", "anchor_id"]), ("ANCHOR_WITHOUT_HASH", hashes, ["parse_id", "anchor_id"]), ("ASSERTION_MISMATCH", bound, ["parse_id", "anchor_id", "assertion"])]
    return integrity.chain_breaks(c, steps).select("fact_candidate_id", "code")


def document_headers(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose header is wrong, by the first field that is."""
    rules = [("LANGUAGE_MISSING", F.col("lang").isNull()), ("LENGTH_MISMATCH", ~F.col("n_chars").eqNullSafe(F.length("text").cast("long"))), ("PACKAGE_MISSING", F.col("package_id").isNull()), ("TEXT_EMPTY", F.col("text") == "")]
    return integrity.first_violation(table(spark, d, "documents"), rules).select("doc_id", "code")


def parse_counts(spark: SparkSession, d: str) -> DataFrame:
    """Anchors and characters of each parse, and how many kinds it has; a parse of one kind is of one format."""
    a = table(spark, d, "anchors").where(F.col("parse_id").isNotNull()).select("parse_id", "anchor_id", "kind", "text").distinct()
    per = a.groupBy("parse_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    return per.groupBy("parse_id").agg(F.sum("n").alias("anchors"), F.sum("chars").alias("characters"), F.count(F.lit(1)).alias("kinds"))


# Files of every format, made of table rows.


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


_TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'


@F.pandas_udf(BinaryType())
def _docx(lines: pd.Series) -> pd.Series:
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = lambda x: "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for t in x)
    return lines.map(lambda x: _zipped({"[Content_Types].xml": _TYPES, "word/document.xml": f"<w:document {space}><w:body>{body(x)}</w:body></w:document>"}))


@F.pandas_udf(BinaryType())
def _xlsx(cells: pd.Series) -> pd.Series:
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def one(values):
        row = "".join(f'<c r="{chr(65 + i)}1" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for i, v in enumerate(values))
        return _zipped({
            "[Content_Types].xml": _TYPES,
            "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData><row r="1">{row}<c r="Z1"><f>A1</f><v>0</v></c></row></sheetData></worksheet>',
        })

    return cells.map(one)


@F.pandas_udf(BinaryType())
def _archive(names: pd.Series) -> pd.Series:
    return names.map(lambda x: _zipped({n: "" for n in x}))


def _anchors(files: DataFrame, key: str) -> DataFrame:
    found = parsed(files.withColumnRenamed(key, "file_id"))
    return found.select(F.col("file_id").cast("long").alias(key), "detected_format", "kind", "coordinate", "text", "warnings")


def docx_anchors(spark: SparkSession, d: str) -> DataFrame:
    lines = F.array(F.concat("s_name", F.lit(" <&> "), F.col("s_nationkey").cast("string")), F.lit(""), F.concat(F.lit("余额 "), F.col("s_suppkey").cast("string")))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("supplier"), F.lit("a.docx").alias("name"), _docx(lines).alias("content"))
    return _anchors(s, "supplier")


def xlsx_anchors(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("customer"), F.lit("b.xlsx").alias("name"), _xlsx(F.array("c_name", "c_mktsegment")).alias("content"))
    return _anchors(c, "customer")


def eml_anchors(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    text = F.concat(F.lit("Subject: "), "s_name", F.lit("\r\nFrom: a@example.test\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nNation "), F.col("s_nationkey").cast("string"), F.lit("\r\nEnd\r\n"))
    return _anchors(s.select(F.col("s_suppkey").cast("long").alias("supplier"), F.lit("c.eml").alias("name"), F.encode(text, "UTF-8").alias("content")), "supplier")


def zip_anchors(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(F.concat("c_mktsegment", F.lit("/x.txt")), F.concat("c_name", F.lit(".md")))
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("customer"), F.lit("d.zip").alias("name"), _archive(names).alias("content"))
    return _anchors(c, "customer")


def csv_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Rows with quotes, separators, line ends and empty cells, two to a file."""
    quoted = F.concat(F.lit('"'), F.col("c_name"), F.lit(', ""'), F.col("c_mktsegment"), F.lit('""\nx"'))
    line = F.concat_ws(",", quoted, F.lit(""), F.col("c_nationkey").cast("string"))
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("customer"), F.lit("e.csv").alias("name"), F.encode(F.concat(F.lit("\ufeff"), line, F.lit("\r\n"), line, F.lit("\n")), "UTF-8").alias("content"))
    return _anchors(c, "customer")


# JSON.


def jcs_orders(spark: SparkSession, d: str) -> DataFrame:
    """Nested objects with unordered keys, numbers of several sizes, nulls and escapes, and the hash of their canonical form."""
    price = F.col("o_totalprice").cast("double")
    inner = F.struct(F.col("o_orderstatus").alias("s\t\"q"), F.lit(None).cast("string").alias("none"), F.array(price / 1000, price * 1e6).alias("é"))
    text = F.to_json(F.struct(price.alias("total"), inner.alias("inner"), F.col("o_orderkey").alias("Key"), (F.col("o_orderkey") % 2 == 0).alias("even")), {"ignoreNullFields": "false"})
    return table(spark, d, "orders").select("o_orderkey", jcs(text).alias("canonical"), json_snapshot(text).alias("snapshot"))


QUERIES = {
    f.__name__: f
    for f in (
        typed_graph_cycle, typed_edge_checks, media_mismatch, file_relationships, file_times, monitor_by_source, monitor_alert_ids, candidate_matrix, exact_anchor_text, predecessor_check,
        allowlist_purposes, conflict_limit, report_exit_codes, text_diff_append, superseded_differences, selection_checks, raw_file_checks, object_paths, fact_findings, freshness_checks, check_errors, unresolved_packages, evidence_coverage, unused_evidence, anchor_chain, document_headers, parse_counts, docx_anchors, xlsx_anchors, eml_anchors, zip_anchors, csv_anchors, jcs_orders,
    )
}
from factloom.plans.checks_sql import SQL  # noqa: E402, F401
