"""Findings: what every rule emits, and the report they roll up to."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

COLUMNS = ("record_id", "code", "path", "message", "severity")


def finding(rows: DataFrame, when: Column, *, record_id: Column, code: str | Column, path: Column, message: str | Column = "", severity: str = "P1") -> DataFrame:
    """One finding for each row where the condition is true; null is not true."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.where(when).select(record_id.alias("record_id"), text(code).alias("code"), path.alias("path"), text(message).alias("message"), F.lit(severity).alias("severity"))


def collect_findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def report(findings: DataFrame, records: DataFrame) -> DataFrame:
    """One row per record of records(record_id): allowed, exit code, counts by severity and code, and what no check may ever claim.

    Codes are counted in a first aggregation, so the list of a record holds each code once however many findings it has.
    """
    per_code = findings.groupBy("record_id", "code").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), F.sum(F.when(F.col("severity") == "P0", 1).otherwise(0)).alias("p0"))
    rolled = per_code.groupBy("record_id").agg(
        F.sum("n").alias("findings"), F.sum("p0").alias("p0_findings"), F.array_join(F.array_sort(F.collect_list(F.concat(F.col("code"), F.lit(":"), F.col("n").cast("string")))), ",").alias("codes")
    )
    r = records.select("record_id").distinct().join(rolled, "record_id", "left")
    return r.select(
        "record_id",
        F.col("findings").isNull().alias("allowed"),
        F.col("findings").isNotNull().cast("int").alias("exit_code"),
        F.coalesce("findings", F.lit(0)).alias("findings"),
        F.coalesce("p0_findings", F.lit(0)).alias("p0_findings"),
        F.coalesce("codes", F.lit("")).alias("codes"),
        F.lit(False).alias("submission_ready"),
        F.lit(True).alias("legal_review_required"),
    )


def guided(findings: DataFrame, guidance: DataFrame, default_zh: str, default_remediation: str) -> DataFrame:
    """Findings with the message and remedy of guidance(code, message_zh, remediation), or the defaults."""
    return findings.join(guidance, "code", "left").withColumns(
        {"message_zh": F.coalesce("message_zh", F.lit(default_zh)), "remediation": F.coalesce("remediation", F.lit(default_remediation))}
    )
