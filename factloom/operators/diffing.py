"""Exact line differences of two texts."""

import difflib

import pandas as pd
from pyspark.sql import DataFrame, functions as F

MAX_BYTES = 1024 * 1024
OPERATIONS = "diff_id string, idx int, tag string, from_start_line int, from_end_line int, to_start_line int, to_end_line int, removed_text string, added_text string"


def line_operations(old: str, new: str) -> list[tuple]:
    """(tag, from start, from end, to start, to end, removed, added) of each block that is not equal; half-open line ranges
    counted from 0, lines with their ends."""
    a, b = old.splitlines(keepends=True), new.splitlines(keepends=True)
    blocks = difflib.SequenceMatcher(None, a, b, autojunk=True).get_opcodes()
    return [(tag.upper(), i, j, k, n, "".join(a[i:j]), "".join(b[k:n])) for tag, i, j, k, n in blocks if tag != "equal"]


def unified_diffs(pairs: DataFrame) -> DataFrame:
    """(diff_id, unified_diff) of pairs(diff_id, old_name, old_text, new_name, new_text): three lines of context, '' for equal texts.
    Null counts as an empty text; a pair with a text of more than 1 MiB is refused, its unified_diff null."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                old, new = r.old_text or "", r.new_text or ""
                small = max(len(old.encode()), len(new.encode())) <= MAX_BYTES
                lines = difflib.unified_diff(old.splitlines(keepends=True), new.splitlines(keepends=True), r.old_name or "", r.new_name or "") if small else ()
                out.append((r.diff_id, "".join(lines) if small else None))
            yield pd.DataFrame(out, columns=["diff_id", "unified_diff"])

    return pairs.selectExpr("cast(diff_id as string) as diff_id", "old_name", "old_text", "new_name", "new_text").mapInPandas(run, "diff_id string, unified_diff string")


def text_differences(pairs: DataFrame) -> DataFrame:
    """OPERATIONS that turn old_text into new_text, for pairs(diff_id, old_text, new_text).

    Null counts as an empty text. A pair with a text of more than 1 MiB is refused, never cut: its one row has tag REFUSED
    and index -1.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                old, new = r.old_text or "", r.new_text or ""
                if max(len(old.encode()), len(new.encode())) > MAX_BYTES:
                    out.append((r.diff_id, -1, "REFUSED", 0, 0, 0, 0, "", ""))
                else:
                    out += [(r.diff_id, i, *op) for i, op in enumerate(line_operations(old, new))]
            yield pd.DataFrame(out, columns=[f.split()[0] for f in OPERATIONS.split(", ")])

    return pairs.select(F.col("diff_id").cast("string").alias("diff_id"), "old_text", "new_text").mapInPandas(run, OPERATIONS)


def overlapping_operations(operations: DataFrame) -> DataFrame:
    """Operations that start before the end of one before them, in either text."""
    from pyspark.sql import Window as W

    w = W.partitionBy("diff_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    return operations.where((F.col("from_start_line") >= 0) & (F.col("idx") >= 0)).withColumns({"_a": F.max("from_end_line").over(w), "_b": F.max("to_end_line").over(w)}).where(
        (F.col("from_start_line") < F.col("_a")) | (F.col("to_start_line") < F.col("_b"))
    ).drop("_a", "_b")
