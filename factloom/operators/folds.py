"""Folds over each key's rows in order, where a row's result depends on the results before it."""

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.canonical import identifier

# Outcomes and states of a monitored source.
FAILURES = ("UNAVAILABLE", "MISSED")
UNCHANGED, CHANGED, STALE, UNAVAILABLE, MISSED = "UNCHANGED_RESPONSE_BODY_CANDIDATE", "CHANGE_DETECTED_REVIEW_REQUIRED", "STALE_DRAFT_ONLY", "UNAVAILABLE_DRAFT_ONLY", "NOT_CHECKED_MISSED_DRAFT_ONLY"


def fold(rows: DataFrame, key: str, order: list[str], step: Callable[[Any, Any], tuple[Any, tuple]], schema: str) -> DataFrame:
    """``step(state, row)`` for each row of a key in order gives the next state and the columns of ``schema``; the state
    starts as None for each key.

    Rows are dealt to partitions by key and sorted there, and the fold reads them as a stream: a task holds one batch and
    one state, so the number of a key's rows is not bounded by memory. A chain of dependent steps is sequential by nature;
    different keys run in parallel.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, state = object(), None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = getattr(row, key)
                if k != known:
                    known, state = k, None
                state, result = step(state, row)
                out.append(result)
            yield pd.DataFrame(out, columns=names)

    return rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def reserve_step(last, now: int, interval: int) -> tuple[int | None, str]:
    """(last accepted time, decision) of one reservation; a refused one leaves the last accepted time as it was."""
    if last is not None and now < last:
        return last, "CLOCK_ROLLBACK"
    if last is not None and now - last < interval:
        return last, "INTERVAL_NOT_ELAPSED"
    return now, "ACCEPTED"


def reservations(requests: DataFrame, *, min_interval_us: int) -> DataFrame:
    """(key, request_id, at_us, decision): a request is accepted where at least the interval has passed since the key's last
    accepted one. requests(key, request_id, at_us) are taken in order of request_id; rows without a key or time give none."""

    def step(last, row):
        last, decision = reserve_step(last, row.at_us, min_interval_us)
        return last, (row.key, row.request_id, row.at_us, decision)

    asked = requests.where(F.col("at_us").isNotNull()).select("key", "request_id", "at_us")
    return fold(asked, "key", ["request_id"], step, "key long, request_id long, at_us long, decision string")


def monitor_step(state: dict | None, now: int, technical: str | None, interval: int, retry: int, window: int, budget: int) -> dict:
    """The state of a monitored source after a run at ``now`` (hours). ``technical`` is the status a check gave, or None
    where none was made: then a due source is missed and any other keeps its state. Only executed runs enter the window."""
    due = state is None or now >= state["next_due"]
    if technical is None and not due:
        return {**state, "execution": "CARRIED_FORWARD_NOT_DUE"}
    outcome = "MISSED" if technical is None else "UNAVAILABLE" if technical == UNAVAILABLE else "SUCCESS"
    recent = ((state["recent"] if state else ()) + (outcome,))[-window:]
    failures = sum(o in FAILURES for o in recent)
    return {
        "execution": "MISSED_DUE_CHECK" if technical is None else "CHECKED",
        "technical": MISSED if technical is None else technical,
        "next_due": now + (interval if outcome == "SUCCESS" else retry),
        "recent": recent,
        "failures": failures,
        "exhausted": failures > budget,
        "last_checked": now if technical is not None else state["last_checked"] if state else None,
    }


STATES = "key long, run_at long, execution string, technical string, next_due long, failures int, exhausted boolean, last_checked long"
RULES = ("interval", "retry", "window", "budget")


def with_rules(runs: DataFrame, definitions: DataFrame | None, defaults: dict[str, int]) -> DataFrame:
    """runs(key, run_at, technical) with the rules of their source: those of definitions(key, interval, retry, window, budget),
    each source once, and the defaults where a source or a rule has none."""
    runs = runs.select("key", "run_at", "technical")
    if definitions is None:
        return runs.withColumns({r: F.lit(defaults[r]) for r in RULES})
    own = runs.join(definitions.select("key", *[F.col(r).alias(f"_{r}") for r in RULES]), "key", "left")
    return own.select("key", "run_at", "technical", *[F.coalesce(f"_{r}", F.lit(defaults[r])).cast("int").alias(r) for r in RULES])


def monitor_states(runs: DataFrame, definitions: DataFrame | None = None, *, interval: int, retry: int, window: int, budget: int) -> DataFrame:
    """STATES of every source after every run. runs(key, run_at hours, technical or null), one row per source and run;
    definitions: see ``with_rules``."""

    def step(state, row):
        technical = row.technical if isinstance(row.technical, str) else None
        state = monitor_step(state, row.run_at, technical, row.interval, row.retry, row.window, row.budget)
        last = state["last_checked"]
        return state, (row.key, row.run_at, state["execution"], state["technical"], state["next_due"], state["failures"], state["exhausted"], last)

    return fold(with_rules(runs, definitions, {"interval": interval, "retry": retry, "window": window, "budget": budget}), "key", ["run_at"], step, STATES)


def _raised(urgency: Column) -> Column:
    """The up to two alerts of a state as an array of (code, severity)."""
    failure = F.when(urgency.isin("CRITICAL", "HIGH"), "HIGH").otherwise("WARNING")
    alert = lambda code, severity: F.struct(F.lit(f"LEGAL_SOURCE_{code}").alias("code"), severity.alias("severity"))
    status = F.col("technical")
    code = F.when(status == CHANGED, alert("CHANGE_DETECTED", F.lit("CRITICAL"))).when(status == UNAVAILABLE, alert("CHECK_UNAVAILABLE", failure))
    code = code.when(status == STALE, alert("CHECK_STALE", F.lit("HIGH"))).when(status == MISSED, alert("CHECK_MISSED", failure))
    spent = F.when(F.col("exhausted"), alert("ERROR_BUDGET_EXHAUSTED", F.when(urgency == "CRITICAL", "CRITICAL").otherwise("HIGH")))
    return F.array_compact(F.array(code, spent))


def alerts(states: DataFrame, *, urgency: Column | None = None) -> DataFrame:
    """(key, run_at, code, severity): up to two alerts of every state, carried-forward ones included; ``urgency``: that of the
    source, in whose absence nothing is urgent."""
    return states.select("key", "run_at", F.inline(_raised(F.coalesce(urgency, F.lit("")) if urgency is not None else F.lit(""))))


def identified(raised: DataFrame, *, evaluated_at: Column, source: Column, check_id: Column, check_sha256: Column) -> DataFrame:
    """``alerts`` with alert_id, from what was checked, when and where; a missed check has neither id nor hash."""
    made = F.col("code") != "LEGAL_SOURCE_CHECK_MISSED"
    own = {"check_id": F.when(made, check_id), "check_snapshot_sha256": F.when(made, check_sha256), "code": F.col("code"), "evaluated_at": evaluated_at, "source_monitor_id": source}
    return raised.withColumn("alert_id", identifier("LMALERT", **own))


def overall(states: DataFrame) -> DataFrame:
    """(run_at, alerts, overall) of each run over all sources, in one pass over the states."""
    codes = F.transform(_raised(F.lit("")), lambda a: a["code"])
    critical = F.arrays_overlap(codes, F.array(F.lit("LEGAL_SOURCE_CHANGE_DETECTED"), F.lit("LEGAL_SOURCE_ERROR_BUDGET_EXHAUSTED")))
    per = states.groupBy("run_at").agg(F.sum(F.size(codes)).alias("alerts"), F.bool_or(critical).alias("critical"))
    status = F.when(F.col("critical"), "CRITICAL_DRAFT_ONLY").when(F.col("alerts") > 0, "WARNING_DRAFT_ONLY").otherwise("HEALTHY_TECHNICALLY_UNCHANGED")
    return per.select("run_at", "alerts", status.alias("overall"))


def rolling_failures(runs: DataFrame, *, window: int, budget: int) -> DataFrame:
    """Executed runs(key, run_at, outcome) with the failures among the key's last ``window`` runs, itself included."""
    from pyspark.sql import Window as W

    w = W.partitionBy("key").orderBy("run_at").rowsBetween(1 - window, 0)
    failures = F.sum(F.when(F.col("outcome").isin(*FAILURES), 1).otherwise(0)).over(w)
    return runs.select("key", "run_at", failures.alias("failures")).withColumn("exhausted", F.col("failures") > budget)
