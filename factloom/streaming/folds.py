"""The folds as streaming queries: the same steps, with the state kept by Spark between micro-batches."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.folds import monitor_step, reserve_step, with_rules


def reservations(requests: DataFrame, *, min_interval_us: int) -> DataFrame:
    """(key, request_id, at_us, decision) of a stream requests(key, request_id, at_us).

    Rows of one micro-batch are taken in order of request_id. A request older than the last accepted one is refused as a
    clock rollback, whenever it comes; no watermark drops it. A key has one state, so one writer.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("request_id")
        decisions = []
        for now in rows["at_us"]:
            last, decision = reserve_step(last, int(now), min_interval_us)
            decisions.append(decision)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"key": rows["key"], "request_id": rows["request_id"], "at_us": rows["at_us"], "decision": decisions})

    return requests.select("key", "request_id", "at_us").groupBy("key").applyInPandasWithState(
        step, "key long, request_id long, at_us long, decision string", "last long", "append", GroupStateTimeout.NoTimeout
    )


def monitor_states(runs: DataFrame, definitions: DataFrame | None = None, *, interval: int, retry: int, window: int, budget: int) -> DataFrame:
    """States of a stream runs(key, run_at, technical), with the rules of a static table of definitions: key, run_at, execution, technical, next_due, failures, exhausted.

    A run at or before the source's last one is late: it gets the execution TIME_ROLLBACK_REFUSED and changes nothing.
    """
    schema = "key long, run_at long, execution string, technical string, next_due long, failures int, exhausted boolean"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, at = None, None
        if state.exists:
            at, execution, technical, due, recent, failures, exhausted, last = state.get
            known = {"execution": execution, "technical": technical, "next_due": due, "recent": tuple(x for x in recent.split(",") if x), "failures": failures, "exhausted": exhausted, "last_checked": last if last >= 0 else None}
        out = []
        for r in pd.concat(list(batches)).sort_values("run_at").itertuples(index=False):
            if at is not None and r.run_at <= at:
                out.append((r.key, r.run_at, "TIME_ROLLBACK_REFUSED", known["technical"], known["next_due"], known["failures"], known["exhausted"]))
                continue
            at = int(r.run_at)
            known = monitor_step(known, at, r.technical if isinstance(r.technical, str) else None, int(r.interval), int(r.retry), int(r.window), int(r.budget))
            out.append((r.key, at, known["execution"], known["technical"], known["next_due"], known["failures"], known["exhausted"]))
        last = known["last_checked"]
        state.update((at, known["execution"], known["technical"], known["next_due"], ",".join(known["recent"]), known["failures"], known["exhausted"], -1 if last is None else last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    ruled = with_rules(runs, definitions, {"interval": interval, "retry": retry, "window": window, "budget": budget})
    return ruled.groupBy("key").applyInPandasWithState(
        step, schema, "at long, execution string, technical string, next_due long, recent string, failures int, exhausted boolean, last_checked long", "append", GroupStateTimeout.NoTimeout
    )
