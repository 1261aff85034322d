from factloom.operators import folds
from factloom.streaming import folds as streaming


def drain(spark, source, folder, build, schema, name):
    """Two runs over a folder that grows in between, with the state kept in the checkpoint."""
    out = []
    for rows in source:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = build(spark.readStream.schema(schema).parquet(str(folder / "in")))
        query = stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        out = [tuple(r) for r in spark.read.parquet(str(folder / "out")).collect()]
    return sorted(out, key=repr)


def test_reservations_continue_after_a_restart(spark, tmp_path):
    schema = "key long, request_id long, at_us long"
    first, second = [(1, 1, 100), (1, 2, 150), (2, 3, 100)], [(1, 4, 210), (1, 5, 90), (2, 6, 199)]
    got = drain(spark, [first, second], tmp_path, lambda s: streaming.reservations(s, min_interval_us=100), schema, "r")
    want = folds.reservations(spark.createDataFrame(first + second, schema), min_interval_us=100)
    assert got == sorted((tuple(r) for r in want.collect()), key=repr)


def test_monitor_refuses_late_runs(spark, tmp_path):
    schema = "key long, run_at long, technical string"
    first, second = [(1, 0, folds.UNCHANGED), (1, 24, None), (1, 48, None)], [(1, 24, folds.CHANGED), (1, 72, folds.UNAVAILABLE), (2, 0, None)]
    rule = {"interval": 48, "retry": 24, "window": 3, "budget": 1}
    got = drain(spark, [first, second], tmp_path, lambda s: streaming.monitor_states(s, **rule), schema, "m")
    want = folds.monitor_states(spark.createDataFrame([*first, second[1], second[2]], schema), **rule).select("key", "run_at", "execution", "technical", "next_due", "failures", "exhausted")
    late = [r for r in got if r[2] == "TIME_ROLLBACK_REFUSED"]
    assert [r[:2] for r in late] == [(1, 24)] and sorted(set(got) - set(late), key=repr) == sorted((tuple(r) for r in want.collect()), key=repr)


def test_monitor_with_rules_of_each_source(spark, tmp_path):
    schema = "key long, run_at long, technical string"
    first, second = [(1, 0, folds.UNCHANGED), (2, 0, None), (3, 0, None)], [(1, 24, None), (2, 24, None), (3, 24, folds.UNCHANGED), (1, 48, None)]
    rules = spark.createDataFrame([(1, 24, 12, 2, 1), (2, 48, None, 5, 0)], "key long, interval int, retry int, window int, budget int")
    rule = {"interval": 48, "retry": 24, "window": 3, "budget": 1}
    got = drain(spark, [first, second], tmp_path, lambda s: streaming.monitor_states(s, rules, **rule), schema, "n")
    want = folds.monitor_states(spark.createDataFrame(first + second, schema), rules, **rule).select("key", "run_at", "execution", "technical", "next_due", "failures", "exhausted")
    assert got == sorted((tuple(r) for r in want.collect()), key=repr)
