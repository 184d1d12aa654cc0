from datetime import datetime, timedelta

from tidemark.plans import simulate


def test_the_path_is_not_shuffled_by_symbol(spark):
    """Medians are one row a symbol; joined by a shuffle, all minutes of a symbol would be one task and one file."""
    at = [datetime(2025, 3, 12) + timedelta(minutes=i) for i in range(6)]
    minute = spark.createDataFrame([("A", t, 1.0, 1.0, 1.0, 1.0) for t in at], "symbol string, ts_utc timestamp_ntz, open double, high double, low double, close double")
    costs = spark.createDataFrame([("A", t, 1.0 + i, 2.0 + i, 3.0 + i, False, "measured") for i, t in enumerate(at[:3])], "symbol string, ts_utc timestamp_ntz, spread_optimistic double, spread_base double, spread_pessimistic double, in_rollover_window boolean, spread_source string")
    key, was = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        out = simulate.path_of(minute, costs)
        assert "BroadcastHashJoin [symbol" in out._jdf.queryExecution().executedPlan().toString()
        assert [r.spread_base for r in out.orderBy("ts_utc").collect()] == [2.0, 3.0, 4.0, 3.0, 3.0, 3.0]
    finally:
        spark.conf.set(key, was)
