from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidemark.plans import costs
from tidemark.streaming import bars as stream
from tidemark.streaming import quotes

T0 = datetime(2025, 3, 12, 22, 30)


def test_quote_durations_are_those_of_the_batch(spark, tmp_path):
    """Three files, ticks out of order within the watermark, a midnight, gaps beyond a minute, quotes without a bid."""
    rng = np.random.default_rng(4)
    at = np.sort(rng.integers(0, 9000, 500))
    at = at[(at // 400) % 4 != 2]
    ticks = [("AB"[int(rng.integers(2))], T0 + timedelta(seconds=int(s), milliseconds=int(rng.integers(1000))), i, float(rng.integers(0, 9) > 0) * 100.0, 100.0 + 0.01 * int(rng.integers(0, 4))) for i, s in enumerate(at.tolist())]
    schema = "symbol string, ts_utc timestamp_ntz, event_id long, bid double, ask double"
    thirds = [ticks[: len(ticks) // 3], ticks[len(ticks) // 3 : 2 * len(ticks) // 3], ticks[2 * len(ticks) // 3 :]]
    for part in thirds:
        order = rng.permutation(len(part))
        spark.createDataFrame([part[i] for i in order], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with stream.state_in_rocksdb(spark):
            stream.run_to_table(quotes.durations(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
    limit = max(t[1] for t in ticks) - timedelta(minutes=1)
    whole = costs.histogram(spark.createDataFrame(ticks, schema))
    end = F.timestamp_add("SECOND", F.lit(60), F.timestamp_add("MINUTE", F.lit(5), F.window(F.col("ts_utc").cast("timestamp"), "5 minutes")["start"])).cast("timestamp_ntz")
    want = whole.where(end <= F.lit(limit))
    plain = lambda df: sorted((r.symbol, r.ts_utc, r.spread_points, round(r.seconds, 6), r.ticks) for r in df.collect())
    got = plain(spark.read.parquet(f"{tmp_path}/out"))
    assert got == plain(want) and len(got) > 100


def test_sessions_are_merged_before_the_shuffle(spark, tmp_path, capsys):
    ticks = [("A", T0 + timedelta(seconds=30 * i + 3600 * (i // 40)), i, 1.0, 1.0) for i in range(200)]
    schema = "symbol string, ts_utc timestamp_ntz, event_id long, bid double, ask double"
    spark.createDataFrame(ticks, schema).repartition(3).write.parquet(f"{tmp_path}/in")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with stream.merged_before_shuffle(spark):
        rows = stream.sessions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "10 minutes")
        query = rows.writeStream.outputMode("append").format("memory").queryName("merged").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    query.explain()
    plan = capsys.readouterr().out
    assert "MergingSessions" in plan[plan.rindex("Exchange hashpartitioning") :]
    assert [r.ticks for r in spark.table("merged").orderBy("starts").collect()] == [40] * 4  # the last run may go on
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == was
