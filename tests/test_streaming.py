from datetime import datetime, timedelta

from foliospark.streaming import trends


def test_daily_counts_and_upsert(spark, tmp_path):
    source, day = str(tmp_path / "in"), datetime(2024, 1, 1)
    rows = [(i, day + timedelta(hours=5 * i), "a" if i % 2 else "b") for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, event_type string")
    df.write.parquet(source)
    stream = trends.follow(spark, source, df.schema)
    query = trends.run_available(trends.daily_counts(stream), str(tmp_path / "out"), str(tmp_path / "c1"))
    query.awaitTermination(120)
    closed = {(r.day, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {}
    for _, ts, kind in rows:
        want[ts.strftime("%Y-%m-%d"), kind] = want.get((ts.strftime("%Y-%m-%d"), kind), 0) + 1
    assert closed and all(want[k] == n for k, n in closed.items())

    write = trends.upsert(str(tmp_path / "table"), ["event_type"], "ts")
    write(df.where("id < 10"), 0)
    write(df.where("id >= 10"), 1)
    write(df.where("id >= 10"), 1)  # repeated after a failure
    last = {r.event_type: r.id for r in trends.upserted(spark, str(tmp_path / "table")).collect()}
    assert last == {"a": 19, "b": 18}
    write(df.where("id = 19").withColumn("id", df.id + 100), 2)
    assert {r.event_type: r.id for r in trends.upserted(spark, str(tmp_path / "table")).collect()} == {"a": 119, "b": 18}
