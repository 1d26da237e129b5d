"""The same functions on streams as on tables."""

from orrery.streaming import snapshots

ROWS = [(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", "ab"[i % 2], float(i)) for i in range(40)]


def stream(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, ts string, kind string, value double").selectExpr("id", "cast(ts AS timestamp) AS ts", "kind", "value")
    df.write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_report_and_snapshots(spark, tmp_path):
    table, live = stream(spark, tmp_path)
    seen = []
    q = snapshots.snapshots(snapshots.running_report(live, "kind", "value"), lambda df, n: seen.append({(r.kind, r.mean, r.n) for r in df.collect()}), str(tmp_path / "cp"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert seen[-1] == {(r.kind, r.mean, r.n) for r in snapshots.running_report(table, "kind", "value").collect()}


def test_windows_and_ledger(spark, tmp_path):
    table, live = stream(spark, tmp_path)
    want = {(r.start, r.kind, r.n, r.total) for r in snapshots.windowed(table, "ts", "kind", "value", "1 day", "10 days").collect()}
    for name, df, mode in (("w", snapshots.windowed(live, "ts", "kind", "value", "1 day", "10 days"), "complete"), ("l", snapshots.ledger(live, ["kind"], "ts", "10 days"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {(r.start, r.kind, r.n, r.total) for r in spark.table("w").collect()} == want
    assert spark.table("l").count() == snapshots.ledger(table, ["kind"], "ts", "1 day").count() == 2
