from cytomill.streaming import incremental as inc


def test_append_is_idempotent_over_restarts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 2.0), (2, 3.0)], "image long, v double").write.parquet(src)
    schema = spark.read.parquet(src).schema
    inc.append_metrics(inc.file_stream(spark, src, schema), ["image"], out)
    spark.createDataFrame([(2, 9.0), (3, 4.0)], "image long, v double").write.mode("append").parquet(src)
    got = inc.append_metrics(inc.file_stream(spark, src, schema), ["image"], out)
    assert sorted((r["image"], r["v"]) for r in got.collect()) == [(1, 2.0), (2, 3.0), (3, 4.0)]


def test_late_channel_turns_a_field_ready(spark, tmp_path):
    from datetime import datetime, timedelta

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = datetime(2024, 1, 1)
    spark.createDataFrame([("f", "DNA", t)], "field string, ch string, ts timestamp").write.parquet(src)
    schema = spark.read.parquet(src).schema
    run = lambda: inc.latest(inc.run_to_table(inc.readiness(inc.file_stream(spark, src, schema), ["field"], "ch", ["DNA", "ER"], "ts", "1 day", "7 days"), out, "update"), ["field"])
    assert [r["ready"] for r in run().collect()] == [False]
    spark.createDataFrame([("f", "ER", t + timedelta(days=5))], "field string, ch string, ts timestamp").write.mode("append").parquet(src)
    assert [r["ready"] for r in run().collect()] == [True]


def test_sessions_come_once_over_batches_and_restarts(spark, tmp_path):
    from datetime import datetime, timedelta

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = datetime(2024, 1, 1)
    rows = [[("a", 0), ("a", 1), ("b", 1)], [("a", 3), ("b", 20)], [("a", 90), ("z", 400)], [("z", 800)]]
    for part in rows:
        spark.createDataFrame([(u, t + timedelta(hours=h)) for u, h in part], "u string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
        s = inc.sessions(inc.file_stream(spark, src, spark.read.parquet(src).schema, 1), "ts", "6 hours", ["u"], "1 day")
        got = inc.run_to_table(s, out)
    hours = lambda x: int((x - t).total_seconds() // 3600)
    assert sorted((r["u"], hours(r["start"]), r["n"]) for r in got.where("u <> 'z'").collect()) == [("a", 0, 3), ("a", 90, 1), ("b", 1, 1), ("b", 20, 1)]


def test_whole_results_are_no_table_of_batches(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError, match="complete"):
        inc.run_to_table(spark.range(1), str(tmp_path), "complete")
