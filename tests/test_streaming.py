from stratograph.streaming import feed


def test_parse_stream_replays_nothing(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("def a():\n    return b()\n")
    run = lambda: feed.parse_stream(spark, str(root), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert run()
    (root / "b.py").write_text("def b():\n    return 1\n")
    assert run() and run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["path"] for r in got.collect()} == {"a.py", "b.py"} and got.count() == 2


def test_journal_stream(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1L, 'a', 'upsert', timestamp'2025-01-01 01:00:00'), (1L, 'a', 'upsert', timestamp'2025-01-01 01:00:00'), (2L, 'a', 'delete', timestamp'2025-01-02 01:00:00') AS t(seq, node_id, op, recorded_at)")
    rows.write.parquet(str(tmp_path / "j"))
    q = feed.journal_stream(spark, str(tmp_path / "j")).writeStream.format("memory").queryName("journal").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.table("journal").count() == 2
    assert {(str(r["start"])[:10], r["op"], r["entries"]) for r in feed.journal_rates(rows).collect()} == {("2025-01-01", "upsert", 2), ("2025-01-02", "delete", 1)}
