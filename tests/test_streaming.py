from ravand.streaming.progress import progress_counts, strict_sessions


def test_progress(spark, tmp_path):
    rows = [("f", 1, "pending", "2025-01-01 00:10:00"), ("f", 1, "pending", "2025-01-01 00:11:00"), ("f", 2, "completed", "2025-01-01 00:20:00"), ("g", 1, "pending", "2025-01-01 01:20:00")]
    df = spark.createDataFrame(rows, "file_id string, chunk_id long, status string, at string").selectExpr("file_id", "chunk_id", "status", "cast(at as timestamp) as ingested_at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = progress_counts(stream).writeStream.outputMode("complete").format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["status"], r["n"]) for r in spark.table("progress").collect()) == [("completed", 1), ("pending", 1), ("pending", 1)]


def run_sessions(spark, folder, batches, late):
    """Segments written file by file, each a micro-batch of its own."""
    schema = "file_id string, start_time double, end_time double"
    q = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if q is None:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            q = strict_sessions(stream, 3.0, late, None).writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", f"{folder}/c").start()
        q.processAllAvailable()
    q.stop()
    return sorted((r["start_time"], r["end_time"], r["n_segments"]) for r in spark.table("sessions").collect())


def test_sessions_with_a_strict_gap(spark, tmp_path):
    rows = [("f", 0.0, 1.0), ("f", 3.9, 5.0), ("f", 8.0, 9.0), ("f", 20.0, 21.0)]
    assert run_sessions(spark, tmp_path, [rows], 0.0) == [(0.0, 5.0, 2), (8.0, 9.0, 1)]


def test_sessions_of_late_segments(spark, tmp_path):
    """Segments that come late and out of order join their sessions; one that comes too late is left out."""
    batches = [[("f", 0.0, 1.0), ("f", 8.0, 9.0)], [("f", 3.5, 5.5)], [("f", 30.0, 31.0), ("f", 2.0, 3.0)], [("f", 6.0, 7.0)], [("f", 60.0, 61.0)], [("f", 1.0, 2.0), ("f", 90.0, 91.0)]]
    assert run_sessions(spark, tmp_path, batches, 25.0) == [(0.0, 9.0, 5), (30.0, 31.0, 1), (60.0, 61.0, 1)]
