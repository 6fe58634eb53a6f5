from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ferrule.sources import files
from ferrule.streaming import sessions


def test_workspace_reader(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_bytes(b"\xef\xbb\xbfx = 1\n")
    (tmp_path / "b.bin").write_bytes(b"a\x00b")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "d.txt").write_bytes(b"  \n")
    (tmp_path / "e.txt").write_bytes(b"y" * (256 * 1024 + 1))
    got = {r["path"]: (r["skip"], r["text"]) for r in files.read_workspace(spark, str(tmp_path)).collect()}
    assert got["src/a.py"] == (None, "x = 1\n")
    assert {p: s for p, (s, _) in got.items() if s} == {"b.bin": "binary", "c.txt": "not_utf8", "d.txt": "blank", "e.txt": "too_large"}


def test_call_log_round_trip(spark, tmp_path):
    rows = [(1, f"2026-0{m}-05T10:00:00Z", "w", "normal", True, 200, None, 5, 10, 1) for m in (3, 4, 5)]
    files.write_calls(spark.createDataFrame(rows, files.CALL_LINE), str(tmp_path / "log"))
    assert files.read_calls(spark, str(tmp_path / "log"), "2026-04-01").count() == 2


def test_manifest_changes(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, digest string")
    b = spark.createDataFrame([("y", "3"), ("z", "4")], "path string, digest string")
    assert {tuple(r) for r in files.manifest_changes(a, b).collect()} == {("x", "removed"), ("y", "changed"), ("z", "added")}


def test_session_memory_stream(spark, tmp_path):
    t = datetime(2026, 3, 1, 10)
    rows = [("s", t, "a", 10), ("s", t + timedelta(seconds=5), "a", 10), ("s", t + timedelta(seconds=700), "a", 10), ("u", t, "a", 10)]
    spark.createDataFrame(rows, "session string, ts timestamp, item string, size long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, ts timestamp, item string, size long").parquet(str(tmp_path / "in"))
    q = sessions.remembered(stream).writeStream.format("memory").queryName("memory_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    got = [(r["session"], r["repeat"]) for r in spark.table("memory_out").orderBy("session", "ts").collect()]
    assert got == [("s", False), ("s", True), ("s", False), ("u", False)]


def test_incremental_refresh(spark, tmp_path):
    """Of two versions in one batch the later counts, whatever their digests; deleted files and versions without rows
    leave none behind; a batch that runs again changes nothing."""
    schema = "path string, text string, digest string, modified long"
    write = sessions.refresh_into(str(tmp_path / "out"), lambda df: df.where("text <> ''").select("path", F.length("text").alias("n")))
    batches = [[("a", "one", "9", 1), ("a", "three", "1", 2), ("b", "two", "2", 1), ("c", "gone", "3", 1), ("d", "x", "4", 1)], [("c", None, "0", 5), ("d", "", "5", 5)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    write(spark.createDataFrame(batches[1], schema), 1)
    got = sessions.latest(spark, str(tmp_path / "out"))
    assert {(r["path"], r["n"]) for r in got.collect()} == {("a", 5), ("b", 3)}


def test_largest_skipped_files(spark):
    rows = [("a", "too_large", 10), ("b", "binary", 99), ("c", "too_large", 30), ("d", None, 5), ("e", "too_large", 30)]
    got = files.skipped(spark.createDataFrame(rows, "path string, skip string, bytes long"), 3).orderBy("place").collect()
    assert [r["path"] for r in got] == ["c", "e", "a"]


def test_ignored_files(spark, tmp_path):
    for name in ("a.txt", "b.log"):
        (tmp_path / name).write_text("x\n")
    ignored = spark.createDataFrame([(r"\.log$",)], "pattern string")
    assert [r["path"] for r in files.read_workspace(spark, str(tmp_path), ignored).collect()] == ["a.txt"]


def test_sessions_release_only_their_own(spark):
    from ferrule import session

    kept = session.materialize(spark.range(3), "kept")
    other = spark.newSession()
    other.conf.set("ferrule.shared.dir", session.shared_dir(spark))
    session.materialize(other.range(2), "other")
    assert session.session_dir(other) != session.session_dir(spark)
    session.release(other)
    assert kept.count() == 3
