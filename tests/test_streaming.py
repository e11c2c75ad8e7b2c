"""Streams driven to their end over files."""

import json

from runlore.streaming import capture


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def test_sessions_keep_state_between_batches(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    ev = lambda c, ts, repo="/a": {"command": c, "ts": ts, "dir": "/", "repo": repo}
    from pyspark.sql import functions as F

    def run():
        s = capture.live_sessions(capture.event_stream(spark, str(src)).withColumn("device", F.lit("d")))
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.started_at, r.ended_at, r.repo, r.commands) for r in spark.read.parquet(out).collect())

    write(src / "1.jsonl", [ev("a", 100), ev(" hidden", 120), ev("b", 400), ev("c", 701)])
    assert run() == [(380, 400, "/a", ["a", "b"])]
    write(src / "2.jsonl", [ev("d", 800), ev("e", 801, "/b"), ev("f", 802, "/b")])
    assert run() == [(380, 400, "/a", ["a", "b"]), (780, 800, "/a", ["c", "d"])]


def test_picks_and_windows(spark, tmp_path):
    src = tmp_path / "p"
    src.mkdir()
    write(src / "1.json", [{"command": "a", "ts": 0}, {"command": "a", "ts": 0}, {"command": "b", "ts": 0}])
    sel = lambda: spark.readStream.schema("command string, ts long").json(str(src))
    capture.keep_picks(sel(), str(tmp_path / "t"), lambda: 0, str(tmp_path / "c")).awaitTermination()
    write(src / "2.json", [{"command": "b", "ts": 21 * 86400}])
    capture.keep_picks(sel(), str(tmp_path / "t"), lambda: 21 * 86400, str(tmp_path / "c")).awaitTermination()
    assert {(r.command, r["count"]) for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()} == {("a", 1.0), ("b", 1.5)}
    w = tmp_path / "w"
    w.mkdir()
    write(w / "1.jsonl", [{"command": "a", "ts": 10, "dir": "", "exit_code": 1}, {"command": "b", "ts": 20, "dir": ""}, {"command": "c", "ts": 400, "dir": ""}])
    q = capture.windowed_counts(capture.event_stream(spark, str(w))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.failed) for r in spark.table("w").collect()) == [(1, 0), (2, 1)]


def test_maintenance_runs_every_so_often(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    calls = []
    go = lambda: capture.maintained(capture.event_stream(spark, str(src)), str(tmp_path / "t"), str(tmp_path / "c"), calls.append, 3).awaitTermination()
    write(src / "1.jsonl", [{"command": "a", "ts": n, "dir": "", "repo": "/r"} for n in range(4)])
    go()
    assert len(calls) == 1 and spark.read.parquet(str(tmp_path / "t")).count() == 4
