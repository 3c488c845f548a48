import hashlib

import pytest

from grainmill.sources import tables
from grainmill.streaming import gauge


def test_strict_json_refuses_other_keys(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "s": "x"}\n\n{"id": 2, "s": "y"}\n')
    (tmp_path / "b.jsonl").write_text('{"id": 1, "s": "x", "more": 1}\n')
    assert [tuple(r) for r in tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id long, s string").collect()] == [(1, "x"), (2, "y")]
    with pytest.raises(Exception, match="unexpected keys"):
        tables.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id long, s string").collect()


def test_csv_header_is_exact(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    assert tables.read_csv_exact(spark, str(tmp_path / "a.csv"), ["a", "b"]).count() == 1
    with pytest.raises(ValueError):
        tables.read_csv_exact(spark, str(tmp_path / "a.csv"), ["b", "a"])


def test_pins_and_write_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.bin").write_bytes(b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    pins = spark.createDataFrame([("f.bin", good, 3), ("g.bin", good, 3)], "name string, sha256 string, size long")
    assert dict(tables.read_pinned(spark, str(tmp_path / "in"), pins).select("name", "ok").collect()) == {"f.bin": True, "g.bin": False}
    tables.write_once(spark.range(3), str(tmp_path / "out"))
    with pytest.raises(Exception):
        tables.write_once(spark.range(3), str(tmp_path / "out"))
    tables.write_sharded(spark.range(50), str(tmp_path / "sharded"), "id")
    assert spark.read.parquet(str(tmp_path / "sharded")).count() == 50


def test_gauge_and_watchdog_on_a_stream(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:00:20"), (3, "a", "2024-01-01 00:00:30"), (4, "b", "2024-01-01 05:00:00"), (5, "b", "2024-01-01 09:00:00")]
    df = spark.createDataFrame(rows, "id long, kind string, t string").selectExpr("id", "kind", "cast(t as timestamp) ts")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = gauge.rate_gauge(stream, "ts", "kind", "1 hour", "1 hour").writeStream.outputMode("append").format("memory").queryName("gauge").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["kind"], r["n"]) for r in spark.table("gauge").collect()} >= {("a", 3)}
    q = gauge.burst_watchdog(stream, "ts", "kind", 60, 2, 900).writeStream.outputMode("append").format("memory").queryName("alarms").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["key"], r["n"]) for r in spark.table("alarms").collect()] == [("a", 2)]


def test_health_steps():
    from grainmill.streaming.gauge import health_steps

    go, state, said = health_steps(total=8, floor=2, step=2, within_s=60, least=2, watch_s=900), None, []
    for row in [(0, "tick", None), (5, "ramp", 10), (6, "ramp", 12), (910, "refusal", None), (920, "refusal", None), (930, "tick", None), (940, "tick", None), (1000, "ramp", 4), (1829, "tick", None), (1830, "tick", None), (1831, "ramp", 5), (1832, "ramp", 4)]:
        state, action = go(state, *row)
        said += [(action, state[1])] if action else []
    assert said == [("watching", 8), ("ramped", 10), ("refused", 10), ("downscaled", 2), ("watching", 2), ("refused", 2), ("watching", 2), ("storm_cleared", 2), ("refused", 2), ("ramped", 4)]


def test_health_gate_stream(spark, tmp_path):
    from grainmill.streaming.gauge import health_gate, health_steps

    rows = [("a", 1, "refusal", None), ("a", 2, "refusal", None), ("a", 3, "tick", None), ("b", 3, "tick", None), ("b", 4, "ramp", 9)]
    spark.createDataFrame(rows, "who string, t long, kind string, wanted long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("who string, t long, kind string, wanted long").parquet(str(tmp_path / "in"))
    out = health_gate(stream, "who", health_steps(8, 2, 2, 60, 2, 900))
    done = out.writeStream.format("memory").queryName("gate").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert done.awaitTermination(120)
    assert sorted(map(tuple, spark.table("gate").collect())) == [("a", 3, "downscaled", 2), ("b", 3, "watching", 8), ("b", 4, "ramped", 9)]
