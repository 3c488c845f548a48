"""File sources and sinks on small files, sound and unsound; distances of meshes by sampling; ranks and selections by brute force."""

import hashlib
import io
import json
import struct
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.operators import mesh, reconcile, select
from grainmill.sources import files, tables


def test_line_index(spark, tmp_path):
    content = 'one\n{"a": "é"}\r\n\nlast'.encode()
    (tmp_path / "x.jsonl").write_bytes(content)
    rows = files.read_line_index(spark, str(tmp_path / "x.jsonl")).orderBy("line").collect()
    assert [(r["line"], r["offset"], r["length"]) for r in rows] == [(1, 0, 4), (2, 4, 13), (3, 17, 1), (4, 18, 4)]
    assert all(hashlib.sha256(content[r["offset"] : r["offset"] + r["length"]]).hexdigest() == r["sha256"] for r in rows)


@pytest.mark.parametrize(
    "doc,want",
    [
        ([3, 1], {(1, None), (3, None)}),
        ([{"qid": 3}, {"id": 4}], {(3, None), (4, None)}),
        ({"qids": [1, 2], "qids_by_category": {"a": [1], "b": [2]}}, {(1, "a"), (2, "b")}),
        ({"qids_by_category": {"a": [5]}}, {(5, "a")}),
        ([1, 1], None),
        ({"qids": [1, 2], "qids_by_category": {"a": [1]}}, None),
        ({"qids": []}, None),
    ],
)
def test_membership(spark, tmp_path, doc, want):
    (tmp_path / "m.json").write_text(json.dumps(doc))
    read = files.read_membership(spark, str(tmp_path / "m.json")).select("qid", "category")
    if want is None:
        with pytest.raises(Exception, match="unsound membership"):
            read.collect()
    else:
        assert {tuple(r) for r in read.collect()} == want


def test_attempts_arrays_meshes(spark, tmp_path):
    at = tmp_path / "attempts" / "q7" / "b16384" / "finalized" / "q7"
    at.mkdir(parents=True)
    (at / "trace_q7.json").write_text("{}")
    (at / "trace_q8.json").write_text("{}")
    assert [(r["qid"], r["budget"], r["sha256"]) for r in files.read_attempts(spark, str(tmp_path / "attempts")).collect()] == [("q7", 16384, hashlib.sha256(b"{}").hexdigest())]
    a = np.arange(6.0).reshape(3, 2)
    np.savez(tmp_path / "a.npz", depth=a)
    got = files.read_arrays(spark, str(tmp_path / "a.npz"), "depth").orderBy("row").collect()
    assert np.array_equal([r["values"] for r in got], a)
    face = struct.pack("<12fH", *range(12), 0)
    (tmp_path / "m.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 2) + face * 2)
    assert [r["corners"] for r in files.read_meshes(spark, str(tmp_path / "m.stl")).collect()] == [list(map(float, range(3, 12)))] * 2
    (tmp_path / "m.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 3) + face * 2)
    with pytest.raises(Exception, match="not a mesh"):
        files.read_meshes(spark, str(tmp_path / "m.stl")).collect()


def test_strict_lines_and_pins(spark, tmp_path):
    for bad in ('{"a": {"x": 1, "x": 2}}', '{"a": NaN}', '{"a": 1, "b": 2}'):
        (tmp_path / "x.jsonl").write_text(bad + "\n")
        with pytest.raises(Exception, match="unexpected keys or numbers"):
            tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a string").collect()
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n')
    assert tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a long", strict=False).count() == 2
    for d in "pq":
        (tmp_path / "pins" / d).mkdir(parents=True)
        (tmp_path / "pins" / d / "same.txt").write_text(d)
    pins = spark.createDataFrame([(f"{d}/same.txt", hashlib.sha256(b"p").hexdigest(), 1) for d in "pqr"], "name string, sha256 string, size long")
    assert {r["name"]: r["ok"] for r in tables.read_pinned(spark, str(tmp_path / "pins"), pins).collect()} == {"p/same.txt": True, "q/same.txt": False, "r/same.txt": False}
    import datetime

    late = datetime.datetime(2100, 1, 1)
    assert tables.read_snapshot(spark, str(tmp_path / "pins"), "same", late).count() == 2 and tables.read_snapshot(spark, str(tmp_path / "pins"), "other", late).count() == 0
    assert tables.read_snapshot(spark, str(tmp_path / "pins"), "same", datetime.datetime(2000, 1, 1)).count() == 0


def test_shards_archives_manifest(spark, tmp_path):
    df = spark.range(25).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    told = {r["shard"]: (r["n"], r["sha256"]) for r in files.write_shards(df, str(tmp_path / "s"), "k", 10).collect()}
    lines = spark.read.text(str(tmp_path / "s")).collect()
    for shard, (n, digest) in told.items():
        mine = sorted((json.loads(r["value"])["k"], r["value"]) for r in lines if r["shard"] == shard)
        assert len(mine) == n and digest == hashlib.sha256("".join(hashlib.sha256(v.encode()).hexdigest() for _, v in mine).encode()).hexdigest()
    assert sorted(n for n, _ in told.values()) == [5, 10, 10]
    sized = df.withColumn("size", (F.col("k") * 7 % 11 + 1).cast("long"))
    got = {}
    for r in files.packed(sized, "k", "size", 20, 4).orderBy("k").collect():
        got.setdefault(r["archive"], []).append(r["size"])
    assert all(len(s) <= 4 and (sum(s) <= 20 or len(s) == 1) for s in got.values()) and len(got) < 14
    packed = files.packed(sized, "k", "size", 20).withColumns({"name": F.concat(F.lit("f"), F.lpad("k", 3, "0")), "content": F.col("v").cast("binary")})
    for r in files.write_archives(packed, "archive", "name", "content").collect():
        with tarfile.open(fileobj=io.BytesIO(r["data"])) as tar:
            for m in r["members"]:
                assert tar.extractfile(m["name"]).read() == bytes(r["data"][m["offset"] : m["offset"] + m["length"]])
    rows = {r["name"]: r["digest"] for r in files.manifest({"a": df, "b": df.repartition(3), "c": df.where("k > 0")}, "{}").collect()}
    assert rows["a"] == rows["b"] != rows["c"]
    assert files.merged_shards([df.where("k % 2 = 0"), df.where("k % 2 = 1")], df, "k").count() == 25
    for parts in ([df, df.where("k = 3")], [df.where("k > 1")]):
        with pytest.raises(Exception, match="no exact cover"):
            files.merged_shards(parts, df, "k").collect()
    assert files.targets(df, {"x": lambda: F.col("v"), "y": lambda: F.upper("v")}).where("k = 1").select("form", "target").collect() == [("x", "v1"), ("y", "V1")]
    assert [r[0] for r in spark.createDataFrame([('{"a": "q_12", "b": ["q_3", "q_12"]}',)], "t string").select(files.harvested_ids(F.col("t"), r"q_\d+")).collect()] == [["q_12", "q_3"]]


def test_journal_appends_once(spark, tmp_path):
    df = spark.range(5).select("id")
    df.write.parquet(str(tmp_path / "in" / "a"))
    for _ in range(2):
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in" / "*"))
        files.append_journal(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    spark.range(5, 8).write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in" / "*"))
    files.append_journal(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == list(range(8))


def test_triangle_distances_by_sampling():
    r = np.random.default_rng(5)
    u, v = np.meshgrid(np.linspace(0, 1, 41), np.linspace(0, 1, 41))
    u, v = u[u + v <= 1.0001], v[u + v <= 1.0001]
    s, t = r.normal(size=(40, 3, 3)), r.normal(size=(40, 3, 3)) + 0.8
    t[0] = s[0]
    t[1] = s[1] + [0, 0, 5]
    got = mesh.triangle_triangle(s, t)
    spread = lambda x: x[0] + u[:, None] * (x[1] - x[0]) + v[:, None] * (x[2] - x[0])
    for i in range(40):
        near = ((spread(s[i])[:, None] - spread(t[i])[None]) ** 2).sum(-1).min()
        assert got[i] <= near + 1e-9 and near**0.5 - got[i] ** 0.5 < 0.12


def test_closest_of_meshes(spark):
    r = np.random.default_rng(6)
    rows = [(0, o, (r.normal(size=(3, 3)) * 0.3 + np.array([o * 2.0, 0, 0]) + r.normal(size=3) * 0.5).ravel().tolist()) for o in (0, 1) for _ in range(60)]
    by = {o: np.array([c for _, k, c in rows if k == o]).reshape(-1, 3, 3) for o in (0, 1)}
    i, j = np.meshgrid(range(60), range(60))
    want = mesh.triangle_triangle(by[0][i.ravel()], by[1][j.ravel()]).min() ** 0.5
    f = spark.createDataFrame(rows, "scene int, object int, corners array<double>")
    got = mesh.mesh_distances(f, spark.createDataFrame([(0, 0, 1), (0, 0, 9)], "scene int, a int, b int")).collect()
    assert len(got) == 1 and abs(got[0]["distance"] - want) < 1e-9
    cams = spark.createDataFrame([(0, 1, 9.0, 9.0, 9.0)], "scene int, frame int, x double, y double, z double")
    far = {r["object"]: r["distance"] for r in mesh.camera_distances(f, cams).collect()}
    p = np.full((60, 3), 9.0)
    assert all(abs(far[o] - mesh.point_triangle(p, by[o]).min() ** 0.5) < 1e-9 for o in (0, 1))


def test_ranks_are_those_of_one_order(spark):
    r = np.random.default_rng(7)
    rows = [(int(r.integers(0, 3)) or None, int(r.integers(0, 50)), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, v int, k int").repartition(5)
    want = {}
    for g in {x[0] for x in rows}:
        want |= {x[2]: n for n, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: x[1:]), 1)}
    assert {x["k"]: x["rank"] for x in select.ranked(df, ["g"], [F.col("v"), F.col("k")], "rank").collect()} == want


def test_greedy_by_brute_force(spark):
    r = np.random.default_rng(8)
    rows = [(k, int(r.integers(0, 6)), int(r.integers(0, 9)) or None, hashlib.sha256(str(k).encode()).hexdigest()) for k in range(300)]

    def greedy(caps, n):
        used, out = {}, []
        for k, a, b, _ in sorted(rows, key=lambda x: (x[3], x[0])):
            keys = [("a", a), ("b", b)]
            if len(out) < n and all(used.get(x, 0) < caps[x[0]] for x in keys):
                out.append(k)
                for x in keys:
                    used[x] = used.get(x, 0) + 1
        return sorted(out)

    df = spark.createDataFrame(rows, "k long, a int, b int, h string")
    for block in (100_000, 7):
        assert sorted(x["k"] for x in select.capped_greedy(df, "h", "k", {"a": 9, "b": 4}, 30, block).collect()) == greedy({"a": 9, "b": 4}, 30)
    total, caps_of = 120, lambda t: {"a": t // 8, "b": t // 10}
    while (found := greedy(caps_of(total), total)) and len(found) != total:
        total = len(found)
    assert sorted(x["k"] for x in select.shrinking_select(df, "h", "k", caps_of, 120).collect()) == found


def test_unions_and_quotas(spark):
    a, b = spark.range(3).withColumnRenamed("id", "k"), spark.range(2, 5).withColumnRenamed("id", "k")
    with pytest.raises(Exception, match="repeated key"):
        reconcile.disjoint_union([a, b], "k").collect()
    assert reconcile.quotas({"a": 2, "b": 10, "c": 10}, {"a": 5, "b": 3, "c": 2}, 12) == {"a": 2, "b": 6, "c": 4}
    assert reconcile.quotas({}, {"a": 1}, 5) == {"a": 0} and reconcile.quotas({"a": 1, "b": 1}, {"a": 1, "b": 1}, 9) == {"a": 1, "b": 1}
