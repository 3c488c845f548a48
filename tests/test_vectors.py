"""Poses, trajectories, templates and citation tiers on small cases."""

import math

import pytest
from pyspark.sql import functions as F

from grainmill.functions import scalar as fn
from grainmill.functions import vector
from grainmill.operators import joins
from grainmill.sources.tables import read_trajectory


def value(spark, columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).collect()[0])


def test_canonical_frame(spark):
    level = [0.0, 0.0, 1.0, 1.0, -1.0, 0.0, 0.0, 2.0, 0.0, -1.0, 0.0, 3.0]  # looks along +X, stands at (1, 2, 3)
    down = [1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0]
    rows = [(0, level, [0.0, 0.0, 2.0]), (1, down, [0.0, 0.0, 1.0]), (2, None, [0.0, 0.0, 1.0]), (3, level, [0.0, 0.0, 0.0]), (4, level[:3], [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "i int, pose array<double>, up array<double>")
    got = {r.i: r.m for r in df.select("i", vector.canonical_frame("pose", "up").alias("m")).collect()}
    assert got[0] == pytest.approx([0, -1, 0, 2, 1, 0, 0, -1, 0, 0, 1, -3])  # the camera goes to the origin, its heading to +Y
    assert got[1] == pytest.approx([1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0])  # along the vertical: the right axis stays +X
    assert got[2] is got[3] is got[4] is None


def test_inverse_pose(spark):
    r, t = [F.lit(x) for x in (0.0, 0.0, math.pi / 2)], [F.lit(x) for x in (1.0, 0.0, 0.0)]
    there = value(spark, vector.rigid([[*row, 0.0] for row in vector.rotation(r)], [F.lit(x) for x in (5.0, 6.0, 7.0)]))
    assert there == pytest.approx([-6, 5, 7])
    back = vector.rigid(vector.camera_to_world(r, t), [F.lit(x) for x in (-5.0, 5.0, 7.0)])
    assert value(spark, back) == pytest.approx([5, 6, 7])


def test_trajectory(spark, tmp_path):
    (tmp_path / "a.traj").write_text("1.5 0 0 0 1 2 3\n\n2.25 0.1 0 0  4 5 6\n")
    rows = read_trajectory(spark, str(tmp_path / "a.traj")).orderBy("line").collect()
    assert [(r.line, float(r.ts), r.rotation, r.translation) for r in rows] == [(1, 1.5, [0, 0, 0], [1, 2, 3]), (3, 2.25, [0.1, 0, 0], [4, 5, 6])]
    for n, bad in enumerate(("1 0 0 0 1 2\n", "1 0 0 0 1 2 nan\n", "2 0 0 0 1 2 3\n2 0 0 0 1 2 3\n")):
        (tmp_path / f"bad{n}").write_text(bad)
        with pytest.raises(Exception, match="malformed trajectory line"):
            read_trajectory(spark, str(tmp_path / f"bad{n}")).collect()


def test_template(spark):
    text = F.lit("Is the office chair nearer to the chair or the table? The chair is old, chairs are not.")
    names = fn.slot_names(text, ["chair", "table", "office chair", "c++"])
    made = fn.template(text, names)
    got = value(spark, [names, made, fn.rendered(made, names) == text])
    assert got[0] == ["office chair", "chair", "table"] and got[2]
    assert got[1] == "Is the {slot_0} nearer to the {slot_1} or the {slot_2}? The {slot_1} is old, chairs are not."


def test_citation_tiers(spark):
    docs = spark.createDataFrame([(1, "say café now here"), (2, "say  café\nnow"), (3, "say cafe\u0301 now"), (4, "nothing"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "say café now"), (8, ""), (9, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.tier) for r in joins.citation_tiers(docs, items).collect()} == {(1, 7, "exact"), (2, 7, "spaces"), (3, 7, "nfc")}
