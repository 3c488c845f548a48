"""Joins within scenes: overlapping boxes, points in turned boxes with one owner, faces whose corners agree, nearest valid pixels, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box_overlaps(boxes: DataFrame, frame: str, key: str, least: float, cell: float) -> DataFrame:
    """boxes(frame, key, x0, y0, x1, y1) -> frame, a, b, overlap: pairs a < b whose intersection is more than `least` of the smaller area.

    Boxes meet in the grid cells that both touch, and a pair counts in the cell of its intersection's lower corner only."""
    at = lambda c: F.floor(F.col(c) / cell)
    spread = boxes.where("x1 > x0 AND y1 > y0").withColumn("_cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("_cy", F.explode(F.sequence(at("y0"), at("y1"))))
    side = lambda n: spread.select(F.col(frame), "_cx", "_cy", *(F.col(c).alias(f"{c}_{n}") for c in (key, "x0", "y0", "x1", "y1")))
    met = side("a").join(side("b"), [frame, "_cx", "_cy"]).where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    left, low = F.greatest("x0_a", "x0_b"), F.greatest("y0_a", "y0_b")
    wide, high = F.least("x1_a", "x1_b") - left, F.least("y1_a", "y1_b") - low
    area = lambda n: (F.col(f"x1_{n}") - F.col(f"x0_{n}")) * (F.col(f"y1_{n}") - F.col(f"y0_{n}"))
    met = met.where((wide > 0) & (high > 0) & (F.floor(left / cell) == F.col("_cx")) & (F.floor(low / cell) == F.col("_cy")))
    share = wide * high / F.least(area("a"), area("b"))
    return met.select(frame, F.col(f"{key}_a").alias("a"), F.col(f"{key}_b").alias("b"), share.alias("overlap")).where(F.col("overlap") > least)


def box_owners(points: DataFrame, boxes: DataFrame, slack: float = 0.0) -> DataFrame:
    """points(scene, point, x, y, z) and turned boxes(scene, box, cx, cy, cz, axes of nine numbers, hx, hy, hz) -> scene, point, owner (null
    where no box or several hold the point), holders. Points are compared with the boxes of their scene."""
    met = points.join(boxes, "scene")
    d = [F.col(a) - F.col(c) for a, c in (("x", "cx"), ("y", "cy"), ("z", "cz"))]
    along = lambda k: sum((d[i] * F.col("axes")[3 * k + i] for i in range(3)), F.lit(0.0))
    inside = F.lit(True)
    for k, h in enumerate(("hx", "hy", "hz")):
        inside = inside & (F.abs(along(k)) <= F.col(h) + slack)
    held = met.where(inside).groupBy("scene", "point").agg(F.min("box").alias("owner"), F.count("*").alias("holders"))
    out = points.select("scene", "point").join(held, ["scene", "point"], "left").na.fill(0, ["holders"])
    return out.withColumn("owner", F.when(F.col("holders") == 1, F.col("owner")))


def face_owners(faces: DataFrame, owners: DataFrame) -> DataFrame:
    """faces(scene, face, a, b, c) and owners(scene, point, owner) -> scene, face, owner: the one that all three corners have, else null."""
    corners = faces.select("scene", "face", F.explode(F.array("a", "b", "c")).alias("point")).join(owners.select("scene", "point", "owner"), ["scene", "point"], "left")
    agree = corners.groupBy("scene", "face").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.count("owner").alias("n"))
    return agree.select("scene", "face", F.when((F.col("n") == 3) & (F.col("lo") == F.col("hi")), F.col("lo")).alias("owner"))


def segment_boxes(segments: DataFrame, vertices: DataFrame) -> DataFrame:
    """segments(scene, segment, instance) and vertices(scene, segment, x, y, z) -> scene, instance, n and the box around its vertices."""
    ends = [f(c).alias(f"{c}{k}") for k, f in ((0, F.min), (1, F.max)) for c in ("x", "y", "z")]
    return segments.join(vertices, ["scene", "segment"]).groupBy("scene", "instance").agg(F.count("*").alias("n"), *ends)


def nearest_valid(wanted: DataFrame, pixels: DataFrame, reach: int) -> DataFrame:
    """wanted(frame, u, v) and pixels(frame, u, v, value) -> frame, u, v, value of the nearest pixel with a value within `reach`, ties by row
    then column; null if there is none. Squares of the reach's side are the cells in which both meet."""
    cell = lambda c: F.expr(f"{c} div {reach}")
    p = pixels.where("value IS NOT NULL").select("frame", F.col("u").alias("pu"), F.col("v").alias("pv"), "value", cell("u").alias("_i"), cell("v").alias("_j"))
    near = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    w = wanted.select("frame", "u", "v").distinct()
    asked = w.withColumn("_i", F.explode(F.transform(near, lambda k: cell("u") + k))).withColumn("_j", F.explode(F.transform(near, lambda k: cell("v") + k)))
    far = (F.col("pu") - F.col("u")) ** 2 + (F.col("pv") - F.col("v")) ** 2
    best = asked.join(p, ["frame", "_i", "_j"]).where(far <= reach * reach).groupBy("frame", "u", "v").agg(F.min(F.struct(far.alias("d"), "pv", "pu", "value")).alias("x"))
    return w.join(best, ["frame", "u", "v"], "left").select("frame", "u", "v", F.col("x.value").alias("value"))


def pairs_within(df: DataFrame, group: str, key: str, *columns: str) -> DataFrame:
    """group, a, b (a < b) and the columns of both: every pair of a group whose size is bounded by its nature, such as a scene's objects."""
    side = lambda n: df.select(group, F.col(key).alias(n), *(F.col(c).alias(f"{c}_{n}") for c in columns))
    return side("a").join(side("b"), group).where("a < b")


def named_in(questions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """questions(key, question) and labels(key, label): pairs of one key whose question names the label as whole words."""
    quoted = F.concat(F.lit(r"(?i)(?:^|\W)\Q"), "label", F.lit(r"\E(?:\W|$)"))
    return questions.join(labels, key).where(F.rlike(F.col("question"), quoted))


def csr_members(pointers: DataFrame, indices: DataFrame) -> DataFrame:
    """pointers(row, start, stop) and indices(at, column) -> row, column of a compressed matrix. Rows that overlap, run backwards or reach
    beyond the indices, and indices that no row has, stop the query."""
    last = indices.agg(F.coalesce(F.max("at") + 1, F.lit(0)).alias("_all"), F.count("*").alias("_n"))  # one row
    w = Window.orderBy("row")  # a row an instance
    checked = pointers.withColumn("_next", F.lead("start").over(w)).withColumn("_first", F.row_number().over(w)).crossJoin(F.broadcast(last))
    sound = (F.col("start") <= F.col("stop")) & (F.col("stop") == F.coalesce("_next", "_all")) & ((F.col("_first") > 1) | (F.col("start") == 0)) & (F.col("_all") == F.col("_n"))
    wrong = F.raise_error(F.concat(F.lit("unsound row "), F.col("row").cast("string"))).cast("long")
    spread = checked.select("row", F.when(sound, F.col("start")).otherwise(wrong).alias("start"), "stop").where("start < stop")
    return spread.select("row", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("at")).join(indices, "at").select("row", "column")


def interpolated(df: DataFrame, group: str, at: str, value: str, reach: int) -> DataFrame:
    """Nulls lie on the line between the nearest values before and after, by position `at`; only within `reach` rows, and where there is one
    side only its value is taken."""
    w = Window.partitionBy(group).orderBy(at)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("p"), F.col(value).alias("v")))
    b, a = F.last(known, True).over(w.rowsBetween(-reach, -1)), F.first(known, True).over(w.rowsBetween(1, reach))
    out = df.withColumns({"_b": b, "_a": a})
    part = (F.col(at) - F.col("_b.p")) / (F.col("_a.p") - F.col("_b.p"))
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * part
    return out.withColumn("filled", F.coalesce(F.col(value), line, F.col("_b.v"), F.col("_a.v"))).drop("_b", "_a")


def disjoint_greedy(boxes: Column, least: float) -> Column:
    """How many of the boxes(score, x0, y0, x1, y1) of a frame stand when, best first, each that overlaps a standing one by more than
    `least` of the smaller area falls."""
    area = lambda b: F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))
    common = lambda a, b: F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0)) * F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    falls = lambda k, b: (F.least(area(k), area(b)) <= 0) | (common(k, b) / F.greatest(F.least(area(k), area(b)), F.lit(1e-300)) > least)
    ordered = F.array_sort(F.transform(boxes, lambda b: F.struct((-b["score"]).alias("rank"), b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"))))
    none = F.filter(ordered, lambda b: F.lit(False))
    return F.size(F.aggregate(ordered, none, lambda kept, b: F.when(F.exists(kept, lambda k: falls(k, b)), kept).otherwise(F.concat(kept, F.array(b)))))
