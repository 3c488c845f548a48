"""Queries on scene joins. Points, boxes and faces are made from embeddings and line items, which stand in for scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.operators import mesh, scene, select
from grainmill.plans.catalog import query

_B = """(SELECT l_suppkey % 50 AS frame, l_orderkey * 8 + l_linenumber AS k, CAST(l_partkey % 97 AS DOUBLE) AS x0, CAST(l_suppkey % 31 AS DOUBLE) AS y0, CAST(l_partkey % 97 + l_quantity / 4 AS DOUBLE) AS x1, CAST(l_suppkey % 31 + l_linenumber AS DOUBLE) AS y1 FROM lineitem WHERE l_quantity = 50)"""


def _boxes(t):
    x0, y0 = (F.col("l_partkey") % 97).cast("double"), (F.col("l_suppkey") % 31).cast("double")
    return t.lineitem.where("l_quantity = 50").select((F.col("l_suppkey") % 50).alias("frame"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity") / 4).alias("x1"), (y0 + F.col("l_linenumber")).alias("y1"))


@query(f"""WITH b AS {_B}, p AS (SELECT a.frame, a.k AS a, b.k AS b, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS s FROM b a JOIN b b ON a.frame = b.frame AND a.k < b.k)
    SELECT frame, a, b, round(w * h / s, 6) AS overlap FROM p WHERE w > 0 AND h > 0 AND w * h / s > 0.5""")
def box_overlap_join(t):
    return scene.box_overlaps(_boxes(t), "frame", "k", 0.5, 10.0).withColumn("overlap", F.round("overlap", 6))


@query()
def disjoint_boxes(t):
    boxes = F.collect_list(F.struct(F.col("k").cast("double").alias("score"), "x0", "y0", "x1", "y1"))
    return _boxes(t).groupBy("frame").agg(F.count("*").alias("n"), scene.disjoint_greedy(boxes, 0.5).cast("long").alias("standing"))


_P = "(SELECT vec_id AS point, vec_id % 20 AS scene, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z FROM embeddings)"


@query(f"""WITH p AS {_P}, b AS (SELECT scene, box, cx, cy, s, h FROM (SELECT unnest(range(0, 20)) AS scene) a, (VALUES (0, 1.0, 0.0, 0.0, 1.5), (1, 0.0, 1.0, 0.6, 2.0), (2, -1.0, -1.0, 0.8, 1.2)) v(box, cx, cy, s, h)),
    m AS (SELECT p.scene, point, box FROM p JOIN b ON p.scene = b.scene AND abs((x - cx) * sqrt(1 - s * s) + (y - cy) * s) <= h AND abs((y - cy) * sqrt(1 - s * s) - (x - cx) * s) <= h AND abs(z) <= 3),
    o AS (SELECT scene, point, count(*) AS holders, min(box) AS box FROM m GROUP BY ALL)
    SELECT scene, point, CASE WHEN holders = 1 THEN box END AS owner, coalesce(holders, 0) AS holders FROM p LEFT JOIN o USING (scene, point)""")
def box_owners(t):
    p = t.embeddings.select(F.col("vec_id").alias("point"), (F.col("vec_id") % 20).alias("scene"), *((F.col("embedding")[i].cast("double") * 10).alias(c) for i, c in enumerate("xyz")))
    each = t.spark.createDataFrame([(0, 1.0, 0.0, 0.0, 1.5), (1, 0.0, 1.0, 0.6, 2.0), (2, -1.0, -1.0, 0.8, 1.2)], "box int, cx double, cy double, s double, h double")
    c = F.sqrt(1 - F.col("s") * F.col("s"))
    zero, one = F.lit(0.0), F.lit(1.0)
    axes = F.array(c, F.col("s"), zero, -F.col("s"), c, zero, zero, zero, one)
    boxes = t.spark.range(20).select(F.col("id").alias("scene")).crossJoin(each).select("scene", "box", "cx", "cy", zero.alias("cz"), axes.alias("axes"), F.col("h").alias("hx"), F.col("h").alias("hy"), F.lit(3.0).alias("hz"))  # three boxes a scene
    return scene.box_owners(p, boxes)


@query("""WITH f AS (SELECT DISTINCT l_suppkey % 40 AS scene, l_orderkey * 8 + l_linenumber + l_partkey * 100000000 AS face, l_partkey % 60 AS a, (l_partkey + l_linenumber) % 60 AS b, (l_partkey + 1) % 60 AS c FROM lineitem), o AS (SELECT s AS scene, p AS point, CASE WHEN (p + s) % 7 <> 0 THEN p // 20 END AS owner FROM (SELECT unnest(range(0, 40)) AS s), (SELECT unnest(range(0, 60)) AS p))
    SELECT f.scene, face, CASE WHEN x.owner = y.owner AND y.owner = z.owner THEN x.owner END AS owner FROM f JOIN o x ON x.scene = f.scene AND x.point = a JOIN o y ON y.scene = f.scene AND y.point = b JOIN o z ON z.scene = f.scene AND z.point = c""")
def face_owners(t):
    k = F.col("l_partkey")
    f = t.lineitem.select((F.col("l_suppkey") % 40).alias("scene"), (F.col("l_orderkey") * 8 + F.col("l_linenumber") + k * 100000000).alias("face"), (k % 60).alias("a"), ((k + F.col("l_linenumber")) % 60).alias("b"), ((k + 1) % 60).alias("c"))
    o = t.spark.range(2400).select(F.expr("id div 60").alias("scene"), (F.col("id") % 60).alias("point")).withColumn("owner", F.when((F.col("point") + F.col("scene")) % 7 != 0, F.expr("point div 20")))
    return scene.face_owners(f, o)


@query("""SELECT o_custkey % 30 AS scene, o_orderpriority AS instance, count(*) AS n, min(l_quantity) AS x0, min(l_tax) AS y0, min(l_discount) AS z0, max(l_quantity) AS x1, max(l_tax) AS y1, max(l_discount) AS z1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def segment_boxes(t):
    key = (F.col("o_custkey") % 30).alias("scene")
    segments = t.orders.select(key, F.col("o_orderkey").alias("segment"), F.col("o_orderpriority").alias("instance"))
    vertices = t.lineitem.join(t.orders.select(key, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("scene", F.col("l_orderkey").alias("segment"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"), F.col("l_discount").alias("z"))
    return scene.segment_boxes(segments, vertices)


_PX = "(SELECT event_id % 5 AS frame, user_id % 40 AS u, event_id % 37 AS v, CAST(max(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value FROM events WHERE event_type = 'click' GROUP BY ALL)"


@query(f"""WITH p AS {_PX}, w AS (SELECT DISTINCT event_id % 5 AS frame, user_id % 40 AS u, event_id % 41 AS v FROM events WHERE event_type = 'purchase'),
    m AS (SELECT w.frame, w.u, w.v, value, row_number() OVER (PARTITION BY w.frame, w.u, w.v ORDER BY (p.u - w.u) * (p.u - w.u) + (p.v - w.v) * (p.v - w.v), p.v, p.u) AS rn FROM w JOIN p ON p.frame = w.frame AND (p.u - w.u) * (p.u - w.u) + (p.v - w.v) * (p.v - w.v) <= 9)
    SELECT w.frame, w.u, w.v, value FROM w LEFT JOIN (SELECT * FROM m WHERE rn = 1) USING (frame, u, v)""")
def nearest_valid_pixel(t):
    of = lambda kind, rows: t.events.where(F.col("event_type") == kind).select((F.col("event_id") % 5).alias("frame"), (F.col("user_id") % 40).alias("u"), (F.col("event_id") % rows).alias("v"), F.round(F.col("value") * 100).cast("long").alias("value"))
    pixels = of("click", 37).groupBy("frame", "u", "v").agg(F.max("value").alias("value"))
    return scene.nearest_valid(of("purchase", 41), pixels, 3)


@query("""SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b, a.l_partkey = b.l_partkey AS same FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber""")
def pairs_within_scene(t):
    return scene.pairs_within(t.lineitem, "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "a", "b", (F.col("l_partkey_a") == F.col("l_partkey_b")).alias("same"))


@query("""SELECT n_nationkey AS key, label FROM (SELECT n_nationkey, n_regionkey, 'Is the ' || lower(n_name) || ' near ' || lower(r_name) || '?' AS q FROM nation JOIN region ON r_regionkey = n_regionkey), (SELECT unnest(['asia', 'near', 'united', 'an', 'france']) AS label) WHERE regexp_matches(q, '(^|[^a-z0-9_])' || label || '([^a-z0-9_]|$)')""")
def label_in_question(t):
    q = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("key"), F.concat(F.lit("Is the "), F.lower("n_name"), F.lit(" near "), F.lower("r_name"), F.lit("?")).alias("question"))
    labels = t.nation.select(F.col("n_nationkey").alias("key"), F.explode(F.array(*map(F.lit, ["asia", "near", "united", "an", "france"]))).alias("label"))
    return scene.named_in(q, labels, "key").select("key", "label")


@query("""WITH x AS (SELECT l_orderkey, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS at FROM lineitem) SELECT l_orderkey AS row, l_partkey AS column FROM x""")
def csr_lookup(t):
    ranks = select.ranked(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), [], [F.col("l_orderkey"), F.col("l_linenumber")], "rank").select("l_orderkey", "l_partkey", (F.col("rank") - 1).alias("at"))
    pointers = ranks.groupBy(F.col("l_orderkey").alias("row")).agg(F.min("at").alias("start"), (F.max("at") + 1).alias("stop"))
    return scene.csr_members(pointers, ranks.select("at", F.col("l_partkey").alias("column")))


@query("""WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE WHEN event_id % 3 <> 0 THEN round(value) END AS v FROM events),
    f AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER b AS bp, last_value(v IGNORE NULLS) OVER b AS bv, first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER a AS ap, first_value(v IGNORE NULLS) OVER a AS av FROM e
        WINDOW b AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
    SELECT event_id, round(coalesce(v, bv + (av - bv) * ((k - bp) / (ap - bp)), bv, av), 6) AS filled FROM f""")
def interpolated_fill(t):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = t.events.select("event_id", "user_id", at.alias("at"), F.when(F.col("event_id") % 3 != 0, F.round("value")).alias("v"))
    return scene.interpolated(rows, "user_id", "at", "v", 5).select("event_id", F.round("filled", 6).alias("filled"))


def _faces(t):
    e = lambda k: F.col("embedding")[k] * 4 + (F.col("vec_id") % 5) * (3.0 if k % 3 == 0 else 0.0)
    return t.embeddings.select((F.col("vec_id") % 7).alias("scene"), (F.col("vec_id") % 5).alias("object"), F.array(*(e(k) for k in range(9))).alias("corners"))


@query()
def mesh_distances(t):
    f = _faces(t)
    objects = f.select("scene", "object").distinct()
    return mesh.mesh_distances(f, scene.pairs_within(objects, "scene", "object")).withColumn("distance", F.round("distance", 6))


@query()
def camera_distances(t):
    cameras = t.spark.range(7).select(F.col("id").alias("scene"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("frame")).withColumns({"x": F.col("frame") * 1.0, "y": F.lit(-5.0), "z": F.lit(2.0)})
    return mesh.camera_distances(_faces(t), cameras).withColumn("distance", F.round("distance", 6))


@query(f"""WITH p AS {_P}, a AS (SELECT * FROM p WHERE point % 3 = 0), b AS (SELECT * FROM p WHERE point % 3 <> 0), d AS (SELECT a.scene, a.point, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM a JOIN b USING (scene) GROUP BY ALL)
    SELECT scene, round(sqrt(quantile_cont(d, 0.05)), 6) AS distance FROM d GROUP BY 1""")
def cloud_distance(t):
    p = t.embeddings.select((F.col("vec_id") % 20).alias("scene"), (F.col("vec_id") % 3 != 0).cast("int").alias("side"), *((F.col("embedding")[i].cast("double") * 10).alias(c) for i, c in enumerate("xyz")))
    return mesh.cloud_distances(p).withColumn("distance", F.round("distance", 6))
