"""Queries over measurements, ranks, windows and vectors; the same conventions as the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from grainmill.functions import scalar as fn
from grainmill.functions import vector
from grainmill.operators import area, joins, measure, score, select
from grainmill.plans.catalog import _cents, query
from grainmill.streaming import gauge

# ---- aggregates


@query("""SELECT l_suppkey, count(*) AS extra FROM (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A') GROUP BY 1""")
def multiset_difference(t):
    returned, accepted = (F.count_if(F.col("l_returnflag") == x) for x in ("R", "A"))
    return t.lineitem.where("l_returnflag IN ('R', 'A')").groupBy("l_suppkey").agg((returned - accepted).alias("extra")).where("extra > 0")


@query("SELECT user_id, min(ts) AS first_at, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events GROUP BY 1 HAVING count(DISTINCT CAST(ts AS DATE)) >= 3")
def persistence_gate(t):
    days = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("first_at"), F.count("*").alias("n"))
    return days.groupBy("user_id").agg(F.min("first_at").alias("first_at"), F.sum("n").alias("n"), F.count("*").alias("n_days")).where("n_days >= 3")


@query("""WITH s AS (SELECT l_returnflag AS g, avg(l_quantity) AS m, stddev_pop(l_quantity) AS d, count(*) AS n FROM lineitem GROUP BY 1),
    k AS (SELECT g, n, count(*) AS inside FROM lineitem JOIN s ON g = l_returnflag WHERE abs(l_quantity - m) <= 1.5 * d GROUP BY ALL)
    SELECT g AS l_returnflag, n, CASE WHEN n >= 50 AND inside >= greatest(25, 0.3 * n) THEN inside ELSE n END AS kept FROM k""")
def sigma_trim(t):
    return measure.sigma_trim(t.lineitem, "l_returnflag", "l_quantity", 1.5).groupBy("l_returnflag").agg(F.first("n").alias("n"), F.count("*").alias("kept"))


@query("""WITH h AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, hour) AS rn FROM h),
    p AS (SELECT event_type, max(n) AS peak, max(n) FILTER (rn = 2) AS second FROM r GROUP BY 1), m AS (SELECT event_type, count(DISTINCT user_id) AS merged FROM events GROUP BY 1)
    SELECT event_type, peak, second, merged, CASE WHEN merged > 5 THEN merged ELSE peak END AS estimate, greatest(merged, peak) AS at_least FROM p JOIN m USING (event_type)""")
def peak_simultaneous(t):
    peaks = measure.peaks(t.events, "event_type", F.date_trunc("hour", "ts"), 2)
    merged = t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("merged"))
    estimate = F.when(F.col("merged") > 5, F.col("merged")).otherwise(F.col("peak"))
    return peaks.join(merged, "event_type").select("event_type", "peak", "second", "merged", estimate.alias("estimate"), F.greatest("merged", "peak").alias("at_least"))


@query("SELECT max(n) AS most, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_sources, round(max(n) / sum(n), 6) AS share FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def concentration(t):
    per = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return per.agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.count("*").alias("n_sources"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("""SELECT count(*) AS n, count(DISTINCT user_id) AS n_users, count(*) FILTER (value IS NULL) AS missing, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents,
    max(ts) FILTER (event_type = 'purchase') AS last_purchase, round(count(*) / 1440.0, 6) AS per_minute FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def rate_snapshot(t):
    last = t.events.agg(F.max("ts").alias("now"))  # one row
    recent = t.events.join(F.broadcast(last), F.col("ts") > F.col("now") - F.expr("INTERVAL 1 DAY"))
    return recent.agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.count_if(F.col("value").isNull()).alias("missing"), F.sum(_cents("value")).alias("cents"),
        F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_purchase"), F.round(F.count("*") / 1440.0, 6).alias("per_minute"),
    )


@query("SELECT p_brand, round(corr(p_size, p_retailprice), 6) AS r, round(avg(abs(p_retailprice - 20 * p_size)), 6) AS mean_gap FROM part GROUP BY 1")
def correspondence(t):
    return t.part.groupBy("p_brand").agg(F.round(F.corr("p_size", "p_retailprice"), 6).alias("r"), F.round(F.avg(F.abs(F.col("p_retailprice") - 20 * F.col("p_size"))), 6).alias("mean_gap"))


@query("""SELECT split_part(o_orderpriority, '-', 1) AS reason, o_orderstatus, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95,
    max(o_totalprice) AS most FROM orders GROUP BY ALL""")
def refusal_summary(t):
    rows = t.orders.select(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("reason"), "o_orderstatus", "o_totalprice")
    q = score.quantiles(rows, ["reason", "o_orderstatus"], "o_totalprice", {"p50": 0.5, "p95": 0.95, "most": 1.0})
    return q.withColumns({"p50": F.round("p50", 4), "p95": F.round("p95", 4)})


@query("""SELECT start, count(*) AS n, count(DISTINCT user_id) AS n_users FROM (SELECT user_id, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events WHERE event_type = 'purchase')
    GROUP BY 1 HAVING count(DISTINCT user_id) >= 3""")
def storm_windows(t):
    return measure.storms(t.events.where("event_type = 'purchase'"), "ts", "user_id", "2 hours", "1 hour", 3)


# ---- windows and ranks


@query("""SELECT conv_id, CAST((rn - 1) // 2 AS BIGINT) AS pair, round(avg(n), 6) AS mean FROM (SELECT conv_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations) GROUP BY ALL""")
def pair_means(t):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pair = F.expr("(rn - 1) div 2").alias("pair")
    return t.conversations.select("conv_id", F.length("text").alias("n"), F.row_number().over(w).alias("rn")).groupBy("conv_id", pair).agg(F.round(F.avg("n"), 6).alias("mean"))


@query("SELECT s_nationkey, s_suppkey, round(s_acctbal, 2) = round(max(s_acctbal) OVER (PARTITION BY s_nationkey), 2) AS best FROM supplier")
def best_marking(t):
    best = F.max("s_acctbal").over(Window.partitionBy("s_nationkey"))
    return t.supplier.select("s_nationkey", "s_suppkey", (F.round("s_acctbal", 2) == F.round(best, 2)).alias("best"))


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, inner_line ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM
    (SELECT l_orderkey, l_linenumber, l_extendedprice, l_linenumber NOT IN (min(l_linenumber) OVER w, max(l_linenumber) OVER w) AS inner_line FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))) WHERE NOT inner_line OR rn <= 1""")
def forced_endpoints(t):
    return select.with_endpoints(t.lineitem, ["l_orderkey"], "l_linenumber", [F.desc("l_extendedprice")], 1).select("l_orderkey", "l_linenumber")


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, CAST(round(value * 100) AS BIGINT) AS v FROM events WHERE value IS NOT NULL),
    s AS (SELECT a.user_id, o AS lag, CAST(sum(abs(a.v - b.v)) // count(*) AS BIGINT) AS gap, count(*) AS n FROM e a, range(-3, 4) r(o), e b WHERE a.user_id = b.user_id AND b.rn = a.rn + o AND o <> 0 GROUP BY ALL)
    SELECT user_id, lag, gap FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap, lag) AS r FROM s WHERE n >= 4) WHERE r = 1""")
def best_offset(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    series = t.events.where("value IS NOT NULL").select("user_id", F.row_number().over(w).alias("at"), _cents("value").alias("v"))
    return measure.best_offset(series, "user_id", "at", "v", 3, 4)


@query("""SELECT p_brand, min(p_retailprice) AS least, CASE WHEN count(*) FILTER (p_retailprice = m) = 1 THEN min(p_partkey) FILTER (p_retailprice = m) END AS p_partkey
    FROM (SELECT *, min(p_retailprice) OVER (PARTITION BY p_brand) AS m FROM part) GROUP BY 1""")
def unique_argmin(t):
    return measure.unique_argmin(t.part, "p_brand", "p_retailprice", "p_partkey")


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT DISTINCT lang, doc_id FROM r, range(0, 8) s(k) WHERE i = k * (n - 1) // 7""")
def evenly_spaced(t):
    return select.evenly_spaced(t.documents.select("lang", "doc_id"), "lang", "doc_id", 8)


# ---- scalar rules


@query("""SELECT l_orderkey, CAST(l_quantity AS BIGINT) + unnest(range(0, l_linenumber)) AS line, 'E' || l_linenumber AS source FROM lineitem WHERE l_quantity <= 5""")
def citation_ranges(t):
    q = F.col("l_quantity").cast("long")
    cited = F.concat(F.lit("E"), F.col("l_linenumber"), F.lit(".L"), q, F.when(F.col("l_linenumber") > 1, F.concat(F.lit("-L"), q + F.col("l_linenumber") - 1)).otherwise(""))
    found = t.lineitem.where("l_quantity <= 5").select("l_orderkey", F.inline(fn.cited_lines(cited)))
    return found.select("l_orderkey", "line", "source")


@query("""SELECT doc_id, n AS number, length(split_part(n, '.', 2)) AS places FROM (SELECT doc_id, regexp_extract(text, '[0-9]+(\\.[0-9]+)?') AS n FROM documents) WHERE n <> ''""")
def printed_places(t):
    number = F.regexp_extract("text", r"[0-9]+(\.[0-9]+)?", 0)
    return t.documents.select("doc_id", number.alias("number")).where("number <> ''").select("doc_id", "number", fn.places(F.col("number")).alias("places"))


@query("""WITH c AS (SELECT l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)
    SELECT l_returnflag, count(*) FILTER (c % 10 = 5) AS refused, CAST(sum(c // 10 + CASE WHEN c % 10 > 5 THEN 1 ELSE 0 END) FILTER (c % 10 <> 5) AS BIGINT) AS tenths FROM c GROUP BY 1""")
def rounding_guard(t):
    tenths = fn.rounded_or_refused(F.col("l_extendedprice").cast("decimal(18,2)"), 1)
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(tenths.isNull()).alias("refused"), (F.sum(tenths) * 10).cast("long").alias("tenths"))


@query("""SELECT l_linenumber, l_shipmode AS after, CAST(greatest(least(60, 2 ** l_linenumber), l_shipmode) AS BIGINT) AS delay, count(*) AS n FROM (SELECT l_linenumber, CAST(l_quantity AS BIGINT) AS l_shipmode FROM lineitem) GROUP BY ALL""")
def retry_delay(t):
    after = F.col("l_quantity").cast("long")
    return t.lineitem.groupBy("l_linenumber", after.alias("after"), fn.backoff(F.col("l_linenumber"), after, 60).alias("delay")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (abs(round(o_totalprice, 2) - round(s, 2)) <= 0.005 + 1e-10) AS agree FROM orders JOIN
    (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def stored_against_recomputed(t):
    lines = t.lineitem.groupBy("l_orderkey").agg((F.sum(_cents("l_extendedprice")).cast("double") / 100).alias("s"))
    both = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(fn.same_score(F.col("o_totalprice"), F.col("s"))).alias("agree"))


@query("SELECT regexp_replace(c_name, '[0-9]{2}$', '') AS scene, count(*) AS n, count(DISTINCT c_nationkey) AS n_nations FROM customer GROUP BY 1")
def physical_groups(t):
    return t.customer.groupBy(F.regexp_replace("c_name", "[0-9]{2}$", "").alias("scene")).agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("n_nations"))


@query("""SELECT event_type, count(*) FILTER (regexp_matches(props, '"(k|secret|[a-z_]*token)"\\s*:')) AS forbidden, count(*) AS n FROM events GROUP BY 1""")
def forbidden_fields(t):
    return t.events.groupBy("event_type").agg(F.count_if(fn.has_field(F.col("props"), ["k", "secret", "[a-z_]*token"])).alias("forbidden"), F.count("*").alias("n"))


@query("SELECT doc_id, length(text) > 2000 AS cut, sha256(CASE WHEN length(text) > 2000 THEN left(text, 2000) || ' [cut]' ELSE text END) AS shown FROM documents")
def text_preview(t):
    return t.documents.select("doc_id", (F.length("text") > 2000).alias("cut"), F.sha2(fn.preview(F.col("text"), 2000), 256).alias("shown"))


# ---- vectors: camera frames, projections, bearings

_XYZ = "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings"
#: A rotation by the 3-4-5 angle about the vertical, a step back, and a pinhole camera.
POSE = [[0.6, -0.8, 0.0, 0.25], [0.8, 0.6, 0.0, -0.5], [0.0, 0.0, 1.0, 2.0]]
FOCAL, CENTRE = 500.0, (320.0, 240.0)


def _xyz(t):
    return t.embeddings.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))


@query(f"""WITH c AS (SELECT vec_id, 0.6::DOUBLE * x - 0.8::DOUBLE * y + 0.25 AS a, 0.8::DOUBLE * x + 0.6::DOUBLE * y - 0.5 AS b, z + 2.0 AS d FROM ({_XYZ}))
    SELECT vec_id, round(320 + 500 * a / d, 4) AS u, round(240 + 500 * b / d, 4) AS v, round(d, 6) AS depth FROM c WHERE d > 0""")
def pinhole_projection(t):
    seen = vector.rigid(POSE, [F.col(c) for c in "xyz"])
    u, v = vector.pinhole(seen, FOCAL, CENTRE)
    return _xyz(t).where(seen[2] > 0).select("vec_id", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"), F.round(seen[2], 6).alias("depth"))


@query(f"""SELECT vec_id, round(sqrt(x * x + y * y + z * z), 6) AS distance, round(degrees(atan2(y, x)), 4) AS bearing, round(degrees(atan2(z, sqrt(x * x + y * y))), 4) AS elevation,
    ['E', 'NE', 'N', 'NW', 'W', 'SW', 'S', 'SE'][1 + CAST((floor((degrees(atan2(y, x)) + 22.5) / 45) + 8) % 8 AS INT)] AS sector,
    CASE WHEN least(abs(degrees(atan2(abs(y), abs(x)))), 90 - abs(degrees(atan2(abs(y), abs(x))))) > 15 THEN CASE WHEN y > 0 THEN 'front' ELSE 'back' END || '-' || CASE WHEN x > 0 THEN 'right' ELSE 'left' END END AS quadrant FROM ({_XYZ})""")
def bearing_sectors(t):
    x, y, z = (F.col(c) for c in "xyz")
    away, bearing, up = vector.polar(x, y, z)
    out = (F.round(away, 6).alias("distance"), F.round(bearing, 4).alias("bearing"), F.round(up, 4).alias("elevation"))
    return _xyz(t).select("vec_id", *out, fn.sector(x, y).alias("sector"), vector.quadrant(x, y, 15).alias("quadrant"))


@query(f"""WITH p AS ({_XYZ}), m AS (SELECT label, median(x) AS cx, median(y) AS cy, median(z) AS cz, quantile_cont(x, 0.05) AS x0, quantile_cont(x, 0.95) AS x1, quantile_cont(y, 0.05) AS y0, quantile_cont(y, 0.95) AS y1,
    quantile_cont(z, 0.05) AS z0, quantile_cont(z, 0.95) AS z1, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 30)
    SELECT label, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(x1 - x0, 6) AS dx, round(y1 - y0, 6) AS dy, round(z1 - z0, 6) AS dz,
    (SELECT count(*) FROM p WHERE p.label = m.label AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1) AS inside FROM m""")
def trimmed_boxes(t):
    return measure.trimmed_boxes(_xyz(t), "label", ["x", "y", "z"], 0.05, 30)


@query()
def floor_area_union(t):
    corners = t.embeddings.select("label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(area.CORNERS)))
    return area.union_area(corners, "label", 0.25).withColumn("area", F.round("area", 6))


@query()
def alpha_area_sensitivity(t):
    return area.alpha_area(_xyz(t), "label", "x", "y", [0.02, 0.05, 0.1, 0.2]).withColumn("area", F.round("area", 6))


@query()
def room_footprints(t):
    wide = _xyz(t).select((F.col("vec_id") % 2).alias("scene"), *((F.col(c) * 10).alias(c) for c in "xy"), (F.col("z") * 3).alias("z"))
    out = area.room_footprint(wide, "scene", ["x", "y", "z"], least=20)
    return out.select("scene", "n_points", "fragmented", *(F.round(c, 6).alias(c) for c in ("floor_z", "tight", "loose", "area")))


# ---- citations


@query(r"""WITH d AS (SELECT doc_id, text AS t, trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g')) AS c FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, text AS p, trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g')) AS q FROM benchmark WHERE text <> '')
    SELECT item_id, CASE WHEN contains(t, p) THEN 'exact' WHEN contains(c, q) THEN 'spaces' ELSE 'nfc' END AS tier, count(*) AS n FROM d, b
    WHERE contains(t, p) OR contains(c, q) OR contains(nfc_normalize(c), nfc_normalize(q)) GROUP BY ALL""")
def citation_tiers(t):
    return joins.citation_tiers(t.documents, t.benchmark).groupBy("item_id", "tier").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS t FROM events) SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM e""")
def trailing_gauge(t):
    return gauge.trailing_gauge(t.events.select("event_id", "event_type", "ts"), "ts", ["event_type"], 3600).select("event_id", "n")
