"""Queries on joins that assert, unions, rewrites, aggregates over sets, orders, and replays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from grainmill.functions import scalar as fn
from grainmill.operators import reconcile as rc
from grainmill.operators import select
from grainmill.plans.catalog import RANK, query


@query("""SELECT lang, count(*) AS n FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) FILTER (quality = 0) * 5 > count(*)) GROUP BY 1""")
def held_out_exclusion(t):
    bad = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("k"), F.count("*").alias("n")).where("k * 5 > n").select("source")
    kept = rc.exclude(t.documents.select("doc_id", "lang", "source"), [(t.labels.where("toxic = 1").select("doc_id"), "doc_id"), (bad, "source")])
    return kept.groupBy("lang").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > -500) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 1)))""")
def admitted_bundles(t):
    lists = {"trained": (t.supplier.where("s_acctbal > -500").select("s_suppkey"), "l_suppkey"), "held": (t.part.where("p_size = 1").select("p_partkey"), "l_partkey")}
    refused = rc.flagged(t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey"), lists).groupBy("l_orderkey").agg(F.bool_and(F.col("trained") & ~F.col("held")).alias("ok")).where("NOT ok")
    return t.orders.select("o_orderkey").join(refused.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""WITH a AS (SELECT user_id AS k, count(*) AS l FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id AS k, count(*) AS r FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT CASE WHEN l = 1 AND r = 1 THEN 'paired' WHEN r IS NULL THEN 'left only' WHEN l IS NULL THEN 'right only' ELSE 'repeated' END AS state, count(*) AS n, CAST(sum(coalesce(l, 0)) AS BIGINT) AS lefts FROM a FULL JOIN b USING (k) GROUP BY 1""")
def start_terminal_pairing(t):
    of = lambda kind: t.events.where(F.col("event_type") == kind).select(F.col("user_id").alias("k"))
    return rc.pairing_census(of("click"), of("purchase"), "k").groupBy("state").agg(F.count("*").alias("n"), F.sum("lefts").alias("lefts"))


@query("""WITH l AS (SELECT l_orderkey AS k, count(*) AS lines, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1)
    SELECT CASE WHEN k IS NULL THEN 'no receipt' WHEN o_orderkey IS NULL THEN 'no attempt' WHEN o_orderstatus = 'O' AND lines > 5 THEN 'open' WHEN cents < 5000000 THEN 'small' ELSE 'reconciled' END AS state, count(*) AS n FROM orders FULL JOIN l ON k = o_orderkey GROUP BY 1""")
def receipt_reconciliation(t):
    receipts = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("lines"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    state = F.when(F.col("k").isNull(), "no receipt").when(F.col("o_orderkey").isNull(), "no attempt").when((F.col("o_orderstatus") == "O") & (F.col("lines") > 5), "open").when(F.col("cents") < 5_000_000, "small").otherwise("reconciled")
    return t.orders.select("o_orderkey", "o_orderstatus").join(receipts, F.col("k") == F.col("o_orderkey"), "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT l_orderkey, l_partkey AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem), b AS (SELECT l_orderkey, l_partkey AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem WHERE l_linenumber <> 4)
    SELECT l_orderkey, count(v) AS n_left, count(w) AS n_right, min(k) FILTER (WHERE v IS DISTINCT FROM w) AS first_difference FROM a FULL JOIN b USING (l_orderkey, k) GROUP BY 1""")
def ordered_equality(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_linenumber", "l_partkey").alias("place"))
    return rc.same_order(rows, rows.where("l_linenumber <> 4"), "l_orderkey", "place", "l_partkey")


@query("""SELECT a.o_orderkey, b.l_linenumber FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS at FROM orders) a JOIN lineitem b ON b.l_orderkey = a.o_orderkey AND b.l_linenumber = a.at""")
def positional_join(t):
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    a = t.orders.select("o_orderkey", "o_custkey").select("o_orderkey", at.alias("at"))
    return a.join(t.lineitem, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("at") == F.col("l_linenumber"))).select("o_orderkey", "l_linenumber")


@query("""WITH f AS (SELECT o_custkey AS k, min(o_orderkey) AS x, count(*) AS n1 FROM orders GROUP BY 1), s AS (SELECT l_orderkey AS x, min(l_suppkey) AS y, count(*) AS n2 FROM lineitem GROUP BY 1)
    SELECT status, count(*) AS n, min(CASE WHEN status = 'found' THEN y END) AS least FROM (SELECT *, CASE WHEN n1 IS NULL THEN 'no index' WHEN n1 > 1 THEN 'repeated index' WHEN n2 IS NULL THEN 'no position' WHEN n2 > 1 THEN 'repeated position' ELSE 'found' END AS status
        FROM customer LEFT JOIN f ON k = c_custkey LEFT JOIN s USING (x)) GROUP BY 1""")
def two_hop_index(t):
    slots = t.customer.select(F.col("c_custkey").alias("k"))
    first = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("x"))
    second = t.lineitem.select(F.col("l_orderkey").alias("x"), F.col("l_suppkey").alias("y"))
    return rc.two_hops(slots, first, second, "k", "x", "y").groupBy("status").agg(F.count("*").alias("n"), F.min("y").alias("least"))


@query("""WITH q AS (SELECT DISTINCT lower(trim(x)) AS query FROM (SELECT unnest(['Machinery', 'auto', 'the building site', 'cars', 'home', 'zzz']) AS x FROM region)), l AS (SELECT DISTINCT lower(c_mktsegment) AS label FROM customer),
    m AS (SELECT query, label, CASE WHEN query = label THEN 1 WHEN contains(query, label) OR contains(label, query) THEN 2 WHEN (query = 'cars' AND (contains(label, 'automobile') OR contains('automobile', label))) OR (query = 'home' AND (contains(label, 'furniture') OR contains('furniture', label) OR contains(label, 'household') OR contains('household', label))) THEN 3
        WHEN len(list_intersect(list_filter(string_split(query, ' '), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and')), string_split(label, ' '))) > 0 THEN 4 END AS tier FROM q, l)
    SELECT query, label, tier FROM m WHERE tier = (SELECT min(tier) FROM m n WHERE n.query = m.query)""")
def label_cascade(t):
    asked = t.region.select(F.explode(F.array(*map(F.lit, ["Machinery", "auto", "the building site", "cars", "home", "zzz"]))).alias("query"))
    labels = t.customer.select(F.lower("c_mktsegment").alias("label")).distinct()
    return rc.label_cascade(asked, labels, {"cars": ["automobile"], "home": ["furniture", "household"]})


@query("""WITH b AS (SELECT ps AS k, max(v) AS best FROM (SELECT l_partkey AS ps, l_quantity AS v, count(*) OVER (PARTITION BY l_partkey, l_returnflag) AS c FROM lineitem WHERE l_returnflag = 'N') WHERE c <= 30 GROUP BY 1),
    u AS (SELECT l_partkey AS k, min(l_orderkey) AS o FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48 GROUP BY 1 HAVING count(*) = 1) SELECT k, o, best FROM u JOIN b USING (k)""")
def base_run_pairing(t):
    base = t.lineitem.where("l_returnflag = 'N'").groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_quantity").alias("best"), F.count("*").alias("c")).where("c <= 30").drop("c")
    one = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 48").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_orderkey").alias("o"), F.count("*").alias("c")).where("c = 1").drop("c")
    return one.join(base, "k")


@query("""WITH s AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn, text) AS rn FROM conversations WHERE role = 'assistant'), u AS (SELECT conv_id, max(text) AS u FROM conversations WHERE role = 'user' GROUP BY 1)
    SELECT conv_id, length(text) AS n, length(text) <= length(u) AS agrees FROM s LEFT JOIN u USING (conv_id) WHERE rn = 1""")
def shortest_sample_agreement(t):
    s = t.conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.min(F.struct(F.length("text").alias("n"), "turn", "text")).alias("x"))
    u = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.max("text").alias("u"))
    return s.join(u, "conv_id", "left").select("conv_id", F.col("x.n").cast("long").alias("n"), (F.col("x.n") <= F.length("u")).alias("agrees"))


@query("""SELECT d.doc_id, quality IS NOT NULL AND embedding IS NOT NULL AS complete, sha256(d.text) AS row_sha, len(embedding) AS width FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def bundle_alignment(t):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("row_sha")).join(t.labels.select("doc_id", "quality"), "doc_id", "left").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), F.size("embedding").cast("long").alias("width")), "doc_id", "left")
    return rows.select("doc_id", (F.col("quality").isNotNull() & F.col("width").isNotNull()).alias("complete"), "row_sha", "width")


# ---- sets, rewrites, routes


@query("SELECT doc_id, 'a' AS part FROM labels UNION ALL SELECT doc_id, 'b' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def disjoint_union(t):
    labelled = t.labels.select("doc_id").distinct()
    return rc.disjoint_union([labelled.withColumn("part", F.lit("a")), t.documents.select("doc_id").join(labelled, "doc_id", "left_anti").withColumn("part", F.lit("b"))], "doc_id")


@query("""WITH b AS (SELECT page_id AS k, sha256(html) AS b FROM pages WHERE length(html) < 2000), w AS (SELECT page_id AS k, sha256(CASE WHEN length(html) % 10 = 0 THEN lower(html) || ' ' ELSE html END) AS w FROM pages WHERE length(html) > 200)
    SELECT CASE WHEN b IS NULL THEN 'new' WHEN w IS NULL THEN 'missing' WHEN b = w THEN 'carried' ELSE 'changed' END AS state, count(*) AS n FROM b FULL JOIN w USING (k) GROUP BY 1""")
def superset_carry(t):
    p = t.pages.select("page_id", F.length("html").alias("n"), "html")
    wider = F.when(F.col("n") % 10 == 0, F.concat(F.lower("html"), F.lit(" "))).otherwise(F.col("html"))
    return rc.carried(p.where("n < 2000").select("page_id", F.sha2("html", 256).alias("d")), p.where("n > 200").select("page_id", F.sha2(wider, 256).alias("d")), "page_id", "d")


@query("""SELECT side, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'held' ELSE 'train' END AS side, o_custkey FROM orders) WHERE side = 'held' OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1""")
def base_exclusion(t):
    rows = t.orders.select(F.when(F.col("o_orderpriority") == "1-URGENT", "held").otherwise("train").alias("side"), "o_custkey")
    owing = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return rows.join(owing, (F.col("o_custkey") == F.col("k")) & (F.col("side") == "train"), "left_anti").groupBy("side").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS modes FROM lineitem GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (NOT (list_contains(modes, 'A') AND list_contains(modes, 'R'))) AS kept FROM g""")
def sibling_label_drop(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("modes"))
    siblings = F.array_contains("modes", "A") & F.array_contains("modes", "R")  # two labels of one group
    return g.agg(F.count("*").alias("n"), F.count_if(~siblings).alias("kept"))


@query("""SELECT conv_id, turn, CASE WHEN turn = 0 THEN replace(text, 'e', 'E') ELSE text END AS text, turn = 0 AND contains(text, 'e') AS rewritten FROM conversations""")
def selective_rewrite(t):
    new = F.when(F.col("turn") == 0, F.replace(F.col("text"), F.lit("e"), F.lit("E"))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", new.alias("text"), (F.sha2(new, 256) != F.sha2("text", 256)).alias("rewritten"))


@query("""SELECT CASE WHEN len(why) = 0 THEN 'admitted' ELSE 'deferred' END AS route, coalesce(why[1], '') AS reason, count(*) AS n FROM (SELECT list_filter([CASE WHEN p_size > 40 THEN 'size' END, CASE WHEN p_retailprice > 1400 THEN 'price' END], lambda x: x IS NOT NULL) AS why FROM part) GROUP BY ALL""")
def routed_rows(t):
    why = F.array_compact(F.array(F.when(F.col("p_size") > 40, "size"), F.when(F.col("p_retailprice") > 1400, "price")))
    return t.part.groupBy(F.when(F.size(why) == 0, "admitted").otherwise("deferred").alias("route"), F.coalesce(F.try_element_at(why, F.lit(1)), F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


# ---- orders and limits


@query("SELECT o_orderkey FROM orders ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 40")
def id_prefix_limit(t):
    return t.orders.select("o_orderkey").orderBy(F.col("o_orderkey").cast("string")).limit(40)


@query("SELECT p_partkey, p_brand FROM part ORDER BY p_size <> 7, p_retailprice DESC, p_partkey LIMIT 30")
def priority_order(t):
    return t.part.orderBy(F.col("p_size") != 7, F.desc("p_retailprice"), "p_partkey").limit(30).select("p_partkey", "p_brand")


@query(f"SELECT c_custkey FROM customer ORDER BY c_mktsegment <> 'BUILDING', {RANK.format('r', 'c_custkey')}, c_custkey LIMIT 50")
def replacement_order(t):
    return t.customer.orderBy(F.col("c_mktsegment") != "BUILDING", fn.digest(F.lit("r"), F.col("c_custkey")), "c_custkey").limit(50).select("c_custkey")


@query("""WITH s AS (SELECT l_suppkey AS shard, l_linenumber AS owner, count(*) AS left_ FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL), o AS (SELECT l_linenumber AS owner, count(*) FILTER (l_linestatus = 'O' AND l_quantity > 49) AS running FROM lineitem GROUP BY 1)
    SELECT owner, arg_max(shard, (left_, -shard)) AS shard, max(left_) AS left_ FROM s JOIN o USING (owner) WHERE running <= (SELECT max(running) - 1 FROM o) GROUP BY 1""")
def shard_choice(t):
    s = t.lineitem.where("l_returnflag = 'N'").groupBy(F.col("l_suppkey").alias("shard"), F.col("l_linenumber").alias("owner")).agg(F.count("*").alias("left_"))
    o = t.lineitem.groupBy(F.col("l_linenumber").alias("owner")).agg(F.count_if((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 49)).alias("running"))
    free = o.crossJoin(o.agg(F.max("running").alias("cap"))).where("running < cap").select("owner")  # one row beside a few owners
    return s.join(F.broadcast(free), "owner").groupBy("owner").agg(F.max_by("shard", F.struct("left_", -F.col("shard"))).alias("shard"), F.max("left_").alias("left_"))


@query("""WITH a AS (SELECT c_mktsegment, list(c_custkey ORDER BY c_custkey) AS ids FROM customer GROUP BY 1)
    SELECT c_mktsegment, unnest(list_transform(list_distinct(list_transform(range(0, 20), lambda k: CAST(round_even(k * (len(ids) - 1) / 19.0, 0) AS BIGINT))), lambda i: ids[i + 1])) AS c_custkey FROM a""")
def about_twenty(t):
    """Places are ranks; the segments' sizes give the wanted ones."""
    sizes = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.bround(k * (F.col("n") - 1) / 19.0, 0).cast("long")))
    wanted = sizes.select("c_mktsegment", F.explode(places).alias("i"))
    ranks = select.ranked(t.customer.select("c_mktsegment", "c_custkey"), ["c_mktsegment"], [F.col("c_custkey")], "rank")
    return ranks.withColumn("i", F.col("rank") - 1).join(F.broadcast(wanted), ["c_mktsegment", "i"]).select("c_mktsegment", "c_custkey")


@query(f"""SELECT lang, 'd' || lpad(CAST(row_number() OVER (PARTITION BY lang ORDER BY {RANK.format('o', 'doc_id')}, doc_id) AS VARCHAR), 6, '0') AS ordinal, doc_id FROM documents""")
def ordinal_ids(t):
    rank = select.ranked(t.documents.select("lang", "doc_id"), ["lang"], [fn.digest(F.lit("o"), F.col("doc_id")), F.col("doc_id")], "rank")
    return rank.select("lang", F.concat(F.lit("d"), F.lpad(F.col("rank").cast("string"), 6, "0")).alias("ordinal"), "doc_id")


# ---- aggregates


@query("""SELECT l_partkey, min(l_linenumber) AS first_slot, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS slots, min(l_linenumber) FILTER (l_quantity >= 25) AS first_large FROM lineitem GROUP BY 1""")
def visibility_slots(t):
    slots = F.array_join(F.array_sort(F.collect_set("l_linenumber")), ",")
    return t.lineitem.groupBy("l_partkey").agg(F.min("l_linenumber").alias("first_slot"), slots.alias("slots"), F.min(F.when(F.col("l_quantity") >= 25, F.col("l_linenumber"))).alias("first_large"))


@query("""SELECT l_linenumber, count(DISTINCT (l_partkey, l_suppkey)) AS compared, count(DISTINCT (l_partkey, l_suppkey)) FILTER (l_returnflag = 'R') AS differing FROM lineitem GROUP BY 1""")
def disagreement_rates(t):
    each = t.lineitem.groupBy("l_linenumber", "l_partkey", "l_suppkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("d"))
    return each.groupBy("l_linenumber").agg(F.count("*").alias("compared"), F.count_if("d").alias("differing"))


@query("""SELECT p_brand, count(*) FILTER (side = 'held') AS held, count(*) FILTER (side = 'train') AS train FROM (SELECT p_brand, CASE WHEN sha256('t|' || CAST(p_partkey AS VARCHAR)) < '2' THEN 'held' ELSE 'train' END AS side FROM part) GROUP BY 1""")
def composition(t):
    side = F.when(fn.digest(F.lit("t"), F.col("p_partkey")) < "2", "held").otherwise("train")
    return t.part.select("p_brand", side.alias("side")).groupBy("p_brand").pivot("side", ["held", "train"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def supported_types(t):
    return t.part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderstatus, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS lines FROM orders GROUP BY ALL HAVING count(*) > 1""")
def agreeing_lines(t):
    g = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.array_sort(F.collect_list("o_orderkey")).alias("x")).where(F.size("x") > 1)
    return g.select("o_custkey", "o_orderstatus", F.array_join("x", ",").alias("lines"))


@query("""SELECT p_brand, count(*) AS n, count(r) AS finite, round(min(r), 6) AS lo, round(max(r), 6) AS hi, round(quantile_cont(r, 0.5), 6) AS median FROM
    (SELECT p_brand, CASE WHEN p_size % 9 <> 0 THEN CAST(round(l_extendedprice / l_quantity / p_retailprice * 1000) AS DOUBLE) / 1000 END AS r FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1""")
def agreement_ratios(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    r = F.when(F.col("p_size") % 9 != 0, F.round(F.col("l_extendedprice") / F.col("l_quantity") / F.col("p_retailprice") * 1000) / 1000)
    one = rows.select("p_brand", r.alias("r")).groupBy("p_brand", "r").agg(F.count("*").alias("k"))  # equal ratios together
    return one.groupBy("p_brand").agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("r").isNotNull(), F.col("k"))), F.lit(0)).alias("finite"), F.round(F.min("r"), 6).alias("lo"), F.round(F.max("r"), 6).alias("hi"), F.round(F.percentile("r", F.lit(0.5), F.col("k")), 6).alias("median"))


@query("SELECT event_type, CAST(round_even(sum(CAST(round(value * 100) AS DECIMAL(18, 0))) * 10000000000000 / count(*), 0) AS DECIMAL(38, 0)) AS mean_e15 FROM events GROUP BY 1".replace("round_even(sum(CAST(round(value * 100) AS DECIMAL(18, 0))) * 10000000000000 / count(*), 0)", "(sum(CAST(round(value * 100) AS HUGEINT)) * 10000000000000) // count(*)"))
def decimal_means(t):
    total = F.sum(F.round(F.col("value") * 100).cast("decimal(18,0)")).cast("decimal(24,0)")
    return t.events.groupBy("event_type").agg(total.alias("s"), F.count("*").alias("n")).select("event_type", F.expr("cast((s * 10000000000000) div n as decimal(38,0))").alias("mean_e15"))


_CAPACITY = {"a": 3, "b": 50, "c": 1000, "d": 0}


@query("SELECT * FROM (VALUES ('a', 3), ('b', 50), ('c', 47)) v(kind, quota)")
def saturating_quota(t):
    got = rc.quotas(_CAPACITY, {"a": 4, "b": 3, "c": 2, "d": 1}, 100)
    return t.spark.createDataFrame([(k, n) for k, n in got.items() if n], "kind string, quota long")


# ---- replays


@query("""SELECT side, n FROM (VALUES ('stored only', (SELECT count(*) FROM orders WHERE o_orderkey % 13 = 0)), ('again only', (SELECT count(*) FROM orders WHERE o_orderkey % 13 = 0))) v(side, n)""")
def dataset_replay(t):
    stored = t.orders.select("o_orderkey", F.col("o_totalprice").alias("v"))
    again = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("v"))
    return rc.replayed(stored, again)


@query("SELECT true AS same, count(*) AS n FROM documents")
def repeat_is_identical(t):
    once, again = (rc.table_digest(select.hash_ranked(t.documents.select("doc_id", "lang"), ["lang"], "doc_id", "s")) for _ in range(2))
    return once.join(again.withColumnRenamed("n", "m"), "digest", "full").select((F.col("n") == F.col("m")).alias("same"), "n")


@query("""WITH a AS (SELECT event_id, value >= 50 AS accepted FROM events), b AS (SELECT event_id, round(value) >= 50 AS accepted FROM events) SELECT a.accepted AS stored, b.accepted AS again, count(*) AS n FROM a JOIN b USING (event_id) GROUP BY ALL""")
def redecision(t):
    a, b = (t.events.select("event_id", (c >= 50).alias(n)) for c, n in ((F.col("value"), "stored"), (F.round("value"), "again")))
    return a.join(b, "event_id").groupBy("stored", "again").agg(F.count("*").alias("n"))


#: Tables that the printed counts are dealt into.
_LEAVES = 4096


@query("""WITH c AS (SELECT c_mktsegment AS s, count(*) AS n, CAST(round(sum(c_acctbal)) AS BIGINT) AS total FROM customer GROUP BY 1) SELECT s, n = stated AS n_ok, 1 AS found FROM (SELECT s, n, CASE WHEN s = 'BUILDING' THEN n + 1 ELSE n END AS stated FROM c)""")
def document_check(t):
    s = F.col("s")
    counts = t.customer.groupBy(F.col("c_mktsegment").alias("s")).agg(F.count("*").alias("n"))
    # cells are printed with marks and spaces encoded, so that any text is read back as it was; brackets never stand in an encoded text
    cell = F.coalesce(F.url_encode(s), F.lit("(none)"))
    line = F.concat(F.lit("| "), cell, F.lit(" | "), F.when(s == "BUILDING", F.col("n") + 1).otherwise(F.col("n")).cast("string"), F.lit(" |"))
    leaf = F.pmod(F.xxhash64("s"), F.lit(_LEAVES))  # one table a leaf, so that no row holds all segments
    head = F.array(F.lit("Counts:"), F.lit("| segment | n |"), F.lit("| --- | ---: |"))
    page = counts.groupBy(leaf.alias("leaf")).agg(F.concat(head, F.array_sort(F.collect_list(line))).alias("lines"))  # a printed table
    cells = page.select(F.explode(rc.markdown_rows(F.col("lines"))).alias("c")).select(F.when(F.col("c")[0] != "(none)", F.url_decode(F.col("c")[0])).alias("p"), F.col("c")[1].try_cast("long").alias("stated"))
    joined = counts.join(cells, s.eqNullSafe(F.col("p")), "left")
    return joined.select("s", (F.col("n") == F.col("stated")).alias("n_ok"), F.col("stated").isNotNull().cast("int").alias("found"))


@query("""SELECT a.o_orderkey AS k, CASE WHEN a.o_clerk IS NOT DISTINCT FROM b.o_clerk THEN 'paired' WHEN a.o_orderdate > b.o_orderdate THEN 'newer' ELSE 'refused' END AS rule FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1""".replace("a.o_clerk IS NOT DISTINCT FROM b.o_clerk", "a.o_custkey = b.o_custkey"))
def cross_run_pairing(t):
    a = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("d"))
    b = t.orders.select((F.col("o_orderkey") - 1).alias("k"), F.col("o_custkey").alias("c2"), F.col("o_orderdate").alias("d2"))
    return a.join(b, "k").select("k", F.when(F.col("c") == F.col("c2"), "paired").when(F.col("d") > F.col("d2"), "newer").otherwise("refused").alias("rule"))


@query("""WITH r AS (SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn, role, text) AS raw FROM conversations GROUP BY 1), c AS (SELECT conv_id, string_agg(role || ':' || trim(text), '|' ORDER BY turn, role, text) AS clean FROM conversations GROUP BY 1)
    SELECT conv_id, raw = clean AS same FROM r JOIN c USING (conv_id)""")
def trace_equivalence(t):
    def told(text):
        rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
        return rows.select("conv_id", F.transform("x", lambda m: F.struct(m["role"], text(m["text"]).alias("text"))).alias("x"))

    raw, clean = told(lambda c: c), told(F.trim).withColumnRenamed("x", "y")
    return raw.join(clean, "conv_id").select("conv_id", (F.col("x") == F.col("y")).alias("same"))
