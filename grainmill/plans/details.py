"""Queries on the finer rules: missing categories, means by several groupings, strikes, first of several, offsets of citations, sides and closures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from grainmill.functions import scalar as fn
from grainmill.operators import admission as ad
from grainmill.operators import joins, select
from grainmill.operators import reconcile as rc
from grainmill.plans.catalog import RANK, query

# ---- scores


@query("""WITH c AS (SELECT c_mktsegment AS category, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS m FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
    SELECT round(avg(m), 6) AS macro, CAST(count(*) AS BIGINT) AS present, (SELECT string_agg(x, ',' ORDER BY x) FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('SPACE')) v(x) WHERE x NOT IN (SELECT category FROM c)) AS missing FROM c""")
def raw_macro_with_missing(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    c = rows.groupBy("c_mktsegment").agg((F.sum((F.col("o_orderstatus") == "F").cast("long")).cast("double") / F.count("*")).alias("m"))
    wanted = F.array(*map(F.lit, ["AUTOMOBILE", "BUILDING", "SPACE"]))  # the categories of the benchmark
    return c.agg(F.round(F.avg("m"), 6).alias("macro"), F.count("*").alias("present"), F.array_join(F.array_sort(F.array_except(wanted, F.collect_set("c_mktsegment"))), ",").alias("missing"))


@query("""SELECT event_type, k AS variant, count(*) AS n, round(CAST(sum(CAST(value > 50 AS INT)) AS DOUBLE) / count(*), 6) AS mean FROM (SELECT *, user_id % 4 AS k FROM events) GROUP BY GROUPING SETS ((event_type), (k), (event_type, k))""")
def category_variant_means(t):
    rows = t.events.select("event_type", (F.col("user_id") % 4).alias("variant"), (F.col("value") > 50).cast("long").alias("x"))
    sets = rows.groupingSets([["event_type"], ["variant"], ["event_type", "variant"]], "event_type", "variant")
    return sets.agg(F.count("*").alias("n"), F.round(F.sum("x").cast("double") / F.count("*"), 6).alias("mean"))


@query("""WITH a AS (SELECT user_id AS k, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v, event_type FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id, event_type)
    SELECT count(*) AS pairs, count(*) FILTER (x.v > y.v) AS better, CAST(sum(x.v - y.v) AS BIGINT) AS delta FROM a x JOIN a y ON x.k = y.k AND x.event_type = 'click' AND y.event_type = 'view'""")
def paired_comparison(t):
    of = lambda kind, n: t.events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias(n))
    both = of("click", "x").join(of("view", "y"), "user_id")
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("x") > F.col("y")).alias("better"), F.sum(F.col("x") - F.col("y")).alias("delta"))


@query("""WITH e AS (SELECT doc_id FROM documents WHERE n_chars < 100 UNION SELECT doc_id FROM labels WHERE quality IS NULL UNION SELECT doc_id FROM documents WHERE lang = 'de' AND n_chars < 300)
    SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM documents JOIN labels USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM e) GROUP BY 1""")
def matched_subset(t):
    """Ids that any run left empty go from all runs."""
    empty = t.documents.where("n_chars < 100 OR (lang = 'de' AND n_chars < 300)").select("doc_id").union(t.labels.where("quality IS NULL").select("doc_id"))
    kept = rc.exclude(t.documents.select("doc_id", "lang").join(t.labels, "doc_id"), [(empty, "doc_id")])
    return kept.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))


@query("""WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS t FROM events WHERE value < 20), w AS (SELECT e.user_id, e.t, (SELECT count(DISTINCT event_type) FROM e f WHERE f.user_id = e.user_id AND f.t > e.t - 3600000000 AND f.t <= e.t) AS kinds FROM e)
    SELECT user_id, count(*) AS failures, count(*) >= 3 AS struck, max(kinds) AS worst FROM w GROUP BY 1""")
def strikes_and_storms(t):
    """Strikes: three failures of one key. Storms: how many distinct workers failed within the hour before a failure."""
    e = t.events.where("value < 20").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-3_599_999_999, 0)
    kinds = e.withColumn("kinds", F.size(F.collect_set("event_type").over(w)))
    return kinds.groupBy("user_id").agg(F.count("*").alias("failures"), (F.count("*") >= 3).alias("struck"), F.max("kinds").cast("long").alias("worst"))


# ---- selection


@query("""WITH u AS (SELECT conv_id, text, min(struct_pack(n := length(text), turn := turn)) AS x FROM conversations WHERE role = 'assistant' GROUP BY ALL), r AS (SELECT conv_id, x.n AS n, x.turn AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY x.n, x.turn, text) AS rn FROM u)
    SELECT conv_id, turn, CAST(n AS BIGINT) AS n FROM r WHERE rn <= 2""")
def shortest_unique_texts(t):
    first = t.conversations.where("role = 'assistant'").groupBy("conv_id", "text").agg(F.min(F.struct(F.length("text").alias("n"), "turn")).alias("x"))
    return select.best_of(first, ["conv_id"], [F.col("x.n"), F.col("x.turn"), F.col("text")], 2).select("conv_id", "x.turn", F.col("x.n").cast("long").alias("n"))


@query("SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY 1 ORDER BY min(doc_id) LIMIT 3")
def first_of_categories(t):
    return t.documents.groupBy("lang").agg(F.min("doc_id").alias("doc_id")).orderBy("doc_id").limit(3)


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) WHERE rn <= 4")
def first_rows_by_type(t):
    return select.best_of(t.part.select("p_brand", "p_partkey"), ["p_brand"], [F.col("p_partkey")], 4).drop("rn")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 3")
def top_by_score(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return select.best_of(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 3).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, (rn - 1) // 500 AS shard, (rn - 1) % 500 AS record FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)")
def shard_records(t):
    each = select.ranked(t.orders.select("o_orderkey"), [], [F.col("o_orderkey")], "place")
    return each.select("o_orderkey", F.expr("(place - 1) div 500").alias("shard"), ((F.col("place") - 1) % 500).alias("record"))


@query(f"""WITH g AS (SELECT source, count(*) AS n, {RANK.format('split', 'source')} AS h FROM documents GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY h, source) AS upto, sum(n) OVER () AS total FROM g)
    SELECT source, n, CASE WHEN upto * 5 <= total THEN 'held' ELSE 'train' END AS side FROM r""")
def group_quota_split(t):
    """Groups by hash rank until a fifth of the rows is held out; a group is on one side whole."""
    g = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    order = Window.orderBy(fn.digest(F.lit("split"), F.col("source")), "source")  # one row a group
    return g.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy())}).select("source", "n", F.when(F.col("upto") * 5 <= F.col("total"), "held").otherwise("train").alias("side"))


@query("""WITH f AS (SELECT l_partkey AS fact, l_returnflag AS render, l_suppkey AS source FROM lineitem WHERE l_quantity > 45) SELECT fact, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM f GROUP BY 1 HAVING count(DISTINCT render) = 1""")
def merged_facts(t):
    f = t.lineitem.where("l_quantity > 45").groupBy(F.col("l_partkey").alias("fact")).agg(F.min("l_returnflag").alias("a"), F.max("l_returnflag").alias("b"), F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    return f.where("a = b").select("fact", F.array_join(F.col("s").cast("array<string>"), ",").alias("sources"))


@query("""(SELECT 'left' AS side, k, n FROM (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1 EXCEPT SELECT o_orderpriority, count(*) FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority = '2-HIGH' GROUP BY 1)) UNION ALL
    (SELECT 'right', k, n FROM (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority = '2-HIGH' GROUP BY 1 EXCEPT SELECT o_orderpriority, count(*) FROM orders GROUP BY 1))""")
def multiset_equality(t):
    """Values that two lists have in different numbers, with each side's number."""
    count = lambda df, n: df.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias(n))
    both = count(t.orders, "l").join(count(t.orders.where("o_orderstatus <> 'P' OR o_orderpriority = '2-HIGH'"), "r"), "k", "full").na.fill(0, ["l", "r"]).where("l <> r")
    sides = F.array(F.struct(F.lit("left").alias("side"), F.col("l").alias("n")), F.struct(F.lit("right").alias("side"), F.col("r").alias("n")))
    return both.select("k", F.explode(sides).alias("x")).where("x.n > 0").select("x.side", "k", "x.n")


# ---- admission, sides, traces


@query("""SELECT event_id, regexp_matches(lower(k), '^(gold|answer|target)') AS named FROM (SELECT event_id, replace(['Gold-Label', 'note', 'answer_text', 'my_answer'][event_id % 4 + 1], '-', '_') AS k FROM events)""")
def forbidden_names(t):
    name = F.element_at(F.array(*map(F.lit, ["Gold-Label", "note", "answer_text", "my_answer"])), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select("event_id", F.replace(F.lower(name), F.lit("-"), F.lit("_")).rlike("^(gold|answer|target)").alias("named"))


@query("""WITH m AS (SELECT conv_id, turn, role, turn // 2 + CASE WHEN conv_id % 7 = 0 AND role = 'assistant' THEN 1 ELSE 0 END AS call FROM conversations),
    c AS (SELECT conv_id, call, min(turn) AS asked, count(*) AS n FROM m WHERE role = 'user' GROUP BY ALL), r AS (SELECT conv_id, call, min(turn) AS answered, count(*) AS k FROM m WHERE role = 'assistant' GROUP BY ALL)
    SELECT conv_id, bool_and(coalesce(n = 1 AND k = 1 AND answered > asked, false)) AS complete, count(*) AS calls FROM c FULL JOIN r USING (conv_id, call) GROUP BY 1""")
def calls_answered_by_id(t):
    """Every call id is asked once, answered once, and later; an answer without a call counts against the trace."""
    call = F.expr("turn div 2") + F.when((F.col("conv_id") % 7 == 0) & (F.col("role") == "assistant"), 1).otherwise(0)
    m = t.conversations.select("conv_id", "turn", "role", call.alias("call"))
    g = m.groupBy("conv_id", "call").agg(F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("asked"), F.count_if(F.col("role") == "user").alias("n"), F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("answered"), F.count_if(F.col("role") == "assistant").alias("k"))
    g = g.where("n > 0 OR k > 0")
    return g.groupBy("conv_id").agg(F.bool_and(F.coalesce((F.col("n") == 1) & (F.col("k") == 1) & (F.col("answered") > F.col("asked")), F.lit(False))).alias("complete"), F.count("*").alias("calls"))


_SAMPLE = "CASE event_id % 6 WHEN 0 THEN concat('<think>it is ', CAST(user_id AS STRING), '</think><answer>', CAST(user_id AS STRING), '</answer>') WHEN 1 THEN concat('<think>it is 0</think><answer>', CAST(user_id AS STRING), '</answer>') WHEN 2 THEN '<answer>5</answer>' WHEN 3 THEN '<think>x' ELSE concat('<think>', CAST(user_id AS STRING), '</think><answer>7</answer>') END"


@query(f"""WITH e AS (SELECT event_id, user_id, {_SAMPLE.replace('STRING', 'VARCHAR')} AS s FROM events), p AS (SELECT *, regexp_extract(s, '^<think>(.*)</think>', 1) AS t, regexp_extract(s, '<answer>([^<]*)</answer>$', 1) AS a FROM e)
    SELECT CASE WHEN NOT regexp_full_match(s, '<think>.*</think><answer>[^<]*</answer>') THEN 'format' WHEN NOT list_contains(regexp_extract_all(t, '[0-9]+'), a) THEN 'think_answer' WHEN a <> CAST(user_id AS VARCHAR) THEN 'truth' END AS reason, count(*) AS n FROM p GROUP BY 1""")
def sample_judge(t):
    s = F.expr(_SAMPLE)
    think, answer = F.regexp_extract(s, "^<think>(.*)</think>", 1), F.regexp_extract(s, "<answer>([^<]*)</answer>$", 1)
    why = ad.first_reason({"format": s.rlike("^<think>.*</think><answer>[^<]*</answer>$"), "think_answer": F.array_contains(F.regexp_extract_all(think, F.lit("([0-9]+)")), answer), "truth": answer == F.col("user_id").cast("string")})
    return t.events.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT l_suppkey AS track, l_linenumber AS frame, l_discount * 10 AS score, l_quantity / 50 AS area FROM lineitem) SELECT track, count(DISTINCT frame) AS frames FROM d WHERE score >= 0.5 AND area >= 0.2 GROUP BY 1 HAVING count(DISTINCT frame) >= 3""")
def detection_gate(t):
    good = t.lineitem.where((F.col("l_discount") * 10 >= 0.5) & (F.col("l_quantity") / 50 >= 0.2))
    return good.groupBy(F.col("l_suppkey").alias("track")).agg(F.countDistinct("l_linenumber").alias("frames")).where("frames >= 3")


@query("""WITH s AS (SELECT DISTINCT c_custkey AS k, c_nationkey < 5 AS held FROM customer), o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'held' ELSE 'train' END AS side FROM orders)
    SELECT CASE WHEN held IS NULL THEN 'unknown_group' WHEN held AND side = 'train' THEN 'held_group_in_training' WHEN NOT held AND side = 'held' THEN 'training_group_held' END AS reason, count(*) AS n FROM o LEFT JOIN s ON k = o_custkey GROUP BY 1""")
def side_guard(t):
    s = t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") < 5).alias("held"))
    o = t.orders.select("o_custkey", F.when(F.col("o_orderstatus") == "P", "held").otherwise("train").alias("side")).join(s, F.col("k") == F.col("o_custkey"), "left")
    why = F.when(F.col("held").isNull(), "unknown_group").when(F.col("held") & (F.col("side") == "train"), "held_group_in_training").when(~F.col("held") & (F.col("side") == "held"), "training_group_held")
    return o.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT d.doc_id, coalesce(array_to_string(list(a.note ORDER BY a.note) FILTER (a.note IS NOT NULL), ';'), '') AS notes FROM documents d LEFT JOIN (SELECT doc_id, 'toxic=' || toxic AS note FROM labels UNION ALL SELECT doc_id, 'quality=' || quality FROM labels) a ON a.doc_id = d.doc_id GROUP BY 1""")
def annotated(t):
    """Every row stays, whatever notes it has."""
    note = F.explode(F.array(F.concat(F.lit("toxic="), "toxic"), F.concat(F.lit("quality="), "quality")))
    notes = t.labels.select("doc_id", note.alias("note")).where("note IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list("note")).alias("notes"))
    return t.documents.select("doc_id").join(notes, "doc_id", "left").select("doc_id", F.coalesce(F.array_join("notes", ";"), F.lit("")).alias("notes"))


@query("""SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN quality = 1 THEN 'right' ELSE 'wrong' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def missing_status(t):
    both = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality", F.lit(True).alias("there")), "doc_id", "left")
    return both.groupBy(F.when(F.col("there").isNull(), "missing").when(F.col("quality") == 1, "right").otherwise("wrong").alias("status")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT doc_id, 'toxic' AS why FROM labels WHERE toxic = 1 UNION SELECT doc_id, 'low quality' FROM labels WHERE quality = 0 UNION SELECT doc_id, 'short' FROM documents WHERE n_chars < 200),
    g AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT why)), '+') AS why FROM x GROUP BY 1) SELECT coalesce(why, 'kept') AS why, count(*) AS n FROM documents LEFT JOIN g USING (doc_id) GROUP BY 1""")
def exclusion_authorities(t):
    why = lambda df, name: df.select("doc_id", F.lit(name).alias("why"))
    told = why(t.labels.where("toxic = 1"), "toxic").union(why(t.labels.where("quality = 0"), "low quality")).union(why(t.documents.where("n_chars < 200"), "short"))
    g = told.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("why")), "+").alias("why"))
    return t.documents.select("doc_id").join(g, "doc_id", "left").groupBy(F.coalesce("why", F.lit("kept")).alias("why")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN c_nationkey = 3 THEN 'held_out' WHEN c_mktsegment = 'BUILDING' THEN 'benchmark' WHEN c_acctbal < 0 THEN 'not_train' WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'no_trace' ELSE 'kept' END AS why FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT why, count(*) AS n FROM c GROUP BY 1""")
def drop_cascade(t):
    rows = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment", "c_acctbal"), "o_custkey")
    traced = rc.flagged(rows, {"traced": (t.lineitem.select("l_orderkey"), "o_orderkey")})
    why = ad.first_reason({"held_out": F.col("c_nationkey") != 3, "benchmark": F.col("c_mktsegment") != "BUILDING", "not_train": F.col("c_acctbal") >= 0, "no_trace": F.col("traced")})
    return traced.groupBy(F.coalesce(why, F.lit("kept")).alias("why")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_brand, p_partkey, p_retailprice FROM part), m AS (SELECT a.p_brand, a.p_partkey, b.p_partkey AS near, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.p_retailprice - b.p_retailprice), b.p_partkey) AS rn FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey) SELECT p_brand, p_partkey, near FROM m WHERE rn = 1""")
def nearest_instance(t):
    """Nearest of the same group by one value: a neighbour in the order of values, so that no pairs are made."""
    rows = t.part.select("p_brand", "p_partkey", "p_retailprice")
    one = rows.groupBy("p_brand", "p_retailprice").agg(F.min("p_partkey").alias("a"), F.count("*").alias("n"), F.array_sort(F.collect_list("p_partkey")).alias("ids"))
    v = Window.partitionBy("p_brand").orderBy("p_retailprice")
    near = one.withColumns({"before": F.lag(F.struct("p_retailprice", "a")).over(v), "after": F.lead(F.struct("p_retailprice", "a")).over(v)})
    joined = rows.join(near, ["p_brand", "p_retailprice"])
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("p_retailprice") - F.col(f"{c}.p_retailprice")).alias("gap"), F.col(f"{c}.a").alias("id")))
    other = F.when(F.col("n") > 1, F.struct(F.lit(0.0).alias("gap"), F.when(F.col("p_partkey") == F.col("a"), F.get("ids", F.lit(1))).otherwise(F.col("a")).alias("id")))
    best = F.array_min(F.array_compact(F.array(gap("before"), gap("after"), other)))
    return joined.select("p_brand", "p_partkey", best["id"].alias("near")).where("near IS NOT NULL")


@query("""SELECT doc_id, item_id, instr(regexp_replace(text, '[ \t\n]+', ' ', 'g'), regexp_replace(b.t, '[ \t\n]+', ' ', 'g')) - 1 AS at FROM documents JOIN (SELECT item_id, text AS t FROM benchmark) b ON contains(regexp_replace(text, '[ \t\n]+', ' ', 'g'), regexp_replace(b.t, '[ \t\n]+', ' ', 'g'))""")
def spaced_citation_offsets(t):
    """Offset of a quotation in the text with its white space collapsed."""
    d = t.documents.select("doc_id", F.regexp_replace("text", "[ \t\n]+", " ").alias("t"))
    b = t.benchmark.select("item_id", F.regexp_replace("text", "[ \t\n]+", " ").alias("p"))
    return joins.contained(d, b, F.contains(F.col("t"), F.col("p"))).select("doc_id", "item_id", (F.expr("instr(t, p)") - 1).cast("long").alias("at"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(['der', 'the', 'que', 'maybe'], lambda w: regexp_matches(lower(text), '(^|[^a-z0-9_])' || w || '([^a-z0-9_]|$)')))), ',') AS markers FROM documents""")
def word_markers(t):
    found = F.filter(F.array(*map(F.lit, ["der", "the", "que", "maybe"])), lambda w: F.rlike(F.lower("text"), F.concat(F.lit("(^|[^a-z0-9_])"), w, F.lit("([^a-z0-9_]|$)"))))
    return t.documents.select("doc_id", F.array_join(F.array_sort(found), ",").alias("markers"))


@query("SELECT doc_id, len(n) AS numbers, CAST(list_sum(list_transform(n, lambda x: length(split_part(x, '.', 2)))) AS BIGINT) AS places FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+(\\.[0-9]+)?') AS n FROM documents) WHERE len(n) > 0")
def every_number(t):
    n = t.documents.select("doc_id", fn.numbers_in(F.col("text")).alias("n")).where(F.size("n") > 0)
    places = F.aggregate(F.transform("n", fn.places), F.lit(0), lambda a, x: a + x)
    return n.select("doc_id", F.size("n").cast("long").alias("numbers"), places.cast("long").alias("places"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND regexp_matches(o_orderpriority, '^[0-9]') THEN substr(o_orderpriority, 1, 1) ELSE 'Long: ' || o_orderpriority END AS target, o_orderstatus = 'F' AS substituted FROM orders""")
def answer_only_targets(t):
    letter = F.regexp_extract("o_orderpriority", "^([0-9])", 1)
    swap = (F.col("o_orderstatus") == "F") & (letter != "")
    return t.orders.select("o_orderkey", F.when(swap, letter).otherwise(F.concat(F.lit("Long: "), "o_orderpriority")).alias("target"), (F.col("o_orderstatus") == "F").alias("substituted"))


@query("""WITH n AS (SELECT s_suppkey, ['scannet', 'scannetppv2', 'arkit'][s_nationkey % 3 + 1] AS d, 'scene' || lpad(CAST(s_nationkey AS VARCHAR), 4, '0') || '_0' || s_suppkey % 3 AS s FROM supplier)
    SELECT CASE WHEN d LIKE 'scannetpp%' THEN 'scannetpp' ELSE d END || '/' || CASE WHEN d = 'scannet' THEN regexp_replace(s, '_[0-9][0-9]$', '') ELSE s END AS split_group, CASE WHEN d LIKE 'scannetpp%' THEN 'scannetpp' ELSE d END || '/' || regexp_replace(s, '_[0-9]+$', '') AS block_group, count(*) AS n FROM n GROUP BY ALL""")
def scene_groups(t):
    d = F.element_at(F.array(*map(F.lit, ["scannet", "scannetppv2", "arkit"])), F.col("s_nationkey") % 3 + 1)
    s = F.concat(F.lit("scene"), F.lpad(F.col("s_nationkey").cast("string"), 4, "0"), F.lit("_0"), (F.col("s_suppkey") % 3).cast("string"))
    return t.supplier.groupBy(fn.scene_group(d, s, blocking=False).alias("split_group"), fn.scene_group(d, s, blocking=True).alias("block_group")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS questions, count(DISTINCT k) AS distinct_questions FROM (SELECT sha256(concat(source, '|', trim(regexp_replace(lower(text), '[ \t\n\r\f\x0b]+', ' ', 'g')))) AS k FROM documents)""")
def question_keys(t):
    k = fn.digest(F.col("source"), fn.normal_text(fn.nfc(F.col("text"))))
    return t.documents.select(k.alias("k")).agg(F.count("*").alias("questions"), F.countDistinct("k").alias("distinct_questions"))
