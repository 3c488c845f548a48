"""Queries over the standard tables, each with the same rows in DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.functions import scalar as fn
from grainmill.operators import dedup, geometry, joins, score, select
from grainmill.sources.tables import read_table
from grainmill.streaming import gauge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "split_contamination_census"
#: SQL for normalised text and for the digest rank of a key.
NORMAL = "trim(regexp_replace(lower({}), '[ \t\n\r\f\x0b]+', ' ', 'g'))"
RANK = "sha256('{}' || '|' || CAST({} AS VARCHAR))"
SIDE = "CASE WHEN sha256('[\n  \"split-v1\",\n  17,\n  \"' || {} || '\"\n]\n') < '" + format(int(0.1 * 2**256), "064x") + "' THEN 'held' ELSE 'train' END"


def query(sql: str | None = None):
    def add(f):
        class Tables:
            def __init__(self, spark, sf_dir):
                self.spark, self.sf_dir = spark, sf_dir

            def __getattr__(self, name):
                return read_table(self.spark, self.sf_dir, name)

        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _cents(c):
    return F.round(F.col(c) * 100).cast("long")


# ---- splits, contamination, dedup


@query(f"""
    WITH d AS (SELECT doc_id, lang, source, {NORMAL.format("text")} AS t FROM documents),
    k AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
    b AS (SELECT DISTINCT {NORMAL.format("text")} AS p FROM benchmark),
    c AS (SELECT k.*, EXISTS (SELECT 1 FROM b WHERE contains(k.t, b.p)) AS hit FROM k)
    SELECT lang, {SIDE.format("source")} AS side, count(*) AS n_rows,
           count(*) FILTER (doc_id <> first_id) AS duplicates, count(*) FILTER (hit) AS contaminated,
           count(*) FILTER (doc_id = first_id AND NOT hit) AS kept, count(quality) AS labelled, CAST(coalesce(sum(quality), 0) AS BIGINT) AS positive
    FROM c LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def split_contamination_census(t):
    d = t.documents.select("doc_id", "lang", "source", fn.normal_text(F.col("text")).alias("t"))
    firsts = d.groupBy(F.xxhash64("t").alias("x"), F.sha2("t", 256).alias("k")).agg(F.min("doc_id").alias("first_id")).select("k", "first_id")
    passages = t.benchmark.select("item_id", fn.normal_text(F.col("text")).alias("p"))
    hits = joins.contained(d.select("doc_id", "t"), passages, F.contains(F.col("t"), F.col("p"))).select("doc_id", F.lit(True).alias("hit")).distinct()
    rows = d.withColumn("k", F.sha2("t", 256)).drop("t").join(firsts, "k").join(hits, "doc_id", "left").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    dup, hit = F.col("doc_id") != F.col("first_id"), F.coalesce("hit", F.lit(False))
    return rows.groupBy("lang", fn.split_side(F.col("source"), 17, 0.1).alias("side")).agg(
        F.count("*").alias("n_rows"), F.count_if(dup).alias("duplicates"), F.count_if(hit).alias("contaminated"), F.count_if(~dup & ~hit).alias("kept"), F.count("quality").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).alias("positive")
    )


@query(f"SELECT source, {SIDE.format('source')} AS side, count(*) AS n FROM documents GROUP BY ALL")
def hash_split_by_group(t):
    return t.documents.groupBy("source", fn.split_side(F.col("source"), 17, 0.1).alias("side")).agg(F.count("*").alias("n"))


@query(f"""SELECT c_mktsegment, CASE WHEN c_nationkey < 5 THEN 'held' WHEN c_nationkey < 12 THEN 'train' ELSE {SIDE.format("CAST(c_nationkey AS VARCHAR)")} END AS side,
           count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def inherited_split(t):
    known = F.when(F.col("c_nationkey") < 5, "held").when(F.col("c_nationkey") < 12, "train")
    rows = t.orders.select("o_custkey").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment", F.coalesce(known, fn.split_side(F.col("c_nationkey"), 17, 0.1)).alias("side")).agg(F.count("*").alias("n_orders"))


@query(f"""WITH s AS (SELECT DISTINCT source, {SIDE.format("source")} AS side FROM documents)
    SELECT count(*) FILTER (side = 'held') AS held, count(*) FILTER (side = 'train') AS train, CAST(count(*) - count(DISTINCT source) AS BIGINT) AS in_both FROM s""")
def split_proof(t):
    s = t.documents.select("source", fn.split_side(F.col("source"), 17, 0.1).alias("side")).distinct()
    return s.agg(F.count_if(F.col("side") == "held").alias("held"), F.count_if(F.col("side") == "train").alias("train"), (F.count("*") - F.countDistinct("source")).alias("in_both"))


@query(f"SELECT doc_id, min(doc_id) OVER w AS kept_key, doc_id <> min(doc_id) OVER w AS dropped FROM documents WINDOW w AS (PARTITION BY {NORMAL.format('text')})")
def dedup_keep_first_log(t):
    return dedup.keep_first_log(t.documents, F.sha2(fn.normal_text(F.col("text")), 256), "doc_id")


@query(f"""SELECT min(doc_id) AS doc_id, min(quality) AS quality, count(*) AS n FROM documents JOIN labels USING (doc_id)
    GROUP BY {NORMAL.format("text")} HAVING min(quality) = max(quality)""")
def duplicate_conflict_refusal(t):
    rows = t.documents.join(t.labels, "doc_id")
    return dedup.refuse_conflicts(rows, F.sha2(fn.normal_text(F.col("text")), 256), "quality", "doc_id").select("doc_id", "quality", "n")


@query("SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS sources FROM lineitem GROUP BY 1")
def provenance_merge(t):
    return dedup.merge_provenance(t.lineitem, "l_partkey", "l_suppkey").select("l_partkey", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@query(f"""WITH d AS (SELECT source, {NORMAL.format("text")} AS t FROM documents), b AS (SELECT DISTINCT {NORMAL.format("text")} AS p FROM benchmark)
    SELECT source, count(*) AS n FROM d WHERE EXISTS (SELECT 1 FROM b WHERE contains(d.t, b.p)) GROUP BY 1""")
def benchmark_overlap(t):
    d = t.documents.select("doc_id", "source", fn.normal_text(F.col("text")).alias("t"))
    p = t.benchmark.select("item_id", fn.normal_text(F.col("text")).alias("p"))
    hits = joins.contained(d, p, F.contains(F.col("t"), F.col("p"))).select("doc_id", "source").distinct()
    return hits.groupBy("source").agg(F.count("*").alias("n"))


@query("""SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'language' END,
    CASE WHEN quality = 0 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)) AS reason FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def multi_reason_exclusion(t):
    rows = t.documents.select("doc_id", "n_chars", "lang").join(t.labels, "doc_id", "left")
    why = F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.col("lang") != "en", "language"), F.when(F.col("quality") == 0, "quality"), F.when(F.col("toxic") == 1, "toxic"))
    return rows.select(F.explode(F.array_compact(why)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN l_quantity > 45 THEN 'quantity' WHEN l_discount > 0.08 THEN 'discount' WHEN l_tax > 0.06 THEN 'tax' ELSE 'passed' END AS reason, count(*) AS n FROM lineitem GROUP BY 1""")
def first_failing_reason(t):
    why = F.when(F.col("l_quantity") > 45, "quantity").when(F.col("l_discount") > 0.08, "discount").when(F.col("l_tax") > 0.06, "tax").otherwise("passed")
    return t.lineitem.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


# ---- grading and scores

_GRADED = """(SELECT l_orderkey, l_linenumber, p_brand, l_returnflag, l_linestatus, CAST(l_extendedprice / l_quantity AS DECIMAL(18,4)) AS pred, CAST(p_retailprice AS DECIMAL(18,4)) AS gold
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_WITHIN = "(gold > 0 AND abs(pred - gold) * 100 <= gold * {})"


def _graded(t):
    rows = t.lineitem.join(t.part.select("p_partkey", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.withColumns({"pred": F.col("l_extendedprice") / F.col("l_quantity"), "gold": F.col("p_retailprice")})


def _at(percent):
    return fn.within(F.col("pred"), F.col("gold"), percent)


@query(f"SELECT p_brand, count(*) AS n, count(*) FILTER {_WITHIN.format(5).replace('(gold', '(WHERE gold', 1)} AS right_5 FROM {_GRADED} GROUP BY 1")
def grade_numeric(t):
    return _graded(t).groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(_at(5)).alias("right_5"))


@query("SELECT p_brand, " + ", ".join(f"count(*) FILTER (WHERE {_WITHIN.format(p)}) AS within_{p}" for p in (5, 10, 15, 25)) + f" FROM {_GRADED} GROUP BY 1")
def tolerance_tiers(t):
    return _graded(t).groupBy("p_brand").agg(*(F.count_if(_at(p)).alias(f"within_{p}") for p in (5, 10, 15, 25)))


@query("SELECT p_brand, CAST(sum(" + " + ".join(f"CAST({_WITHIN.format(100 - x)} AS INT)" for x in range(50, 100, 5)) + f") AS BIGINT) AS tenths FROM {_GRADED} GROUP BY 1")
def relative_accuracy_credit(t):
    return _graded(t).groupBy("p_brand").agg(F.sum(fn.relative_accuracy(F.col("pred"), F.col("gold"))).alias("tenths"))


@query("""WITH a AS (SELECT o_custkey, max(o_totalprice) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS large, max(o_totalprice) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS small FROM orders GROUP BY 1)
    SELECT CASE WHEN small IS NULL THEN 'no first attempt' WHEN small >= 150000 THEN 'first' WHEN large IS NULL THEN 'needs more' WHEN large >= 150000 THEN 'second' ELSE 'rejected' END AS decision, count(*) AS n FROM a GROUP BY 1""")
def attempt_topup_decision(t):
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    a = t.orders.groupBy("o_custkey").agg(F.max(F.when(urgent, F.col("o_totalprice"))).alias("large"), F.max(F.when(~urgent, F.col("o_totalprice"))).alias("small"))
    said = F.when(F.col("small").isNull(), "no first attempt").when(F.col("small") >= 150000, "first").when(F.col("large").isNull(), "needs more").when(F.col("large") >= 150000, "second").otherwise("rejected")
    return a.groupBy(said.alias("decision")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS attempted, count(*) FILTER (value > 20) AS finalised, count(*) FILTER (value > 50) AS accepted, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def acceptance_by_type(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("attempted"), F.count_if(F.col("value") > 20).alias("finalised"), F.count_if(F.col("value") > 50).alias("accepted"), F.countDistinct("user_id").alias("users"))


@query(f"""WITH c AS (SELECT l_returnflag, l_linestatus, count(*) FILTER (WHERE {_WITHIN.format(25)}) AS s, count(*) AS n FROM {_GRADED} GROUP BY ALL)
    SELECT l_returnflag, round(avg(s / n), 6) AS macro, round(sum(s) / sum(n), 6) AS micro, count(*) AS categories FROM c GROUP BY 1""")
def collapsed_macro_score(t):
    return score.collapsed_macro(_graded(t), "l_returnflag", "l_linestatus", _at(25).cast("long"))


@query(f"""WITH g AS (SELECT l_orderkey, count(*) FILTER (WHERE {_WITHIN.format(50)}) AS r, count(*) AS n FROM {_GRADED} GROUP BY 1 HAVING count(*) >= 4)
    SELECT count(*) AS "groups", count(*) FILTER (r >= 3) AS robust FROM g""")
def robust_group_accuracy(t):
    return score.robust_groups(_graded(t), "l_orderkey", _at(50).cast("long"), 4, 3)


@query("""SELECT event_type, count(*) FILTER (user_id % 2 = 0) AS n_even, count(*) FILTER (user_id % 2 = 1) AS n_odd,
    CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (user_id % 2 = 0), 0) - coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (user_id % 2 = 1), 0) AS BIGINT) AS delta_cents FROM events GROUP BY 1""")
def paired_delta(t):
    even = F.col("user_id") % 2 == 0
    total = lambda c: F.coalesce(F.sum(F.when(c, _cents("value"))), F.lit(0))
    return t.events.groupBy("event_type").agg(F.count_if(even).alias("n_even"), F.count_if(~even).alias("n_odd"), (total(even) - total(~even)).alias("delta_cents"))


@query("""SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id) WHERE n_chars >= 100 GROUP BY 1""")
def matched_subset_score(t):
    rows = t.documents.where("n_chars >= 100").select("doc_id", "lang").join(t.labels, "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))


@query(f"""WITH s AS (SELECT o_orderpriority, seed, count(*) FILTER ({RANK.format("seed", "o_orderkey").replace("'seed'", "seed")} < '8') AS c FROM orders, (VALUES ('a'), ('b'), ('c')) v(seed) GROUP BY ALL)
    SELECT o_orderpriority, round(avg(c), 6) AS mean, max(c) - min(c) AS spread, round(stddev_samp(c), 6) AS dev, count(*) AS seeds FROM s GROUP BY 1""")
def seed_summary(t):
    rows = t.orders.select("o_orderpriority", "o_orderkey", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("seed"))
    s = rows.groupBy("o_orderpriority", "seed").agg(F.count_if(fn.digest(F.col("seed"), F.col("o_orderkey")) < "8").alias("c"))
    return s.groupBy("o_orderpriority").agg(F.round(F.avg("c"), 6).alias("mean"), (F.max("c") - F.min("c")).alias("spread"), F.round(F.stddev_samp("c"), 6).alias("dev"), F.count("*").alias("seeds"))


# ---- distributions


@query("""SELECT lang, count(*) AS n, min(w) AS lo, max(w) AS hi, round(quantile_cont(w, 0.1), 6) AS p10, round(quantile_cont(w, 0.5), 6) AS p50, round(quantile_cont(w, 0.9), 6) AS p90, round(quantile_cont(w, 0.99), 6) AS p99
    FROM (SELECT lang, len(string_split(text, ' ')) AS w FROM documents) GROUP BY 1""")
def token_length_distribution(t):
    rows = t.documents.select("lang", F.size(F.split("text", " ")).cast("long").alias("w"))
    return score.distribution(rows, "lang", "w")


@query("SELECT lang, quantile_disc(n_chars, 0.95) AS p95 FROM documents GROUP BY 1")
def nearest_rank_p95(t):
    return score.quantiles(t.documents, ["lang"], "n_chars", {"p95": 0.95}, nearest=True).drop("n")


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3, min(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low,
    max(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high,
    count(*) FILTER (NOT l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM lineitem JOIN q USING (l_returnflag) GROUP BY 1""")
def tukey_adjacent_values(t):
    return score.tukey(t.lineitem, "l_returnflag", "l_extendedprice").withColumns({c: F.round(c, 4) for c in ("q1", "q3")})


@query("""SELECT l_returnflag, bin, n FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, bin) AS rn FROM
    (SELECT l_returnflag, CAST(floor(l_quantity / 1.0) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE rn = 1""")
def histogram_mode(t):
    return score.histogram_mode(t.lineitem, "l_returnflag", "l_quantity", 1.0)


@query("""SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 4) AS median, max(p_retailprice) - min(p_retailprice) > greatest(0.25, 0.02 * quantile_cont(p_retailprice, 0.5)) AS conflict FROM part GROUP BY 1""")
def preferred_unit_median(t):
    m = F.percentile("p_retailprice", F.lit(0.5))
    return t.part.groupBy("p_brand").agg(F.round(m, 4).alias("median"), ((F.max("p_retailprice") - F.min("p_retailprice")) > F.greatest(F.lit(0.25), 0.02 * m)).alias("conflict"))


# ---- selection


@query(f"""SELECT o_orderpriority, o_orderkey, rn FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {RANK.format("s1", "o_orderkey")}, o_orderkey) AS rn FROM orders) WHERE rn <= 20""")
def balanced_topk(t):
    return select.balanced_topk(t.orders.select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 20, "s1").withColumn("rn", F.col("rn").cast("long"))


@query(f"""SELECT lang, doc_id, rn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {RANK.format("s2", "doc_id")}, doc_id) AS rn FROM documents) ORDER BY rn, lang, doc_id LIMIT 50""")
def stratified_round_robin(t):
    return select.round_robin(t.documents.select("lang", "doc_id"), "lang", "doc_id", 50, "s2").withColumn("rn", F.col("rn").cast("long"))


@query(f"""WITH a AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY {RANK.format("s3", "doc_id")}, doc_id) AS rn_inner FROM documents),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rn_inner, source, doc_id) AS rn FROM a) SELECT lang, source, doc_id, rn FROM b ORDER BY rn, lang, doc_id LIMIT 60""")
def nested_round_robin(t):
    return select.nested_round_robin(t.documents.select("lang", "source", "doc_id"), "lang", "source", "doc_id", 60, "s3").select("lang", "source", "doc_id", F.col("rn").cast("long").alias("rn"))


@query("""SELECT conv_id, turn, n FROM (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS rn FROM conversations WHERE role = 'assistant') WHERE rn = 1""")
def best_of_n_shortest(t):
    rows = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return select.best_of(rows, ["conv_id"], [F.col("n"), F.col("turn")]).drop("rn")


@query(f"""WITH r AS (SELECT lang AS part, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {RANK.format("s4", "doc_id")}, doc_id) AS rn, CASE lang WHEN 'en' THEN 3 ELSE 1 END AS share FROM documents WHERE lang IN ('en', 'fr')),
    u AS (SELECT min(c // s) AS units FROM (SELECT count(*) AS c, any_value(share) AS s FROM r GROUP BY part)) SELECT part, doc_id FROM r, u WHERE rn <= share * units""")
def ratio_mix(t):
    return select.ratio_mix(t.documents.select("lang", "doc_id"), F.col("lang"), {"en": 3, "fr": 1}, "doc_id", "s4").select("part", "doc_id")


@query("""WITH w AS (SELECT c_mktsegment, count(*) AS c FROM customer GROUP BY 1), b AS (SELECT *, 1000 * c // sum(c) OVER () AS f, 1000 * c % sum(c) OVER () AS r FROM w)
    SELECT c_mktsegment, CAST(f + CASE WHEN row_number() OVER (ORDER BY r DESC, c_mktsegment) <= 1000 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b""")
def weighted_quota(t):
    return select.largest_remainder(t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("c")), "c_mktsegment", "c", 1000)


@query(f"""WITH o AS (SELECT count(*) AS n FROM events WHERE event_type <> 'view'), r AS (SELECT event_type, event_id, row_number() OVER (ORDER BY {RANK.format("s5", "event_id")}, event_id) AS rn FROM events WHERE event_type = 'view')
    SELECT event_type, event_id FROM events WHERE event_type <> 'view' UNION ALL SELECT event_type, event_id FROM r, o WHERE rn * 17 <= n * 3""")
def share_cap(t):
    return select.share_cap(t.events.select("event_type", "event_id"), F.col("event_type") == "view", "event_id", 3, 17, "s5")


@query()
def capped_greedy_select(t):
    rows = t.documents.select("doc_id", "lang", "source", F.sha2(F.concat(F.lit("s6|"), F.col("doc_id").cast("string")), 256).alias("h"))
    return select.capped_greedy(rows, "h", "doc_id", {"lang": 40, "source": 9}, 120)


@query()
def shrinking_fixpoint_select(t):
    rows = t.documents.select("doc_id", "lang", "source", F.sha2(F.concat(F.lit("s7|"), F.col("doc_id").cast("string")), 256).alias("h"))
    return select.shrinking_select(rows, "h", "doc_id", lambda total: {"lang": total // 3 + 1, "source": total // 8 + 1}, 160)


# ---- windows and joins


@query("""WITH r AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (SELECT DISTINCT conv_id, turn FROM conversations))
    SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n FROM r GROUP BY conv_id, g""")
def gaps_and_islands(t):
    return score.islands(t.conversations, "conv_id", "turn")


@query("""SELECT event_id, user_id, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us, CAST(round(value * 100) AS BIGINT) - CAST(round(lag(value) OVER w * 100) AS BIGINT) AS delta_cents FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lag_deltas(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", "user_id", (us - F.lag(us).over(w)).alias("gap_us"), (_cents("value") - F.lag(_cents("value")).over(w)).alias("delta_cents"))


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS v FROM events),
    f AS (SELECT event_id, v, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b,
    first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS a FROM e)
    SELECT event_id, CAST(coalesce(v, (a + b) / 2, b, a) AS DOUBLE) AS filled FROM f""")
def nearest_non_null_fill(t):
    rows = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 != 0, _cents("value")).alias("v"))
    return joins.nearest_fill(rows, "user_id", ["ts", "event_id"], "v", 5).select("event_id", F.col("filled").cast("double").alias("filled"))


@query("""SELECT CASE WHEN r IS NULL THEN 'left only' WHEN l IS NULL THEN 'right only' ELSE 'both' END AS state, count(*) AS n
    FROM (SELECT DISTINCT c_custkey AS l FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS r FROM orders) ON l = r GROUP BY 1""")
def exact_set_reconcile(t):
    return joins.reconcile(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), "k")


@query("""WITH c AS (SELECT conv_id, turn, role, lead(role) OVER w AS nr, lead(turn) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role))
    SELECT conv_id, count(*) AS calls, count(*) FILTER (nr = 'assistant') AS answered, bool_and(coalesce(nr = 'assistant', false)) AS complete FROM c WHERE role = 'user' GROUP BY 1""")
def call_response_pairing(t):
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    c = t.conversations.select("conv_id", "role", F.lead("role").over(w).alias("next")).where("role = 'user'")
    ok = F.coalesce(F.col("next") == "assistant", F.lit(False))
    return c.groupBy("conv_id").agg(F.count("*").alias("calls"), F.count_if(ok).alias("answered"), F.bool_and(ok).alias("complete"))


@query("""SELECT DISTINCT a.conv_id, a.turn FROM conversations a WHERE a.role = 'user' AND EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'assistant' AND b.turn > a.turn)""")
def evidence_before_later_turn(t):
    c = t.conversations
    last = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return c.where("role = 'user'").join(last, "conv_id").where("turn < last").select("conv_id", "turn").distinct()


@query("""WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS u FROM events WHERE event_type = 'click'), b AS (SELECT user_id, event_id AS other, epoch_us(ts) AS v FROM events WHERE event_type = 'purchase'),
    m AS (SELECT event_id, other FROM a JOIN b USING (user_id) WHERE abs(u - v) <= 86400000000) SELECT event_id, min(other) AS other FROM m GROUP BY 1 HAVING count(*) = 1""")
def interval_match_unique(t):
    e = t.events.withColumn("u", F.unix_micros(F.col("ts").cast("timestamp")))
    a = e.where("event_type = 'click'").select("event_id", "user_id", "u")
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("other"), F.col("u").alias("v"))
    m = joins.interval_match(a, b, ["user_id"], "u", "v", 86_400_000_000)
    return m.groupBy("event_id").agg(F.min("other").alias("other"), F.count("*").alias("k")).where("k = 1").drop("k")


@query("""WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS u FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, epoch_us(ts) AS v, max(event_id) AS other FROM events WHERE event_type = 'click' GROUP BY ALL)
    SELECT a.event_id, b.other AS matched FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.u >= b.v""")
def asof_join(t):
    e = t.events.withColumn("u", F.unix_micros(F.col("ts").cast("timestamp")))
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", "u")
    b = e.where("event_type = 'click'").select("user_id", F.col("u").alias("v"), F.col("event_id").alias("other"))
    return joins.as_of(a, b, ["user_id"], "u", "v", "other").select("event_id", "matched")


@query("""WITH m AS (SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY 1), r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_retailprice - m), p_partkey) AS rn FROM part JOIN m USING (p_brand))
    SELECT p_brand, p_partkey FROM r WHERE rn = 1""")
def nearest_by_value(t):
    m = t.part.groupBy("p_brand").agg(F.percentile("p_retailprice", F.lit(0.5)).alias("m"))
    gap = F.struct(F.abs(F.col("p_retailprice") - F.col("m")).alias("gap"), F.col("p_partkey").alias("k"))
    return t.part.join(m, "p_brand").groupBy("p_brand").agg(F.min(gap).alias("x")).select("p_brand", F.col("x.k").alias("p_partkey"))


@query("""SELECT doc_id, 'labels' AS origin FROM labels UNION ALL SELECT doc_id, 'documents' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def source_preference_union(t):
    return dedup.prefer_source([t.labels.select("doc_id", F.lit("labels").alias("origin")), t.documents.select("doc_id", F.lit("documents").alias("origin"))], "doc_id").select("doc_id", "origin")


@query("""SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS l_returnflag, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN 'agreed' ELSE 'deferred' END AS status FROM lineitem GROUP BY 1""")
def agree_or_defer(t):
    return dedup.agree_or_defer(t.lineitem.select("l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag")


# ---- text


@query("""WITH p AS (SELECT conv_id, turn, regexp_extract_all(text, '[0-9]+') AS n FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, CASE len(n) WHEN 0 THEN 'none' WHEN 1 THEN 'number' ELSE 'several' END AS branch, CASE WHEN len(n) = 1 THEN n[1] END AS answer FROM p""")
def answer_parser(t):
    p = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("([0-9]+)")).alias("n"))
    branch = F.when(F.size("n") == 0, "none").when(F.size("n") == 1, "number").otherwise("several")
    return p.select("conv_id", "turn", branch.alias("branch"), F.when(F.size("n") == 1, F.get("n", F.lit(0))).alias("answer"))


_LEAKS = {"mail": "[a-z0-9._]+@[a-z0-9.]+", "link": "https?://", "path": "(^|[ ])/[a-z]+/[a-z]+", "digits": "[0-9]{6,}", "code": "(^|[^a-z])(def|class|import) "}


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(lower(text), '{v}') AS {k}" for k, v in _LEAKS.items()) + " FROM documents")
def leakage_screen(t):
    return t.documents.select("doc_id", *(F.lower("text").rlike(v).alias(k) for k, v in _LEAKS.items()))


@query("""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(split_part(text, chr(10), 1), '[0-9]+')) AS a, regexp_extract_all(substr(text, length(split_part(text, chr(10), 1)) + 1), '[0-9]+') AS b FROM documents)
    SELECT doc_id, len(a) AS numbers, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS unsupported FROM d WHERE len(a) > 0""")
def numeric_token_support(t):
    first = F.substring_index("text", "\n", 1)
    d = t.documents.select("doc_id", F.array_distinct(F.regexp_extract_all(first, F.lit("([0-9]+)"))).alias("a"), F.regexp_extract_all(F.expr("substr(text, length(substring_index(text, '\n', 1)) + 1)"), F.lit("([0-9]+)")).alias("b"))
    return d.where(F.size("a") > 0).select("doc_id", F.size("a").cast("long").alias("numbers"), F.size(F.array_except("a", "b")).cast("long").alias("unsupported"))


@query("""SELECT doc_id, item_id, instr(d.text, b.text) AS at, (length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text) AS times FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def citation_resolve_exact(t):
    b = t.benchmark.select("item_id", F.col("text").alias("p"), F.col("text").alias("quote"))
    x = joins.contained(t.documents.select("doc_id", "text", F.col("text").alias("t")), b, F.contains(F.col("t"), F.col("p")))
    return x.select("doc_id", "item_id", F.expr("instr(text, quote)").cast("long").alias("at"), F.expr("(length(text) - length(replace(text, quote, ''))) div length(quote)").alias("times"))


def _hits(words, lexicon):
    return F.size(F.filter(words, lambda w: w.isin(lexicon)))


_LEXICON = {"hedge": ["maybe", "perhaps", "about"], "sure": ["the", "der", "la"], "time": ["was", "then", "que"]}


@query("SELECT lang, " + ", ".join("CAST(sum(len(list_filter(string_split(lower(text), ' '), lambda x: x IN ({})))) AS BIGINT) AS {}".format(", ".join(f"'{w}'" for w in v), k) for k, v in _LEXICON.items()) + " FROM documents GROUP BY 1")
def lexicon_markers(t):
    words = F.split(F.lower("text"), " ")
    return t.documents.groupBy("lang").agg(*(F.sum(_hits(words, v)).alias(k) for k, v in _LEXICON.items()))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS with_k, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS top FROM events GROUP BY 1")
def structural_summary(t):
    k = F.get_json_object("props", "$.k")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.max(k.try_cast("long")).alias("top"))


# ---- censuses, digests, geometry, streams


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_queue_census(t):
    return t.orders.rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((c_mktsegment), (o_orderstatus), ())")
def grouping_sets_counts(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupingSets([["c_mktsegment"], ["o_orderstatus"], []], "c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT url, count(DISTINCT sha256(html)) AS versions FROM (SELECT regexp_replace(url, '[0-9]+', '', 'g') AS url, html FROM pages) GROUP BY 1 HAVING count(DISTINCT sha256(html)) > 1")
def pin_conflict(t):
    rows = t.pages.select(F.regexp_replace("url", "[0-9]+", "").alias("url"), F.sha2("html", 256).alias("pin")).distinct()
    return rows.groupBy("url").agg(F.count("*").alias("versions")).where("versions > 1")


@query("""WITH s AS (SELECT source, doc_id // 256 AS shard, count(*) AS n, sha256(string_agg(sha256(CAST(doc_id AS VARCHAR) || '|' || text), '' ORDER BY doc_id)) AS d FROM documents GROUP BY ALL)
    SELECT source, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY shard)) AS digest FROM s GROUP BY 1""")
def shard_digests(t):
    """A digest for each shard of 256 ids, and for each source the digest of its shards' digests."""
    rows = t.documents.select("source", "doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.col("text")), 256).alias("h"))
    joined = lambda key, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), ""), 256)
    shards = rows.groupBy("source", F.expr("doc_id div 256").alias("shard")).agg(F.count("*").alias("n"), joined("doc_id", "h").alias("d"))
    return shards.groupBy("source").agg(F.sum("n").alias("n"), joined("shard", "d").alias("digest"))


@query("""SELECT l_returnflag, pmod, count(*) AS n FROM (SELECT l_returnflag, (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1) % 8 AS pmod FROM lineitem) GROUP BY ALL""")
def round_robin_shards(t):
    each = select.ranked(t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber"), ["l_returnflag"], [F.col("l_orderkey"), F.col("l_linenumber")], "rank")
    return each.groupBy("l_returnflag", ((F.col("rank") - 1) % 8).cast("long").alias("pmod")).agg(F.count("*").alias("n"))


@query("(SELECT user_id AS k FROM events EXCEPT SELECT c_custkey FROM customer) UNION ALL (SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events)")
def set_equality_difference(t):
    a, b = t.events.select(F.col("user_id").alias("k")), t.customer.select(F.col("c_custkey").alias("k"))
    return a.subtract(b).union(b.subtract(a))


@query("""SELECT floor(embedding[1] * 4) AS p0, floor(embedding[2] * 4) AS p1, count(*) AS n, min(embedding[3]) AS nearest FROM embeddings GROUP BY ALL""")
def zbuffer_min(t):
    e = t.embeddings.select(*(F.col("embedding")[i].alias(f"e{i}") for i in range(3)))
    out = geometry.depth_minimum(e, [F.floor(F.col("e0") * 4), F.floor(F.col("e1") * 4)], "e2")
    return out.select(F.col("p0").cast("float").alias("p0"), F.col("p1").cast("float").alias("p1"), "n", "nearest")


def _points(t):
    return t.embeddings.select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))


@query("""WITH RECURSIVE p AS (SELECT vec_id AS k, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
    e AS (SELECT a.k AS a, b.k AS b FROM p a, p b WHERE a.k <> b.k AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.0009),
    r AS (SELECT k, k AS root FROM p UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.k) SELECT k AS vec_id, min(root) AS root FROM r GROUP BY 1""")
def components_union_find(t):
    p = _points(t)
    return geometry.components(p, geometry.close_pairs(p, "vec_id", ["x", "y", "z"], 0.03), "vec_id")


@query()
def dbscan_clusters(t):
    return geometry.dbscan(_points(t), "vec_id", ["x", "y", "z"], 0.08, 4)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def rate_gauge(t):
    return gauge.rate_gauge(t.events, "ts", "event_type", "1 hour", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# ---- objects seen in several frames

TRACKS = "p AS (SELECT vec_id % 97 AS k, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


def _tracks(t):
    return _points(t).withColumn("k", F.col("vec_id") % 97)


@query(f"""WITH RECURSIVE {TRACKS}, v AS (SELECT DISTINCT k, floor(x / 0.1) AS a, floor(y / 0.1) AS b, floor(z / 0.1) AS c FROM p), n AS (SELECT k, count(*) AS n FROM v GROUP BY 1),
    i AS (SELECT v.k, w.k AS l, count(*) AS x FROM v JOIN v w USING (a, b, c) WHERE v.k <> w.k GROUP BY ALL),
    e AS (SELECT i.k AS a, i.l AS b FROM i JOIN n ON n.k = i.k JOIN n m ON m.k = i.l WHERE i.x / (n.n + m.n - i.x) >= 0.32),
    r AS (SELECT k, k AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.k) SELECT k AS track, min(root) AS root FROM r GROUP BY 1""")
def voxel_iou_merge(t):
    return geometry.voxel_merge(_tracks(t), "k", ["x", "y", "z"], 0.1, 0.32).withColumnRenamed("k", "track")


@query(f"""WITH RECURSIVE {TRACKS}, m AS (SELECT k, median(x) AS x, median(y) AS y, median(z) AS z FROM p GROUP BY 1),
    e AS (SELECT a.k AS a, b.k AS b FROM m a, m b WHERE a.k <> b.k AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.0001),
    r AS (SELECT k, k AS root FROM m UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.k) SELECT k AS track, min(root) AS root FROM r GROUP BY 1""")
def centroid_merge(t):
    return geometry.centroid_merge(_tracks(t), "k", ["x", "y", "z"], 0.01).withColumnRenamed("k", "track")


@query("""WITH RECURSIVE p AS (SELECT vec_id AS k, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS low, CAST(embedding[5] AS DOUBLE) AS high FROM embeddings),
    e AS (SELECT a.k AS a, b.k AS b FROM p a, p b WHERE a.k <> b.k AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.0009),
    r AS (SELECT DISTINCT a AS k, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.k), c AS (SELECT k, min(root) AS cluster FROM r GROUP BY 1)
    SELECT cluster, count(DISTINCT label) AS n_frames, count(*) AS n_detections, round(median(x), 4) AS x, round(median(y), 4) AS y, round(median(z), 4) AS z, round(median(low), 4) AS low, round(median(high), 4) AS high FROM c JOIN p USING (k) GROUP BY 1""")
def grounding_union(t):
    boxes = t.embeddings.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(["x", "y", "z", "low", "high"])))
    return geometry.grounded_objects(boxes, "vec_id", "label", ["x", "y", "z"], ["low", "high"], 0.03, 2)


@query("""WITH p AS (SELECT label, CAST(floor(embedding[1] * 64) AS BIGINT) AS r, CAST(floor(embedding[2] * 64) AS BIGINT) AS c, min(CAST(embedding[3] AS DOUBLE)) AS d FROM embeddings GROUP BY ALL),
    z AS (SELECT r, c, min(d) AS z FROM p GROUP BY ALL) SELECT label, count(*) AS n_pixels, min(r) AS top, max(r) AS bottom, min(c) AS left, max(c) AS right FROM p JOIN z USING (r, c) WHERE d <= z + 0.02 GROUP BY 1""")
def occlusion_visible(t):
    points = t.embeddings.select("label", F.col("embedding")[0].alias("r"), F.col("embedding")[1].alias("c"), F.col("embedding")[2].cast("double").alias("d"))
    return geometry.visible_regions(points, "label", F.floor(F.col("r") * 64), F.floor(F.col("c") * 64), "d", 0.02)


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 950 AND 1500 GROUP BY 1")
def box_extract(t):
    return geometry.in_box(t.part, {"p_size": 10, "p_retailprice": 950}, {"p_size": 30, "p_retailprice": 1500}).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT label, count(DISTINCT vec_id) AS n_objects, max(2 * list_max(CAST(embedding[1:3] AS DOUBLE[]))) AS longest FROM embeddings GROUP BY 1")
def object_size(t):
    edges = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    return t.embeddings.groupBy("label").agg(F.count_distinct("vec_id").alias("n_objects"), F.max(2 * F.array_max(edges)).alias("longest"))


@query("SELECT user_id, max(ts) AS last_at FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def liveness(t):
    return gauge.live_keys(t.events, "ts", "user_id", 2 * 86400)


@query("""WITH g AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    s AS (SELECT *, sum(cut) OVER (PARTITION BY event_type ORDER BY ts) AS run FROM g) SELECT event_type, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM s GROUP BY event_type, run""")
def stall_alarm(t):
    out = gauge.stalls(t.events, "ts", "event_type", 30)
    return out.select("event_type", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), "n")
