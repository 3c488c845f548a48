"""Queries on admission rules, projections and scalar forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from grainmill.functions import jsons
from grainmill.functions import scalar as fn
from grainmill.operators import admission as ad
from grainmill.plans.catalog import query


@query("""WITH a AS (SELECT user_id, list(k ORDER BY event_id) AS i, list(CAST(k AS DOUBLE) / 2 + CASE WHEN event_id % 50 = 0 THEN 0.01 ELSE 0 END ORDER BY event_id) AS s, count(DISTINCT event_type) AS kinds
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 3 - CASE WHEN event_id % 70 = 0 THEN 4 ELSE 0 END AS k FROM events) GROUP BY 1)
    SELECT user_id, len(list_filter(range(2, len(i) + 1), lambda j: i[j] <= i[j - 1])) = 0 AND len(list_filter(range(1, len(i) + 1), lambda j: abs(s[j] - CAST(i[j] AS DOUBLE) / 2) > 0.000001)) = 0 AS on_time, kinds = 4 AS all_kinds FROM a""")
def sample_times(t):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) * 3 - F.when(F.col("event_id") % 70 == 0, 4).otherwise(0)
    rows = t.events.select("user_id", "event_id", "event_type", k.alias("k"), (k / 2 + F.when(F.col("event_id") % 50 == 0, 0.01).otherwise(0.0)).alias("s"))
    a = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "k", "s"))).alias("x"), F.countDistinct("event_type").alias("kinds"))
    at = ad.sampled_on_time(F.transform("x", lambda e: e["k"]), F.transform("x", lambda e: e["s"]), F.lit(2.0))
    return a.select("user_id", at.alias("on_time"), (F.col("kinds") == 4).alias("all_kinds"))


@query("""SELECT event_type, list_sort(list_distinct(flatten(list(json_keys(props))))) = ['k'] AS exact_keys, count(*) FILTER (json_keys(props) <> ['k']) AS refused FROM events GROUP BY 1""")
def exact_key_sets(t):
    keys = F.json_object_keys("props")
    return t.events.groupBy("event_type").agg((F.array_sort(F.array_distinct(F.flatten(F.collect_set(keys)))) == F.array(F.lit("k"))).alias("exact_keys"), F.count_if(F.array_sort(keys) != F.array(F.lit("k"))).alias("refused"))


_BANNED = ["license", "password", "secret"]


@query("SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(lower(text), '(^|[^a-z0-9_])(license|password|secret)([^a-z0-9_]|$)')) AS banned FROM documents GROUP BY 1")
def banned_words(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.count_if(ad.has_word(F.col("text"), _BANNED)).alias("banned"))


@query("""SELECT conv_id, bool_or(regexp_replace(lower(CASE turn % 4 WHEN 0 THEN 'MAX_TOKENS' WHEN 1 THEN 'length' ELSE 'stop' END), '[^a-z]', '', 'g') IN ('maxtokens', 'length')) = (conv_id % 2 = 0) AS consistent FROM conversations GROUP BY 1""")
def output_cap_consistency(t):
    said = F.when(F.col("turn") % 4 == 0, "MAX_TOKENS").when(F.col("turn") % 4 == 1, "length").otherwise("stop")
    c = t.conversations.groupBy("conv_id").agg(F.collect_set(said).alias("f"))
    return c.select("conv_id", ad.cap_recorded(F.col("f"), F.col("conv_id") % 2 == 0).alias("consistent"))


@query("""WITH x AS (SELECT o_orderkey, list_filter([CASE WHEN NOT (o_orderstatus IN ('F', 'O')) THEN 'status' END, CASE WHEN NOT (o_totalprice > 50000) THEN 'price' END, CASE WHEN NOT (c_acctbal >= 0) THEN 'balance' END, CASE WHEN NOT (n_regionkey <> 3) THEN 'region' END], lambda r: r IS NOT NULL) AS why
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
    SELECT array_to_string(why, ',') AS why, len(why) = 0 AS admitted, count(*) AS n FROM x GROUP BY ALL""")
def provenance_conjunction(t):
    nations = F.broadcast(t.nation.select("n_nationkey", "n_regionkey"))  # 25 rows
    rows = t.orders.join(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    why = ad.reasons({"status": F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice") > 50000, "balance": F.col("c_acctbal") >= 0, "region": F.col("n_regionkey") != 3})
    return rows.select(why.alias("why")).groupBy(F.array_join("why", ",").alias("why"), (F.size("why") == 0).alias("admitted")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT map {'size': p_size > 10, 'price': p_retailprice < 1500, 'brand': p_brand <> 'Brand#11'} AS m FROM part)
    SELECT array_to_string(list_sort(list_transform(list_filter(map_entries(m), lambda e: NOT e.value), lambda e: e.key)), ',') AS failed, count(*) AS n FROM m GROUP BY 1""")
def check_vector(t):
    m = F.create_map(F.lit("size"), F.col("p_size") > 10, F.lit("price"), F.col("p_retailprice") < 1500, F.lit("brand"), F.col("p_brand") != "Brand#11")
    failed = F.array_join(F.array_sort(F.map_keys(F.map_filter(m, lambda k, ok: ~ok))), ",")
    return t.part.groupBy(failed.alias("failed")).agg(F.count("*").alias("n"))


_LINE = "concat('The length is ', CAST(CAST(l_quantity AS INT) AS STRING), CASE WHEN l_linenumber = 3 THEN ' feet.' ELSE ' meters.' END)"


@query(f"""WITH r AS (SELECT CAST(l_quantity AS INT) AS q, {_LINE.replace('STRING', 'VARCHAR')} AS line, CASE WHEN l_suppkey % 9 = 0 THEN -1.0 ELSE l_quantity END AS v, CASE WHEN l_partkey % 5 = 0 THEN 'A' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS answer FROM lineitem)
    SELECT CASE WHEN v < 0 THEN 'invalid_measurement' WHEN round_even(v, 0) <> q THEN 'rounding' WHEN answer <> CAST(q AS VARCHAR) THEN 'answer_bytes' WHEN NOT regexp_full_match(line, 'The length is ' || answer || ' meters\\.') THEN 'observation' END AS reason, count(*) AS n FROM r GROUP BY 1""")
def measurement_admission(t):
    value, q = F.when(F.col("l_suppkey") % 9 == 0, -1.0).otherwise(F.col("l_quantity")), F.col("l_quantity").cast("int")
    answer = F.when(F.col("l_partkey") % 5 == 0, "A").otherwise(q.cast("string"))
    pattern = F.concat(F.lit("^The length is "), answer, F.lit(r" meters\.$"))
    why = ad.first_reason({"invalid_measurement": value >= 0, "rounding": F.bround(value, 0) == q, "answer_bytes": answer == q.cast("string"), "observation": F.rlike(F.expr(_LINE), pattern)})
    return t.lineitem.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT source, count(*) AS n FROM documents WHERE CAST(crc32 AS BIGINT) IS NULL OR true GROUP BY 1""".replace("WHERE CAST(crc32 AS BIGINT) IS NULL OR true", "WHERE source <> 'src1' OR n_chars <= 800"))
def training_side_cap(t):
    """Rows over the cap leave the training side only; a counter of tokens may stand in for the lengths."""
    return t.documents.where((F.col("source") != "src1") | (F.col("n_chars") <= 800)).groupBy("source").agg(F.count("*").alias("n"))


_PATH = "concat(CASE WHEN page_id % 5 = 0 THEN '../' WHEN page_id % 7 = 0 THEN '/' ELSE 'a.b/' END, 'page-', CAST(page_id AS STRING), CASE WHEN page_id % 11 = 0 THEN ' x' ELSE '' END)"


@query(f"""SELECT page_id, len(list_filter(string_split({_PATH.replace('STRING', 'VARCHAR')}, '/'), lambda p: NOT regexp_full_match(p, '[A-Za-z0-9][A-Za-z0-9_.-]*') OR p IN ('.', '..'))) = 0 AS safe FROM pages""")
def safe_paths(t):
    return t.pages.select("page_id", ad.safe_path(F.expr(_PATH)).alias("safe"))


_CODE = "CASE event_id % 6 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN 200 ELSE NULL END"
_KIND = "CASE event_id % 5 WHEN 0 THEN 'ServerError' WHEN 1 THEN 'ReadTimeout' WHEN 2 THEN 'RESOURCE_EXHAUSTED' ELSE 'ValueError' END"


@query(f"""WITH e AS (SELECT {_CODE} AS c, {_KIND} AS k FROM events)
    SELECT CASE WHEN c = 429 THEN 'throttled' WHEN c >= 500 THEN 'server' WHEN c >= 400 THEN 'refused' WHEN c IS NULL AND k = 'ServerError' THEN 'server' WHEN c IS NULL AND k = 'ReadTimeout' THEN 'transport' END AS class,
        CASE WHEN c IS NOT NULL THEN c = 429 ELSE k = 'RESOURCE_EXHAUSTED' END AS true_429, count(*) AS n FROM e GROUP BY ALL""")
def http_errors(t):
    code, kind = F.expr(_CODE), F.expr(_KIND)
    return t.events.groupBy(ad.http_class(code, kind).alias("class"), ad.true_429(code, kind).alias("true_429")).agg(F.count("*").alias("n"))


_ERROR = """CASE event_id % 9 WHEN 0 THEN 'Error code: 429 - slow down' WHEN 1 THEN 'error code: 401 rate limit' WHEN 2 THEN 'status 503' WHEN 3 THEN ' 404 ' WHEN 4 THEN 'Request timed out' WHEN 5 THEN 'Invalid API key; 429'
    WHEN 6 THEN 'strange' WHEN 7 THEN 'Bad Gateway' ELSE 'code 1429 seen' END"""


@query(f"""WITH e AS (SELECT lower({_ERROR}) AS x FROM events) SELECT CASE WHEN contains(x, 'invalid api key') OR regexp_matches(x, '(error code|status|http)[: ]+4([013-9][0-9]|2[0-8])') OR regexp_full_match(x, ' *4([013-9][0-9]|2[0-8]) *') THEN 'permanent'
    WHEN regexp_matches(x, '(^|[^0-9a-z])[45]29([^0-9a-z]|$)') OR contains(x, 'rate limit') OR contains(x, 'timed out') OR contains(x, 'bad gateway') OR regexp_matches(x, 'status +5[0-9][0-9]') THEN 'transient' ELSE 'unknown' END AS bucket, x, count(*) AS n FROM e GROUP BY ALL""")
def error_buckets(t):
    return t.events.groupBy(ad.error_bucket(F.expr(_ERROR), ["invalid api key"]).alias("bucket"), F.lower(F.expr(_ERROR)).alias("x")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT id, embedding[1] AS a, embedding[2] AS b, embedding[3] AS c, embedding[4] AS d FROM (SELECT *, vec_id AS id FROM embeddings))
    SELECT id, array_to_string(list_filter([CASE WHEN abs(a) > 0.30 THEN 'area_large' WHEN abs(a) < 0.01 THEN 'area_small' END, CASE WHEN id % 4 >= 2 THEN 'edges' END, CASE WHEN 1 - abs(b) < 0.70 THEN 'score' END,
        CASE WHEN id % 5000 < 2000 THEN 'points' END, CASE WHEN d < -0.1 - 0.15 THEN 'below_floor' END, CASE WHEN abs(b) < 0.10 AND abs(c) < 0.10 THEN 'near_origin' END], lambda x: x IS NOT NULL), ',') AS flags FROM e""")
def grounding_flags(t):
    a, b, c, d = (F.col("embedding")[i] for i in range(4))
    k = F.col("vec_id")
    flags = ad.grounding_flags(F.abs(a), k % 4, 1 - F.abs(b), k % 5000, b, c, d, F.lit(-0.1))
    return t.embeddings.select(k.alias("id"), F.array_join(flags, ",").alias("flags"))


@query("""WITH b AS (SELECT vec_id, list_transform([1, 3, 5, 7], lambda i: [abs(embedding[i]), abs(embedding[i + 1]), abs(embedding[i]) + (i % 4) * 0.1 + 0.05, abs(embedding[i + 1]) + 0.2]) AS boxes FROM embeddings)
    SELECT vec_id, len(list_filter(boxes, lambda x: (x[3] - x[1]) * (x[4] - x[2]) >= 0.006 AND NOT ((x[3] - x[1] < 0.08 AND (x[1] <= 0.02 OR x[3] >= 0.98)) OR (x[4] - x[2] < 0.08 AND (x[2] <= 0.02 OR x[4] >= 0.98))))) AS kept FROM b""")
def sound_boxes(t):
    e = lambda i: F.abs(F.col("embedding")[i - 1])
    boxes = F.array(*(F.struct(e(i).alias("x0"), e(i + 1).alias("y0"), (e(i) + (i % 4) * 0.1 + 0.05).alias("x1"), (e(i + 1) + 0.2).alias("y1")) for i in (1, 3, 5, 7)))
    return t.embeddings.select("vec_id", F.size(ad.sound_boxes(boxes)).cast("long").alias("kept"))


@query("""SELECT k, CASE WHEN regexp_matches(replace(lower(k), '-', '_'), '(^|_)(api_key|access_token|authorization|password|secret|credential)$|^(apikey|token|auth)$|_auth_token$') THEN '[REDACTED]' ELSE regexp_replace(v, '[Bb]earer +[A-Za-z0-9._]+', 'Bearer [REDACTED]') END AS v, count(*) AS n
    FROM (SELECT unnest(['X-API-Key', 'max_tokens', 'Authorization', 'note', 'token']) AS k, 'sent bearer abc.' || event_type AS v FROM events) GROUP BY ALL""")
def credential_redaction(t):
    names = [F.lit(k) for k in ("X-API-Key", "max_tokens", "Authorization", "note", "token")]
    value = F.concat(F.lit("sent bearer abc."), F.col("event_type"))
    fields = ad.redacted(F.create_map(*(x for k in names for x in (k, value))))
    return t.events.select(F.explode(fields).alias("k", "v")).groupBy("k", "v").agg(F.count("*").alias("n"))


# ---- projections


_SCENE = "concat(CASE s_suppkey % 4 WHEN 0 THEN 'ScanNet/' WHEN 1 THEN 'scannet__' ELSE '' END, 'Scene', lpad(CAST(s_nationkey AS STRING), 4, '0'), '_0', CAST(s_suppkey % 3 AS STRING))"


@query(f"SELECT scene, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(lower({_SCENE.replace('STRING', 'VARCHAR')}), '^scannet(/|__)', ''), '_[0-9][0-9]$', '') AS scene FROM supplier) GROUP BY 1")
def canonical_scenes(t):
    return t.supplier.groupBy(fn.canonical_scene(F.lit("scannet"), F.expr(_SCENE)).alias("scene")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, sha256(concat('{"frames":[', string_agg('"' || sha256(CAST(l_partkey AS VARCHAR)) || '"', ',' ORDER BY l_linenumber, l_partkey), '],"question":"', any_value(o_orderpriority), '"}')) AS fingerprint FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def input_fingerprint(t):
    frames = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.sha2(x["l_partkey"].cast("string"), 256))
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(frames.alias("frames"), F.first("o_orderpriority").alias("q"))
    return rows.select("o_orderkey", jsons.digest(F.to_json(F.struct("frames", F.col("q").alias("question")))).alias("fingerprint"))


@query("""SELECT key, substr(sha256(key), 1, 16) AS fact_id, n FROM (SELECT concat('["', sha256(text), '","', lang, '",', doc_id % 10, ']') AS key, count(*) AS n FROM documents GROUP BY 1)""")
def fact_keys(t):
    key = F.concat(F.lit('["'), F.sha2("text", 256), F.lit('","'), "lang", F.lit('",'), (F.col("doc_id") % 10).cast("string"), F.lit("]"))
    return t.documents.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select("key", F.substring(F.sha2("key", 256), 1, 16).alias("fact_id"), "n")


@query("""SELECT conv_id, len(m) AS turns, m[1].role AS first_role, sha256(array_to_string(list_transform(m, lambda x: x.role || ': ' || x.content), chr(10))) AS chat FROM
    (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn, role, text) AS m FROM conversations GROUP BY 1)""")
def chat_records(t):
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    c = t.conversations.groupBy("conv_id").agg(m.alias("m"))
    chat = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    return c.select("conv_id", F.size("m").cast("long").alias("turns"), F.col("m")[0]["role"].alias("first_role"), F.sha2(chat, 256).alias("chat"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"id":' || event_id || '}' ELSE '{"id":' || event_id || ',"type":"' || event_type || '"}' END AS row FROM events""")
def telemetry_rows(t):
    kind = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    return t.events.select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), kind.alias("type"))).alias("row"))


@query("SELECT 'q_' || substr(sha256('salt|' || CAST(c_custkey AS VARCHAR)), 1, 12) AS opaque, c_mktsegment FROM customer")
def opaque_ids(t):
    return t.customer.select(F.concat(F.lit("q_"), F.substring(fn.digest(F.lit("salt"), F.col("c_custkey")), 1, 12)).alias("opaque"), "c_mktsegment")


# ---- scalar forms


_STAMP = "concat('2024-01-0', CAST(event_id % 9 + 1 AS STRING), 'T00:0', CAST(user_id % 10 AS STRING), ':00', CASE event_id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN '' ELSE '-00:30' END)"


@query(f"""WITH e AS (SELECT event_id, {_STAMP.replace('STRING', 'VARCHAR')} AS s FROM events), p AS (SELECT *, CASE WHEN regexp_matches(s, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN epoch(CAST(s AS TIMESTAMPTZ)) END AS s0 FROM e)
    SELECT event_id, CAST(s0 AS BIGINT) AS seconds, coalesce(abs(s0 - epoch(TIMESTAMPTZ '2024-01-03 00:05:00+00')) <= 300, false) AS fresh FROM p""")
def stamp_freshness(t):
    at = fn.zoned_time(F.expr(_STAMP))
    return t.events.select("event_id", F.unix_seconds(at).alias("seconds"), fn.fresh(at, F.lit("2024-01-03 00:05:00+00:00").cast("timestamp"), 300).alias("fresh"))


@query("""WITH a AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS ids FROM lineitem GROUP BY 1)
    SELECT l_orderkey, list_position(ids, list_max(ids)) - 1 AS first_at, len(list_distinct(ids)) = len(ids) AS each_once FROM a""")
def first_index(t):
    a = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("ids"))
    return a.select("l_orderkey", (F.array_position("ids", F.array_max("ids")) - 1).cast("long").alias("first_at"), (F.size(F.array_distinct("ids")) == F.size("ids")).alias("each_once"))


@query("""SELECT kind, map_keys(m)[1] AS first_label, len(map_keys(m)) AS labels, len(m['Brand#1']) AS ids FROM
    (SELECT kind, map_from_entries(list((b, ids) ORDER BY b)) AS m FROM (SELECT p_size % 5 AS kind, p_brand AS b, list(p_partkey ORDER BY p_partkey) AS ids FROM part GROUP BY ALL) GROUP BY 1)""")
def inverted_labels(t):
    ids = t.part.groupBy((F.col("p_size") % 5).alias("kind"), "p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("ids"))
    m = ids.groupBy("kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p_brand", "ids")))).alias("m"))
    one = F.try_element_at("m", F.lit("Brand#1"))
    return m.select("kind", F.map_keys("m")[0].alias("first_label"), F.size("m").cast("long").alias("labels"), F.when(one.isNotNull(), F.size(one)).cast("long").alias("ids"))


_DOC = """concat('{"b":{"y":', CAST(event_id AS STRING), ',"x":[1,{"instance_id":', CAST(user_id AS STRING), '}]},"a":"', event_type, '","instance_id":', CAST(event_id % 7 AS STRING), '}')"""


@query(f"""WITH e AS (SELECT event_id, user_id, event_type FROM events)
    SELECT event_id, sha256(concat('{{"a":"', event_type, '","b":{{"x":[1,{{"instance_id":', user_id, '}}],"y":', event_id, '}},"instance_id":', event_id % 7, '}}')) AS digest,
        array_to_string(list_sort(list_distinct([user_id, event_id % 7])), ',') AS instances FROM e""")
def canonical_json(t):
    return t.events.select("event_id", F.sha2(jsons.canonical(F.expr(_DOC)), 256).alias("digest"), F.array_join(F.array_sort(F.array_distinct(jsons.instances(F.expr(_DOC), "instance_id"))), ",").alias("instances"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'json' ELSE 'text' END AS form, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def decoded_content(t):
    value = jsons.decoded(F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.concat(F.lit("k is "), F.col("props"))))
    return t.events.select("event_id", F.when(value.isNotNull(), "json").otherwise("text").alias("form"), F.try_variant_get(value, "$.k", "long").alias("k"))


@query("""SELECT DISTINCT event_type, 'object{k:integer}' AS shape FROM events""")
def json_shapes(t):
    return t.events.select("event_type", jsons.shape(F.col("props")).alias("shape")).distinct()
