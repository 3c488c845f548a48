"""Queries on answers: parsing, grading, units, targets. Inputs are written forms made from the tables by expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import answers as an
from grainmill.plans.catalog import query

_V = "CAST(event_id % 97 AS STRING)"
#: A generation for every event: tags, thinking, final lines, letters, malformed and boundary forms.
RAW = f"""CASE event_id % 16 WHEN 0 THEN concat('<answer> ', {_V}, ' </answer>') WHEN 1 THEN concat('<think>a 7</think> so <ANSWER>', {_V}, '.50</ANSWER>')
    WHEN 2 THEN concat('It is', chr(10), 'Final answer: ', {_V}) WHEN 3 THEN '<answer>b</answer>' WHEN 4 THEN concat('<answer>1</answer> <answer>', {_V}, '</answer>')
    WHEN 5 THEN '<answer>4' WHEN 6 THEN '<think>never closed 5' WHEN 7 THEN '' WHEN 8 THEN concat('answer: B', chr(10), chr(10)) WHEN 9 THEN concat({_V}, ' meters')
    WHEN 10 THEN '1e3<|im_end|> ' WHEN 11 THEN '1e999' WHEN 12 THEN '<think>x</think>  ' WHEN 13 THEN concat('-', {_V}, '.') WHEN 14 THEN 'C' ELSE NULL END"""
LETTERED = "event_id % 3 = 0"
_BLOCK = "'<answer\\s*>(.*?)</answer\\s*>'"


@query(rf"""WITH e AS (SELECT event_id, {RAW.replace('STRING', 'VARCHAR')} AS raw, CASE WHEN {LETTERED} THEN ['A', 'B', 'C'] ELSE [] END AS letters FROM events),
    a AS (SELECT *, string_split_regex(coalesce(raw, ''), '(?i)</think\s*>')[-1] AS t FROM e),
    b AS (SELECT *, regexp_matches(t, '(?i)<think\s*>') AS unclosed, trim(regexp_replace(t, '(\s*<\|(im_end|endoftext)\|>)+\s*$', ''), ' ' || chr(10)) AS u FROM a),
    c AS (SELECT *, regexp_extract_all(u, {_BLOCK}, 1, 'is') AS blocks, regexp_matches(regexp_replace(u, {_BLOCK}, '', 'gis'), '<\s*/?\s*answer', 'i') AS torn,
        list_filter(list_transform(string_split(u, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM b),
    d AS (SELECT *, CASE WHEN len(blocks) > 0 THEN trim(blocks[-1]) ELSE regexp_replace(lines[-1], '^(final\s+answer|answer)\s*:\s*', '', 'i') END AS span FROM c),
    f AS (SELECT *, CASE WHEN trim(coalesce(raw, '')) = '' THEN 'empty_generation' WHEN unclosed THEN 'unclosed_thinking' WHEN torn THEN 'malformed_answer_tags'
        WHEN len(blocks) = 0 AND len(lines) = 0 THEN 'empty_visible_suffix' WHEN len(letters) > 0 AND NOT (regexp_full_match(span, '[a-zA-Z]') AND list_contains(letters, upper(span))) THEN 'not_one_supplied_option_letter'
        WHEN len(letters) = 0 AND NOT regexp_full_match(span, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'not_one_finite_numeric_scalar'
        WHEN len(letters) = 0 AND (TRY_CAST(span AS DOUBLE) IS NULL OR isinf(TRY_CAST(span AS DOUBLE))) THEN 'nonfinite_numeric_scalar' END AS reason FROM d)
    SELECT event_id, CASE WHEN reason IS NOT NULL THEN 'failure' WHEN len(blocks) > 0 THEN 'tag' ELSE 'final_line' END AS branch, reason,
        CASE WHEN reason IS NULL THEN CASE WHEN len(letters) > 0 THEN upper(span) ELSE CASE WHEN TRY_CAST(span AS DOUBLE) = round(TRY_CAST(span AS DOUBLE)) THEN CAST(CAST(TRY_CAST(span AS DOUBLE) AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(TRY_CAST(span AS DOUBLE) AS VARCHAR) END END END AS answer FROM f""")
def answer_parser_full(t):
    letters = F.when(F.expr(LETTERED), F.array(F.lit("A"), F.lit("B"), F.lit("C"))).otherwise(F.array().cast("array<string>"))
    e = t.events.select("event_id", an.parse_answer(F.expr(RAW), letters).alias("p"))
    return e.select("event_id", "p.branch", "p.reason", "p.answer")


#: Answers at, just under and just over the 5 % rule, with suffixes, of counts and letters.
_ANSWER = """CASE l_linenumber % 8 WHEN 0 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' apples') WHEN 1 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '.0')
    WHEN 2 THEN CAST(CAST(l_quantity AS DECIMAL(12, 2)) * CAST(1.05 AS DECIMAL(4, 2)) AS STRING) WHEN 3 THEN concat(CAST(CAST(l_quantity AS DECIMAL(12, 2)) * CAST(1.0501 AS DECIMAL(6, 4)) AS STRING), ' m')
    WHEN 4 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' ft.') WHEN 5 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' Meters.') WHEN 6 THEN 'none' ELSE NULL END"""
_GOLD = "CASE WHEN l_partkey % 11 = 0 THEN '0' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END"
_N = "[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?"


@query(rf"""WITH r AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'counting' ELSE 'distance' END AS kind, {_ANSWER.replace('STRING', 'VARCHAR')} AS answer, {_GOLD.replace('STRING', 'VARCHAR')} AS gold FROM lineitem),
    a AS (SELECT *, regexp_extract(answer, '^\s*({_N})', 1) AS number, regexp_replace(lower(trim(regexp_replace(answer, '^\s*{_N}', ''))), '\.+$', '') AS suffix FROM r),
    b AS (SELECT *, TRY_CAST(number AS DOUBLE) AS p, TRY_CAST(gold AS DOUBLE) AS g FROM a),
    c AS (SELECT *, CASE WHEN answer IS NULL THEN 'missing_answer' WHEN number = '' THEN 'malformed_number' WHEN p < 0 OR g < 0 THEN 'invalid_number' WHEN kind = 'counting' THEN 'exact_integer'
        WHEN suffix NOT IN ('', 'm', 'meter', 'meters', 'metre', 'metres') THEN 'incompatible_or_unknown_unit' ELSE 'relative_error' END AS rule FROM b)
    SELECT kind, rule, count(*) AS n, count(*) FILTER (CASE rule WHEN 'exact_integer' THEN suffix = '' AND p = floor(p) AND p = g WHEN 'relative_error' THEN g > 0 AND abs(p - g) / g <= 0.05 + 1e-12 ELSE false END) AS correct FROM c GROUP BY ALL""")
def grade_full(t):
    kind = F.when(F.col("l_suppkey") % 2 == 0, "counting").otherwise("distance")
    g = an.grade(kind, F.lit("m"), F.array().cast("array<string>"), F.expr(_GOLD), F.expr(_ANSWER))
    return t.lineitem.select(kind.alias("kind"), g.alias("g")).groupBy("kind", "g.rule").agg(F.count("*").alias("n"), F.count_if("g.correct").alias("correct"))


@query("""WITH o AS (SELECT p_partkey, [chr(65 + CAST(p_partkey % 3 AS INT)) || '. ' || p_brand, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'B) ' END || p_name] AS options FROM part),
    l AS (SELECT p_partkey, list_transform(options, lambda x: upper(regexp_extract(x, '^\\s*([A-Za-z])[.:)]\\s*\\S', 1))) AS l FROM o)
    SELECT p_partkey, CASE WHEN list_contains(l, '') OR len(list_distinct(l)) < len(l) THEN NULL ELSE array_to_string(l, '') END AS letters FROM l""")
def option_letters(t):
    options = F.array(F.concat(F.char(65 + F.col("p_partkey") % 3), F.lit(". "), "p_brand"), F.concat(F.when(F.col("p_size") % 5 == 0, "").otherwise("B) "), F.col("p_name")))
    return t.part.select("p_partkey", F.array_join(an.option_letters(options), "").alias("letters"))


_ASK = """concat('What is the ', CASE p_size % 6 WHEN 0 THEN 'length in meters' WHEN 1 THEN 'length in cm or feet' WHEN 2 THEN 'area in square feet' WHEN 3 THEN 'height in the room' WHEN 4 THEN 'width in centimetres (cm)' ELSE 'area in m2' END, ' of ', p_name, '?')"""


@query(f"""WITH q AS (SELECT p_partkey, p_size % 6 IN (2, 5) AS area, lower({_ASK}) AS q FROM part),
    u AS (SELECT p_partkey, list_distinct(list_filter(list_transform([['meters', 'm'], ['cm', 'cm'], ['centimetres', 'cm'], ['feet', 'ft'], ['square feet', 'ft2'], ['m2', 'm2']],
        lambda x: CASE WHEN (x[2] IN ('m2', 'ft2')) = area AND regexp_matches(q, '(^|[^a-z0-9_])' || x[1] || '([^a-z0-9_]|$)') THEN x[2] END), lambda x: x IS NOT NULL)) AS u FROM q)
    SELECT p_partkey, CASE WHEN len(u) = 1 THEN u[1] END AS unit FROM u""")
def requested_units(t):
    return t.part.select("p_partkey", an.requested_unit(F.expr(_ASK), F.expr("p_size % 6 IN (2, 5)")).alias("unit"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * CASE u WHEN 'cm' THEN 1000000 WHEN 'ft' THEN 30480000 WHEN 'in' THEN 2540000 WHEN 'ft2' THEN 9290304 ELSE 100000000 END AS scaled
    FROM (SELECT *, ['m', 'cm', 'ft', 'in', 'm2', 'ft2'][l_linenumber % 6 + 1] AS u FROM lineitem)""")
def unit_conversion(t):
    unit = F.element_at(F.array(*(F.lit(u) for u in ("m", "cm", "ft", "in", "m2", "ft2"))), (F.col("l_linenumber") % 6 + 1).cast("int"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(an.in_meters(F.col("l_quantity"), unit) * 100000000).cast("long").alias("scaled"))


_PRINTED = "CASE event_id % 4 WHEN 0 THEN concat('it is ', CAST(user_id AS STRING), ' cm') WHEN 1 THEN concat('so 3 then ', CAST(user_id AS STRING)) WHEN 2 THEN 'nothing' ELSE NULL END"


@query(f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'T' END AS tag, {_PRINTED.replace('STRING', 'VARCHAR')} AS p, CASE WHEN event_id % 7 = 0 THEN '9' END AS tool, user_id FROM events),
    n AS (SELECT *, CASE WHEN p LIKE '%cm' THEN user_id / 100 WHEN p LIKE 'so%' THEN user_id END AS v FROM e)
    SELECT event_id, CASE WHEN tag IS NOT NULL THEN 'tag' WHEN v IS NOT NULL THEN 'printed' WHEN tool IS NOT NULL THEN 'tool' ELSE 'none' END AS source,
        TRY_CAST(coalesce(CASE WHEN tag IS NOT NULL THEN NULL ELSE coalesce(CAST(v AS VARCHAR), tool) END, '') AS DOUBLE) AS number FROM n""")
def answer_fallback(t):
    r = an.rescued(F.when(F.col("event_id") % 5 == 0, "T"), F.expr(_PRINTED), F.when(F.col("event_id") % 7 == 0, "9"), F.lit("m"))
    return t.events.select("event_id", r.alias("r")).select("event_id", "r.source", F.col("r.answer").try_cast("double").alias("number"))


_COUNT = """concat(CASE s_nationkey % 5 WHEN 0 THEN 'How many ' WHEN 1 THEN 'What is the number of the different ' WHEN 2 THEN 'Please count the ' WHEN 3 THEN 'Where are ' ELSE 'How many distinct ' END,
    CASE s_suppkey % 6 WHEN 0 THEN 'chairs' WHEN 1 THEN 'chair(s)' WHEN 2 THEN 'shelves' WHEN 3 THEN 'boxes' WHEN 4 THEN 'berries' ELSE 'knives' END, ' are in the room?')"""
_LABELS = ["chair", "shelf", "box", "berry", "knife"]


@query(f"""WITH q AS (SELECT s_suppkey, lower({_COUNT}) AS q FROM supplier),
    m AS (SELECT s_suppkey, CASE WHEN regexp_extract(q, '(how many|(number|quantity|count) (of|for)|count( the)?)\\s+(.+?)\\((s|es)\\)', 5) <> '' THEN regexp_extract(q, '(how many|(number|quantity|count) (of|for)|count( the)?)\\s+(.+?)\\((s|es)\\)', 5)
        ELSE regexp_extract(q, '(how many|(number|quantity|count) (of|for)|count( the)?)\\s+(.+?)\\s+are', 5) END AS n FROM q),
    b AS (SELECT s_suppkey, regexp_replace(n, '^((the|distinct|different)\\s+)+', '') AS noun FROM m),
    f AS (SELECT * FROM (VALUES ('chair', 'chair'), ('chair', 'chairs'), ('chair', 'chaires'), ('shelf', 'shelf'), ('shelf', 'shelfs'), ('shelf', 'shelves'), ('box', 'box'), ('box', 'boxes'), ('berry', 'berry'), ('berry', 'berries'), ('knife', 'knife'), ('knife', 'knives')) v(label, form))
    SELECT s_suppkey, noun, label FROM b LEFT JOIN f ON form = noun""")
def counting_category(t):
    noun = an.counted_noun(F.expr(_COUNT))
    hit = F.filter(F.array(*(F.lit(x) for x in _LABELS)), lambda x: an.names_label(F.col("noun"), x))
    return t.supplier.select("s_suppkey", noun.alias("noun")).select("s_suppkey", "noun", F.explode_outer(hit).alias("label"))


_Q = "concat(CASE WHEN p_size % 4 = 0 THEN 'Ask: ' ELSE 'These are frames. ' END, p_name, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE '' END, ' Answer with a number.')"


@query(f"""WITH q AS (SELECT p_partkey, {_Q} AS q FROM part), c AS (SELECT p_partkey, q, substr(q, 19, length(q) - 18 - 22) AS core FROM q)
    SELECT p_partkey, CASE WHEN starts_with(q, 'These are frames. ') AND ends_with(q, ' Answer with a number.') AND trim(core) = core AND core <> '' THEN core END AS core FROM c""")
def question_core(t):
    return t.part.select("p_partkey", an.core_question(F.expr(_Q), "These are frames. ", " Answer with a number.").alias("core"))


@query(r"""WITH o AS (SELECT l_orderkey, list(concat('Line ', l_linenumber, ' has ', CAST(l_quantity AS INT), ' items.') ORDER BY l_linenumber, CAST(l_quantity AS INT)) AS obs, CAST(CAST(max(l_quantity) AS INT) AS VARCHAR) AS top, CAST(CAST(sum(l_quantity) AS INT) AS VARCHAR) AS total FROM lineitem GROUP BY 1),
    a AS (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN top ELSE total END AS answer, CASE WHEN l_orderkey % 3 = 0 THEN ['The largest is ' || top || '.'] ELSE [] END AS der FROM o)
    SELECT l_orderkey, CASE WHEN list_contains(regexp_extract_all(array_to_string(list_concat(obs, der), ' '), '[0-9]+'), answer) THEN concat('Observations (', len(obs), ')', chr(10), array_to_string(list_transform(obs, lambda x, i: concat(i, '. ', x)), chr(10)), chr(10),
        CASE WHEN len(der) > 0 THEN concat('Derivations (1)', chr(10), '1. ', der[1], chr(10)) ELSE '' END, 'Final answer:', chr(10), answer) END AS target,
        CASE WHEN list_contains(regexp_extract_all(array_to_string(list_concat(obs, der), ' '), '[0-9]+'), answer) THEN len(obs) END AS n_back FROM a""")
def compact_targets(t):
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))), lambda x: F.concat(F.lit("Line "), x["l_linenumber"].cast("string"), F.lit(" has "), x["q"].cast("string"), F.lit(" items.")))
    o = t.lineitem.groupBy("l_orderkey").agg(items.alias("obs"), F.max("l_quantity").cast("int").cast("string").alias("top"), F.sum("l_quantity").cast("int").cast("string").alias("total"))
    answer = F.when(F.col("l_orderkey") % 2 == 0, F.col("top")).otherwise(F.col("total"))
    derived = F.when(F.col("l_orderkey") % 3 == 0, F.array(F.concat(F.lit("The largest is "), F.col("top"), F.lit(".")))).otherwise(F.array().cast("array<string>"))
    out = o.select("l_orderkey", an.render_target(F.col("obs"), derived, answer).alias("target"))
    return out.withColumn("n_back", F.size(an.parse_target(F.col("target"))["observations"]).cast("long")).withColumn("n_back", F.when(F.col("target").isNotNull(), F.col("n_back")))


_TARGET = "concat(CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('Seen.', chr(10), 'Final answer:', chr(10)) END, CASE WHEN event_id % 7 = 0 THEN concat('Final answer:', chr(10)) ELSE '' END, CAST(user_id AS STRING))"


@query(f"""WITH e AS (SELECT event_id, {_TARGET.replace('STRING', 'VARCHAR')} AS t, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE '' END || CAST(user_id AS VARCHAR) AS a FROM events)
    SELECT event_id, CASE WHEN a <> trim(a) THEN 'answer_form' WHEN (length(t) - length(replace(t, 'Final answer:', ''))) // 13 <> 1 THEN 'closing_marker' WHEN NOT ends_with(t, concat(chr(10), 'Final answer:', chr(10), a)) THEN 'terminal_answer'
        WHEN length(t) // 4 > 6 THEN 'token_limit' END AS reason, t = a AND octet_length(encode(a)) <= 64 AS bare FROM e""")
def target_admission(t):
    answer = F.concat(F.when(F.col("event_id") % 11 == 0, " ").otherwise(""), F.col("user_id").cast("string"))
    target = F.expr(_TARGET)
    tokens = F.expr(f"length({_TARGET}) div 4")  # any counter of tokens may be given
    return t.events.select("event_id", an.bound_target(target, answer, tokens, 6).alias("reason"), an.bare_answer(target, answer).alias("bare"))


@query("""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN turn % 3 <> 0 THEN role END, text, CASE WHEN turn % 2 = 0 THEN 'plain' END], lambda x: x IS NOT NULL), chr(10)) AS shown FROM conversations""")
def visible_text(t):
    part = lambda kind, text, thought: F.struct(kind.alias("type"), text.alias("text"), thought.alias("thought"))
    none = F.lit(None).cast("boolean")
    parts = F.array(part(F.lit("text"), F.col("role"), F.col("turn") % 3 == 0), part(F.lit(None).cast("string"), F.col("text"), none), part(F.when(F.col("turn") % 2 == 0, "text").otherwise("reasoning"), F.lit("plain"), none))
    return t.conversations.select("conv_id", "turn", an.visible_text(parts).alias("shown"))
