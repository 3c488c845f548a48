"""Answers: visible text, option letters, the answer of a generation, requested units, grades, compact targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How units are written, and what they are in the base unit.
UNITS = {
    "m": ["m", "meter", "meters", "metre", "metres"],
    "cm": ["cm", "centimeter", "centimeters", "centimetre", "centimetres"],
    "ft": ["ft", "foot", "feet"],
    "in": ["in", "inch", "inches"],
    "m2": ["square meters", "square meter", "square metres", "square metre", "m²", "m^2", "m2"],
    "ft2": ["square feet", "square foot", "ft²", "ft^2", "ft2"],
}
IN_METERS = {"m": "1", "cm": "0.01", "ft": "0.3048", "in": "0.0254", "m2": "1", "ft2": "0.09290304"}
#: The line before the answer of a compact target.
MARKER = "Final answer:"
NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
_BLOCK = r"(?is)<answer\s*>(.*?)</answer\s*>"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _literal(word: str) -> str:
    return r"\Q" + word + r"\E"


def visible_text(parts: Column) -> Column:
    """parts: array of struct(type, text, thought) -> the texts, one a line, without thoughts and reasoning."""
    shown = F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False)) & ~F.coalesce(p["type"], F.lit("")).isin("thinking", "reasoning"))
    return F.array_join(F.transform(shown, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")


def option_letters(options: Column) -> Column:
    """The letters of options such as "B. a chair"; null where one has no letter or two have the same."""
    letters = F.transform(options, lambda o: F.upper(F.regexp_extract(o, r"^\s*([A-Za-z])[.:)]\s*\S", 1)))
    sound = F.forall(letters, lambda x: x != "") & (F.size(F.array_distinct(letters)) == F.size(letters))
    return F.when(sound, letters)


def plain_number(text: Column) -> Column:
    """A number as the nearest double, written without exponent and with at least one place; null beyond 20 digits before the point."""
    value = text.try_cast("double").cast("string").try_cast("decimal(38,18)").cast("string")
    short = F.regexp_replace(F.regexp_replace(value, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(F.contains(short, F.lit(".")), short).otherwise(F.concat(short, F.lit(".0")))


def parse_answer(raw: Column, letters: Column) -> Column:
    """struct(branch, span, blocks, reason, answer): the answer that a generation gives.

    Only what follows the last closed thinking block counts; of complete answer tags the last, or without tags the last line. With letters
    (not null and not empty) the answer has to be one of them, else one finite number. branch is tag, final_line or failure."""
    text = F.element_at(F.split(raw, r"(?i)</think\s*>"), -1)
    unclosed = text.rlike(r"(?i)<think\s*>")
    text = _strip(F.regexp_replace(text, r"(?:\s*<\|(?:im_end|endoftext)\|>)+\s*$", ""))
    blocks = F.regexp_extract_all(text, F.lit(_BLOCK))
    torn = F.regexp_replace(text, _BLOCK, "").rlike(r"(?i)<\s*/?\s*answer\b")
    lines = F.filter(F.transform(F.split(text, r"\R"), _strip), lambda x: x != "")
    tagged = F.size(blocks) > 0
    last = F.regexp_replace(F.try_element_at(lines, F.lit(-1)), r"(?i)^(?:final\s+answer|answer)\s*:\s*", "")
    span = F.when(tagged, _strip(F.try_element_at(blocks, F.lit(-1)))).otherwise(last)
    lettered = F.coalesce(F.size(letters) > 0, F.lit(False))
    value = span.try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    reason = (
        F.when(raw.isNull() | (_strip(raw) == ""), "empty_generation")
        .when(unclosed, "unclosed_thinking")
        .when(torn, "malformed_answer_tags")
        .when(~tagged & (F.size(lines) == 0), "empty_visible_suffix")
        .when(lettered & ~(span.rlike("^[a-zA-Z]$") & F.array_contains(letters, F.upper(span))), "not_one_supplied_option_letter")
        .when(~lettered & ((F.length(span) > 512) | ~span.rlike(f"^{NUMBER}$")), "not_one_finite_numeric_scalar")
        .when(~lettered & ~finite, "nonfinite_numeric_scalar")
    )
    looked = F.coalesce(~reason.isin("empty_generation", "unclosed_thinking", "malformed_answer_tags", "empty_visible_suffix"), F.lit(True))
    return F.struct(
        F.when(reason.isNotNull(), "failure").when(tagged, "tag").otherwise("final_line").alias("branch"),
        F.when(looked, span).alias("span"),
        F.when(F.coalesce(~reason.isin("empty_generation", "unclosed_thinking"), F.lit(True)), F.size(blocks)).otherwise(0).alias("blocks"),
        reason.alias("reason"),
        F.when(reason.isNull(), F.when(lettered, F.upper(span)).otherwise(plain_number(span))).alias("answer"),
    )


def requested_unit(question: Column, area: Column) -> Column:
    """The unit that a question names, of areas or of lengths; null if it names none or several. A bare "in" is not read as inches."""
    def named(units: list[str]) -> Column:
        hit = {u: [w for w in UNITS[u] if w != "in"] for u in units}
        found = F.array(*(F.when(F.lower(question).rlike(r"(?<!\w)(?:" + "|".join(map(_literal, w)) + r")(?!\w)"), u) for u, w in hit.items()))
        return F.array_compact(found)

    found = F.when(area, named(["m2", "ft2"])).otherwise(named(["m", "cm", "ft", "in"]))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def unit_of(word: Column) -> Column:
    """The unit that a written word stands for."""
    return F.element_at(F.create_map(*(F.lit(x) for u, words in UNITS.items() for w in words for x in (w, u))), word)


def in_meters(value: Column, unit: Column) -> Column:
    """A decimal in metres or square metres."""
    factor = F.element_at(F.create_map(*(F.lit(x) for x in (y for kv in IN_METERS.items() for y in kv))), unit)
    return value.cast("decimal(18,6)") * factor.cast("decimal(10,8)")


def grade(kind: Column, unit: Column, letters: Column, gold: Column, answer: Column) -> Column:
    """struct(correct, rule). kind: counting asks for the same integer without a suffix; all else for the unit that was asked for, or none
    written, and a relative error of 5 % and 1e-12 at most; a gold of 0 is never met. With letters the letter decides."""
    number = F.regexp_extract(answer, rf"^\s*({NUMBER})", 1)
    suffix = F.regexp_replace(F.lower(_strip(F.regexp_replace(answer, rf"^\s*{NUMBER}", ""))), r"\.+$", "")
    pred, want = number.try_cast("double"), gold.try_cast("double")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0)
    counted = (suffix == "") & (pred == F.floor(pred)) & (want == F.floor(want)) & (pred == want)
    near = (want > 0) & (F.abs(pred - want) / F.when(want > 0, want) <= 0.05 + 1e-12)
    lettered = F.coalesce(F.size(letters) > 0, F.lit(False))
    rule = (
        F.when(answer.isNull(), "missing_answer")
        .when(lettered, "exact_option")
        .when(number == "", "malformed_number")
        .when(bad(pred) | bad(want), "invalid_number")
        .when(kind == "counting", "exact_integer")
        .when((suffix != "") & ~F.coalesce(unit_of(suffix) == unit, F.lit(False)), "incompatible_or_unknown_unit")
        .otherwise("relative_error")
    )
    letter = F.upper(_strip(answer))
    right = F.when(rule == "exact_option", F.array_contains(letters, letter) & (letter == gold)).when(rule == "exact_integer", counted).when(rule == "relative_error", near)
    return F.struct(F.coalesce(right, F.lit(False)).alias("correct"), rule.alias("rule"))


def rescued(tag: Column, printed: Column, tool: Column, unit: Column) -> Column:
    """struct(answer, source): the tagged answer, else the last number printed, else the tool's, centimetres and inches brought to metres
    where metres are asked for."""
    last = F.try_element_at(F.regexp_extract_all(printed, F.lit(rf"({NUMBER}\s*(?:cm|m)?)\b")), F.lit(-1))
    number = F.regexp_extract(last, rf"({NUMBER})", 1).try_cast("decimal(18,6)")
    scaled = F.when((unit == "m") & last.rlike(r"cm$"), number * F.lit("0.01").cast("decimal(3,2)")).otherwise(number)
    from_print = F.regexp_replace(F.regexp_replace(scaled.cast("decimal(18,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    source = F.when(tag.isNotNull(), "tag").when(from_print.isNotNull(), "printed").when(tool.isNotNull(), "tool").otherwise("none")
    return F.struct(F.coalesce(tag, from_print, tool).alias("answer"), source.alias("source"))


def counted_noun(question: Column) -> Column:
    """The noun after how many, number of, count: up to a bracketed plural, a verb or the sentence's end; without the, distinct, different."""
    ask = r"(?is)\b(?:how many|(?:number|quantity|count) (?:of|for)|count(?: the)?)\s+"
    bracket = F.regexp_extract(question, ask + r"(.+?)\((?:s|es)\)", 1)
    open_ = F.regexp_extract(question, ask + r"(.+?)(?:\s+(?:are|is|do|does|can|have|exist|present|located|in|here)\b|[?.!\n])", 1)
    noun = F.lower(_strip(F.when(bracket != "", bracket).otherwise(open_)))
    return F.regexp_replace(noun, r"^(?:(?:the|distinct|different)\s+)+", "")


def names_label(noun: Column, label: Column) -> Column:
    """Whether a noun is a label or one of its plurals: s, es, y to ies, f and fe to ves."""
    cut = lambda n: F.substring(label, F.lit(1), F.length(label) - n)
    forms = F.array(
        label,
        F.concat(label, F.lit("s")),
        F.concat(label, F.lit("es")),
        F.when(label.endswith("y"), F.concat(cut(1), F.lit("ies"))),
        F.when(label.endswith("f"), F.concat(cut(1), F.lit("ves"))),
        F.when(label.endswith("fe"), F.concat(cut(2), F.lit("ves"))),
    )
    return (noun != "") & F.array_contains(F.array_compact(forms), noun)


def core_question(question: Column, prefix: str, suffix: str) -> Column:
    """A question without its fixed prefix and suffix; null where one of them is missing or nothing, or blank ends, remain."""
    core = F.substring(question, F.lit(len(prefix) + 1), F.length(question) - len(prefix) - len(suffix))
    sound = question.startswith(prefix) & question.endswith(suffix) & (core != "") & (core == _strip(core))
    return F.when(F.coalesce(sound, F.lit(False)), core)


def _section(title: str, lines: Column) -> Column:
    numbered = F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.concat(F.array(F.concat(F.lit(f"{title} ("), F.size(lines).cast("string"), F.lit(")"))), numbered)


def render_target(observations: Column, derivations: Column, answer: Column) -> Column:
    """A compact target: counted and numbered observations, derivations if there are any, the marker, the answer. Null where there is no
    observation, a line is empty or has a break, or a number of the answer is in none of the lines."""
    every = F.concat(observations, derivations)
    grounded = F.size(F.array_except(F.regexp_extract_all(answer, F.lit(r"(\d+(?:\.\d+)?)")), F.regexp_extract_all(F.array_join(every, "\n"), F.lit(r"(\d+(?:\.\d+)?)")))) == 0
    sound = (F.size(observations) > 0) & F.forall(every, lambda x: (x != "") & ~x.rlike(r"[\r\n]")) & answer.rlike(r"^(?:[A-Z]|\d+(?:\.\d+)?)$") & grounded
    lines = F.concat(_section("Observations", observations), F.when(F.size(derivations) > 0, _section("Derivations", derivations)).otherwise(F.array().cast("array<string>")), F.array(F.lit(MARKER), answer))
    return F.when(sound, F.array_join(lines, "\n"))


def parse_target(target: Column) -> Column:
    """struct(observations, derivations, answer) of a compact target; null unless rendering these gives the same text again."""
    lines = F.split(target, "\n")
    n = F.regexp_extract(F.get(lines, F.lit(0)), r"^Observations \(([1-9]\d*)\)$", 1).try_cast("int")
    bare = lambda a: F.transform(a, lambda x: F.regexp_replace(x, r"^\d+\. ", ""))
    observations = bare(F.slice(lines, F.lit(2), F.coalesce(n, F.lit(0))))
    m = F.coalesce(F.regexp_extract(F.get(lines, n + 1), r"^Derivations \(([1-9]\d*)\)$", 1).try_cast("int"), F.lit(0))
    derivations = bare(F.slice(lines, F.coalesce(n, F.lit(0)) + 3, m))
    answer = F.try_element_at(lines, F.lit(-1))
    again = render_target(observations, derivations, answer)
    return F.when(F.coalesce(n.isNotNull() & (again == target), F.lit(False)), F.struct(observations.alias("observations"), derivations.alias("derivations"), answer.alias("answer")))


def bare_answer(target: Column, answer: Column) -> Column:
    """Whether a target is nothing but the answer: one line of at most 64 bytes, a final line feed allowed."""
    return F.coalesce(F.regexp_replace(target, r"\n$", "").eqNullSafe(answer) & ~answer.rlike(r"[\r\n]") & (F.octet_length(answer) <= 64), F.lit(False))


def bound_target(target: Column, answer: Column, tokens: Column, most: int) -> Column:
    """The first rule that a bound target breaks: answer form, one marker, marker and answer as the last lines, token count; null if none."""
    marks = (F.length(target) - F.length(F.replace(target, F.lit(MARKER), F.lit("")))) / len(MARKER)
    return (
        F.when(F.coalesce((answer == "") | (answer != _strip(answer)) | answer.rlike(r"[\r\n]"), F.lit(True)), "answer_form")
        .when(F.coalesce(marks != 1, F.lit(True)), "closing_marker")
        .when(~target.endswith(F.concat(F.lit(f"\n{MARKER}\n"), answer)), "terminal_answer")
        .when(F.coalesce(tokens <= 0, F.lit(True)), "token_count")
        .when(tokens > most, "token_limit")
    )
