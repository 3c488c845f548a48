"""Column functions: normalised text, digests, canonical identities, tolerance grades, rounding, angles."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normal_text(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[ \t\n\r\f\x0b]+", " "))


def digest(*parts: Column, sep: str = "|") -> Column:
    return F.sha2(F.concat_ws(sep, *(p.cast("string") for p in parts)), 256)


def split_side(group: Column, seed: int, fraction: float) -> Column:
    """'held' where the SHA-256 of the canonical (seed, group) lies below the fraction of all digests, else 'train'."""
    limit = format(int(fraction * 2**256), "064x")
    key = F.concat(F.lit(f'[\n  "split-v1",\n  {seed},\n  "'), group.cast("string"), F.lit('"\n]\n'))
    return F.when(F.sha2(key, 256) < limit, "held").otherwise("train")


def within(pred: Column, gold: Column, percent: int) -> Column:
    """|pred - gold| <= percent of gold for a positive gold, in exact decimals; a gold of zero or less is never met."""
    p, g = pred.cast("decimal(18,4)"), gold.cast("decimal(18,4)")
    return F.coalesce((g > 0) & (F.abs(p - g) * 100 <= g * percent), F.lit(False))


def relative_accuracy(pred: Column, gold: Column) -> Column:
    """Share of the ten tolerances 0.50, 0.45 .. 0.05 that the relative error meets, in tenths."""
    return sum((within(pred, gold, 100 - t).cast("int") for t in range(50, 100, 5)), F.lit(0))


def half_even(x: Column, places: int) -> Column:
    return F.bround(x, places)


def signed_turn(degrees: Column) -> Column:
    """Angle in (-180, 180]."""
    return F.lit(180) - F.pmod(F.lit(180) - degrees, F.lit(360))


def sector(dx: Column, dy: Column) -> Column:
    """One of eight compass sectors of a vector."""
    at = F.pmod(F.floor((F.degrees(F.atan2(dy, dx)) + 22.5) / 45), F.lit(8)).cast("int")
    return F.get(F.array(*(F.lit(x) for x in ("E", "NE", "N", "NW", "W", "SW", "S", "SE"))), at)


def increasing(a: Column) -> Column:
    """Whether an array is strictly increasing."""
    return (F.size(a) < 2) | F.forall(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), lambda i: F.get(a, i) > F.get(a, i - 1))


def evenly(a: Column, k: int) -> Column:
    """k elements at the positions i (n - 1) div (k - 1), first and last included."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(a, (i * (F.size(a) - 1) / (k - 1)).cast("int")))


def numbers_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)"))


def answer_of(text: Column) -> Column:
    """The only <answer> block of a text; null if there is none or more than one."""
    found = F.regexp_extract_all(text, F.lit(r"<answer>([^<]*)</answer>"))
    return F.when(F.size(found) == 1, F.trim(F.get(found, F.lit(0))))


def cited_lines(text: Column) -> Column:
    """Array of (source, line) that citations such as E1.L2 and E1.L2-L5 name; a range that runs backwards names none."""
    found = F.regexp_extract_all(text, F.lit(r"(E[0-9]+\.L[0-9]+(?:-L[0-9]+)?)"))
    part = lambda c, i: F.regexp_extract(c, r"^(E[0-9]+)\.L([0-9]+)(?:-L([0-9]+))?$", i)
    first = lambda c: part(c, 2).cast("long")
    last = lambda c: F.coalesce(F.nullif(part(c, 3), F.lit("")).cast("long"), first(c))
    lines = lambda c: F.when(first(c) <= last(c), F.sequence(first(c), F.greatest(first(c), last(c)))).otherwise(F.array().cast("array<bigint>"))
    return F.flatten(F.transform(found, lambda c: F.transform(lines(c), lambda i: F.struct(part(c, 1).alias("source"), i.alias("line")))))


def places(number: Column) -> Column:
    """Digits after the point of a printed number."""
    return F.length(F.split_part(number, F.lit("."), F.lit(2)))


def printed_tolerance(number: Column) -> Column:
    """Half a unit of the last printed digit."""
    return F.lit(0.5) * F.pow(F.lit(10.0), -places(number))


def rounded_or_refused(x: Column, digits: int) -> Column:
    """A decimal rounded half-even; null at an exact midpoint, which the printed form cannot tell from its neighbours."""
    return F.when(F.abs(F.round(x, digits) - x) * 2 * 10**digits != 1, F.bround(x, digits))


def backoff(attempt: Column, after: Column, most: int) -> Column:
    """Seconds to wait: doubled with every attempt up to `most`, and never less than the server asks for."""
    return F.greatest(F.least(F.lit(most), F.pow(F.lit(2.0), attempt)).cast("long"), F.coalesce(after, F.lit(0)).cast("long"))


def same_score(stored: Column, again: Column) -> Column:
    """Equal within half a hundredth after both are rounded to two places."""
    return F.abs(F.round(stored, 2) - F.round(again, 2)) <= 0.005 + 1e-10


def has_field(json: Column, names: list[str]) -> Column:
    """Whether a JSON text has a key, at any depth, that one of the patterns matches."""
    return json.rlike('"(' + "|".join(names) + r')"\s*:')


def preview(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(" [cut]"))).otherwise(text)


def canonical_scene(dataset: Column, scene: Column) -> Column:
    """A physical scene: without the data set's name before it, in lower case, and without the number of the visit."""
    plain = F.lower(scene)
    for mark in ("/", "__"):
        before = F.concat(F.lower(dataset), F.lit(mark))
        plain = F.when(plain.startswith(before), F.substring(plain, F.length(before) + 1, F.length(plain))).otherwise(plain)
    return F.regexp_replace(plain, r"_\d{2}$", "")


def scene_group(dataset: Column, scene: Column, blocking: bool) -> Column:
    """dataset/scene of one physical place. For splits only scannet's scenes lose the two digits of their visit; for blocking all lose any number."""
    name = F.when(dataset.rlike("^scannetpp"), "scannetpp").otherwise(dataset)
    place = F.regexp_replace(scene, r"_\d+$", "") if blocking else F.when(dataset == "scannet", F.regexp_replace(scene, r"_\d{2}$", "")).otherwise(scene)
    return F.concat(name, F.lit("/"), place)


def zoned_time(text: Column) -> Column:
    """The instant of an ISO text with a time zone; null without one."""
    return F.when(text.rlike(r"T.*(?:Z|[+-]\d{2}:?\d{2})$"), text.try_cast("timestamp"))


def fresh(at: Column, now: Column, seconds: int) -> Column:
    return F.coalesce(F.abs(F.unix_seconds(at) - F.unix_seconds(now)) <= seconds, F.lit(False))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C, which Spark has no function for."""
    return text.map(lambda s: s if s is None else unicodedata.normalize("NFC", s))


def one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \t\n\r\f\x0b]+", " "))


def slot_names(text: Column, vocabulary: list[str]) -> Column:
    """The vocabulary's words in a text, the longest where several begin at one place, each once, by first appearance.

    Texts and vocabulary are cut into runs of letters and digits and runs of signs; from left to right, a match uses up its pieces."""
    piece, sep = r"(\w+|[^\w\s]+)", "\u0001"
    known = {sep.join(re.findall(piece, w)): w for w in vocabulary}
    longest = max((k.count(sep) + 1 for k in known), default=1)
    names = F.create_map(*(F.lit(x) for kv in known.items() for x in kv)) if known else F.lit(None).cast("map<string,string>")
    pieces = F.regexp_extract_all(text, F.lit(piece))
    run = lambda i, n: F.element_at(names, F.array_join(F.slice(pieces, i, F.lit(n)), sep))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1))), lambda i: i <= F.size(pieces))
    none = F.struct(F.lit(1).alias("free"), F.array().cast("array<string>").alias("names"))

    def step(state: Column, i: Column) -> Column:
        found = [(n, run(i, n)) for n in range(longest, 0, -1)]
        name = F.coalesce(*(x for _, x in found))
        size = F.coalesce(*(F.when(x.isNotNull(), F.lit(n)) for n, x in found))
        hit = (i >= state["free"]) & name.isNotNull()
        return F.struct(F.when(hit, i + size).otherwise(state["free"]).alias("free"), F.when(hit, F.concat(state["names"], F.array(name))).otherwise(state["names"]).alias("names"))

    return F.array_distinct(F.aggregate(at, none, step, lambda s: s["names"]))


def template(text: Column, names: Column) -> Column:
    """The text with {slot_i} for every occurrence of names[i]; longer names first, so that none is cut by a shorter one."""
    slots = F.array_sort(F.transform(names, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    whole = lambda w: F.concat(F.lit(r"(?<!\w)\Q"), w, F.lit(r"\E(?!\w)"))
    return F.aggregate(slots, text, lambda s, x: F.regexp_replace(s, whole(x["w"]), F.concat(F.lit("{slot_"), x["i"], F.lit("}"))))


def rendered(pattern: Column, names: Column) -> Column:
    """A template with its slots filled again."""
    filled = F.transform(names, lambda w, i: F.struct(F.concat(F.lit("{slot_"), i, F.lit("}")).alias("s"), w.alias("w")))
    return F.aggregate(filled, pattern, lambda s, x: F.replace(s, x["s"], x["w"]))
