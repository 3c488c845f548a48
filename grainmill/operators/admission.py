"""Admission rules: shapes, words, caps, identities, error classes, boxes. Each gives a column: a flag, a class, or the first reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of fields that hold credentials, whole or as endings, and names of transport errors.
SECRET_NAMES = ["api_key", "apikey", "access_token", "token", "auth", "authorization", "password", "secret", "credential"]
SECRET_ENDS = ["_api_key", "_access_token", "_auth_token", "_authorization", "_password", "_secret", "_credential"]
TRANSPORT = [
    "ConnectionError", "ConnectionResetError", "ConnectionAbortedError", "ConnectionRefusedError", "BrokenPipeError", "TimeoutError", "TimeoutException", "Timeout",
    "ConnectTimeout", "ReadTimeout", "WriteTimeout", "PoolTimeout", "ConnectError", "ReadError", "WriteError", "NetworkError", "RemoteProtocolError", "gaierror",
]
TRANSIENT_WORDS = [
    "rate limit", "too many requests", "resource_exhausted", "resource exhausted", "connection error", "connection reset", "connection aborted", "connection refused",
    "all connection attempts failed", "server disconnected", "timed out", "overloaded", "service unavailable", "internal server error", "bad gateway", "gateway timeout",
]


def reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that do not hold, in order; a null check does not hold."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items())))


def first_reason(checks: dict[str, Column]) -> Column:
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()))


def sampled_on_time(index: Column, at: Column, fps: Column, slack: float = 1e-6) -> Column:
    """Whether indices rise strictly and every time is its index by the frame rate, within slack."""
    rising = (F.size(index) < 2) | F.forall(F.sequence(F.lit(1), F.greatest(F.size(index) - 1, F.lit(1))), lambda i: F.get(index, i) > F.get(index, i - 1))
    on_time = F.forall(F.zip_with(index, at, lambda i, x: F.abs(x - i / fps) <= slack), lambda ok: F.coalesce(ok, F.lit(False)))
    return (F.size(index) == F.size(at)) & rising & on_time


def has_word(text: Column, words: list[str]) -> Column:
    """Whether a text has one of the words, whole and in any case."""
    return F.lower(text).rlike(r"(?:^|\W)(?:" + "|".join(r"\Q" + w.lower() + r"\E" for w in words) + r")(?:\W|$)")


def safe_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$") & ~value.isin(".", ".."), F.lit(False))


def safe_path(value: Column) -> Column:
    """Relative, every part a safe id."""
    return F.coalesce(F.forall(F.split(value, "/"), safe_id), F.lit(False))


def secret_name(name: Column) -> Column:
    """Whether a field of that name holds a credential; counts of tokens do not."""
    plain = F.replace(F.lower(name), F.lit("-"), F.lit("_"))
    return plain.isin(SECRET_NAMES) | plain.rlike("(" + "|".join(SECRET_ENDS) + ")$")


def redacted(fields: Column) -> Column:
    """A map with the values of credential fields and bearer tokens within all others taken out."""
    return F.transform_values(fields, lambda k, v: F.when(secret_name(k), "[REDACTED]").otherwise(without_bearer(v)))


def without_bearer(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]")


def http_class(code: Column, kind: Column) -> Column:
    """throttled (429), server (500 to 599), refused (other 400 to 499), transport (by the error's name), else null. A code decides before a name."""
    return (
        F.when(code == 429, "throttled")
        .when(code.between(500, 599), "server")
        .when(code.between(400, 499), "refused")
        .when(code.isNull() & (kind == "ServerError"), "server")
        .when(code.isNull() & kind.isin(TRANSPORT), "transport")
    )


def true_429(code: Column, status: Column) -> Column:
    """A typed status decides; only without one does the provider's own word count."""
    return F.coalesce(F.when(code.isNotNull(), code == 429).otherwise(status == "RESOURCE_EXHAUSTED"), F.lit(False))


def error_bucket(text: Column, permanent: list[str]) -> Column:
    """permanent, transient or unknown. Signatures of permanent errors and codes 4xx other than 429 win over all others."""
    low = F.lower(text)
    code = lambda c: low.rlike(rf"(?:error code|\bstatus|\bhttp)[:\s]+{c}\b")
    lasting = code(r"4(?!29)\d\d") | low.rlike(r"^\s*4(?!29)\d\d\s*$") | F.lit(False)
    for word in permanent:
        lasting = lasting | F.contains(low, F.lit(word))
    passing = code(r"5\d\d") | low.rlike(r"\b(?:429|529)\b")
    for word in TRANSIENT_WORDS:
        passing = passing | F.contains(low, F.lit(word))
    return F.when(lasting, "permanent").when(passing, "transient").otherwise("unknown")


def grounding_flags(area: Column, edges: Column, score: Column, points: Column, x: Column, y: Column, z: Column, floor: Column) -> Column:
    """What makes a grounded region doubtful; measures that are null say nothing."""
    return F.array_compact(
        F.array(
            F.when(area > 0.30, "area_large").when(area < 0.01, "area_small"),
            F.when(edges >= 2, "edges"),
            F.when(score < 0.70, "score"),
            F.when(points < 2000, "points"),
            F.when(z < floor - 0.15, "below_floor"),
            F.when((F.abs(x) < 0.10) & (F.abs(y) < 0.10), "near_origin"),
        )
    )


def sound_boxes(boxes: Column) -> Column:
    """boxes(x0, y0, x1, y1) in shares of the picture without the tiny ones and slivers at an edge."""
    def sound(b: Column) -> Column:
        w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
        sliver = ((w < 0.08) & ((b["x0"] <= 0.02) | (b["x1"] >= 0.98))) | ((h < 0.08) & ((b["y0"] <= 0.02) | (b["y1"] >= 0.98)))
        return (w * h >= 0.006) & ~sliver

    return F.filter(boxes, sound)


def cap_recorded(finishes: Column, flag: Column) -> Column:
    """Whether the flag says what the calls' finish reasons say: that one of them ran into the output limit."""
    plain = F.transform(finishes, lambda x: F.regexp_replace(F.lower(x), "[^a-z]+", ""))
    return F.exists(plain, lambda x: x.isin("maxtokens", "length")) == flag
