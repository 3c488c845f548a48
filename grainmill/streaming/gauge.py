"""Rate gauge and burst watchdog over an event stream; the gauge also runs on a static table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_gauge(events: DataFrame, ts: str, kind: str, width: str, slide: str, late: str = "1 hour") -> DataFrame:
    """Events by sliding window [start, end) and kind. A stream keeps windows until the watermark, `late` behind the newest event, has passed."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", width, slide).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def trailing_gauge(events: DataFrame, ts: str, keys: list[str], seconds: int = 60) -> DataFrame:
    """events with n, how many of their keys' events lie in (t - seconds, t], themselves included, and that number a minute."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy("_at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("_at", at).withColumn("n", F.count("*").over(w)).withColumn("per_minute", F.col("n") * 60.0 / seconds).drop("_at")


def burst_watchdog(events: DataFrame, ts: str, key: str, within_s: int, least: int, clear_s: int, late: str = "1 hour") -> DataFrame:
    """Alarms (key, raised_at, n) of a stream: `least` events of a key within (t - within_s, t], and after that none again until the key
    has been quiet for clear_s seconds. Events wait until the watermark, `late` behind the newest event, has passed them, and are judged in
    order of time, whatever batch brought them; later ones are dropped. Times keep their microseconds."""
    within, clear = within_s * 1_000_000, clear_s * 1_000_000

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, recent, alarmed = state.get if state.exists else ([], [], False)
        waiting, recent, out = list(waiting), list(recent), []
        if not state.hasTimedOut:
            for frame in frames:
                waiting += [int(x) for x in frame["at"]]
        passed = state.getCurrentWatermarkMs() * 1000
        for t in sorted(x for x in waiting if x <= passed):
            alarmed = alarmed and not (recent and t - recent[-1] >= clear)
            recent = [x for x in recent if x > t - max(within, clear)] + [t]
            n = sum(x > t - within for x in recent)
            if n >= least and not alarmed:
                out.append((group[0], pd.Timestamp(t, unit="us"), n))
                alarmed = True
        waiting = [x for x in waiting if x > passed]
        state.update((waiting, recent, alarmed))
        if waiting:
            state.setTimeoutTimestamp(max(min(waiting) // 1000 + 1, passed // 1000 + 1))
        yield pd.DataFrame(out, columns=["key", "raised_at", "n"])

    timed = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("time")).withWatermark("time", late).withColumn("at", F.unix_micros("time"))
    kind = timed.schema["key"].dataType.simpleString()
    schema, kept = f"key {kind}, raised_at timestamp, n long", "waiting array<long>, recent array<long>, alarmed boolean"
    return timed.groupBy("key").applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)


def live_keys(beats: DataFrame, ts: str, key: str, timeout_s: int) -> DataFrame:
    """Keys whose last heartbeat is at most timeout_s behind the newest one of all."""
    newest = beats.agg(F.max(ts)).scalar()
    return beats.groupBy(key).agg(F.max(ts).alias("last_at")).where(F.col("last_at") >= newest - F.expr(f"interval {timeout_s} seconds"))


def stalls(events: DataFrame, ts: str, key: str, minutes: int, late: str = "1 hour") -> DataFrame:
    """Runs of a key's events that `minutes` without another one ended: first and last event, n. The same on a stream, once the watermark has passed."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.session_window("at", f"{minutes} minutes").alias("w"), key).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n")).drop("w")


def health_steps(total: int, floor: int, step: int, within_s: int, least: int, watch_s: int):
    """Transition of the worker target. Rows (t seconds, kind, wanted): a `refusal`; a `tick`, at which a fresh burst of refusals lowers the
    target to `floor` and raises the storm, and a clean watch ends it; a `ramp` to `wanted` workers, granted by one step at most, outside
    a storm, after the last watch and without a recent refusal. A window holds cutoff < t <= now."""

    def go(state: tuple | None, t: int, kind: str, wanted: int | None) -> tuple[tuple, str | None]:
        recent, now, storm, acted, gate = state or ([], total, False, None, 0)
        recent = [x for x in recent if x > t - within_s]
        if kind == "refusal":
            return ([*recent, t], now, storm, acted, gate), None
        if kind == "ramp":
            if storm or t < gate or recent or wanted is None or not now < wanted <= now + step:
                return (recent, now, storm, acted, gate), "refused"
            return (recent, wanted, storm, acted, t + watch_s), "ramped"
        if len(recent) >= least and (acted is None or recent[-1] > acted):
            return (recent, floor, True, recent[-1], t + watch_s), "downscaled"
        if storm and t >= gate and not recent:
            return (recent, now, False, acted, gate), "storm_cleared"
        return (recent, now, storm, acted, gate), "watching"

    return go


def health_gate(events: DataFrame, key: str, go) -> DataFrame:
    """events(key, t, kind, wanted) of a stream -> (key, t, action, total) for every tick and ramp; go as health_steps() returns it."""

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = None, []
        if state.exists:
            recent, total, storm, acted, gate = state.get
            now = (list(recent), total, storm, acted, gate)
        for f in sorted((r for f in frames for r in f.itertuples()), key=lambda r: (r.t, r.kind != "refusal")):
            now, action = go(now, int(f.t), f.kind, None if pd.isna(f.wanted) else int(f.wanted))
            if action:
                out.append((group[0], int(f.t), action, now[1]))
        state.update(now)
        yield pd.DataFrame(out, columns=["key", "t", "action", "total"])

    rows = events.select(F.col(key).alias("key"), F.col("t").cast("long").alias("t"), "kind", F.col("wanted").cast("long").alias("wanted"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, t long, action string, total long", "recent array<long>, total long, storm boolean, acted long, gate long", "append", GroupStateTimeout.NoTimeout)
