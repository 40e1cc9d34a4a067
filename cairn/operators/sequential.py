"""Operators whose decision on a row depends on the rows kept before it.

They run as a scan: rows are brought together by key, sorted on disk where need be, and passed through a
small state one after the other, over the batches of a partition. Memory is bounded by the state however
long a key's rows are; keys are stretches of a trip between pauses, where the state starts anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import asin, cos, radians, sin, sqrt

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def metres(lon1: float, lat1: float, lon2: float, lat2: float, radius: float = 6371000.0) -> float:
    a, b = radians(lat1), radians(lat2)
    h = sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * asin(min(1.0, sqrt(h)))


def scan(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Callable], schema: str, keep: list[str]) -> DataFrame:
    """rows with what a state says of each, in order within its key.

    start() gives a fresh function of one row (a named tuple) that returns the values of schema beyond the
    columns keep, which are passed on. Rows with a null key form a key of their own.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", " + schema
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = object(), None
        for batch in batches:
            out = []
            for row, key in zip(batch.itertuples(index=False), zip(*[batch[k].astype(object).where(batch[k].notna(), None) for k in keys])):
                if key != current:
                    current, step = key, start()
                out.append(step(row))
            yield pd.concat([batch[keep].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, fields)


def _number(x) -> bool:
    return x is not None and x == x


def fix_gate(max_ms: float = 70.0, max_rejections: int = 3, always_m: float = 15.0) -> Callable[[], Callable]:
    """Verdict on a fix against the last accepted one: far too fast ones are rejected, but not more than a few in a row."""
    def start():
        last, rejected = None, 0

        def step(row):
            nonlocal last, rejected
            if last is None:
                last = row
                return ("first",)
            d, dt = metres(last.lon, last.lat, row.lon, row.lat), (row.t - last.t) / 1000.0
            if d <= always_m or (d / dt if dt > 0.001 else 0.0) <= max_ms:
                last, rejected = row, 0
                return ("accepted",)
            rejected += 1
            if rejected > max_rejections:
                last, rejected = row, 0
                return ("accepted_after_run",)
            return ("rejected",)

        return step

    return start


def kinematic_screen(max_ms: float = 200 / 3.6) -> Callable[[], Callable]:
    """Whether a point is kept against the last kept one, and its speed, derived where it has none."""
    def start():
        last = None

        def step(row):
            nonlocal last
            speed = row.speed if _number(row.speed) else None
            if last is not None:
                d, dt = metres(last.lon, last.lat, row.lon, row.lat), (row.t - last.t) / 1000.0
                if (dt > 0 and d / dt > max_ms) or (dt <= 0 and d > 0):
                    return (False, None)
                if speed is None and dt > 0:
                    speed = round(d / dt, 2)
            last = row
            return (True, speed)

        return step

    return start


def probe_buffer(spacing_m: float = 8.0, accuracy_m: float = 50.0, batch: int = 30, age_ms: int = 30_000) -> Callable[[], Callable]:
    """Whether a probe is taken (far enough from the last taken, sharp enough, later) and the number of the batch it goes out with."""
    def start():
        last, count, began, number = None, 0, 0, 0

        def step(row):
            nonlocal last, count, began, number
            blurred = _number(row.accuracy) and row.accuracy > accuracy_m
            if blurred or (last is not None and (row.t <= last.t or metres(last.lon, last.lat, row.lon, row.lat) < spacing_m)):
                return (False, None)
            if count == 0:
                began = row.t
            last, count, mine = row, count + 1, number
            if count >= batch or row.t - began >= age_ms:
                count, number = 0, number + 1
            return (True, mine)

        return step

    return start


def speed_alert(tolerance: float = 5.0, rearm: float = 2.0, repeat_ms: int = 60_000) -> Callable[[], Callable]:
    """Whether an alert sounds: once on going over the limit, again after a while, and anew after slowing down or a new limit."""
    def start():
        armed, fired, limit = True, None, None

        def step(row):
            nonlocal armed, fired, limit
            if row.limit_kmh != limit:
                armed, fired, limit = True, None, row.limit_kmh
            if not _number(row.limit_kmh) or not _number(row.speed_kmh):
                return (False,)
            if row.speed_kmh <= row.limit_kmh + tolerance:
                armed = armed or row.speed_kmh <= row.limit_kmh - rearm
                return (False,)
            if not armed and not (fired is not None and row.t - fired >= repeat_ms):
                return (False,)
            armed, fired = False, row.t
            return (True,)

        return step

    return start


def greedy_collapse(within_m: float = 250.0) -> Callable[[], Callable]:
    """Whether a row is kept: not if a row of its key kept before lies within reach. Kept rows are looked up by cells."""
    side = within_m / 111_000.0

    def start():
        kept: dict[tuple[int, int], list[tuple[float, float]]] = {}

        def step(row):
            wide = side / max(0.01, cos(radians(row.lat)))
            y = int(row.lat // side)
            reach = range(int((row.lon - wide) // side), int((row.lon + wide) // side) + 1)
            if any(metres(a, b, row.lon, row.lat) <= within_m for i in reach for j in (y - 1, y, y + 1) for a, b in kept.get((i, j), ())):
                return (False,)
            kept.setdefault((int(row.lon // side), y), []).append((row.lon, row.lat))
            return (True,)

        return step

    return start


def chained_collapse(within_m: float = 250.0) -> Callable[[], Callable]:
    """Whether a row is kept: not if any row of its key before, kept or not, lies within reach."""
    side = within_m / 111_000.0

    def start():
        seen: dict[tuple[int, int], list[tuple[float, float]]] = {}

        def step(row):
            wide = side / max(0.01, cos(radians(row.lat)))
            y = int(row.lat // side)
            reach = range(int((row.lon - wide) // side), int((row.lon + wide) // side) + 1)
            near = any(metres(a, b, row.lon, row.lat) <= within_m for i in reach for j in (y - 1, y, y + 1) for a, b in seen.get((i, j), ()))
            seen.setdefault((int(row.lon // side), y), []).append((row.lon, row.lat))
            return (not near,)

        return step

    return start


def spaced(least_m: float = 15.0) -> Callable[[], Callable]:
    """Whether an event along a line is kept: at least so far after the last one kept."""
    def start():
        last = None

        def step(row):
            nonlocal last
            if last is not None and row.cum - last < least_m:
                return (False,)
            last = row.cum
            return (True,)

        return step

    return start


def _foot(feet, around: float | None = None, back: float = 0.0, ahead: float = 0.0):
    """(along, offset) of the nearest foot, of those from back behind to ahead of a place if one is given; the least along of equal ones."""
    some = [(f["offset"], f["along"]) for f in feet if around is None or around - back <= f["along"] <= around + ahead]
    return (min(some)[1], min(some)[0]) if some else None


def route_tracker(off_m: float = 60.0, snap_m: float = 40.0, gain: float = 0.25, back_m: float = 40.0, ahead_m: float = 120.0, reckon_s: float = 3.0) -> Callable[[], Callable]:
    """State and place along its route after each fix (t, speed, feet).

    Between fixes the place is dead reckoned by the last speed, for reckon_s at most; without a fix for
    longer the lock is lost. A locked fix is looked up around the place, if that is too far off anywhere; it
    corrects the place by gain.
    """
    def start():
        place, locked, speed, last = 0.0, False, 0.0, None

        def step(row):
            nonlocal place, locked, speed, last
            if last is not None:
                since = (row.t - last) / 1000.0
                if since > reckon_s:
                    locked = False
                elif locked:
                    place += speed * since
            foot = _foot(row.feet, place, back_m, ahead_m) if locked else _foot(row.feet)
            if locked and (foot is None or foot[1] > off_m):
                anywhere = _foot(row.feet)
                foot = anywhere if anywhere is not None and (foot is None or anywhere[1] <= snap_m) else foot
            last = row.t
            if _number(row.speed) and row.speed >= 0:
                speed = row.speed
            if foot is None or foot[1] > off_m:
                locked = False
                return ("off_route", None)
            if foot[1] <= snap_m:
                place = place + (foot[0] - place) * gain if locked else foot[0]
                locked = True
            elif not locked:
                return ("off_route", None)
            return ("on_route", round(place, 2))

        return step

    return start


def walk_follower(on_m: float = 25.0, off_m: float = 45.0, persist_ms: int = 6_000, back_m: float = 20.0, ahead_m: float = 40.0, pace: float = 1.35, slack: float = 1.5, cap_m: float = 60.0) -> Callable[[], Callable]:
    """State and place along its way after each fix (t, accuracy, feet): on the way, uncertain, or off it once outside for persist_ms.

    Unsharp fixes widen both limits, up to cap_m. The place goes forward with the fixes, and back no faster
    than a walk with some slack.
    """
    def start():
        place, locked, outside, last = 0.0, False, None, None

        def step(row):
            nonlocal place, locked, outside, last
            foot = _foot(row.feet, place, back_m, ahead_m) if locked else _foot(row.feet)
            if foot is None:
                foot = _foot(row.feet) or (0.0, float("inf"))
            wide = min(row.accuracy * slack, cap_m) if _number(row.accuracy) and row.accuracy > 0 else 0.0
            near, far = max(on_m, wide), max(off_m, wide + (off_m - on_m))
            if foot[1] >= far:
                outside = row.t if outside is None else outside
            else:
                outside = None
            if foot[1] <= near:
                since = (row.t - last) / 1000.0 if last is not None and row.t > last else 1.0
                place = foot[0] if not locked or foot[0] >= place else max(foot[0], place - pace * since * slack)
                locked = True
            last = row.t
            state = "on_route" if foot[1] <= near else "off_route" if outside is not None and row.t - outside >= persist_ms else "uncertain"
            locked = locked and state != "off_route"
            return (state, round(place, 2) if locked else None)

        return step

    return start


def same_lights(merge_m: float = 10.0) -> Callable[[], Callable]:
    """Whether a signal (along, lon, lat) is kept: not if it stands within reach of the last one kept, along the line and in place."""
    def start():
        last = None

        def step(row):
            nonlocal last
            if last is not None and row.along <= last.along + merge_m and metres(row.lon, row.lat, last.lon, last.lat) <= merge_m:
                return (False,)
            last = row
            return (True,)

        return step

    return start


def stretches(fixes: DataFrame, gap_ms: int = 300_000) -> DataFrame:
    """fixes (trip, t, id) with part, the stretch of the trip between pauses longer than gap_ms.

    Pauses are found in hours of a trip and numbered over the hours, so that no window spans a whole trip.
    """
    from pyspark.sql import Window as W

    f = fixes.withColumn("_hour", F.floor(F.col("t") / 3_600_000))
    ends = f.groupBy("trip", "_hour").agg(F.max("t").alias("_last"))
    trip = W.partitionBy("trip").orderBy("_hour")
    f = f.join(ends.select("trip", "_hour", F.lag("_last").over(trip).alias("_before")), ["trip", "_hour"])
    w = W.partitionBy("trip", "_hour").orderBy("t", "id")
    f = f.withColumn("_new", F.coalesce(F.col("t") - F.coalesce(F.lag("t").over(w), F.col("_before")) > gap_ms, F.lit(False)).cast("long"))
    f = f.withColumn("_local", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    hours = f.groupBy("trip", "_hour").agg(F.sum("_new").alias("_n"))
    hours = hours.select("trip", "_hour", (F.sum("_n").over(trip.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_offset"))
    return f.join(hours, ["trip", "_hour"]).withColumn("part", F.col("_offset") + F.col("_local")).drop("_hour", "_before", "_new", "_local", "_offset")
