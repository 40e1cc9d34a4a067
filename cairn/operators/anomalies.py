"""Implausible readings of moving receivers: impossible values, momentary spikes and frozen stretches.

How far each reading lies from its neighbours is summarised by quantile sketches per trip and hour, built
in every task, merged over partitions, to the hour of the day and to the trip. A reading whose distance lies
outside the expanded interquartile fences of its hour is a spike, unless the neighbouring readings or the
distances driven between fixes bear it out. Runs of one value are flagged where the trip moves on while the
reading does not and the receiver varies otherwise.

Fixes sent again are merged before anything else, so a stretch of time holds no more rows than it can have
fixes. All row-level steps then run after one shuffle keyed by (trip, stretch of time) with an overlap, never
by the trip alone: one trip, or one fix, may hold a third of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cairn.functions.geo import haversine
from cairn.storage import materialize


@dataclass(frozen=True)
class Limits:
    chunk_ms: int = 21_600_000  # stretch of time whose rows stay together
    gap_ms: int = 300_000  # fixes further apart are no neighbours
    speed_max: float = 80.0  # m/s, beyond any traveller on the ground
    accuracy_max: float = 5000.0  # m, beyond any usable fix
    sketch_size: int = 800  # k of the sketches: quantiles of up to so many readings are exact, of more within 0.4 % of the ranks
    fence: float = 3.0  # widths of the interquartile range
    least_width: tuple[float, float] = (0.15, 0.05)  # of speed in m/s, of accuracy as a logarithm: steps of receivers
    least_in_hour: int = 20  # readings from which an hour has fences of its own
    speed_slack: tuple[float, float] = (0.85, 0.16)  # m/s, share of what neighbours bear out
    speed_drop: tuple[float, float] = (0.6, 0.5)  # the same downwards
    speed_borne: float = 0.65  # share of the neighbours' speed that the distances must show for a drop to be false
    accuracy_up: float = 2.5  # times what neighbours show
    accuracy_down: float = 0.35
    frozen_rows: int = 8  # readings of one value
    frozen_move_m: float = 25.0
    varied_rows: int = 5  # readings outside long runs that show that the receiver varies
    varied_share: float = 0.1


def impossible(field: Column, value: Column, limits: Limits = Limits()) -> Column:
    return F.isnan(value) | F.when(field == "speed", (value < 0) | (value > limits.speed_max)).otherwise((value <= 0) | (value > limits.accuracy_max))


_FIX = ["trip_pseudonym", "t", "lng", "lat", "speed", "accuracy"]
_FIELDS = ("speed", "accuracy")
_HOUR = 3_600_000


_OVER = "over (partition by trip_pseudonym, chunk order by t, lng, lat, speed, accuracy)"


def _shift(column: str, k: int) -> Column:
    return F.expr(f"{'lag' if k < 0 else 'lead'}({column}, {abs(k)}) ignore nulls {_OVER}")


def _stretches(fixes: DataFrame, limits: Limits) -> DataFrame:
    """Distinct fixes brought together by (trip, chunk), each also in the chunk it is near to."""
    halo = 2 * limits.gap_ms
    chunk_of = lambda t: F.floor(t / limits.chunk_ms)
    t = F.col("t")
    rows = fixes.withColumn("chunk", F.explode(F.array_distinct(F.array(chunk_of(t), chunk_of(t - halo), chunk_of(t + halo)))))
    rows = rows.repartition("trip_pseudonym", "chunk")  # the windows' own shuffle, before columns are derived
    columns = {"own": F.col("chunk") == chunk_of(t), "place": F.when(F.col("lng").isNotNull() & F.col("lat").isNotNull(), F.struct("t", "lng", "lat"))}
    for f in _FIELDS:
        bad = F.coalesce(impossible(F.lit(f), F.col(f), limits), F.lit(False))
        columns[f"{f}_bad"] = bad
        columns[f"{f}_ok"] = F.when(F.col(f).isNotNull() & ~bad, F.struct("t", F.col(f).cast("double").alias("v")))
    return rows.withColumns(columns)


def _spikes(rows: DataFrame, limits: Limits) -> DataFrame:
    """rows with, per field, off: the distance from what is usual around, and spike: whether nothing around bears it out."""
    rows = rows.withColumns({"before": _shift("place", -1), "after": _shift("place", 1), **{f"{f}{k}": _shift(f"{f}_ok", k) for f in _FIELDS for k in (-2, -1, 1, 2)}})

    def metres(a: str, b: str) -> Column:
        return F.when(F.col(f"{b}.t") - F.col(f"{a}.t") <= limits.gap_ms, haversine(F.col(f"{a}.lng"), F.col(f"{a}.lat"), F.col(f"{b}.lng"), F.col(f"{b}.lat")))

    rows = rows.withColumns({"d_in": metres("before", "place"), "d_out": metres("place", "after"), "chord": metres("before", "after")})
    apart = F.col("place.t") - F.col("before.t")
    whole = W.partitionBy("trip_pseudonym", "chunk")
    rows = rows.withColumn("step_s", F.percentile_approx(F.when((apart > 0) & (apart <= limits.gap_ms), apart), 0.5, 200).over(whole) / 1000.0)
    for f in _FIELDS:
        rows = rows.withColumn("around", F.array_sort(F.array_compact(F.array(*[F.when(F.abs(F.col(f"{f}{k}.t") - F.col("t")) <= limits.gap_ms, F.col(f"{f}{k}.v")) for k in (-2, -1, 1, 2)])))).withColumn("many", F.size("around"))
        value = F.col(f"{f}_ok.v")
        # one of the neighbours may be false itself: the second from either end counts
        high = F.expr("case when many >= 3 then around[many - 2] when many > 0 then around[many - 1] end")
        low = F.expr("case when many >= 3 then around[1] when many > 0 then around[0] end")
        usual = F.expr("case when many = 0 then null when many % 2 = 1 then around[many div 2] else (around[many div 2 - 1] + around[many div 2]) / 2 end")
        if f == "speed":
            driven = [F.when((F.col("step_s") > 0) & (F.col(c) / F.col("step_s") / k <= limits.speed_max), F.col(c) / F.col("step_s") / k) for c, k in (("d_in", 1), ("d_out", 1), ("chord", 2))]
            rows = rows.withColumns({"top": F.greatest(high, driven[0], driven[1]), "bottom": F.least(low, *driven), "usual": usual})
            slack, drop = limits.speed_slack, limits.speed_drop
            up = value - F.col("top") > slack[0] + slack[1] * F.col("top")
            down = (F.col("bottom") - value > F.greatest(F.lit(drop[0]), drop[1] * F.col("bottom"))) & (F.col("bottom") > limits.speed_borne * F.col("usual"))
            off = value - F.col("usual")
        else:
            rows = rows.withColumns({"top": high, "bottom": low, "usual": usual})
            up, down = value > limits.accuracy_up * F.col("top"), value < limits.accuracy_down * F.col("bottom")
            off = F.log(value / F.col("usual"))
        rows = rows.withColumns({f"{f}_off": off.cast("float"), f"{f}_spike": F.coalesce(up | down, F.lit(False))})
    return rows.drop("around", "many", "top", "bottom", "usual", "before", "after", "d_in", "d_out", "chord", *[f"{f}{k}" for f in _FIELDS for k in (-2, -1, 1, 2)])


def _runs(rows: DataFrame, limits: Limits) -> DataFrame:
    """Own rows with, per field, the run of one value they are in: its start, its length and whether it goes on beyond the chunk."""
    rows = rows.withColumns({f"{f}_quiet": F.when(~F.col(f"{f}_spike"), F.col(f"{f}_ok")) for f in _FIELDS})
    rows = rows.withColumns({f"{f}_prior": _shift(f"{f}_quiet", -1) for f in _FIELDS})
    rows = rows.where("own")
    goes_on = {f: F.coalesce((F.col(f"{f}_prior.v") == F.col(f"{f}_quiet.v")) & (F.col("t") - F.col(f"{f}_prior.t") <= limits.gap_ms), F.lit(False)) for f in _FIELDS}
    w = W.partitionBy("trip_pseudonym", "chunk").orderBy("t", "lng", "lat", "speed", "accuracy")
    so_far, whole = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("trip_pseudonym", "chunk")
    rows = rows.withColumns({f"{f}_at": F.count(f"{f}_quiet").over(so_far) for f in _FIELDS} | {f"{f}_joins": goes_on[f] for f in _FIELDS})
    starts = {f: F.when(F.col(f"{f}_quiet").isNotNull() & (~F.col(f"{f}_joins") | (F.col(f"{f}_at") == 1)), F.struct(F.col(f"{f}_at").alias("at"), F.col(f"{f}_joins").alias("joins"))) for f in _FIELDS}
    rows = rows.withColumns({f"{f}_start": starts[f] for f in _FIELDS})
    return rows.withColumns(
        {f"{f}_run": F.last(f"{f}_start", True).over(so_far) for f in _FIELDS}
        | {f"{f}_next": _shift(f"{f}_start", 1) for f in _FIELDS}
        | {f"{f}_count": F.count(f"{f}_quiet").over(whole) for f in _FIELDS}
    )


def _measured(rows: DataFrame, limits: Limits) -> DataFrame:
    """One row per fix: trip, hour and distances; the rest of the fix only with readings that are impossible, may be a spike, or are in a long run or one at the edge of the chunk."""
    fields = []
    for f in _FIELDS:
        ends = F.coalesce(F.col(f"{f}_next.at"), F.col(f"{f}_count") + 1)
        size, run = ends - F.col(f"{f}_run.at"), F.col(f"{f}_run.at")
        edge = (run == 1) | (ends > F.col(f"{f}_count"))
        state = F.when(F.col(f).isNull(), None).when(F.col(f"{f}_bad"), "impossible").when(F.col(f"{f}_spike"), "spike").when((size >= limits.frozen_rows) | edge, "run")
        fields.append(F.struct(F.lit(f).alias("field"), state.alias("state"), run.alias("run"), edge.alias("edge"), F.col(f"{f}_run.joins").alias("joins")))
    found = F.filter(F.array(*fields), lambda r: r["state"].isNotNull())
    kept = F.when(F.size(found) > 0, F.struct("id", "copies", *_FIX[1:], "chunk", found.alias("readings")))
    offs = [F.when(F.col(f"{f}_ok").isNotNull(), F.col(f"{f}_off")).alias(f"{f}_off") for f in _FIELDS]
    return rows.select("trip_pseudonym", F.floor(F.col("t") / _HOUR).alias("hour"), *offs, *[F.col(f"{f}_ok").isNotNull().alias(f"{f}_some") for f in _FIELDS], kept.alias("fix"))


def _fences(measured: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """((trip, field, hour, low, high), (trip, field, all)): fences of each hour and the number of readings of each trip."""
    sketch = lambda f: F.kll_sketch_agg_double(F.when(~F.isnan(f"{f}_off") & (F.abs(f"{f}_off") < 1e9), F.col(f"{f}_off").cast("double")), F.lit(limits.sketch_size))
    hours = measured.groupBy("trip_pseudonym", "hour").agg(*[sketch(f).alias(f) for f in _FIELDS], *[F.sum(F.col(f"{f}_some").cast("long")).alias(f"{f}_n") for f in _FIELDS])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("sketch"), F.col(f"{f}_n").alias("n"), F.lit(limits.least_width[k]).alias("least")) for k, f in enumerate(_FIELDS)]))
    hours = materialize(hours.select("trip_pseudonym", "hour", F.pmod("hour", F.lit(24)).alias("of_day"), each.alias("e")).select("trip_pseudonym", "hour", "of_day", "e.*"), "sketches")
    keys, n = ["trip_pseudonym", "field"], F.kll_sketch_get_n_double
    daily = hours.groupBy(*keys, "of_day").agg(F.kll_merge_agg_double("sketch").alias("daily"))
    trips = hours.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("whole"), F.sum("n").alias("all"))
    used = F.when(n("daily") >= limits.least_in_hour, F.col("daily")).when(n("whole") > 0, F.col("whole"))
    q = [F.when(used.isNotNull(), F.kll_sketch_get_quantile_double(used, F.lit(p))) for p in (0.25, 0.75)]
    out = hours.join(daily, [*keys, "of_day"]).join(trips, keys).withColumns({"q1": q[0], "q3": q[1]})
    width = limits.fence * F.greatest(F.col("q3") - F.col("q1"), F.col("least"))
    return out.select(*keys, "hour", (F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high")), trips.select(*keys, "all")


def _frozen(readings: DataFrame, spikes: DataFrame, counts: DataFrame, limits: Limits) -> DataFrame:
    """The readings in runs that belong to a frozen stretch."""
    keys = ["trip_pseudonym", "field"]
    in_runs = readings.where("state = 'run'")
    parts = in_runs.groupBy(*keys, "chunk", "run", "edge").agg(
        F.count("*").alias("rows"), F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lng").alias("w"), F.max("lng").alias("e"), F.max((~F.col("joins")).cast("long")).alias("opens")
    )
    # only a run at the edge of its stretch of time can go on in the next: at most two parts for each (trip, chunk), however many rows a trip has
    chain = W.partitionBy(*keys).orderBy("chunk", "run").rowsBetween(W.unboundedPreceding, 0)
    at_edge = parts.where("edge").withColumn("whole", F.concat(F.lit("edge "), F.sum("opens").over(chain).cast("string")))
    parts = at_edge.unionByName(parts.where("not edge").withColumn("whole", F.concat_ws(" ", "chunk", "run")))
    runs = parts.groupBy(*keys, "whole").agg(F.sum("rows").alias("rows"), F.min("s").alias("s"), F.max("n").alias("n"), F.min("w").alias("w"), F.max("e").alias("e"))
    long = F.col("rows") >= limits.frozen_rows
    held = runs.groupBy(*keys).agg(F.sum(F.when(long, F.col("rows")).otherwise(0)).alias("held"))
    hits = spikes.groupBy(*keys).agg(F.count("*").alias("hits"))
    trips = counts.join(held, keys).join(hits, keys, "left").withColumn("varied", F.col("all") - F.col("held") - F.coalesce("hits", F.lit(0)))
    varies = trips.where((F.col("varied") >= limits.varied_rows) & (F.col("varied") >= limits.varied_share * F.col("all"))).select(*keys)
    moved = haversine("w", "s", "e", "n") > limits.frozen_move_m
    stuck = parts.join(runs.where(long & moved).join(varies, keys, "left_semi").select(*keys, "whole"), [*keys, "whole"], "left_semi")
    return in_runs.join(stuck.select(*keys, "chunk", "run"), [*keys, "chunk", "run"], "left_semi")


def implausible_readings(observations: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(id, field, reason) of the speed and accuracy readings that cannot be true, reason being impossible, spike or frozen.

    Null readings are never flagged; NaN and infinite ones are impossible. Rows without id, trip or time
    are left out. Fixes sent again (trip, time, place and readings all alike) are judged once and every
    copy is flagged by its own id; the order of rows does not matter. An empty table gives no rows.
    Positions that jump are no evidence. Columns other than those used are ignored.
    """
    rows = observations.select("id", *_FIX).where("t is not null and id is not null and trip_pseudonym is not null")
    fixes = rows.groupBy(*_FIX).agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    measured = materialize(_measured(_runs(_spikes(_stretches(fixes, limits), limits), limits), limits), "measured")
    fences, counts = _fences(measured, limits)
    off = F.when(F.col("r.field") == "speed", F.col("speed_off")).otherwise(F.col("accuracy_off"))
    flat = measured.where("fix is not null").select("trip_pseudonym", "hour", "speed_off", "accuracy_off", "fix.*")
    readings = flat.withColumn("r", F.explode("readings")).select("trip_pseudonym", "hour", "id", "copies", *_FIX[1:], "chunk", off.cast("double").alias("off"), "r.*")
    spikes = readings.where("state = 'spike'").join(fences, ["trip_pseudonym", "field", "hour"]).where((F.col("off") < F.col("low")) | (F.col("off") > F.col("high")))
    spikes = materialize(spikes.select(*readings.columns), "spikes")
    flagged = readings.where("state = 'impossible'").unionByName(spikes).unionByName(_frozen(readings, spikes, counts, limits).select(*readings.columns).withColumn("state", F.lit("frozen")))
    flagged = materialize(flagged.select("id", "copies", *_FIX, "field", F.col("state").alias("reason")), "flagged")
    # copies find their fix by time and a hash of all of it
    print_of = [F.col("t"), F.xxhash64(*_FIX).alias("fix")]
    sent_again = flagged.where("copies > 1").select(*print_of, "field", "reason")
    copies = rows.select(*print_of, "id").join(sent_again, ["t", "fix"]).select("id", "field", "reason")
    return flagged.where("copies = 1").select("id", "field", "reason").unionByName(copies).distinct()
