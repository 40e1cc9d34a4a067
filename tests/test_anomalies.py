"""Implausible readings on trips with known faults."""

import math
import random

from pyspark.sql import functions as F

from cairn.operators.anomalies import Limits, implausible_readings

SCHEMA = "id long, trip_pseudonym string, t long, lng double, lat double, speed double, accuracy double"


def trip(name, n, speed=10.0, step_s=5, start=1_736_000_000_000, first_id=0, noise=0.3, seed=1):
    rng, lat, rows = random.Random(seed), 25.0, []
    for k in range(n):
        v = max(0.0, speed + 2 * math.sin(k / 20) + rng.uniform(-noise, noise))
        lat += v * step_s / 111195
        rows.append([first_id + k, name, start + k * step_s * 1000, 51.2, lat, round(v, 2), round(8 + math.sin(k / 9) + rng.uniform(-0.5, 0.5), 1)])
    return rows


def flags(spark, rows, limits=Limits(), extra=False):
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    if extra:
        df = df.withColumn("chunk", F.lit("x")).withColumn("field", F.lit(1))
    return {(r["id"], r["field"], r["reason"]) for r in implausible_readings(df, limits).collect()}


def test_clean_trip_and_empty_table(spark):
    assert flags(spark, trip("a", 400)) == set()
    assert flags(spark, []) == set()


def test_spikes_impossible_and_nulls(spark):
    rows = trip("a", 300)
    rows[50][5], rows[80][5], rows[120][5], rows[150][6], rows[200][6], rows[210][5], rows[220][6] = 45.0, -3.6, 0.0, 300.0, 0.0, None, None
    assert flags(spark, rows, extra=True) == {(50, "speed", "spike"), (80, "speed", "impossible"), (120, "speed", "spike"), (150, "accuracy", "spike"), (200, "accuracy", "impossible")}


def test_halt_is_normal_and_order_does_not_matter(spark):
    rows = trip("a", 200)
    for k in range(90, 110):  # standing still: place and speed agree
        rows[k][4], rows[k][5] = rows[90][4] + (k % 3) * 1e-5, 0.0
    for k in range(110, 200):
        rows[k][4] -= rows[110][4] - rows[90][4] - 60 / 111195
    random.Random(3).shuffle(rows)
    assert not {f for f in flags(spark, rows) if f[2] != "spike"}
    assert len(flags(spark, rows)) <= 2  # the made-up edges of the halt


def test_frozen_stretch_and_constant_receiver(spark):
    rows = trip("a", 300)
    for k in range(100, 130):
        rows[k][5] = rows[100][5]
    constant = trip("b", 300, first_id=1000)
    for r in constant:
        r[6] = 11.0
    found = flags(spark, rows + constant)
    assert {f for f in found if f[2] == "frozen"} == {(k, "speed", "frozen") for k in range(100, 130)}


def test_frozen_over_the_edge_of_a_chunk(spark):
    start = 1_736_000_000_000 // 21_600_000 * 21_600_000 + 21_600_000 - 60_000
    rows = trip("a", 300, start=start)
    for k in range(5, 30):
        rows[k][6] = 7.7
    assert {f for f in flags(spark, rows) if f[1] == "accuracy"} == {(k, "accuracy", "frozen") for k in range(5, 30)}


def test_copies_count_by_their_own_id_light_and_heavy(spark):
    rows = trip("a", 300)
    rows[50][5] = 60.0
    copies = [[5000 + k, *rows[50][1:]] for k in range(40)]
    want = {(50, "speed", "spike")} | {(5000 + k, "speed", "spike") for k in range(40)}
    assert flags(spark, rows + copies) == want
    assert flags(spark, [r for r in rows + copies for _ in range(2)]) == want


def test_the_fences_of_the_trip_decide_over_spikes(spark):
    quiet, rough = trip("a", 300, noise=0.1), trip("b", 300, noise=3.0, first_id=1000, seed=5)
    for rows in (quiet, rough):
        rows[150][5] += 5.5
    found = {f for f in flags(spark, quiet + rough) if f[1] == "speed"}
    assert (150, "speed", "spike") in found and (1150, "speed", "spike") not in found  # normal for the one, not for the other
    assert flags(spark, quiet + rough, Limits(fence=0.0, least_width=(0.0, 0.0))) > flags(spark, quiet + rough)
    assert {f[2] for f in flags(spark, quiet + rough, Limits(fence=1e9))} <= {"impossible", "frozen"}


def test_null_readings_and_places_crash_nothing(spark):
    rows = trip("a", 60) + [[900 + k, "n", 1_736_000_000_000 + k * 1000, None, None, None, None] for k in range(5)]
    rows += [[950, "a", None, 51.0, 25.0, 900.0, -1.0], [951, None, 5, 51.0, 25.0, 900.0, -1.0], [952, "z", 5, 51.0, 25.0, float("nan"), float("inf")]]
    rows[7][3] = rows[7][4] = None
    assert flags(spark, rows) == {(952, "speed", "impossible"), (952, "accuracy", "impossible")}
