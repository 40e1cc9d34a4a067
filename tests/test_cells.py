"""Cells at any latitude and over the date line."""

import math
import random

from pyspark.sql import functions as F

from cairn.operators import cells


def test_cells_hold_all_points_within_reach_anywhere(spark):
    rng, rows = random.Random(6), []
    for _ in range(400):
        lat, lon = rng.choice([0, 25, 60, 80, 89.9, -71, -89.99]) + rng.uniform(-0.01, 0.01), rng.choice([179.999, -179.999, 0.0, 51.0])
        lat2 = lat + rng.uniform(-0.0026, 0.0026)
        rows.append((lon, lat, (lon + rng.uniform(-0.0026, 0.0026) / max(0.0002, math.cos(math.radians(lat))) + 540) % 360 - 180, lat2))
    df = spark.createDataFrame([r for r in rows if abs(r[3]) <= 90 and abs(r[1]) <= 90], "a double, b double, c double, d double")
    x = [F.col(c) for c in "abcd"]
    got = df.select(cells.near_metres(*x).alias("m"), F.array_contains(cells.cells_within(x[0], x[1], 300.0), cells.cell(x[2], x[3])).alias("held")).collect()
    near = [r for r in got if r["m"] <= 299]
    assert len(near) > 100 and all(r["held"] for r in near)
