"""Dual-tree joins against all pairs."""

import math
import random

import pytest

from cairn.functions import wkt
from cairn.functions.geo import RADIUS
from cairn.operators import dual_tree
from pyspark.sql import functions as F


def far(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * RADIUS * math.asin(math.sqrt(h))


def cloud(seed, n, spread=0.004, centres=6):
    rng = random.Random(seed)
    middle = [(51 + rng.random() * 0.4, 25 + rng.random() * 0.4) for _ in range(centres)]
    out = []
    for k in range(n):
        x, y = rng.choice(middle)
        out.append((f"{seed}-{k}", x + rng.gauss(0, spread), y + rng.gauss(0, spread)))
    return out + [(f"{seed}-heap{k}", 51.2, 25.2) for k in range(30)]  # one place many times


@pytest.mark.parametrize("metres", [50.0, 400.0])
def test_points_near_points(spark, metres):
    a, b = cloud(1, 400), cloud(2, 300) + [("same", *cloud(1, 400)[0][1:])]
    frame = lambda rows: spark.createDataFrame(rows + [(None, 51.0, 25.0), ("null", None, 25.0)] + rows[:5], "id string, lon double, lat double").withColumn("leaf", F.lit(1))
    got = [tuple(r) for r in dual_tree.near_points(frame(a), frame(b), metres).collect()]
    want = {(i, j) for i, *p in a for j, *q in b if far(p, q) <= metres}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_points_near_lines(spark):
    points, rng = cloud(3, 300), random.Random(5)
    pieces = [(f"l{k}", x, y, x + rng.uniform(-0.002, 0.002), y + rng.uniform(-0.002, 0.002)) for k, (_, x, y) in enumerate(cloud(4, 200))] + [("dot", 51.2, 25.2, 51.2, 25.2)]
    got = {tuple(r) for r in dual_tree.near_lines(spark.createDataFrame(points, "id string, lon double, lat double"), spark.createDataFrame(pieces, "id string, lon1 double, lat1 double, lon2 double, lat2 double"), 80.0).collect()}

    def to(p, s):
        kx = dual_tree.METRES * math.cos(math.radians(p[1]))
        ax, ay, bx, by = (s[0] - p[0]) * kx, (s[1] - p[1]) * dual_tree.METRES, (s[2] - p[0]) * kx, (s[3] - p[1]) * dual_tree.METRES
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(ax + t * dx, ay + t * dy)

    assert got == {(i, j) for i, *p in points for j, *s in pieces if to(p, s) <= 80.0}


def test_points_in_areas_with_holes_and_parts(spark):
    shapes = [
        ("square", "POLYGON ((51 25, 51.3 25, 51.3 25.3, 51 25.3, 51 25))"),
        ("holed", "SRID=4326;Polygon ((51.1 25.1, 51.4 25.1, 51.4 25.4, 51.1 25.4),(51.2 25.2,51.3 25.2,51.3 25.3,51.2 25.3,51.2 25.2))"),
        ("two", "MULTIPOLYGON (((51 25.3, 51.05 25.3, 51.05 25.35, 51 25.35, 51 25.3)), ((51.35 25, 51.4 25, 51.4 25.05, 51.35 25.05, 51.35 25)))"),
        ("line", "LINESTRING (51 25, 52 26)"), ("broken", "POLYGON ((51 25, x"), ("null", None),
    ]
    areas = spark.createDataFrame(shapes, "id string, geom string").select("id", wkt.rings(F.col("geom")).alias("r")).where("r is not null").select("id", wkt.edges(F.col("r")).alias("edges"))
    points = [(f"p{k}", 51 + random.Random(k).random() * 0.45, 25 + random.Random(k + 9999).random() * 0.45) for k in range(1500)]
    got = {tuple(r) for r in dual_tree.points_in_areas(spark.createDataFrame(points, "id string, lon double, lat double"), areas).collect()}
    box = lambda x, y, a, b, c, d: a < x < c and b < y < d
    inside = {
        "square": lambda x, y: box(x, y, 51, 25, 51.3, 25.3), "holed": lambda x, y: box(x, y, 51.1, 25.1, 51.4, 25.4) and not box(x, y, 51.2, 25.2, 51.3, 25.3),
        "two": lambda x, y: box(x, y, 51, 25.3, 51.05, 25.35) or box(x, y, 51.35, 25, 51.4, 25.05),
    }
    assert got == {(i, name) for i, x, y in points for name, f in inside.items() if f(x, y)}


def test_empty_sides(spark):
    empty, one = spark.createDataFrame([], "id string, lon double, lat double"), spark.createDataFrame([("a", 51.0, 25.0)], "id string, lon double, lat double")
    assert dual_tree.near_points(empty, one, 50).isEmpty() and dual_tree.near_points(one, empty, 50).isEmpty()


def test_wkt_notations(spark):
    texts = ["POINT(51.1 25.2)", "SRID=4326;POINT(5.11e+01 2.52e+01)", "Point ( 51.1  25.2 )", "POINT Z (51.1 25.2 7.7)", "POINT(51.1,25.2", "POINT EMPTY", "POINT(51.1)", "POINT(nan nan)", "", None, "SRID=3857;POINT(1 2)"]
    got = [r["p"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, g string").orderBy("k").select(wkt.point(F.col("g")).alias("p")).collect()]
    assert [tuple(p) for p in got[:4]] == [(51.1, 25.2)] * 4 and got[4:] == [None] * 7


def place(rows):
    return [(k, (x + 540) % 360 - 180, y) for k, x, y in rows]


def test_over_the_date_line_and_at_the_pole(spark):
    rng = random.Random(8)
    a = place([(f"a{k}", 180 + rng.uniform(-0.004, 0.004), rng.choice([0, 60]) + rng.uniform(-0.002, 0.002)) for k in range(150)]) + [(f"n{k}", rng.uniform(-180, 180), 89.9995) for k in range(20)]
    b = place([(f"b{k}", 180 + rng.uniform(-0.004, 0.004), rng.choice([0, 60]) + rng.uniform(-0.002, 0.002)) for k in range(150)]) + [(f"m{k}", rng.uniform(-180, 180), 89.9995) for k in range(20)]
    frame = lambda rows: spark.createDataFrame(rows, "id string, lon double, lat double")
    got = {tuple(r) for r in dual_tree.near_points(frame(a), frame(b), 150.0).collect()}
    want = {(i, j) for i, *p in a for j, *q in b if far(p, q) <= 150.0}
    assert got == want and any(p[0] > 0 > q[0] for i, *p in a for j, *q in b if (i, j) in want)
    pieces = spark.createDataFrame([("over", 179.999, 0.0, -179.999, 0.0)], "id string, lon1 double, lat1 double, lon2 double, lat2 double")
    near = {r["left_id"] for r in dual_tree.near_lines(frame([("x", -179.9995, 0.0001), ("y", 179.9995, -0.0001), ("z", 0.0, 0.0001), ("far", -179.9, 0.0)]), pieces, 30.0).collect()}
    assert near == {"x", "y"}


def test_hot_leaves_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(dual_tree, "HOT_ROWS", 10)
    a, b = cloud(11, 150), cloud(12, 150)
    frame = lambda rows: spark.createDataFrame(rows, "id string, lon double, lat double")
    want = {(i, j) for i, *p in a for j, *q in b if far(p, q) <= 100.0}
    assert {tuple(r) for r in dual_tree.near_points(frame(a), frame(b), 100.0).collect()} == want
    monkeypatch.setattr(dual_tree, "FEW_LEAVES", 0)  # joined by a shuffle
    assert {tuple(r) for r in dual_tree.near_points(frame(a), frame(b), 100.0).collect()} == want


def test_points_in_star_shaped_areas_against_all_pairs(spark):
    rng, areas = random.Random(21), []
    for k in range(25):
        x, y, n, r = 51 + rng.random() * 0.3, 25 + rng.random() * 0.3, rng.randrange(3, 60), 10 ** rng.uniform(-3.5, -0.8)
        ring = [(x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * j / n), y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * j / n)) for j in range(n)]
        areas.append((f"s{k}", [(*p, *q) for p, q in zip(ring, ring[1:] + ring[:1])]))
    areas.append(("grid", [(51.0, 25.0, 51.12, 25.0), (51.12, 25.0, 51.12, 25.12), (51.12, 25.12, 51.0, 25.12), (51.0, 25.12, 51.0, 25.0)]))
    points = [(f"p{k}", round(51 + rng.random() * 0.3, 4), round(25 + rng.random() * 0.3, 4)) for k in range(1200)] + [(f"g{k}", 51.0 + 0.012 * k, 25.05) for k in range(1, 9)]

    def inside(x, y, edges):
        return sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for a, b, c, d in edges) % 2 == 1

    frame = spark.createDataFrame(areas, "id string, edges array<struct<lon1: double, lat1: double, lon2: double, lat2: double>>")
    got = {tuple(r) for r in dual_tree.points_in_areas(spark.createDataFrame(points + [("n", None, 25.0)], "id string, lon double, lat double"), frame).collect()}
    assert got == {(i, a) for i, x, y in points for a, e in areas if inside(x, y, e)}
    empty = frame.limit(0)
    assert dual_tree.points_in_areas(spark.createDataFrame(points[:3], "id string, lon double, lat double"), empty).isEmpty()
