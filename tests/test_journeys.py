"""Steps of routes, arms of junctions and followers, on small cases."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import sequential as S, steps
from cairn.plans import journeys

VERTEX = "route string, i int, cum double, delta double, same_road boolean, choice boolean, ring boolean, leaves boolean"


def kinds(spark, rows, spaced=False):
    """rows: (cum, delta, same_road, choice, ring, leaves) of one route."""
    v = spark.createDataFrame([("r", i, float(c), float(d), s, ch, ring, lv) for i, (c, d, s, ch, ring, lv) in enumerate(rows)], VERTEX)
    found = steps.maneuvers(v)
    if spaced:
        found = steps.spaced_by_rank(found.select("route", "i", "cum", "kind"))
        return {r["i"]: r["kind"] for r in found.collect()}
    return {r["i"]: (r["kind"], r["exit_number"]) for r in found.collect()}


def plain(cum, delta, same=True, choice=True, ring=False, leaves=False):
    return (cum, delta, same, choice, ring, leaves)


def test_turns_changes_of_road_and_bends_without_choice(spark):
    rows = [plain(0, 0), plain(100, 90), plain(200, 30, choice=False), plain(300, 5, same=False), plain(400, -170, choice=False), plain(500, -30, same=False, choice=False), plain(600, 10), plain(700, 0)]
    assert kinds(spark, rows) == {0: ("depart", None), 1: ("turn-right", None), 3: ("continue", None), 4: ("uturn", None), 5: ("slight-left", None), 7: ("arrive", None)}


def test_one_corner_read_twice_and_two_corners(spark):
    rows = [plain(0, 0), plain(100, 60), plain(112, 90), plain(124, 70), plain(200, -60), plain(220, 80), plain(400, 178), plain(420, -179), plain(600, 0)]
    got = {i: k for i, (k, _) in kinds(spark, rows).items()}
    assert got == {0: "depart", 2: "turn-right", 4: "turn-left", 5: "turn-right", 7: "uturn", 8: "arrive"}


def test_roundabout_is_one_maneuver_with_its_exit(spark):
    ring = [plain(200, 60, ring=True), plain(215, 50, ring=True, leaves=True), plain(230, 50, ring=True, leaves=True), plain(245, 40, same=False, leaves=True)]
    rows = [plain(0, 0), plain(185, -80), *ring, plain(400, 0)]
    assert kinds(spark, rows) == {0: ("depart", None), 5: ("roundabout", 3), 6: ("arrive", None)}
    assert kinds(spark, [plain(0, 0), plain(150, -80), *ring, plain(400, 0)])[1] == ("turn-left", None)  # too far before to be its approach


def test_spacing_by_rank(spark):
    rows = [plain(0, 0), plain(5, 30, same=False), plain(100, 3, same=False), plain(110, 90), plain(112, 2, same=False), plain(300, 0)]
    assert kinds(spark, rows, spaced=True) == {0: "depart", 1: "slight-right", 3: "turn-right", 5: "arrive"}


@pytest.mark.parametrize(
    "kind,bearing,highway,name,exit_number,same,text",
    [
        ("depart", 350.0, None, None, 0, False, "Head north on the road"), ("depart", 112.4, "trunk", None, 0, False, "Head east on the main road"), ("turn-left", 0.0, "motorway_link", None, 0, False, "Turn left onto the slip road"),
        ("slight-right", 0.0, "x", "Corniche", 0, True, "Bear right to stay on Corniche"), ("turn-right", 0.0, "x", "Corniche", 0, True, "Keep right to stay on Corniche"), ("roundabout", 0.0, "service", None, 2, False, "At the roundabout, take the second exit onto the service road"),
        ("roundabout", 0.0, "service", "", 11, False, "At the roundabout, exit onto the service road"), ("uturn", 0.0, None, "A", 0, True, "Make a U-turn onto A"), ("continue", 0.0, None, "A", 0, False, "Continue on A"), ("arrive", 0.0, None, "A", 0, False, "Arrive at destination"),
    ],
)
def test_instructions(spark, kind, bearing, highway, name, exit_number, same, text):
    df = spark.createDataFrame([(kind, bearing, highway, name, exit_number, same)], "kind string, bearing double, highway string, name string, e int, same boolean")
    said = steps.instruction(F.col("kind"), F.col("bearing"), steps.road_label(F.col("highway"), F.col("name")), F.col("e"), F.col("same"))
    assert df.select(said.alias("s")).first()["s"] == text


def test_no_vertices_give_no_steps(spark):
    empty = spark.createDataFrame([], VERTEX)
    assert steps.maneuvers(empty).isEmpty() and steps.spaced_by_rank(steps.maneuvers(empty).select("route", "i", "cum", "kind")).isEmpty()
    assert kinds(spark, [plain(0, 0)]) == {0: ("arrive", None)}


def test_arms_through_and_branch(spark):
    arms = [("n", "a", 0.0), ("n", "b", 178.0), ("n", "c", 95.0), ("m", "a", 0.0), ("m", "b", 180.0), ("k", "a", 0.0), ("k", "b", 170.0), ("k", "c", 200.0)]
    got = {(r["node"], r["arm"]): (r["role"], r["partner"]) for r in journeys.arm_roles(spark.createDataFrame(arms, "node string, other string, brg double")).collect()}
    assert got == {("n", "a"): ("through", "b"), ("n", "b"): ("through", "a"), ("n", "c"): ("branch", None), ("k", "a"): ("through", "b"), ("k", "b"): ("through", "a"), ("k", "c"): ("branch", None)}


class Fix:
    def __init__(self, t, along, offset, speed=10.0, accuracy=None):
        self.t, self.speed, self.accuracy, self.feet = t, speed, accuracy, [{"along": float(along), "offset": float(offset)}] if along is not None else []


def test_tracker_locks_corrects_reckons_and_leaves():
    step = S.route_tracker()()
    assert step(Fix(0, 100, 50)) == ("off_route", None)  # within 60 m, but too far to lock on
    assert step(Fix(1000, 100, 5)) == ("on_route", 100.0)
    assert step(Fix(2000, 114, 5)) == ("on_route", 111.0)  # reckoned 110, a quarter of the way to 114
    assert step(Fix(3000, 130, 50))[0] == "on_route"  # locked: a fix between the limits leaves the reckoned place
    assert step(Fix(4000, 130, 80)) == ("off_route", None)
    assert step(Fix(5000, None, None)) == ("off_route", None)


def test_follower_is_uncertain_before_it_is_off_the_way():
    step = S.walk_follower()()
    assert step(Fix(0, 50, 5)) == ("on_route", 50.0)
    assert step(Fix(1000, 45, 5)) == ("on_route", 47.98)  # back no faster than a walk with slack, rounded
    assert step(Fix(2000, 50, 60)) == ("uncertain", 47.98) and step(Fix(7000, 50, 60))[0] == "uncertain"
    assert step(Fix(8000, 50, 60)) == ("off_route", None)
    assert step(Fix(9000, 52, 30, accuracy=40.0)) == ("on_route", 52.0)  # an unsharp fix may lie further off


def test_second_nodes_of_the_same_lights_are_merged():
    class Signal:
        def __init__(self, along, lon):
            self.along, self.lon, self.lat = along, lon, 25.0

    step = S.same_lights()()
    assert [step(Signal(a, x))[0] for a, x in ((10, 51.0), (18, 51.00005), (19, 51.0003), (60, 51.0003))] == [True, False, True, True]


def test_fan_out_swaps_the_order_of_points(spark):
    s = spark.createDataFrame([("s", [(51.0, 25.0), (51.1, 25.1)], 50.0, None)], "segment_id string, line array<struct<lon: double, lat: double>>, free_flow_kmh double, mean_speed_kmh double")
    viewers, overlay = journeys.fan_out(s)
    assert [tuple(p) for p in viewers.first()["coordinates"]] == [(51.0, 25.0), (51.1, 25.1)] and [tuple(p) for p in overlay.first()["geometry"]] == [(25.0, 51.0), (25.1, 51.1)]


def test_sidecar_keeps_its_own_tags(spark):
    w = spark.createDataFrame([("w1", [1, 2, 3], {"layer": "1", "name": "x", "lanes:forward": ""}), ("w2", [1], {"layer": "1"})], "way string, nodes array<int>, tags map<string, string>")
    assert [(r["way"], r["tags"]) for r in journeys.lane_sidecar(w).collect()] == [("w1", {"layer": "1"})]


def test_offset_between_two_places(spark):
    rows = [(0.0, (10.0, 0.0), (60.0, 5.0)), (35.0, (10.0, 0.0), (60.0, 5.0)), (99.0, (10.0, 0.0), (60.0, 5.0)), (5.0, None, (60.0, 5.0)), (5.0, (10.0, 2.0), None), (7.0, (10.0, 1.0), (10.0, 3.0))]
    df = spark.createDataFrame(rows, "at double, a struct<at: double, offset: double>, b struct<at: double, offset: double>")
    assert [r["o"] for r in df.select(journeys.lateral_at(F.col("a"), F.col("b")).alias("o")).collect()] == [0.0, 2.5, 5.0, 5.0, 2.0, 3.0]
