"""Points near points, near lines and inside areas, by a dual-tree join.

Both sides are arranged as trees of bounding boxes over a common grid whose cells halve from level to
level, from one root that is the whole earth. Starting with the pair of roots, pairs of nodes whose boxes
are further apart than the limit are discarded, pairs whose boxes lie within it as a whole are accepted
without looking at their points, and the rest are replaced by the pairs of their children. Only pairs of
leaves still in doubt are refined by exact tests. Each level is one distributed join on node keys; no step
compares all with all. Areas form a tree too: a node of an area is what of its boundary lies in a cell, and
is split along with the points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions.geo import RADIUS, haversine
from cairn.storage import materialize

METRES = RADIUS * math.pi / 180  # per degree of latitude
LEAF_DEGREES = 0.0012  # side of a leaf cell
SHIFTS = (19, 13, 9, 6, 3, 0)  # halvings above the leaf of each level; the root's one cell covers the earth
BASE = 3  # shift from which on downwards the pairs of a level are many enough to be written as a table
HOT_ROWS = 20_000  # items of a leaf from which it is dealt into parts of that many
FEW_LEAVES = 100_000  # hot leaves that are broadcast; more are joined by a shuffle


def _leaf(lon: Column, lat: Column) -> Column:
    """Key of the leaf cell: column in the upper, row in the lower half of a long."""
    x, y = F.floor((lon + 180) / LEAF_DEGREES), F.floor((lat + 90) / LEAF_DEGREES)
    return F.shiftleft(x.cast("long"), 32).bitwiseOR(y.cast("long"))


def _above(leaf: Column, shift: int) -> Column:
    x, y = F.shiftright(leaf, 32), leaf.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(F.shiftright(x, shift), 32).bitwiseOR(F.shiftright(y, shift))


class Tree:
    """Nodes of the bounding boxes of items (id, leaf, x1, y1, x2, y2) at every level; may serve several joins."""

    def __init__(self, items: DataFrame, boxes: DataFrame | None = None) -> None:
        self.items = items
        grown = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.sum("n").alias("n")]
        boxes = items.select("leaf", "x1", "y1", "x2", "y2", F.lit(1).cast("long").alias("n")) if boxes is None else boxes
        self.leaves = materialize(boxes.groupBy("leaf").agg(*grown), "leaves")
        above = F.explode(F.array(*[F.struct(F.lit(s).alias("shift"), _above(F.col("leaf"), s).alias("node")) for s in SHIFTS[:-1]]))
        self._upper = materialize(self.leaves.withColumn("above", above).groupBy("above.shift", "above.node").agg(*grown), "nodes")
        self._n_hot: int | None = None

    def union(self, other: Tree) -> Tree:
        """The tree of the items of both."""
        return Tree(self.items.unionByName(other.items), self.leaves.unionByName(other.leaves))

    def nodes(self, k: int, side: str) -> DataFrame:
        """Nodes of level k as (up, node, x1, y1, x2, y2), named for a side; up is the key of the parent."""
        out = self._upper.where(F.col("shift") == SHIFTS[k]) if SHIFTS[k] else self.leaves.withColumnRenamed("leaf", "node")
        up = _above(F.col("node"), SHIFTS[k - 1] - SHIFTS[k]) if k else F.col("node")
        return out.select(up.alias(f"{side}_up"), F.col("node").alias(f"{side}_node"), *[F.col(c).alias(f"{side}_{c}") for c in ("x1", "y1", "x2", "y2")])

    def leaves_under(self, k: int, side: str) -> DataFrame:
        return self.leaves.select(_above(F.col("leaf"), SHIFTS[k]).alias(f"{side}_parent"), F.col("leaf").alias(f"{side}_leaf"))

    def _hot(self, key: str) -> DataFrame | None:
        """Leaves of more than HOT_ROWS items and the number of their parts; None if there are none. Broadcast only if they are few."""
        hot = self.leaves.where(F.col("n") > HOT_ROWS)
        if self._n_hot is None:
            self._n_hot = hot.count()
        hot = hot.select(F.col("leaf").alias(key), F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("parts"))
        return None if not self._n_hot else F.broadcast(hot) if self._n_hot <= FEW_LEAVES else hot

    def parts(self, rows: DataFrame, key: str, ident: str) -> DataFrame:
        """rows with part: which part of its leaf an item is dealt to; 0 unless the leaf is hot."""
        hot = self._hot(key)
        if hot is None:
            return rows.withColumn("part", F.lit(0))
        return rows.join(hot, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(ident), F.col("parts")).cast("int"), F.lit(0))).drop("parts")

    def all_parts(self, pairs: DataFrame, key: str) -> DataFrame:
        """pairs of leaves, once for each part of the leaf named by key."""
        hot = self._hot(key)
        if hot is None:
            return pairs.withColumn("part", F.lit(0))
        return pairs.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")


def _bounds() -> tuple[Column, Column]:
    """Least and greatest metres between two boxes, a little wide to either side; the short way round the earth."""
    ways = (-360.0, 0.0, 360.0)

    def gap(lo: str, hi: str, by: float = 0.0) -> Column:
        return F.greatest(F.lit(0.0), F.col(f"a_{lo}") - F.col(f"b_{hi}") - by, F.col(f"b_{lo}") + by - F.col(f"a_{hi}"))

    def span(lo: str, hi: str, by: float = 0.0) -> Column:
        return F.greatest(F.col(f"a_{hi}"), F.col(f"b_{hi}") + by) - F.least(F.col(f"a_{lo}"), F.col(f"b_{lo}") + by)

    poleward = F.radians(F.greatest(*[F.abs(F.col(c)) for c in ("a_y1", "a_y2", "b_y1", "b_y2")]))
    equatorward = F.radians(F.when(F.least("a_y1", "b_y1") * F.greatest("a_y2", "b_y2") <= 0, F.lit(0.0)).otherwise(F.least(*[F.abs(F.col(c)) for c in ("a_y1", "a_y2", "b_y1", "b_y2")])))
    # the chord between two points is no longer than the arc, over a pole too
    dx = F.least(*[gap("x1", "x2", w) for w in ways])
    straight = 2 * RADIUS * F.cos(poleward) * F.sin(F.radians(F.least(dx, F.lit(180.0)) / 2))
    near = F.sqrt(F.pow(straight, 2) + F.pow(2 * RADIUS * F.sin(F.radians(gap("y1", "y2") / 2)), 2)) * 0.998
    far = METRES * F.sqrt(F.pow(F.least(*[span("x1", "x2", w) for w in ways]) * F.cos(equatorward), 2) + F.pow(span("y1", "y2"), 2)) * 1.002
    return near, far


def _grows(nodes: DataFrame, k: int) -> DataFrame:
    """Nodes of the lower levels, which grow with the data, are never broadcast."""
    return nodes.hint("merge") if SHIFTS[k] < BASE else nodes


def leaf_pairs(a: Tree, b: Tree, metres: float, accept: bool = True) -> DataFrame:
    """(a_leaf, b_leaf, sure) of the leaves of two trees that may hold items within metres of one another.

    sure marks pairs of which every two items are that near. accept=False for items that fill their box
    only partly (lines), whose boxes prove nothing.
    """
    near, far = _bounds()
    pairs, sure = None, []
    for k in range(len(SHIFTS)):
        left, right = a.nodes(k, "a"), b.nodes(k, "b")
        if pairs is None:
            pairs = left.join(right, left.a_node == right.b_node)  # the two roots
        else:
            pairs = pairs.join(_grows(left, k), F.col("a_parent") == F.col("a_up")).join(_grows(right, k), F.col("b_parent") == F.col("b_up"))
        pairs = pairs.where(near <= metres).withColumn("sure", (far <= metres) if accept else F.lit(False))
        pairs = pairs.select(F.col("a_node").alias("a_parent"), F.col("b_node").alias("b_parent"), "sure")
        if SHIFTS[k] <= BASE:
            pairs = materialize(pairs, "pairs")
        if k < len(SHIFTS) - 1:
            # at upper levels a box is only within the limit if its points lie in a heap: expand it to leaves at once
            if accept and SHIFTS[k] <= BASE:
                done = pairs.where("sure")
                sure.append(done.join(a.leaves_under(k, "a").hint("merge"), "a_parent").join(b.leaves_under(k, "b").hint("merge"), "b_parent").select("a_leaf", "b_leaf", "sure"))
                pairs = pairs.where("not sure")
            pairs = pairs.drop("sure")
    out = pairs.select(F.col("a_parent").alias("a_leaf"), F.col("b_parent").alias("b_leaf"), "sure")
    for s in sure:
        out = out.unionByName(s)
    return materialize(out, "leaf-pairs")


def point_tree(points: DataFrame | Tree) -> Tree:
    """The tree of points (id, lon, lat); rows with a null in any of the columns or no place on earth are left out."""
    return points if isinstance(points, Tree) else Tree(_points(points))


def _points(points: DataFrame) -> DataFrame:
    placed = points.where("id is not null and lon between -180 and 180 and lat between -90 and 90")
    return placed.select("id", F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.col("lon").alias("x2"), F.col("lat").alias("y2"), _leaf(F.col("lon"), F.col("lat")).alias("leaf"))


def _refined(pairs: DataFrame, a: Tree, a_rows: DataFrame, b: Tree, b_rows: DataFrame) -> DataFrame:
    """The rows of both sides in pairs of leaves; a hot leaf of either side is dealt into parts, its pairs repeated for each."""
    a_parts = a.parts(a_rows, "a_leaf", "left_id").withColumnRenamed("part", "a_part")
    b_parts = b.parts(b_rows, "b_leaf", "right_id").withColumnRenamed("part", "b_part")
    each = a.all_parts(pairs, "a_leaf").withColumnRenamed("part", "a_part")
    each = b.all_parts(each, "b_leaf").withColumnRenamed("part", "b_part")
    return each.join(b_parts, ["b_leaf", "b_part"]).join(a_parts, ["a_leaf", "a_part"])


def near_points(left: DataFrame | Tree, right: DataFrame | Tree, metres: float) -> DataFrame:
    """(left_id, right_id) of points (id, lon, lat), or their trees, at most metres apart, distinct.

    Rows with a null in any of the columns, or no place on earth, match nothing; so do empty tables.
    """
    a, b = point_tree(left), point_tree(right)
    a_rows, b_rows = a.items, b.items
    pairs = leaf_pairs(a, b, metres)
    a_rows = a_rows.select(F.col("leaf").alias("a_leaf"), F.col("id").alias("left_id"), F.col("x1").alias("ax"), F.col("y1").alias("ay"))
    b_rows = b_rows.select(F.col("leaf").alias("b_leaf"), F.col("id").alias("right_id"), F.col("x1").alias("bx"), F.col("y1").alias("by"))
    near = _refined(pairs, a, a_rows, b, b_rows)
    return near.where(F.col("sure") | (haversine("ax", "ay", "bx", "by") <= metres)).select("left_id", "right_id").distinct()


def metres_to_piece(lon: Column, lat: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres from a point to a short segment, planar about the point, the short way round the earth."""
    kx = METRES * F.cos(F.radians(lat))
    turn = lambda d: d - 360 * F.floor((d + 180) / 360)
    x1, x2 = turn(lon1 - lon), turn(lon2 - lon)
    x2 = x1 + turn(x2 - x1)
    ax, ay, bx, by = x1 * kx, (lat1 - lat) * METRES, x2 * kx, (lat2 - lat) * METRES
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(square > 0, -(ax * dx + ay * dy) / square).otherwise(0.0)))
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


def near_lines(points: DataFrame | Tree, pieces: DataFrame, metres: float) -> DataFrame:
    """(left_id, right_id) of points (id, lon, lat), or their tree, and lines at most metres apart, distinct.

    pieces has one row (id, lon1, lat1, lon2, lat2) for each segment of a line; a segment of no length is a
    point. Rows with a null in any of the columns match nothing; so do empty tables.
    """
    a = point_tree(points)
    a_rows = a.items
    whole = pieces.where("id is not null and lon1 between -180 and 180 and lon2 between -180 and 180 and lat1 between -90 and 90 and lat2 between -90 and 90")
    # a piece over the date line runs on beyond 180 degrees
    east = F.col("lon1") + (F.col("lon2") - F.col("lon1") - 360 * F.floor((F.col("lon2") - F.col("lon1") + 180) / 360))
    b_rows = whole.withColumn("east", east).select(
        "id", "lon1", "lat1", "lon2", "lat2", F.least("lon1", "east").alias("x1"), F.least("lat1", "lat2").alias("y1"), F.greatest("lon1", "east").alias("x2"), F.greatest("lat1", "lat2").alias("y2"),
        _leaf(F.least(F.lit(180.0), F.greatest(F.lit(-180.0), (F.col("lon1") + F.col("east")) / 2)), (F.col("lat1") + F.col("lat2")) / 2).alias("leaf"),
    )
    b = Tree(b_rows)
    pairs = leaf_pairs(a, b, metres, accept=False)
    a_rows = a_rows.select(F.col("leaf").alias("a_leaf"), F.col("id").alias("left_id"), F.col("x1").alias("lon"), F.col("y1").alias("lat"))
    b_rows = b_rows.select(F.col("leaf").alias("b_leaf"), F.col("id").alias("right_id"), "lon1", "lat1", "lon2", "lat2")
    near = _refined(pairs, a, a_rows, b, b_rows)
    apart = metres_to_piece(*[F.col(c) for c in ("lon", "lat", "lon1", "lat1", "lon2", "lat2")])
    return near.where(apart <= metres).select("left_id", "right_id").distinct()


def inside(edges: Column, lon: Column, lat: Column) -> Column:
    """Even-odd test of a point against edges array<struct(lon1, lat1, lon2, lat2)>."""
    return F.size(F.filter(edges, lambda e: _crosses(e, lon, lat))) % 2 == 1


def _at_lat(e: Column, lat: Column) -> Column:
    """Longitude of an edge at a latitude that it spans."""
    return (e["lon2"] - e["lon1"]) * (lat - e["lat1"]) / F.when(e["lat2"] == e["lat1"], 1.0).otherwise(e["lat2"] - e["lat1"]) + e["lon1"]


def _at_lon(e: Column, lon: Column) -> Column:
    return (e["lat2"] - e["lat1"]) * (lon - e["lon1"]) / F.when(e["lon2"] == e["lon1"], 1.0).otherwise(e["lon2"] - e["lon1"]) + e["lat1"]


def _crosses(e: Column, lon: Column, lat: Column) -> Column:
    return ((e["lat1"] > lat) != (e["lat2"] > lat)) & (lon < _at_lat(e, lat))


def _moved(odd: Column, edges: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether (x1, y1) is inside, given whether (x0, y0) is and the edges that the way up or down, then along, may cross."""
    upright = lambda e: ((e["lon1"] > x0) != (e["lon2"] > x0)) & ((_at_lon(e, x0) > y0) != (_at_lon(e, x0) > y1))
    along = lambda e: ((e["lat1"] > y1) != (e["lat2"] > y1)) & ((_at_lat(e, y1) > x0) != (_at_lat(e, y1) > x1))
    return odd != ((F.size(F.filter(edges, upright)) + F.size(F.filter(edges, along))) % 2 == 1)


#: A node is judged by a corner this far outside its box, where no vertex and no edge lies; edges within _PAD of a box belong to its node.
_OFF_X, _OFF_Y, _PAD = 3.1415926e-8, 2.7182818e-8, 1e-7


def _smallest_cell(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Level of the smallest node whose cell holds a box as a whole, as an index of SHIFTS."""
    inside_world = lambda x, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), x))
    a = _leaf(inside_world(x1, -180.0, 180.0), inside_world(y1, -90.0, 90.0))
    b = _leaf(inside_world(x2, -180.0, 180.0), inside_world(y2, -90.0, 90.0))
    level = F.lit(0)
    for k, shift in enumerate(SHIFTS):
        level = F.when(_above(a, shift) == _above(b, shift), k).otherwise(level)
    return level


def points_in_areas(points: DataFrame | Tree, areas: DataFrame) -> DataFrame:
    """(left_id, right_id) of points (id, lon, lat), or their tree, inside areas (id, edges), holes left out, distinct.

    Starts with each area at the smallest node that holds it. A pair of a node of points and an area carries
    the edges of the area near the node's box and whether the node's corner is inside. Without such edges
    the node is accepted or discarded as a whole; otherwise its children are taken, each with the edges near
    it. So an area is split over the tree as the points are, and its edges are never sent again as a whole.
    Rows with a null in any of the columns and areas without edges match nothing; so do empty tables.
    """
    a = point_tree(points)
    a_rows = a.items
    whole = areas.where("id is not null and size(edges) > 0").select("id", "edges").distinct().withColumn("area", F.xxhash64("id", "edges"))
    box = lambda f, c: f(F.transform("edges", lambda e: e[c]))
    whole = whole.withColumns({"x1": box(F.array_min, "lon1"), "y1": box(F.array_min, "lat1"), "x2": box(F.array_max, "lon1"), "y2": box(F.array_max, "lat1")})
    leaf = _leaf(F.least(F.lit(180.0), F.greatest(F.lit(-180.0), F.col("x1"))), F.least(F.lit(90.0), F.greatest(F.lit(-90.0), F.col("y1"))))
    whole = materialize(whole.withColumns({"level": _smallest_cell(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]), "leaf": leaf}), "areas")
    # the way into the tree: from a corner outside the area
    start = whole.select("area", "edges", F.lit(False).alias("odd"), (F.col("x1") - 1e-6).alias("x0"), (F.col("y1") - 1e-6).alias("y0"), "level", "leaf")
    low_x, low_y = F.col("a_x1") - _OFF_X, F.col("a_y1") - _OFF_Y
    touches = lambda e: (F.least(e["lon1"], e["lon2"]) <= F.col("a_x2") + _PAD) & (F.greatest(e["lon1"], e["lon2"]) >= F.col("a_x1") - _PAD) & (F.least(e["lat1"], e["lat2"]) <= F.col("a_y2") + _PAD) & (F.greatest(e["lat1"], e["lat2"]) >= F.col("a_y1") - _PAD)
    pairs, sure = None, []
    for k in range(len(SHIFTS)):
        nodes = a.nodes(k, "a")
        entering = start.where(F.col("level") == k).join(_grows(nodes, k), _above(F.col("leaf"), SHIFTS[k]) == F.col("a_node"))
        columns = ["area", "edges", "odd", "x0", "y0", *nodes.columns]
        met = entering.select(*columns)
        if pairs is not None:
            met = met.unionByName(pairs.join(_grows(nodes, k), F.col("parent") == F.col("a_up")).select(*columns))
        met = met.select("area", F.col("a_node").alias("parent"), _moved(F.col("odd"), F.col("edges"), F.col("x0"), F.col("y0"), low_x, low_y).alias("odd"), low_x.alias("x0"), low_y.alias("y0"), F.filter("edges", touches).alias("edges"))
        met = met.where((F.size("edges") > 0) | F.col("odd"))
        if SHIFTS[k] <= BASE:
            met = materialize(met, "pairs")
        if k < len(SHIFTS) - 1:
            sure.append(met.where("size(edges) = 0").select("area", F.col("parent").alias("a_parent")).join(a.leaves_under(k, "a").hint("merge"), "a_parent").select("a_leaf", "area"))
            pairs = met.where("size(edges) > 0")
        else:
            sure.append(met.where("size(edges) = 0").select(F.col("parent").alias("a_leaf"), "area"))
            pairs = met.where("size(edges) > 0").withColumnRenamed("parent", "a_leaf")
    cells = pairs.select("a_leaf", "area", "odd", "x0", "y0", "edges")
    for s in sure:
        cells = cells.unionByName(s, allowMissingColumns=True)
    cells = a.all_parts(materialize(cells, "cells"), "a_leaf")
    items = a.parts(a_rows.select(F.col("leaf").alias("a_leaf"), F.col("id").alias("left_id"), F.col("x1").alias("lon"), F.col("y1").alias("lat")), "a_leaf", "left_id")
    hits = items.join(cells, ["a_leaf", "part"]).where(F.col("edges").isNull() | _moved(F.col("odd"), F.col("edges"), F.col("x0"), F.col("y0"), F.col("lon"), F.col("lat")))
    return hits.select("left_id", "area").join(whole.select("area", F.col("id").alias("right_id")), "area").select("left_id", "right_id").distinct()
