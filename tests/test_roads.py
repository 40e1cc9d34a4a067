"""Routing over the roads of a small traffic_state against plain searches."""

import heapq
from collections import defaultdict

import pytest

from cairn.plans import roads, routing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two towns of crossing streets, of either and both directions, and one street by itself."""
    lines = []
    for town, side in ((51.1, 5), (51.4, 4)):
        at = lambda i, j: f"{town + i * 0.0011 + j * j * 0.00003:.7f} {25.2 + j * 0.0013 + i * 0.00007:.7f}"  # noqa: B023, E731
        for k in range(side):
            lines += [[at(i, k) for i in range(side)], [at(k, j) for j in range(side)]]
    lines.append(["51.9 25.9", "51.901 25.9", "51.902 25.901"])
    rows = [(f"seg-{c}{k:05d}", f"LINESTRING ({', '.join(line)})", 50.0) for k, line in enumerate(lines) for c in "0123456789abcdef"[k * 5 % 16]]
    path = str(tmp_path_factory.mktemp("roads"))
    spark.createDataFrame(rows, "segment_id string, geom string, free_flow_kmh double").write.parquet(f"{path}/traffic_state.parquet")
    return path


@pytest.fixture(scope="module")
def near(spark, folder):
    out = defaultdict(dict)
    for r in routing.r1_edges(spark, folder).collect():
        out[r["src"]][r["dst"]] = round(r["metres"] * 1000)
    return out


def search(near, source, allowed=lambda *turn: True):
    """Least cost of each (node before, node) from source."""
    best, heap = {}, [(0, -1, source)]
    while heap:
        d, p, x = heapq.heappop(heap)
        if (p, x) not in best:
            best[p, x] = d
            for y, w in near.get(x, {}).items():
                if allowed(p, x, y):
                    heapq.heappush(heap, (d + w, x, y))
    return best


def least(best):
    out = {}
    for (p, x), d in best.items():
        out[x] = min(d, out.get(x, d))
    return out


def origins(near):
    nodes, part = {x for a in near for x in (a, *near[a])}, {}
    part = {x: x for x in nodes}
    for _ in nodes:
        for a in near:
            for b in near[a]:
                part[a] = part[b] = min(part[a], part[b])
    entered = {b for a in near for b in near[a]}
    return {min((a in entered, a) for a in near if part[a] == p)[1] for p in set(part.values())}


def test_paths_of_all_parts(spark, folder, near):
    want = {(s, x): d for s in origins(near) for x, d in least(search(near, s)).items()}
    assert len({s for s, _ in want}) == 3 and len(want) > 20
    got = {(r["source"], r["node"]): r["cost"] for r in roads.r3_r4_road_paths(spark, folder).collect()}
    assert got == want


def test_paths_without_banned_turns(spark, folder, near):
    def allowed(f, v, t):
        return f == -1 or f == t or v % 3 != 1 or f % 7 >= 4

    want = {(s, x): d for s in origins(near) for x, d in least({k: d for k, d in search(near, s, allowed).items() if k[0] != -1}).items()}
    free = {(s, x): d for s in origins(near) for x, d in least({k: d for k, d in search(near, s).items() if k[0] != -1}).items()}
    got = {(r["source"], r["node"]): r["cost"] for r in roads.r5_r15_road_turns(spark, folder).collect()}
    assert got == want != free


def test_traced_paths_and_alternatives(spark, folder, near):
    cost = {s: least(search(near, s)) for s in origins(near)}
    target = {s: min((-d, x) for x, d in c.items())[1] for s, c in cost.items()}
    got = {r["source"]: r for r in roads.r24_road_path(spark, folder).collect()}
    assert {s: (r["target"], r["cost"]) for s, r in got.items()} == {s: (t, cost[s][t]) for s, t in target.items()}
    assert max(r["hops"] for r in got.values()) >= 6
    again = roads.r25_alternative(spark, folder).collect()
    assert {r["source"]: (r["target"], r["least_cost"]) for r in again} == {s: (t, cost[s][t]) for s, t in target.items()}
    assert all(r["cost"] >= r["least_cost"] and 0 <= r["overlap"] <= 1 for r in again)
    assert any(r["overlap"] < 1 for r in again) and any(r["overlap"] == 1 for r in again)
