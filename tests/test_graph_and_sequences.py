"""Iterative and order-dependent operators against plain versions."""

import heapq
import random
from collections import defaultdict
from types import SimpleNamespace

import pytest

from cairn.operators import graph
from cairn.operators import sequential as S
from cairn.streaming import trips as streams
from pyspark.sql import functions as F


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(500, 560)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).isEmpty()


def test_shortest_paths_with_closed_edges(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40), rng.choice([None, *range(1, 20)])) for _ in range(200)]
    near = defaultdict(list)
    for a, b, w in edges:
        if w is not None:
            near[a].append((b, w))
    best, heap = {}, [(0, 0)]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in best:
            best[x] = d
            for y, w in near[x]:
                heapq.heappush(heap, (d + w, y))
    got = graph.shortest_paths(spark.createDataFrame(edges, "src long, dst long, w long"), spark.createDataFrame([(0,)], "node long")).collect()
    assert {r["node"]: r["cost"] for r in got} == best
    assert [r["before"] for r in got if r["node"] == 0] == [None]


def _walk(seed, n=120):
    rng, lon, lat, t = random.Random(seed), 51.2, 25.2, 1_736_000_000_000
    out = []
    for k in range(n):
        lon, lat, t = lon + rng.uniform(0, 0.0003), lat + rng.uniform(0, 0.0003), t + rng.choice([1000, 2000, 5000])
        jump = 0.05 if rng.random() < 0.05 else 0.0
        out.append((f"trip{seed}", k, t, lon + jump, lat, None if rng.random() < 0.3 else 5.0, rng.choice([None, 8.0, 80.0])))
    return out


@pytest.mark.parametrize("maker,names", [(S.kinematic_screen, 2), (S.fix_gate, 1), (S.probe_buffer, 2)])
def test_scan_equals_loop(spark, maker, names):
    rows = [r for seed in range(4) for r in _walk(seed)]
    columns = ["trip", "id", "t", "lon", "lat", "speed", "accuracy"]
    df = spark.createDataFrame(rows, "trip string, id long, t long, lon double, lat double, speed double, accuracy double").repartition(5)
    schema = {S.kinematic_screen: "a boolean, b double", S.fix_gate: "a string", S.probe_buffer: "a boolean, b long"}[maker]
    got = {(r["trip"], r["id"]): tuple(r)[2:] for r in S.scan(S.stretches(df), ["trip", "part"], ["t", "id"], maker(), schema, ["trip", "id"]).collect()}
    want = {}
    for seed in range(4):
        step = maker()()
        for r in _walk(seed):
            want[r[0], r[1]] = step(SimpleNamespace(**dict(zip(columns, r))))
    assert got == want


def test_stretches_cut_at_pauses(spark):
    rows = [("a", k, t) for k, t in enumerate([0, 1000, 302_000, 302_500, 7_300_000, 7_300_100])] + [("b", 9, 5)]
    got = {r["id"]: r["part"] for r in S.stretches(spark.createDataFrame(rows, "trip string, id long, t long")).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 9: 0}


def test_greedy_collapse_and_speed_alert():
    near = S.greedy_collapse(250.0)()
    place = lambda lon, lat: SimpleNamespace(lon=lon, lat=lat)
    assert [near(place(*p))[0] for p in [(51.0, 25.0), (51.001, 25.0), (51.01, 25.0), (51.0, 25.002), (51.0, 25.003)]] == [True, False, True, False, True]
    alert = S.speed_alert()()
    at = lambda t, v, limit: alert(SimpleNamespace(t=t, speed_kmh=v, limit_kmh=limit))[0]
    assert [at(0, 56, 50), at(1000, 57, 50), at(2000, 47, 50), at(3000, 60, 50), at(70_000, 60, 50), at(71_000, 60, 40), at(72_000, None, 40)] == [True, False, False, True, True, True, False]


def _batch_truncation(rows):
    cum, total, last = [], 0.0, None
    for r in rows:
        total += S.metres(last[3], last[4], r[3], r[4]) if last else 0.0
        cum.append(total)
        last = r
    return {r[1] for r, c in zip(rows, cum) if c >= 200 and total - c >= 200}


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_commits_what_the_batch_form_keeps(spark, tmp_path, parts):
    rows = [r[:5] for r in _walk(3, 400)]
    source = tmp_path / "in"
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], "trip string, id long, t long, lon double, lat double").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("trip string, id long, t long, lon double, lat double").option("maxFilesPerTrigger", 1).parquet(str(source))
    out = streams.run_to_end(streams.truncate_stream(stream, idle_ms=None), str(tmp_path / "run"))
    assert {r["id"] for r in out.where("outcome = 'committed'").collect()} == _batch_truncation(rows)
    late = out.where("outcome = 'out_of_order'").count()
    assert late == 0


def test_upsert_sink_keeps_the_latest(spark, tmp_path):
    write = streams.upsert_sink(str(tmp_path / "t"), ["k"], "at")
    batch = lambda rows: spark.createDataFrame(rows, "k string, at long, v int")
    write(batch([("a", 1, 1), ("b", 5, 2)]), 0)
    write(batch([("a", 3, 7), ("b", 4, 9)]), 1)
    write(batch([("a", 3, 7), ("b", 4, 9)]), 1)  # run again after a fault
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t" / "version=1")).select("k", "at", "v").collect()} == {("a", 3, 7), ("b", 5, 2)}
