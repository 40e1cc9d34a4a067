"""Signals along lines and on nodes of the roads."""

import pytest

from cairn.plans import guidance, routing
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("signals"))
    # about 201 m to the east, then north; metres of longitude at this latitude: 100,650 a degree
    lines = [("seg-a00001", "LINESTRING (51.2 25.2, 51.202 25.2, 51.202 25.203)", 50.0)]
    spark.createDataFrame(lines, "segment_id string, geom string, free_flow_kmh double").write.parquet(f"{path}/traffic_state.parquet")
    points = [("osm:n1", 51.2005, 25.2001), ("osm:n2", 51.20057, 25.2), ("osm:n3", 51.20064, 25.2), ("osm:n4", 51.20195, 25.2), ("osm:n5", 51.202, 25.203), ("osm:w6", 51.202, 25.2), ("osm:n7", 51.2005, 25.2006), ("osm:n8", 51.203, 25.3)]
    rows = [(k, lon, lat, "atm") for k, lon, lat in points] + [("osm:n9", 51.2, 25.2, "cafe")]
    spark.createDataFrame(rows, "osm_key string, lon double, lat double, category string").write.parquet(f"{path}/poi_osm.parquet")
    return path


def test_signals_merge_with_the_last_one_kept(spark, folder):
    got = sorted((r["along_m"], r["id"], r["approach_bearing"]) for r in guidance.m6_signals_on_path(spark, folder).collect())
    # n2 is 7 m after n1 and merged, n3 is 14 m after n1, the last kept; w6 is 5 m after n4; n4 looks 12 m ahead round the corner
    assert [(k, round(b)) for _, k, b in got] == [("osm:n1", 90), ("osm:n3", 90), ("osm:n4", 0), ("osm:n5", 0)]


def test_signals_on_nodes(spark, folder):
    key = lambda lon, lat: spark.range(1).select(routing.node_key(F.lit(lon), F.lit(lat))).first()[0]
    got = {r["node"]: (r["id"], r["source"]) for r in guidance.m7_signal_index(spark, folder).collect()}
    assert got == {key(51.202, 25.203): ("osm:n5", "osm:node:5"), key(51.202, 25.2): ("osm:w6", "signal:osm:w6")}
