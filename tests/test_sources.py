"""File formats."""

import json

from cairn.sources import files, vector_tiles as mvt


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": "w1", "geometry": {"type": "LineString", "coordinates": [[51.0, 25.0], [51.5, 25.5]]}, "properties": {"kind": "road"}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-1.5, 2]}, "properties": {"id": "p9"}},
        {"type": "Feature", "geometry": None, "properties": {}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {}},
    ]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    (tmp_path / "b.geojson").write_text("no json")
    rows = {r["id"]: r for r in files.read_geojson(spark, str(tmp_path)).collect()}
    assert set(rows) == {"w1", "p9", "feature-3"}
    assert tuple(rows["w1"]["bbox"]) == (51.0, 25.0, 51.5, 25.5) and json.loads(rows["w1"]["properties"])["kind"] == "road"


OSM = """<osm><node id="1" lat="25.0" lon="51.0"/><node id="2" lat="25.1" lon="51.1"><tag k="barrier" v="gate"/></node><node id="3" lat="25.2" lon="51.0"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="highway" v="residential"/></way><way id="11"><nd ref="1"/><nd ref="99"/></way>
<relation id="5"><member type="way" ref="10" role="from"/><tag k="type" v="restriction"/></relation></osm>"""


def test_osm_xml(spark, tmp_path):
    (tmp_path / "a.osm").write_text(OSM)
    (tmp_path / "b.osm").write_text(OSM.replace('lat="25.0"', 'lat="26.0"').replace('id="3"', 'id="4"'))
    paths = [str(tmp_path / "a.osm"), str(tmp_path / "b.osm")]
    nodes, ways, relations = (files.read_osm_xml(spark, paths, e) for e in ("node", "way", "relation"))
    assert {r["id"]: r["lat"] for r in nodes.collect()} == {1: 25.0, 2: 25.1, 3: 25.2, 4: 25.2}
    lines = {r["id"]: r for r in files.assemble_ways(ways, nodes).collect()}
    assert set(lines) == {10} and lines[10]["closed"] and len(lines[10]["line"]) == 4 and lines[10]["tags"] == {"highway": "residential"}
    assert relations.where("tags['type'] = 'restriction'").count() == 1


def test_gpx(spark, tmp_path):
    good = '<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg><trkpt lat="25" lon="51"><time>2025-01-01T00:00:00Z</time><speed>3.5</speed></trkpt><trkpt lat="x" lon="51"/></trkseg><trkseg><trkpt lat="25.1" lon="51.1"><hacc>7</hacc></trkpt></trkseg></trk></gpx>'
    for name, text in {"a": good, "b": "<!DOCTYPE x><gpx/>", "c": "<gpx", "d": "<gpx/>", "e": '<gpx><wpt lat="1" lon="2"/></gpx>'}.items():
        (tmp_path / f"{name}.gpx").write_text(text)
    rows = files.read_gpx(spark, str(tmp_path)).collect()
    by = lambda n: [r for r in rows if r["file"].endswith(f"{n}.gpx")]
    assert [(r["segment"], r["seq"], r["t"], r["speed"], r["accuracy"]) for r in by("a")] == [(0, 0, 1735689600000, 3.5, None), (1, 0, None, None, 7.0)]
    assert all(by(n)[0]["error"] for n in "bcd") and by("e")[0]["lon"] == 2.0


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n\n{"a": 2, "b": 3}\n')
    rows, bad = files.read_lines(spark, str(tmp_path / "x.jsonl"), "a int")
    assert sorted(r["a"] for r in rows.collect()) == [1, 2] and bad.count() == 1
    assert files.read_lines(spark, str(tmp_path / "none.jsonl"), "a int")[0].count() == 0


def test_vector_tile_round_trip():
    features = [
        {"id": 7, "kind": "Point", "parts": [[(5, 9)]], "properties": {"name": "Café", "kind": "poi"}},
        {"id": "w1", "kind": "LineString", "parts": [[(0, 0), (-10, 4096), (300, 2)], [(1, 1), (2, 2)]], "properties": {}},
        {"id": 9, "kind": "Polygon", "parts": [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 2), (2, 4), (4, 4)]], "properties": {"kind": "poi"}},
    ]
    got = mvt.decode(mvt.encode_layer("a", features[:2]) + mvt.encode_layer("b", features[2:]))
    assert [(f["layer"], f["kind"], f["properties"]) for f in got] == [("a", "Point", {"name": "Café", "kind": "poi"}), ("a", "LineString", {}), ("b", "Polygon", {"kind": "poi"})]
    assert got[0]["parts"] == [[(5, 9)]] and got[1]["parts"] == features[1]["parts"] and got[1]["id"] == mvt.feature_hash("w1")
    assert got[2]["parts"] == [features[2]["parts"][0][:-1], features[2]["parts"][1]]


def test_damaged_and_empty_tiles(spark):
    good = mvt.encode_layer("a", [{"id": 1, "kind": "Point", "parts": [[(1, 1)]], "properties": {}}])
    rows = [(1, 0, 0, bytearray(good)), (1, 0, 1, bytearray(b"")), (1, 1, 0, bytearray(good[:-3])), (1, 1, 1, None)]
    got = {(r["x"], r["y"]): r["verdict"] for r in mvt.check_tiles(spark.createDataFrame(rows, "z int, x int, y int, tile binary")).collect()}
    assert got == {(0, 0): "valid", (0, 1): "empty", (1, 0): "bad", (1, 1): "empty"}


def test_clipping():
    assert mvt.clip_line([(-5.0, 5.0), (15.0, 5.0)], 0.0, 10.0) == [[(0.0, 5.0), (10.0, 5.0)]]
    assert mvt.clip_line([(-5.0, -5.0), (-1.0, 20.0)], 0.0, 10.0) == []
    ring = mvt.clip_ring([(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0)], 0.0, 10.0)
    assert set(ring) == {(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0)}
    assert mvt.clip_ring([(20.0, 20.0), (30.0, 20.0), (30.0, 30.0)], 0.0, 10.0) == []
