"""Ranked search: neighbouring records of one place take one row."""

from cairn.plans import places


def test_copies_do_not_fill_the_answer(spark, tmp_path):
    osm = [(f"o{k:02d}", "Tarharthal", "cafe", None, None, 51.2 + k * 0.001, 25.3) for k in range(15)]  # 100 m apart, a chain of 1.5 km
    osm += [(f"far{k}", "Tarharthal", "cafe", None, None, 51.3 + k * 0.01, 25.3) for k in range(3)] + [("hall", "Tarharthal Hall", "cafe", None, None, 51.2, 25.3), ("near", "Tarharthal", None, None, None, 51.2, 25.32)]
    spark.createDataFrame(osm, "osm_key string, name string, category string, brand string, address string, lon double, lat double").write.parquet(f"{tmp_path}/poi_osm.parquet")
    spark.createDataFrame([("v", "Tarharthal", "hospital", None, "1 Street, Town", 51.2, 25.321, 0.9)], "overture_key string, name string, category string, brand string, address string, lon double, lat double, confidence double").write.parquet(f"{tmp_path}/poi_overture.parquet")
    rows = [r for r in places.c7_ranked_search(spark, str(tmp_path)).collect() if r["q"] == "tarharthal"]
    got = [r["key"] for r in sorted(rows, key=lambda r: r["rank"])]
    # the hospital is 111 m further off than the record without category, but of better quality
    assert got == ["o00", "v", "near", "far0", "far1", "far2", "hall"]
