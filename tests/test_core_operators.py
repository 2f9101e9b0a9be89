"""Spatial, iterative, source, sink and stream operators against brute force and plain twins."""

import json
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kerbline.operators import access, iterate, spatial
from kerbline.sources import geojson, sinks
from kerbline.streaming import runs, windows


def _distance(px, py, x1, y1, x2, y2):
    d2 = (x2 - x1) ** 2 + (y2 - y1) ** 2
    t = 0 if d2 == 0 else max(0, min(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / d2))
    return math.hypot(px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1))


def test_distance_join_is_complete(spark):
    rng = np.random.default_rng(1)
    edges = [(i, *map(float, rng.integers(-300, 300, 4))) for i in range(60)] + [(60, 5.0, 5.0, 5.0, 5.0)]
    points = [(i, *map(float, rng.integers(-300, 300, 2))) for i in range(80)]
    e = spark.createDataFrame(edges, "e int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame(points, "p int, px double, py double")
    got = {(r["e"], r["p"]) for r in spatial.pairs_within(e, p, F.lit(40.0), 55.0).collect()}
    assert got == {(a[0], b[0]) for a in edges for b in points if _distance(*b[1:], *a[1:]) <= 40}
    assert spatial.pairs_within(e, p, F.lit(40.0), 55.0).count() == len(got)


def test_nearest_however_far(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 0.0)], "a int, ax double, ay double")
    b = spark.createDataFrame([(7, 3.0, 4.0), (8, -3.0, 4.0), (9, 9000.0, 0.0)], "b int, px double, py double")
    assert sorted((r["a"], r["b"], r["dist"]) for r in spatial.expanding_nearest(a, b, "a", "b", 10.0).collect()) == [(1, 7, 5.0), (2, 9, 4000.0)]


def test_nearest_beyond_twelve_doublings(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, -1e6, 0.0), (3, None, 0.0)], "a int, ax double, ay double")
    b = spark.createDataFrame([(7, 0.5, 0.0), (8, 0.0, 9e6), (9, None, None)], "b int, px double, py double")
    assert sorted((r["a"], r["b"], r["dist"]) for r in spatial.expanding_nearest(a, b, "a", "b", 1.0).collect()) == [(1, 7, 0.5), (2, 7, 1e6 + 0.5)]
    assert spatial.expanding_nearest(a, b.limit(0), "a", "b", 1.0).count() == 0


def test_intervals_merge(spark):
    df = spark.createDataFrame([("a", 0.0, 2.0), ("a", 1.0, 3.0), ("a", 3.0, 4.0), ("a", 6.0, 7.0), ("b", 0.0, 1.0)], "k string, lo double, hi double")
    assert sorted(tuple(r) for r in spatial.merged_intervals(df, ["k"]).collect()) == [("a", 0.0, 4.0), ("a", 6.0, 7.0), ("b", 0.0, 1.0)]


def _smooth_twin(rows):
    v = dict(rows)
    while True:
        new = {k: min(v[k - 1], v[k + 1]) if k - 1 in v and k + 1 in v and v[k] < min(v[k - 1], v[k + 1]) else v[k] for k in v}
        if new == v:
            return v
        v = new


def test_smoothing_reaches_the_fixed_point(spark):
    rng = np.random.default_rng(3)
    lines = {n: {k: float(rng.integers(1, 6) * 10) for k in range(12)} for n in range(8)}
    df = spark.createDataFrame([(f"{n}-{k}", n, k, v, 10.0, False) for n, line in lines.items() for k, v in line.items()], "id string, line int, k int, v double, length double, excluded boolean")
    out, rounds = iterate.smooth(df, key="id", line="line", place="k", value="v", length="length", most_length=250.0, excluded="excluded")
    assert rounds >= 1
    got = {(r["line"], r["k"]): r["v_smoothed"] for r in out.collect()}
    assert got == {(n, k): v for n, line in lines.items() for k, v in _smooth_twin(line).items()}


def test_greedy_leaders(spark):
    t0 = datetime(2024, 1, 1)
    pts = [(1, 0.0, 0.0, 3), (2, 0.8, 0.0, 1), (3, 1.6, 0.0, 2), (4, 9.0, 0.0, 4)]
    df = spark.createDataFrame([(i, x, y, t0 + timedelta(seconds=s)) for i, x, y, s in pts], "id long, px double, py double, first_seen timestamp")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r["id"]: r["leader"] for r in iterate.greedy_leaders(df, pairs).collect()} == {1: 2, 2: 2, 3: 2, 4: 4}


def _frechet_twin(a, b):
    seen = {}

    def go(i, j):
        if (i, j) not in seen:
            before = [go(x, y) for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0]
            seen[i, j] = max(math.dist(a[i], b[j]), min(before) if before else 0)
        return seen[i, j]

    return go(len(a) - 1, len(b) - 1)


def test_frechet_distance():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.normal(size=(rng.integers(1, 9), 2)), rng.normal(size=(rng.integers(1, 9), 2))
        assert math.isclose(iterate.frechet(a, b), _frechet_twin(a, b))


def test_partition_is_disjoint():
    spans = pd.DataFrame({"key": [1, 2, 3], "lo": [0.0, 8.0, 9.0], "hi": [10.0, 20.0, 19.0], "dist": [1.0, 2.0, 1.0]})
    out = iterate.midpoint_partition(spans)
    assert out[["key", "lo", "hi"]].to_numpy().tolist() == [[1, 0.0, 9.5], [3, 9.5, 19.0]]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    labels = {r["node"]: r["label"] for r in iterate.components(edges).collect()}
    assert labels == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    assert iterate.components(edges.limit(0)).count() == 0


def test_access_meaning(spark):
    rows = [("yes", "yes"), ("permit", "restricted"), ("use_sidepath", "no"), ("odd", "unknown"), (None, None)]
    df = spark.createDataFrame(rows, "v string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", access.meaning(F.col("v"))).collect())


def test_geojson_readers(spark, tmp_path):
    feature = lambda **p: {"type": "Feature", "properties": p, "geometry": {"type": "LineString", "coordinates": [[100.0, 13.0], [100.1, 13.1]]}}
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [
        feature(OBJECTID=1, SpeedLimit="50", MedianSpeed=40, F85thPercentileSpeed=55.5, AnalysisStatus="Valid"),
        feature(OBJECTID=2, SpeedLimit=0, MedianSpeed=0, F85thPercentileSpeed=0, AnalysisStatus="Valid", ExcludeFromSpeedSPI=1), feature(OBJECTID=3, SpeedLimit=None, AnalysisStatus="Odd"),
    ]}))
    df = geojson.read_segments(spark, str(path), "thailand")
    rows = {r["segment_id"]: r for r in df.collect()}
    assert rows["1"]["speed_limit"] == 50.0 and rows["2"]["data_quality_flag"] == "invalid_speed" and rows["3"]["speed_limit"] is None and rows["1"]["geometry"][1] == [100.1, 13.1]
    assert [r["segment_id"] for r in geojson.analysed(df).collect()] == ["1"]
    lines = tmp_path / "w.ndjson"
    lines.write_text("\x1e" + json.dumps(feature(**{"@id": 5, "highway": "trunk"})) + "\n\n")
    way = geojson.read_ways(spark, str(lines)).first()
    assert (way["osm_way_id"], way["highway"]) == (5, "trunk") and json.loads(way["tags"])["highway"] == "trunk"
    docs = spark.createDataFrame([('{"7": [{"id": "x", "object_value": "v"}, {"id": "y", "object_value": "w"}], "8": []}',)], "json string")
    assert sorted(tuple(r) for r in geojson.flatten_documents(docs).collect()) == [("7", "v", "x"), ("7", "w", "y")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "a"), (1, "b"), (3, "a")], "id int, kind string")
    path = sinks.write_by_class(df, "kind", path=str(tmp_path / "p"), rows_per_file=1)
    assert sorted(r["id"] for r in spark.read.parquet(path).filter("kind = 'a'").collect()) == [2, 3]
    sinks.write_list(df, str(tmp_path / "c"), "id")
    assert [r["id"] for r in spark.read.csv(str(tmp_path / "c"), header=True, inferSchema=True).collect()] == [1, 2, 3]


def test_streams_equal_tables(spark, tmp_path):
    t0 = pd.Timestamp("2024-01-01")
    events = pd.DataFrame({"event_id": range(200), "ts": [t0 + pd.Timedelta(minutes=7 * i) for i in range(200)], "event_type": ["a", "b"] * 100, "value": 1.0})
    spark.createDataFrame(events).repartition(3).write.parquet(str(tmp_path / "e"))
    table = spark.read.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "e"))
    query = windows.counted(stream, "1 hour", late="1 day").writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    want = sorted(map(str, windows.counted(table, "1 hour").collect()))
    assert sorted(map(str, spark.table("counted").collect())) == want


def test_run_events_fold(spark, tmp_path):
    rows = [("load", "running", 1), ("load", "done", 3), ("score", "running", 2), ("load", "done", 3)]
    table = spark.createDataFrame(rows, "step_id string, status string, seq long")
    assert {r["step_id"]: (r["status"], r["n_events"]) for r in runs.folded(table).collect()} == {"load": ("done", 3), "score": ("running", 1)}
    table.write.parquet(str(tmp_path / "r"))
    stream = runs.folded_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "r")))
    query = stream.writeStream.outputMode("update").format("memory").queryName("folded").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["step_id"], r["status"], r["seq"]) for r in spark.table("folded").collect()} == {("load", "done", 3), ("score", "running", 2)}
    assert [r["seq"] for r in runs.replayed(table, 1).collect()] == [2, 3, 3]
