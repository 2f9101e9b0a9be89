"""Operators whose earlier forms did not stand large tables, against those forms or brute force."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbline.functions import columns
from kerbline.operators import iterate, network, order, scoring, shapes, spatial, within, zones
from kerbline.plans import graph, relational
from kerbline.plans import spatial as plans_spatial


def _no_kernel(*_, **__):
    raise AssertionError("a kernel for each group")


def test_ranges_are_parted_in_one_walk(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(g), i, float(lo), float(lo + rng.integers(1, 30)), float(rng.integers(0, 4))) for i, (g, lo) in enumerate(zip(rng.integers(0, 60, 900), rng.integers(0, 90, 900), strict=True))]
    spans = pd.DataFrame(rows, columns=["parent_id", "key", "lo", "hi", "dist"]).sort_values(["parent_id", "lo", "hi", "key"])
    want = pd.concat([iterate.midpoint_partition(x) for _, x in spans.groupby("parent_id")])
    out = iterate.midpoint_partitions(spark.createDataFrame(spans), "parent_id", ["lo", "hi", "key"])
    assert sorted(map(tuple, out.collect())) == sorted(want.itertuples(index=False, name=None))
    monkeypatch.setattr(iterate, "midpoint_partition", _no_kernel)
    assert graph.q64(spark, "/root/testdata/sf0.001").count() > 0


def test_search_for_the_nearest_begins_at_the_spacing_of_points(spark, monkeypatch):
    radii, old = [], spatial.points_within
    monkeypatch.setattr(spatial, "points_within", lambda a, b, r: radii.append(r) or old(a, b, r))
    rng = np.random.default_rng(6)
    a, b = [(i, *map(float, x)) for i, x in enumerate(rng.integers(0, 1000, (40, 2)))], [(i, *map(float, x)) for i, x in enumerate(rng.integers(0, 1000, (2000, 2)))]
    one, two = spark.createDataFrame(a, "a int, ax double, ay double"), spark.createDataFrame(b, "b int, px double, py double")
    got = {r["a"]: (r["b"], r["dist"]) for r in spatial.expanding_nearest(one, two, "a", "b", 500.0).collect()}
    for i, x, y in a:
        dist, at = min((((x - px) ** 2 + (y - py) ** 2) ** 0.5, j) for j, px, py in b)
        assert got[i][0] == at and abs(got[i][1] - dist) < 1e-9
    assert radii[0] < 60


def test_kinds_are_found_without_pairs_where_cells_settle_them(spark, monkeypatch):
    rng = np.random.default_rng(7)
    edges = [(i, *map(float, rng.integers(-400, 400, 4))) for i in range(80)] + [(80, 5.0, 5.0, 5.0, 5.0)]
    points = [(["p", "q", "other"][i % 3], *map(float, rng.integers(-400, 400, 2))) for i in range(60)]
    e = spark.createDataFrame(edges, "e int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame(points, "kind string, px double, py double")

    def near(e, x, y, reach=60.0):
        d2 = (e[3] - e[1]) ** 2 + (e[4] - e[2]) ** 2
        t = 0 if d2 == 0 else max(0, min(1, ((x - e[1]) * (e[3] - e[1]) + (y - e[2]) * (e[4] - e[2])) / d2))
        return np.hypot(x - e[1] - t * (e[3] - e[1]), y - e[2] - t * (e[4] - e[2])) <= reach

    asked, old = [], spatial.pairs_within
    monkeypatch.setattr(spatial, "pairs_within", lambda a, *b: asked.append(a) or old(a, *b))
    got = {r["e"]: (r["is_p"], r["is_q"]) for r in spatial.kinds_within(e, p, "e", "kind", ("p", "q"), 60.0).collect()}
    assert got == {x[0]: tuple(any(near(x, *c[1:]) for c in points if c[0] == k) for k in "pq") for x in edges}
    around = spark.createDataFrame([(k, x, y) for x, y in {(a, b) for e in edges for a, b in [(e[1] + 1, e[2])]} for k in "pq"], "kind string, px double, py double")
    assert all(r["is_p"] and r["is_q"] for r in spatial.kinds_within(e, p.unionByName(around), "e", "kind", ("p", "q"), 60.0).collect())
    assert asked[1].count() < 20


def test_leaders_in_growing_batches(spark):
    rng = np.random.default_rng(8)
    pts = [(i, str(i % 2), *map(float, rng.integers(0, 60, 2)), int(rng.integers(0, 50))) for i in range(400)] + [(400, "0", None, None, 3)]
    want, leaders = {400: 400}, []
    for i, kind, x, y, t in sorted(pts[:-1], key=lambda r: (r[4], r[0])):
        want[i] = next((j for j, k, a, b in leaders if k == kind and (a - x) ** 2 + (b - y) ** 2 <= 100), i)
        if want[i] == i:
            leaders.append((i, kind, x, y))
    df = spark.createDataFrame(pts, "id long, kind string, px double, py double, first_seen long")
    assert {r["id"]: r["leader"] for r in iterate.leaders_within(df, "kind", 10.0, rows_per_range=40).collect()} == want


def test_first_class_puts_only_the_score_at_the_cut_in_order(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [("ab"[i % 2], "URBAN", f"s{i:04d}", float(rng.integers(0, 20)), None if i % 9 == 0 else float(rng.integers(0, 5)), float(rng.integers(1, 9))) for i in range(600)]
    rows += [("z", "RURAL", f"z{i}", 1.0, 1.0, 0.0) for i in range(3)] + [("a", "URBAN", "none", None, 1.0, 5.0)]
    df = spark.createDataFrame([(*r, None) for r in rows], "country string, land_use string, segment_id string, safety_score double, exp_delta_fatal_percent_uniform double, length_m double, data_quality_flag string")
    want = {r["segment_id"] for r in scoring.add_class(df).filter("priority_class = 'Top Priority'").collect()}
    counts, old = [], scoring.order.running
    monkeypatch.setattr(scoring.order, "running", lambda x, *a: counts.append(x.count()) or old(x, *a))
    assert {r["segment_id"] for r in scoring.first_class(df).collect()} == want and max(counts) < 100


def test_fields_of_large_ids_equal_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    ids = [0, 1, 7, 16_383, 2_912_000, 2_934_000, 5_999_999]
    t = pd.Timestamp("2024-01-01")
    events = pd.DataFrame({"event_id": ids, "ts": [t] * 7, "user_id": [1] * 7, "event_type": ["view"] * 7, "value": [1.0] * 7, "props": ['{"k": 3}'] * 7})
    spark.createDataFrame(events).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(relational.SQL["q49_field_normalise"])
    names = [c[0] for c in want.description]
    got = relational.QUERIES["q49_field_normalise"](spark, str(tmp_path)).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_only_possible_humps_ask_for_neighbours(spark):
    rng = np.random.default_rng(9)
    rows = [(f"{n}-{k}", float(rng.choice([30, 50, 50, 70])), bool(rng.random() < 0.2), 60.0 * k, 500.0 * n, 60.0 * (k + 1), 500.0 * n) for n in range(8) for k in range(12)]
    df = spark.createDataFrame(rows, "id string, v double, fixed boolean, x1 double, y1 double, x2 double, y2 double")
    free = ~F.col("fixed")
    some, sides = network.possible_humps(df, "id", "v", free)
    every = network.touching(df, "id"), network.along(network.continuing(df, "id"), "id")
    assert some.select("id").distinct().count() < sum(not r[2] for r in rows) * 2 / 3
    few, all_ = [{r["id"]: r["v_lowered"] for r in network.lower_humps(df, *x, key="id", value="v", eligible=free)[0].collect()} for x in ((some, sides), every)]
    assert few == all_ and all_ != {r[0]: r[1] for r in rows}


def test_places_are_rounded_as_in_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(10)
    values = [0.0, 1.0, *((rng.integers(0, 10**9, 500) + 0.5) / 1e9).tolist(), *rng.random(500).tolist()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 9)", [x]).fetchone()[0] for x in values]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double").orderBy("i")
    assert [r["y"] for r in df.select(columns.rounded(F.col("x"), 9).alias("y")).collect()] == want
    assert [r["y"] for r in df.select(F.round("x", 9).alias("y")).collect()] != want


def test_points_around_are_counted_without_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    ends = [tuple(map(float, x)) for x in rng.integers(-300, 300, (60, 4))]
    short = [(x, y, float(x + a), float(y + b)) for (x, y, *_), (a, b) in zip(ends, rng.integers(-40, 40, (60, 2)).tolist(), strict=True)]
    short += [(x, y, x + 30, y) for x, y, *_ in ends[:20]] + [(x, y, x, y - 30) for x, y, *_ in ends[:20]] + [(5.0, 5.0, 5.0, 5.0), (0.0, 0.0, 1e-9, 7.0), (0.0, 0.0, 7.0, 1e-9)]
    radii = [50.0, 90.0]
    edges = [(i, *e, radii[i % 2]) for i, e in enumerate(short)] + [(900, None, 0.0, 1.0, 1.0, 50.0), (901, 0.0, 0.0, 1.0, 1.0, None), (902, 0.0, float("nan"), 1.0, 1.0, 50.0)]
    points = [(["p", "q", "other", None][i % 4], *map(float, rng.integers(-350, 350, 2))) for i in range(700)] + [("q", None, 1.0), ("p", float("inf"), 0.0), ("p", 5.0, 55.0)]
    shape, seen = "e int, x1 double, y1 double, x2 double, y2 double, r double", "kind string, px double, py double"
    p = spark.createDataFrame(points, seen)

    def want(e):
        _, x1, y1, x2, y2, r = e
        near = [k for k, px, py in points if None not in (px, py, *e) and _apart(px, py, x1, y1, x2, y2) <= r]
        return "p" in near, "q" in near, len(near), len({*near} - {None})

    def got(rows):
        return {r["e"]: tuple(r[c] for c in ("is_p", "is_q", "poi_count", "poi_category_count")) for r in within.counts_around(spark.createDataFrame(rows, shape), p, "e", "kind", ("p", "q"), F.col("r"), radii).collect()}

    far = [(i, *e, radii[i % 2]) for i, e in enumerate(ends, 1000)] + [(2000, 2e12, 0.0, 2e12, 1.0, 50.0)]
    assert got(edges + far) == {e[0]: want(e) for e in edges + far}
    monkeypatch.setattr(spatial, "pairs_within", _no_kernel)
    assert got(edges) == {e[0]: want(e) for e in edges}
    assert plans_spatial.q21(spark, "/root/testdata/sf0.001").count() > 0


def _apart(px, py, x1, y1, x2, y2):
    d2 = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    t = 0.0 if d2 == 0 else max(0.0, min(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / d2))
    x, y = px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1)
    return (x * x + y * y) ** 0.5


def test_rows_of_cells_agree_with_all_pairs():
    rng = np.random.default_rng(12)
    for i in range(40):
        side, r = float(rng.choice([1, 100, 1500])), float(rng.choice([5, 200]))
        px, py = np.round(rng.random((2, 800)) * side, i % 3)
        x1, y1 = np.round(rng.random((2, 30)) * side * 1.2, i % 3)
        dx, dy = np.round(rng.normal(size=(2, 30)) * 60, i % 3) * np.array([[(1, 0, 1, 1e-9)[i % 4]], [(1, 1, 0, 1)[i % 4]]])
        want = [sum(_apart(*q, *e) <= r for q in zip(px, py, strict=True)) for e in zip(x1, y1, x1 + dx, y1 + dy, strict=True)]
        assert within.Rows(px, py, r).count(x1, y1, x1 + dx, y1 + dy).tolist() == want


def _dense(line, step=5.0):
    xy = np.array(line, float)
    out = [xy[:1]]
    for a, b in zip(xy[:-1], xy[1:], strict=True):
        n = max(1, int(np.ceil(np.hypot(*(b - a)) / step)))
        out.append(a + (b - a) * (np.arange(1, n + 1) / n)[:, None])
    return np.concatenate(out)


def test_like_shapes_are_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(13)
    lines = [(rng.integers(-60, 60, 2) + np.cumsum(rng.integers(-25, 26, (rng.integers(1, 6), 2)), axis=0)).tolist() for _ in range(70)]
    lines += [[[x + 20 * k, y] for k in range(n)] for x, y, n in rng.integers(1, 50, (30, 3)).tolist()]
    lines = [[(float(x), float(y)) for x, y in line] for line in lines]
    want = {}
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[i + 1 :], i + 1):
            if np.hypot(a[0][0] - b[0][0], a[0][1] - b[0][1]) <= 20 and (v := iterate.frechet(_dense(a), _dense(b))) <= 60:
                want[i, j] = v
    odd = [(200, None), (201, []), (202, [(0.0, 0.0), (None, 1.0)]), (203, [(0.0, 0.0), (float("nan"), 1.0)])]
    df = spark.createDataFrame([*enumerate(lines), *odd], "id long, line array<struct<x: double, y: double>>")
    got = {(r["a"], r["b"]): r["frechet"] for r in shapes.frechet_within(df, "id", "line", 20.0, 60.0).collect()}
    assert got == want and len(want) > 100
    assert shapes.frechet_within(df.limit(0), "id", "line", 20.0, 60.0).count() == 0
    # few pairs at a time give the same
    monkeypatch.setattr(shapes, "PAIRS", 7)
    monkeypatch.setattr(shapes, "BLOCK", 50)
    rows = pa.table({"_key": list(range(len(lines))), "_line": pa.array([[{"x": x, "y": y} for x, y in line] for line in lines]), "_home": [True] * len(lines)})
    few = pa.Table.from_batches(shapes._matched(20.0, 60.0, 5.0)(iter(rows.to_batches()))).to_pylist()
    assert {(r["a"], r["b"]): r["frechet"] for r in few} == want


def test_straight_lines_need_no_table_of_gaps(monkeypatch):
    rng, asked, old = np.random.default_rng(14), [], shapes.Lines.frechet
    monkeypatch.setattr(shapes.Lines, "frechet", lambda self, a, b: asked.append(len(a)) or old(self, a, b))
    lines = [[{"x": float(x + 60 * k * (i % 2)), "y": float(y + 60 * k * (1 - i % 2))} for k in range(n)] for i, (x, y, n) in enumerate(zip(*rng.integers(0, 90, (2, 200)).tolist(), rng.integers(1, 8, 200).tolist(), strict=True))]
    rows = pa.table({"_key": list(range(200)), "_line": pa.array(lines), "_home": [True] * 200})
    found = pa.Table.from_batches(shapes._matched(100.0, 150.0, 5.0)(iter(rows.to_batches())))
    assert found.num_rows > 3000 and sum(asked) < found.num_rows / 10


def _zone(edge, points, radius, share):
    _, x1, y1, x2, y2 = edge
    d2, spans = (x2 - x1) ** 2 + (y2 - y1) ** 2, []
    for px, py in points if d2 else ():
        b = ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / d2
        h2 = b * b - ((px - x1) ** 2 + (py - y1) ** 2 - radius * radius) / d2
        lo, hi = (max(0.0, b - h2**0.5), min(1.0, b + h2**0.5)) if h2 > 0 else (1.0, 0.0)
        if hi > lo:
            spans.append((lo, hi))
    runs = []
    for lo, hi in sorted(spans):
        runs[-1:] = [(runs[-1][0], max(runs[-1][1], hi))] if runs and lo <= runs[-1][1] else [*runs[-1:], (lo, hi)]
    if sum(hi - lo for lo, hi in runs) >= share:
        return [(0.0, 1.0, True)]
    ends = [0.0, *[x for run in runs for x in run], 1.0]
    return [(lo, hi, i % 2 == 1) for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if hi > lo] if runs else []


def test_zones_cut_edges_without_all_pairs(spark, monkeypatch):
    rng, tried = np.random.default_rng(15), []
    edges = [(f"e{i}", float(x), float(y), float(x + a), float(y + b)) for i, (x, y, a, b) in enumerate(zip(*rng.integers(-500, 500, (2, 700)), *rng.integers(-60, 61, (2, 700)), strict=True))]
    edges += [("level", 10.0, 10.0, 70.0, 10.0), ("point", 5.0, 5.0, 5.0, 5.0), ("far", 9000.0, 9000.0, 9060.0, 9000.0)]
    # dense in one half, sparse in the other, some in the same place
    points = [tuple(map(float, x)) for x in [*rng.integers([-500, -500], [0, 500], (900, 2)), *rng.integers([0, -500], [500, 500], (60, 2))]]
    points += points[:20] + [(9010.0, 9005.0)]
    want = {(e[0], k + 1, *p) for e in edges for k, p in enumerate(_zone(e, points, 40.0, 0.8))}
    old = zones.Circles.proved
    monkeypatch.setattr(spatial, "pairs_within", _no_kernel)
    odd = [("none", None, 0.0, 1.0, 1.0), ("nan", 0.0, float("nan"), 1.0, 1.0), edges[0], edges[0]]
    e = spark.createDataFrame(edges + odd, "id string, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([*points, (None, 1.0), (float("inf"), 0.0)], "px double, py double")
    out = [tuple(r) for r in zones.zone_pieces(e, p, "id", 40.0, 60.0, 0.8).collect()]
    assert len(out) == len(want) and {x[:2] + x[4:] for x in out} == {x[:2] + x[4:] for x in want}
    assert np.allclose([x[2:4] for x in sorted(out)], [x[2:4] for x in sorted(want)], rtol=0, atol=1e-12)
    assert zones.zone_pieces(e, p.limit(0), "id", 40.0, 60.0, 0.8).count() == 0 == zones.zone_pieces(e.limit(0), p, "id", 40.0, 60.0, 0.8).count()
    assert plans_spatial.q29(spark, "/root/testdata/sf0.001").count() > 0
    # where points are dense, few edges need all of them
    dense = zones.Circles(*np.array(points[:900]).T, 40.0)
    monkeypatch.setattr(zones.Circles, "proved", lambda self, *a: tried.append(old(self, *a)) or tried[-1])
    ends = np.array([x[1:] for x in edges[:700] if -400 < x[1] < -100]).T
    ends = ends[:, (ends[0] != ends[2]) | (ends[1] != ends[3])]
    first = dense.pieces(*ends, 0.8)
    assert tried[0].mean() > 0.4
    monkeypatch.setattr(zones.Circles, "proved", lambda self, x1, *_: np.zeros(len(x1), bool))
    assert all(np.array_equal(a, b) for a, b in zip(first, dense.pieces(*ends, 0.8), strict=True))


def test_an_edge_too_long_for_its_tile_is_an_error(spark):
    e = spark.createDataFrame([("a", 0.0, 0.0, 61.0, 0.0)], "id string, x1 double, y1 double, x2 double, y2 double")
    with pytest.raises(Exception, match="longer than"):
        zones.zone_pieces(e, spark.createDataFrame([(0.0, 0.0)], "px double, py double"), "id", 40.0, 60.0, 0.8).collect()


def test_sums_at_the_limit_are_added_in_the_order_of_rows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from pyarrow import parquet

    for name in ("customer", "orders", "lineitem"):
        parquet.write_table(parquet.read_table(f"/root/testdata/sf0.01/{name}.parquet"), str(tmp_path / f"{name}.parquet"), row_group_size=4000)
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for name in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(graph.SQL["q69_object_raise"]).fetchall()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        got = graph.q69(spark, str(tmp_path)).select("segment_id", "v_safe", "raised").collect()
        tasks = spark.read.parquet(str(tmp_path / "lineitem.parquet")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert tasks > 4 and sorted(map(tuple, got)) == sorted(want)
    rows = [("a", i, v) for i, v in enumerate([0.05, 0.07, 0.08])] + [("b", i, v) for i, v in enumerate([0.1, 0.06, 0.04])] + [("none", 0, None), ("nan", 0, float("nan")), (None, 0, 1.0), ("big", 0, 9.0), ("odd", 0, 1e308), ("odd", 1, 1e308), ("odd", 2, -1e308)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(5)
    out = {r["k"]: (r["reached"], r["n"]) for r in order.sums_reaching(df, "k", "v", ["i"], 0.2, n=F.count("i")).collect()}
    assert out == {"a": (0.05 + 0.07 + 0.08 >= 0.2, 3), "b": (0.1 + 0.06 + 0.04 >= 0.2, 3), "none": (None, 1), "nan": (True, 1), "big": (True, 1), "odd": (True, 3)}
