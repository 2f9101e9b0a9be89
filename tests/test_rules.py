"""Repairs, tags, parameters, reports and the network against plain twins."""

import difflib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.operators import checks, enrich, network


def test_access_control_raises(spark):
    rows = [
        ("mapped", True, "primary", 10.0, None, None, None), ("fast", False, "motorway", 50.0, None, None, None), ("slow", False, "motorway", 49.9, None, None, None), ("closed", None, "primary", None, "no", "no", "medium"),
        ("untagged", False, "primary", None, "no", "no", "low"), ("cyclists", False, "primary", None, "no", "yes", "high"), ("fast and closed", False, "motorway", 60.0, "no", "no", "high"),
    ]
    df = spark.createDataFrame(rows, "id string, is_access_controlled boolean, road_class string, f85_speed double, legal_foot string, legal_bicycle string, legal_foot_confidence string")
    got = {r["id"]: (r["is_access_controlled"], r["access_control_basis"]) for r in enrich.add_access_control(df).collect()}
    assert got == {
        "mapped": (True, "osm_motorroad"), "fast": (True, "overture_motorway_fallback"), "slow": (False, None), "closed": (True, "osm_vru_prohibited"), "untagged": (False, None), "cyclists": (False, None),
        "fast and closed": (True, "overture_motorway_fallback"),
    }
    assert not enrich.add_access_control(spark.createDataFrame([("x", False, "motorway")], "id string, is_access_controlled boolean, road_class string")).first()["is_access_controlled"]


def test_repairs(spark):
    rows = [("whole", "invalid_speed", 0.0, 0.0, 0.0, 50.0, 40.0, 48.0), ("half", "invalid_speed", 0.0, 0.0, 0.0, None, 40.0, 48.0), ("sound", None, 60.0, 50.0, 55.0, 70.0, 10.0, 11.0), ("zero", "invalid_speed", 0.0, 0.0, 0.0, 50.0, 0.0, 48.0)]
    df = spark.createDataFrame(rows, "id string, data_quality_flag string, speed_limit double, median_speed double, f85_speed double, tomtom_speed_limit double, tomtom_median_speed double, tomtom_p85_speed double")
    out = {r["id"]: r for r in enrich.clear_repaired(enrich.backfill_speeds(enrich.override_limit(df))).collect()}
    assert {k: (r["data_quality_flag"], r["speed_limit"], r["median_speed"], r["f85_speed"]) for k, r in out.items()} == {
        "whole": (None, 50.0, 40.0, 48.0), "half": ("invalid_speed", 0.0, 40.0, 48.0), "sound": (None, 70.0, 50.0, 55.0), "zero": ("invalid_speed", 50.0, 0.0, 0.0),
    }
    assert out["whole"]["speed_limit_backfilled"] and not out["sound"]["speed_limit_backfilled"] and out["sound"]["speed_limit_adb"] == 60.0


def test_frames_are_completed(spark):
    df = spark.createDataFrame([(1, None), (2, "yes")], "id int, a string")
    assert enrich.ensure_columns(df, {"a": ("string", "x")}) is df
    out = enrich.fill_unmatched(enrich.ensure_columns(df, {"b": ("double", 1.0)}), {"a": "unknown"})
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, "unknown", 1.0), (2, "yes", 1.0)]


@pytest.mark.parametrize("given", [{"radius": 0}, {"radius": 10.5}, {"rad": 3}, {"radius": True}, {"radius": float("nan")}, {"radius": "9"}])
def test_parameters_are_checked(given):
    with pytest.raises(ValueError):
        enrich.checked(given, {"radius": (1, 500, True)})
    assert enrich.checked({"radius": 30.0}, {"radius": (1, 500, True)}) == {"radius": 30}


def test_cover_and_reports(spark, tmp_path):
    need, have = spark.createDataFrame([(1, 1), (2, 2)], "x int, y int"), spark.createDataFrame([(1, 1)], "x int, y int")
    assert checks.covered(need.filter("x = 1"), have, "x", "y").count() == 1
    with pytest.raises(ValueError, match=r"\(2, 2\)"):
        checks.covered(need, have, "x", "y")
    report = checks.basis_report(spark.createDataFrame([("a", 1000.0), ("a", 500.0), (None, 500.0)], "basis string, m double"), "basis", "m")
    checks.write_report(report.orderBy("basis"), f"{tmp_path}/r.json")
    assert json.load(open(f"{tmp_path}/r.json")) == [{"basis": "a", "n": 2, "km": 1.5, "share": 0.75}, {"basis": "none", "n": 1, "km": 0.5, "share": 0.25}]
    with pytest.raises(ValueError):
        checks.write_report(report, f"{tmp_path}/r.json", most=1)


def test_narrowing_and_codes(spark):
    df = spark.createDataFrame([(1, 1 << 40, None, "a"), (-2, 3, None, "zz")], "small long, large long, none long, name string")
    assert dict(checks.narrowed(df).dtypes) == {"small": "int", "large": "bigint", "none": "int", "name": "string"}
    words = spark.createDataFrame([("a", 0), ("b", 1)], "value string, code int")
    assert {r["name"]: r["name_code"] for r in checks.encoded(df, words, "name").collect()} == {"a": 0, "zz": -1}


def test_name_similarity(spark):
    rows = [("central school", ["centralschool", "market"]), ("", ["x"]), (None, ["x"]), ("x", []), ("x", None)]
    out = spark.createDataFrame(rows, "a string, b array<string>").select(checks.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert math.isclose(out[0]["s"], difflib.SequenceMatcher(None, "central school", "centralschool").ratio()) and [r["s"] for r in out[1:]] == [None] * 4


def test_migration_finds_no_difference(spark):
    df = spark.range(2000).select("id", F.col("id").cast("string").alias("s"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("x"))
    out = checks.migrated(df, "test-migrated", share=0.2).first()
    assert out["n_rows"] == 2000 and 200 < out["n_compared"] < 600 and out["n_differ"] == 0


def _twin_lower(speed, touching, along, eligible):
    speed, rounds, lowered = dict(speed), 0, set()
    while True:
        moves = {i: max(speed[j] for j in along[i]) for i in speed if i in along and eligible[i] and touching.get(i) and max(speed[j] for j in touching[i]) < speed[i]}
        if not moves:
            return speed, rounds, lowered
        speed.update(moves)
        lowered |= set(moves)
        rounds += 1


def test_humps_are_lowered_and_joined(spark):
    rng = np.random.default_rng(4)
    rows = []
    for line in range(6):
        for k in range(12):
            rows.append((f"{line}-{k}", f"p{line}", float(rng.choice([30, 50, 70])), 60.0, bool(rng.random() < 0.1), 60.0 * k, 500.0 * line, 60.0 * (k + 1), 500.0 * line))
    df = spark.createDataFrame(rows, "id string, parent string, v double, length double, fixed boolean, x1 double, y1 double, x2 double, y2 double")
    touched, neighbours = network.touching(df, "id"), network.along(network.continuing(df, "id"), "id")
    speed, eligible = {r[0]: r[2] for r in rows}, {r[0]: not r[4] for r in rows}
    near = {f"{n}-{k}": {f"{n}-{j}" for j in (k - 1, k + 1) if 0 <= j < 12} for n in range(6) for k in range(12)}
    assert {(r["id"], r["other"]) for r in touched.collect()} == {(i, j) for i, js in near.items() for j in js}
    sides = {i: sorted(js, key=lambda x: int(x.split("-")[1])) for i, js in near.items() if len(js) == 2}
    assert {r["id"]: [r["before"], r["after"]] for r in neighbours.collect()} == sides
    lowered, rounds = network.lower_humps(df, touched, neighbours, key="id", value="v", eligible=~F.col("fixed"))
    want, want_rounds, humps = _twin_lower(speed, near, sides, eligible)
    got = lowered.collect()
    assert ({r["id"]: r["v_lowered"] for r in got}, rounds, {r["id"] for r in got if r["is_hump"]}) == (want, want_rounds, humps)
    joined = network.join_humps(lowered, neighbours, key="id", parent="parent", value="v_lowered", length="length").collect()
    assert sum(r["n_pieces"] for r in joined) == len(rows) and math.isclose(sum(r["length"] for r in joined), 60.0 * len(rows))
    assert len(joined) < len(rows) and all(r["length"] == 60.0 * r["n_pieces"] for r in joined)


def test_rings_are_cut_at_the_widest_gap(spark):
    def twin(at, length):
        if len(at) < 2:
            return at
        s = sorted(x % length for x in at)
        gaps = [b - a for a, b in zip(s, [*s[1:], s[0] + length])]
        cut = s[(gaps.index(max(gaps)) + 1) % len(s)]
        return [x % length + length if x % length < cut else x % length for x in at]

    rng = np.random.default_rng(9)
    rings = {r: [float(x) for x in rng.integers(0, 300, int(rng.integers(1, 9)))] for r in range(20)}
    df = spark.createDataFrame([(r, i, x, 250.0) for r, xs in rings.items() for i, x in enumerate(xs)], "r int, i int, x double, len double")
    got = {(r["r"], r["i"]): r["unwrapped"] for r in network.unwrapped(df, "r", "x", "len").collect()}
    assert got == {(r, i): v for r, xs in rings.items() for i, v in enumerate(twin(xs, 250.0))}


def test_access_by_tags_class_and_country(spark):
    from kerbline.operators import access

    rows = [("thailand", "motorway", None, None), ("maharashtra", "motorway", None, None), ("thailand", "primary", "No", None), ("thailand", "primary", "no", "designated"), ("thailand", "raceway", None, None), ("thailand", "path", None, None)]
    df = spark.createDataFrame([(i, *r, None, None, None, None) for i, r in enumerate(rows)], "i int, country string, highway string, access string, motorcycle string, vehicle string, motor_vehicle string, foot string, bicycle string")
    out = {r["i"]: r for r in access.add_access(df).collect()}
    assert [tuple(out[i][f"legal_motorcycle{x}"] for x in ("", "_basis", "_confidence")) for i in range(5)] == [
        ("no", "default:thailand", "low"), ("yes", "default:base", "low"), ("no", "tag:access", "medium"), ("yes", "tag:motorcycle", "high"), ("unknown", "default:unknown_highway", "low"),
    ]
    assert out[5]["legal_bicycle_basis"] == "default:incomplete_base" and out[3]["legal_motor_vehicle"] == "no"


def test_catalogues(spark, tmp_path):
    from kerbline.sources import catalogs

    good = tmp_path / "w.csv"
    good.write_text("object,b,c,d,foot,bike\nsign,,,,0.5,\nbench,,,,0,0\nramp,,,,1,0.25\n")
    assert sorted(map(tuple, catalogs.read_weights(spark, str(good)).collect())) == [("ramp", 1.0, 0.25), ("sign", 0.5, 0.0)]
    for bad in ("sign,,,,2,0", "sign,,,,x,0", "sign,,,,0.1,0\nsign,,,,0.2,0"):
        path = tmp_path / "bad.csv"
        path.write_text(f"object,b,c,d,foot,bike\n{bad}\n")
        with pytest.raises(Exception, match="weight|twice"):
            catalogs.read_weights(spark, str(path)).collect()
    folder = tmp_path / "d"
    folder.mkdir()
    feature = lambda i, v: {"id": "x", "properties": {"image_id": i, "object_value": v}}
    (folder / "s1.geojson").write_text(json.dumps({"features": [feature("i1", "bench"), feature("i1", "sign"), feature("i2", "ramp")]}))
    (folder / "s2.geojson").write_text(json.dumps({"features": [feature("i2", "bench")]}))
    (folder / "s3.geojson").write_text(json.dumps({"features": []}))
    rows, segments = catalogs.read_detections(spark, str(folder))
    assert sorted(map(tuple, rows.collect())) == [("i1", "bench", "s1"), ("i2", "ramp", "s1")] and {r["segment_id"] for r in segments.collect()} == {"s1", "s2", "s3"}
    spark.range(3).write.parquet(f"{tmp_path}/p/a_part1.parquet")
    spark.range(3, 5).write.parquet(f"{tmp_path}/p/a_part2.parquet")
    assert catalogs.read_parts(spark, f"{tmp_path}/p", columns=["id"]).count() == 5
    with pytest.raises(FileNotFoundError):
        catalogs.read_parts(spark, f"{tmp_path}/p", "*_none*.parquet")


def test_tags_stamps_and_curves(spark):
    from kerbline.sources import catalogs

    row = spark.sql("SELECT map('a', '1', 'b', '2') AS m, map('b', CAST(NULL AS STRING), 'c', '3') AS p, TIMESTAMP '2024-01-02 03:04:05' AS t, 800D AS x")
    out = row.select(
        catalogs.merged_tags(F.col("m"), F.col("p")).alias("m"), catalogs.iso_stamp(F.col("t")).alias("t"), catalogs.logistic(F.col("x")).alias("one"), catalogs.logistic(-F.col("x")).alias("none"), catalogs.logit(catalogs.logistic(F.lit(1.5))).alias("back")
    ).first()
    assert out["m"] == {"a": "1", "c": "3"} and out["t"] == "2024-01-02T03:04:05Z" and out["one"] == 1.0 and 0 <= out["none"] < 1e-300 and math.isclose(out["back"], 1.5, rel_tol=1e-6)
