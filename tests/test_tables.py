"""States, side inputs, pairs, tiles, analyses and diagnostics against plain computations."""

import json
import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsq.operators import pairs, variational
from obsq.plans import config, diagnostics
from obsq.sources import states


def problem(spark, extra=()):
    r = random.Random(5)
    cells = [(i, r.uniform(-5, 5), r.uniform(0.5, 3)) for i in range(12)]
    obs = [(j, r.uniform(-5, 5), r.uniform(0.5, 2)) for j in range(20)]
    weights = [(j, c, r.uniform(0.1, 1)) for j in range(20) for c in r.sample(range(11), 3)]
    tables = (
        spark.createDataFrame(cells, "cell long, background double, variance double"),
        spark.createDataFrame([*obs, *extra], "obs_id long, observed double, variance double"),
        spark.createDataFrame([*weights, *((e[0], 99, 1.0) for e in extra)], "obs_id long, cell long, weight double"),
    )
    return cells, obs, weights, tables


def test_minimum_is_that_of_dense_algebra(spark):
    """Observations without a value, or with a cell that isn't there, don't count."""
    cells, obs, weights, tables = problem(spark, extra=[(50, None, 1.0), (51, 3.0, 1.0)])
    found = variational.minimise(*tables, reduction=1e-10)
    h = np.zeros((20, 12))
    for j, c, w in weights:
        h[j, c] += w
    xb, b = np.array([c[1] for c in cells]), np.diag([c[2] for c in cells])
    y, r = np.array([o[1] for o in obs]), np.diag([o[2] for o in obs])
    want = xb + b @ h.T @ np.linalg.solve(h @ b @ h.T + r, y - h @ xb)
    got = {x["cell"]: x["analysis"] for x in found.state.collect()}
    assert np.allclose([got[i] for i in range(12)], want, atol=1e-7)
    assert got[11] == xb[11] and 0 < found.iterations <= 14 and found.reduction <= 1e-10
    at = lambda c: variational.cost(*tables, found.state.select("cell", F.col(c).alias("x"))).first()
    before, after = at("background"), at("analysis")
    assert before["jb"] == 0 and after["j"] < before["j"] and math.isclose(after["j"], after["jb"] + after["jo"])


def test_minimise_stops_and_takes_empty_tables(spark):
    *_, (cells, obs, weights) = problem(spark)
    assert variational.minimise(cells, obs, weights, ninner=2, reduction=1e-10).iterations == 2
    nothing = variational.minimise(cells, obs.limit(0), weights)
    assert nothing.iterations == 0 and nothing.state.where("analysis <> background OR analysis IS NULL").count() == 0
    assert variational.minimise(cells.limit(0), obs, weights).state.count() == 0


def test_adjoint_is_the_transpose(spark):
    *_, (cells, obs, weights) = problem(spark)
    x = cells.select("cell", F.col("background").alias("x"))
    y = obs.select("obs_id", F.col("observed").alias("y"))
    forward = variational.applied(weights, x).withColumnRenamed("y", "hx").join(y, "obs_id").agg(F.sum(F.col("hx") * F.col("y"))).first()[0]
    back = variational.adjoint(weights, y).withColumnRenamed("x", "hty").join(x, "cell").agg(F.sum(F.col("hty") * F.col("x"))).first()[0]
    assert math.isclose(forward, back, rel_tol=1e-12)


def test_a_halo_holds_what_is_within_the_radius(spark):
    r = random.Random(4)
    places = [(i, r.uniform(-180, 360), math.degrees(math.asin(r.uniform(-1, 1)))) for i in range(250)]
    places += [(900, 0.0, 90.0), (901, 180.0, -90.0), (902, 359.999, 0.0), (903, 0.0, 0.0), (904, None, 1.0), (905, 30.0, 30.0)]
    radius = 900.0
    rows = pairs.halo(spark.createDataFrame(places, "k long, lon double, lat double"), "lon", "lat", 30, radius).collect()
    held = {}
    for x in rows:
        held.setdefault((x.tile_x, x.tile_y), set()).add(x.k)
    own = {x.k: (x.tile_x, x.tile_y) for x in rows if not x.ghost}
    assert set(own) == {p[0] for p in places if p[1] is not None}
    assert len(rows) == len({(x.k, x.tile_x, x.tile_y) for x in rows})

    def far(a, b):
        x, y = (math.radians(v) for v in (a[1], b[1]))
        p, q = (math.radians(v) for v in (a[2], b[2]))
        s = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((x - y) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(s)))

    real = [p for p in places if p[1] is not None]
    for a in real:
        assert {b[0] for b in real if far(a, b) <= radius} <= held[own[a[0]]]
    with pytest.raises(ValueError):
        pairs.halo(spark.createDataFrame(places, "k long, lon double, lat double"), "lon", "lat", 7, radius)


def test_rows_are_dealt_out_evenly(spark):
    sizes = pairs.round_robin(spark.range(0, 400, 1, 3), 5).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 5 and max(s["count"] for s in sizes) <= 90


def test_positions_that_agree_aren_t_apart(spark):
    a = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, None), (3, None, None), (4, 0.0, 0.0)], "k long, lon double, lat double")
    b = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 5.0), (3, None, None), (9, 0.0, 0.0)], "k long, lon double, lat double")
    assert [r.k for r in pairs.apart(a, b, ["k"], "lon", "lat").collect()] == [2]


def test_restart_files_are_read_as_they_were_written(spark, tmp_path):
    rows = [(c, v, f, float(c * 10 + v)) for c in range(3) for v in (1, 2) for f in ("T", "u", "o3")] + [(7, 1, "T", None)]
    state = spark.createDataFrame(rows, "cell long, level int, field string, value double")
    files = {k: str(tmp_path / k) for k in ("core", "tracers")}
    fields = {"core": ["T", "u"], "tracers": ["o3"]}
    states.write_restart(state, files, fields)
    back = states.read_restart(spark, files, fields).where("value IS NOT NULL")
    assert sorted(map(tuple, back.collect())) == sorted(r for r in rows if r[3] is not None)
    with pytest.raises(KeyError):
        states.read_restart(spark, files, {"surface": ["ps"]})


def test_streams_read_what_their_list_names(spark, tmp_path):
    names = states.stream_variables("theta\n\n# winds\nu  # zonal\ntheta\n")
    assert names == ["theta", "u"]
    at, template = datetime(2024, 5, 27, 6), str(tmp_path / "bg.$Y-$M-$D_$h.$m.$s")
    df = spark.createDataFrame([(1, 1, 300.0, 2.0, 9.0)], "cell long, level int, theta double, u double, v double")
    states.write_stream(df, template, at, ["theta", "u", "v"])
    assert (tmp_path / "bg.2024-05-27_06.00.00").exists()
    got = states.read_stream(spark, template, at, names)
    assert got.columns == ["cell", "level", "theta", "u"] and ",v:double" not in got._jdf.queryExecution().executedPlan().toString().split("struct<")[1].replace("level:", "")


def test_side_inputs(spark, tmp_path):
    (tmp_path / "lapse.txt").write_text("  atms_npp 1  0.5\natms_npp 2 -1.25e-1\n\nheader\natms_npp x 1\n")
    got = sorted(map(tuple, states.read_coefficients(spark, str(tmp_path / "lapse.txt")).collect()))
    assert got == [("atms_npp", 1, 0.5), ("atms_npp", 2, -0.125)]
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (None, 1.0)], "channel int, x double")
    c = spark.createDataFrame([("one", 1, 0.5), ("x", 1, 2.0), ("other", 2, 9.0)], "predictor string, channel int, value double")
    assert {r.channel: r.bias for r in states.with_bias(df, c, {"one": F.lit(1.0), "x": F.col("x")}).collect()} == {1: 4.5, 2: 0.0, None: 0.0}


def test_tables_are_handed_on_once(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "Location long, `HofX/t` double")
    assert states.hand_on(df, str(tmp_path / "hofx")).collect() == df.collect()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        states.hand_on(df, str(tmp_path / "hofx"))


def test_layers_and_limits(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (-3.0, 4.0)], "`a/x` double, `a/y` double")
    got = diagnostics.layer(df, {"type": "Scatter", "x": {"variable": "a/x"}, "y": {"variable": "a/y"}})
    assert got.columns == ["x", "y"] and got.count() == 2
    bins = diagnostics.layer(df, {"type": "Histogram", "data": {"variable": "a/y"}, "range": [0, 4], "bins": 4})
    assert sorted(map(tuple, bins.collect())) == [(2, 1), (3, 1), (4, 1)]
    assert tuple(diagnostics.limits(df, "a/x").first()) == (-3.0, 3.0) and tuple(diagnostics.limits(df, "a/y").first()) == (1.0, 4.0)
    with pytest.raises(KeyError):
        diagnostics.layer(df, {"type": "Pie"})


def test_configurations_are_revised_and_written(tmp_path):
    tree = {"datasets": [{"file": "old.nc"}], "graphics": [{"layers": [{"type": "MapScatter", "data": {"variable": "ombg/sst"}}, {"data": {"variable": "b"}, "vmin": 0}]}]}
    new = diagnostics.revised(tree, {"old.nc": "new.nc"}, {"ombg/sst": (-2, 2)})
    assert new["datasets"] == [{"file": "new.nc"}]
    assert new["graphics"][0]["layers"] == [{"type": "MapScatter", "data": {"variable": "ombg/sst"}, "vmin": -2, "vmax": 2}, {"data": {"variable": "b"}, "vmin": 0}]
    assert tree["datasets"] == [{"file": "old.nc"}]
    for name, read in (("c.json", json.loads), ("c.yaml", config.load)):
        diagnostics.write_config(new, tmp_path / name)
        assert read((tmp_path / name).read_text()) == new
    with pytest.raises(ValueError):
        diagnostics.write_config(new, tmp_path / "c.txt")
