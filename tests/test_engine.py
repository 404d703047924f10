"""Boundaries of the where language and the filters, thinning, geometry, mappings, configuration and ensembles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsq.functions import geometry, named, predicates, scalars
from obsq.operators import ensemble, filters, hops, nearby, profiles, thinning
from obsq.operators.space import ObsSpace
from obsq.plans import config, mapping
from obsq.plans.pipeline import Pipeline, dispatch
from obsq.sources import files

SCHEMA = "Location long, `ObsValue/x` double, `HofX/x` double, `ObsError/x` double, `QualityMarker/x` int, `MetaData/kind` string"
ROWS = [(1, 5.0, 5.0, 1.0, 1, "a"), (2, 10.0, 7.0, 1.0, 3, "b"), (3, 10.1, 7.0, 1.0, 4, "a"), (4, None, 7.0, 1.0, 1, None), (5, 4.9, None, 1.0, None, "c"), (6, 10.0, 6.9, None, 2, "a")]


@pytest.fixture
def space(spark):
    return ObsSpace(spark.createDataFrame(ROWS, SCHEMA), ("x",)).started()


def qc(s):
    return [r[0] for r in s.df.orderBy("Location").select("`QC/x`").collect()]


def values(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_state_starts_with_missing(space):
    assert qc(space) == [0, 0, 0, 10, 10, 0]


def test_bounds_pass_at_the_bound(space):
    assert qc(filters.apply(space, {"filter": "Bounds Check", "minvalue": 5, "maxvalue": 10})) == [0, 0, 15, 10, 10, 0]


def test_where_bounds_are_inclusive(space):
    got = filters.apply(space, {"filter": "Perform Action", "where": [{"variable": {"name": "x@ObsValue"}, "minvalue": 10, "maxvalue": 10.1}], "action": {"name": "reject"}})
    assert qc(got) == [0, 20, 20, 10, 10, 20]


def test_background_check_is_strict_and_skips_null_errors(space):
    assert qc(filters.apply(space, {"filter": "Background Check", "threshold": 3})) == [0, 0, 19, 10, 10, 0]
    assert qc(filters.apply(space, {"filter": "Background Check", "absolute threshold": 3.05})) == [0, 0, 19, 10, 10, 19]


def test_null_fulfils_no_condition(spark, space):
    c = {"variable": "MetaData/kind", "is_not_in": ["a"]}
    assert [r[0] for r in space.df.where(predicates.where([c])).orderBy("Location").select("Location").collect()] == [2, 5]
    assert space.df.where(predicates.where([])).count() == 6
    assert space.df.where(predicates.where([{"variable": "MetaData/kind"}])).count() == 6


def test_lists_preqc_and_codes_of_earlier_filters_stay(space):
    s = filters.apply(space, {"filter": "PreQC"})
    assert qc(s) == [0, 0, 11, 10, 10, 0]
    s = filters.apply(s, {"filter": "RejectList"})
    assert qc(s) == [12, 12, 11, 10, 10, 12]
    s = filters.apply(s, {"filter": "AcceptList", "where": [{"variable": "MetaData/kind", "is_in": ["a"]}]})
    assert qc(s) == [0, 12, 0, 10, 10, 0]


@pytest.mark.parametrize("spec", [{"filter": "Bounds Check", "minvalu": 1}, {"filter": "Bound Check"}, {"filter": "Background Check"}, {"filter": "Background Check", "threhold": 1.0}])
def test_unknown_keys_are_errors(space, spec):
    with pytest.raises(KeyError):
        filters.apply(space, spec)


def test_filters_keep_rows_and_rejections_are_idempotent(space):
    p = Pipeline.of({"obs filters": [{"filter": "Bounds Check", "maxvalue": 9}, {"filter": "Background Check", "threshold": 2.0}]})
    once = p.run(space)
    assert qc(p.run(once)) == qc(once) and once.df.count() == len(ROWS)


def test_deferred_filters_run_last():
    p = Pipeline.of({"obs filters": [{"filter": "Bounds Check", "defer to post": True}, {"filter": "RejectList"}], "obs pre filters": [{"filter": "PreQC", "apply at iterations": "0, 2-3"}]})
    assert [f["filter"] for f in p.ordered(0)] == ["PreQC", "RejectList", "Bounds Check"]
    assert [f["filter"] for f in p.ordered(1)] == ["RejectList", "Bounds Check"]


def test_errors_and_flags(space):
    s = filters.apply(space, {"filter": "Perform Action", "actions": [{"name": "assign error", "error parameter": 2.0}, {"name": "inflate error", "inflation factor": 0.0}, {"name": "set", "flag": "f", "ignore": "rejected observations"}]})
    rows = s.df.orderBy("Location").select("`Err/x`", "`Diag/f/x`").collect()
    assert [r[0] for r in rows] == [2.0] * 6 and [r[1] for r in rows] == [True, True, True, False, False, True]


def test_int_ranges():
    assert predicates.int_set("1-3, 7") == [1, 2, 3, 7]
    for bad in ("a", "3-1", "1;2"):
        with pytest.raises(ValueError):
            predicates.int_set(bad)


def test_scalars(spark):
    got = values(spark, a=scalars.scan_position(F.lit(12.5)), b=scalars.scan_position(F.lit(12.51)), c=scalars.longitude_360(F.lit(-0.1)), d=scalars.longitude_360(F.lit(360.0)), e=scalars.round_half_even(F.lit(2.5)), f=scalars.percent_difference(F.lit(1.0), F.lit(0.0)), g=scalars.magnitude_floor(F.lit(0.0)), h=scalars.type_code(F.lit(88), F.lit("windEastward")), i=scalars.nan_to_null(F.lit(float("nan"))))
    assert (got.a, got.b, round(got.c, 6), got.d, got.e, got.f, got.g, got.h, got.i) == (13, 14, 359.9, 0.0, 2.0, None, 0.0, 288, None)


def test_interpolation(spark):
    xs, ys = [100.0, 50.0, 10.0], [1.0, 2.0, 4.0]
    for x, want in ((200.0, 1.0), (100.0, 1.0), (75.0, 1.5), (10.0, 4.0), (1.0, 4.0)):
        assert values(spark, v=named.stepwise_linear(F.lit(x), xs, ys)).v == pytest.approx(want)
        levels, profile = F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))
        assert values(spark, v=hops.vert_interp(profile, levels, F.lit(x))).v == pytest.approx(want)
    assert values(spark, v=named.ramp(F.lit(None).cast("double"), 0, 1, 2, 3)).v is None


def test_taper_and_circle(spark):
    both = values(spark, a=geometry.gaspari_cohn(F.lit(0.0), 10.0), b=geometry.gaspari_cohn(F.lit(5.0), 10.0), c=geometry.gaspari_cohn(F.lit(10.0), 10.0), d=geometry.in_circle(F.lit(-97.5), F.lit(38.5), (262.5, 38.5), 1.0))
    assert (both.a, round(both.b, 9), both.c, both.d) == (1.0, round(5 / 24, 9), pytest.approx(0, abs=1e-12), 1)


def test_hull_of_a_grid(spark):
    points = [(float(x), float(y)) for x in range(6) for y in range(6) if not (x > 2 and y > 2)]
    moved = [(x + 1e-4 * math.sin(7 * x + 3 * y), y + 1e-4 * math.cos(5 * x + y)) for x, y in points]
    ring = geometry.concave_hull(moved, 0.8)[0]
    df = spark.createDataFrame([(1.5, 1.5), (4.0, 4.0), (4.0, 1.0), (9.0, 1.0), (-0.5, 0.5)], "x double, y double")
    assert [r[0] for r in df.select(geometry.in_polygon(F.col("x"), F.col("y"), ring)).collect()] == [True, False, True, False, False]


@pytest.mark.parametrize("seed_time", [None, "2024-01-01 12:00:00"])
def test_thinning_keeps_the_spacing(spark, seed_time):
    r = random.Random(8)
    rows = [(i, r.choice("ab"), r.randint(0, 86400)) for i in range(300)] + [(900, None, 5), (901, "a", None)]
    df = spark.createDataFrame(rows, "Location long, g string, s long").withColumn("t", F.timestamp_seconds(F.col("s") + 1704067200))
    got = thinning.temporal(df, "t", 1800, "g", seed=seed_time).collect()
    assert len(got) == len(rows)
    for g in ("a", "b"):
        kept = sorted(x.s for x in got if x._kept and x.g == g)
        assert kept and all(b - a >= 1800 for a, b in zip(kept, kept[1:]))
        every = sorted((x.s, x.Location) for x in got if x.g == g and x.s is not None)
        if seed_time is None:
            want, last = [], None
            for s, _ in every:
                if last is None or s - last >= 1800:
                    want.append(s)
                    last = s
            assert kept == want
        else:
            assert min(every, key=lambda e: (abs(e[0] - 43200), e))[0] in kept
    assert all(not x._kept for x in got if x.s is None)
    assert {x._kept for x in thinning.temporal(df.where("s is not null"), "t", 0, "g").collect()} == {True}


@pytest.mark.parametrize("width", [1, 3, 64])
def test_walk_over_blocks_equals_the_walk(spark, width):
    """A category with most rows, ties, blocks without rows, times before the epoch, strings as locations."""
    r = random.Random(21)
    rows = [("hot", r.randint(-4000, 4000), f"h{i}") for i in range(3000)] + [("even", 7 * i, f"e{i}") for i in range(400)]
    rows += [("rare", r.randint(-200000, 200000), f"r{i}") for i in range(60)] + [("one", 100, "o")]
    got = {x[0] for x in thinning.kept_rows(spark.createDataFrame(rows, "_g string, _t long, _l string"), 100, width).collect()}
    want, last = set(), {}
    for g, t, place in sorted(rows):
        if g not in last or t - last[g] >= 100:
            want.add(place)
            last[g] = t
    assert got == want
    assert thinning.kept_rows(spark.createDataFrame([], "_g string, _t long, _l string"), 100, width).collect() == []


def test_durations():
    assert [thinning.seconds(d) for d in ("PT06M", "PT30M", "PT00M", "P1DT2H")] == [360, 1800, 0, 93600]
    with pytest.raises(ValueError):
        thinning.seconds("30 minutes")


def test_mapping(spark):
    schema = "subset string, YEAR int, MNTH int, DAYS int, HOUR int, MINU int, RPT struct<A:array<struct<POB:double,Q:int>>,CLAT:double>, GATES array<struct<D:double,V:double>>"
    rows = [("X", 2024, 5, 27, 1, 30, ([(1.0, 2), (3.0, 4)], 45.0), [(1.0, 10.0), (2.0, 20.0)]), ("Y", 2024, 5, 27, 1, 30, ([], None), [])]
    df = spark.createDataFrame(rows, schema)
    spec = config.load(
        """
subsets: [X]
exports:
  group_by_variable: gate
  variables:
    time: {timestamp: {datetime: {year: "*/YEAR", month: "*/MNTH", day: "*/DAYS", hour: "*/HOUR", minute: "*/MINU"}}}
    p2: {query: "*/RPT/A{2}/POB", transforms: [{scale: 100}]}
    lat: {query: ["*/RPT/CLATH", "*/RPT/CLAT"]}
    gate: {query: "*/GATES/D", type: float, transforms: [{scale: 125}]}
outputs:
  - {name: MetaData/dateTime, source: variables/time}
  - {name: MetaData/pressure, source: variables/p2, units: Pa}
  - {name: MetaData/latitude, source: variables/lat}
  - {name: MetaData/range, source: variables/gate}
"""
    )
    out = mapping.compile_mapping(df, spec)
    assert [tuple(r)[1:] for r in out.collect()] == [(300.0, 45.0, 125.0), (300.0, 45.0, 250.0)]
    assert out.schema["MetaData/pressure"].metadata == {"units": "Pa"}
    with pytest.raises(KeyError):
        mapping.first_of(df.schema, ["*/NONE"])


def test_configuration(tmp_path):
    from datetime import datetime

    (tmp_path / "part.yaml").write_text("b: $(X)\n")
    text = config.render("a: {{ T | to_isotime }}\nlist:\n  !INC part.yaml\nc: @TOKEN@ ${X}\n", {"T": datetime(2024, 5, 27), "X": 3, "TOKEN": "t"}, tmp_path)
    assert config.load(text) == {"a": datetime(2024, 5, 27, tzinfo=config.load(text)["a"].tzinfo), "list": {"b": 3}, "c": "t 3"}
    with pytest.raises(ValueError):
        config.load("a: [1]\na: [2]\n")
    assert config.load("a: [1]\na: [2]\n", merge_duplicates=True) == {"a": [1, 2]}
    assert config.load("x: &d {k: 1, m: 2}\ny:\n  <<: *d\n  k: 3\n") == {"x": {"k": 1, "m": 2}, "y": {"k": 3, "m": 2}}
    whole = config.concatenate(["- obs: *t\n", "- obs: b\n"], "t: &t 5\nobservers:\n  @OBSERVATIONS@\n")
    assert config.observers(config.load(whole)) == [{"obs": 5}, {"obs": "b"}]
    assert config.cast_env({"A": "2024052700", "B": ".true.", "C": "007", "D": "-3", "E": "1.5"}) == {"A": datetime(2024, 5, 27), "B": True, "C": "007", "D": -3, "E": 1.5}
    with pytest.raises(KeyError):
        config.render("$(NONE)", {})
    with pytest.raises(ValueError):
        dispatch("nothing")


def test_transform_filter_is_the_kalman_gain():
    r = np.random.default_rng(1)
    x = r.normal(3, 2, 40)
    got = ensemble.transform(x, x[None, :], np.array([5.0]), np.array([1.5]))
    b = x.var(ddof=1)
    assert got.mean() == pytest.approx(x.mean() + b / (b + 1.5) * (5 - x.mean()))
    assert got.var(ddof=1) == pytest.approx(b * 1.5 / (b + 1.5))
    assert ensemble.transform(x, np.zeros((0, 40)), np.zeros(0), np.zeros(0)).tolist() == x.tolist()


def test_letkf_over_groups(spark):
    points = spark.createDataFrame([(c, m, float(c + m)) for c in (1, 2) for m in range(4)], "cell long, member int, value double")
    obs = points.where("cell = 1").selectExpr("cell", "1 as obs_id", "member", "value as simulated", "9D as observed", "1D as variance")
    got = {(r.cell, r.member): r.analysis for r in ensemble.letkf(points, obs, "cell").collect()}
    x = np.arange(1.0, 5.0)
    want = ensemble.transform(x, x[None, :], np.array([9.0]), np.array([1.0]))
    assert [got[1, m] for m in range(4)] == pytest.approx(want.tolist()) and [got[2, m] for m in range(4)] == [2, 3, 4, 5]


def test_letkf_leaves_out_observations_that_lack_a_member(spark):
    points = spark.createDataFrame([(1, m, float(m)) for m in range(4)], "cell long, member int, value double")
    rows = [(1, 5, m, float(m), 9.0, 1.0) for m in range(4)] + [(1, 6, m, 3.0 * m, 2.0, 1.0) for m in range(3)] + [(1, 8, m, None if m == 2 else 1.0, 2.0, 1.0) for m in range(4)] + [(1, 5, 9, 4.0, 9.0, 1.0)]
    obs = spark.createDataFrame(rows, "cell long, obs_id long, member int, simulated double, observed double, variance double")
    got = {r.member: r.analysis for r in ensemble.letkf(points, obs, "cell").collect()}
    x = np.arange(4.0)
    assert [got[m] for m in range(4)] == pytest.approx(ensemble.transform(x, x[None, :], np.array([9.0]), np.array([1.0])).tolist())


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    assert files.read_or_empty(spark, f"{tmp_path}/none", df.schema).count() == 0
    for m in (1, 2):
        df.withColumn("v", F.col("v") * m).write.parquet(f"{tmp_path}/mem0{m}")
    got = files.read_ensemble(spark, f"{tmp_path}/mem%iMember%", 2)
    assert sorted((r.member, r.v) for r in got.collect()) == [(1, 1.0), (1, 2.0), (2, 2.0), (2, 4.0)]
    assert [r.k for r in files.differences(df, df.withColumn("v", F.col("v") + F.when(F.col("k") == 2, 0.1).otherwise(1e-6)), ["k"], 1e-3).collect()] == [2]
    g = files.grid(spark.createDataFrame([(math.pi, 0.0)], "lonCell double, latCell double")).first()
    assert (round(g.lon, 6), g.lat) == (180.0, 0.0)
    with pytest.raises(ValueError):
        files.grid(df)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("A", 1.0, 2.0)], "subset string, `ObsValue/x` double, other double").write.parquet(f"{tmp_path}/t")
    plan = files.read_space(spark, f"{tmp_path}/t", ["ObsValue/x"], ["A"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(subset,A)" in plan or "In(subset" in plan
    assert "other" not in plan


#: Functions with the options that configurations give them.
FORMS = [
    ("ObsErrorFactorPressureCheck", {"variable": "airTemperature", "inflation factor": 8.0}), ("ObsErrorFactorPressureCheck", {"variable": "windEastward", "inflation factor": 4.0, "SetSfcWndObsHeight": True, "AddObsHeightToStationElevation": True, "AssumedSfcWndObsHeight": 10}),
    ("ObsErrorFactorSfcPressure", {"geovar_geomz": "z", "geovar_sfc_geomz": "s"}), ("ObsErrorFactorConventional", {"inflate variables": ["windEastward"], "pressure": "MetaData/pressure"}), ("ObsErrorFactorDuplicateCheck", {}),
    ("CLWRetMW", {"clwret_ch238": 1, "clwret_ch314": 2, "clwret_types": ["ObsValue"]}), ("SCATRetMW", {"scatret_ch238": 1, "scatret_ch314": 2, "scatret_ch890": 16, "scatret_types": ["ObsValue"], "bias_application": "HofX"}),
    ("CLWRetSymmetricMW", {"clwret_ch238": 1, "clwret_ch314": 2, "clwret_types": ["ObsValue", "HofX"], "bias_application": "HofX"}), ("HydrometeorCheckATMS", {"channels": "1-22", "obserr_clearsky": [1.0], "clwret_function": {}, "obserr_function": {}}),
    ("HydrometeorCheckAMSUA", {"channels": "1-15"}), ("ObsErrorFactorTopoRad", {"channels": "1-22", "sensor": "atms"}), ("ObsErrorFactorTransmitTopRad", {"channels": "1-22"}), ("ObsErrorFactorSurfJacobianRad", {"channels": "1-22", "sensor": "atms", "obserr_demisf": [0.01], "obserr_dtempf": [0.5]}),
    ("ObsErrorFactorSituDependMW", {"channels": "1-22", "sensor": "atms", "clwbkg_function": {}, "obserr_clearsky": [1.0]}), ("ObsErrorFactorLatRad", {"latitude_parameters": [25.0, 0.25, 0.04, 3.0]}), ("ObsErrorBoundMW", {"channels": "1-22", "sensor": "atms", "threhold": 3, "obserr_bound_max": [1.0]}),
    ("InterChannelConsistencyCheck", {"channels": "1-22", "sensor": "atms", "use_flag": [1], "use passive_bc": True}), ("WindsSPDBCheck", {"wndtype": [220], "cgross": [10.0], "error_min": [1.4], "error_max": [6.1], "variable": "windEastward"}),
    ("Velocity", {}), ("WindDirAngleDiff", {}), ("SatWindsErrnormCheck", {}), ("ScatWindsAmbiguityCheck", {"minimum_uv": 0.0001}),
]


@pytest.mark.parametrize("name,options", FORMS)
def test_functions_as_configurations_write_them(spark, name, options):
    from obsq.functions.named import SUPPLIED, resolve

    assert resolve({"name": f"ObsFunction/{name}", "options": options}) is not None
    assert resolve({"name": f"{name}@ObsFunction", "options": options}) is not None
    if name in SUPPLIED:
        with pytest.raises(KeyError):
            resolve({"name": f"ObsFunction/{name}", "options": options | {"no such": 1}})


def test_unknown_keys_of_exports(spark):
    from obsq.plans.mapping import compile_mapping

    df = spark.createDataFrame([(1, "A")], "ID int, subset string")
    spec = {"exports": {"variables": {"id": {"query": "*/ID"}}}, "outputs": [{"name": "i", "source": "variables/id"}]}
    assert compile_mapping(df, spec | {"exports": spec["exports"] | {"subsets": ["B"]}}).count() == 0
    with pytest.raises(KeyError):
        compile_mapping(df, spec | {"exports": spec["exports"] | {"subset": ["B"]}})


def test_unknown_operators_are_errors(spark):
    from obsq.operators.hops import operator_of

    with pytest.raises(KeyError):
        operator_of({"name": "CRTM"}, ["x"])
    made = operator_of({"name": "SfcPCorrected"}, ["p"]) | operator_of({"name": "SfcCorrected"}, ["t"]) | operator_of({"name": "AtmVertInterpLay", "thickness": "d"}, ["o"])
    assert sorted(made) == ["o", "p", "t"]


def near_pairs(points, obs, radius):
    def far(a, b):
        (x, y), (u, v) = (tuple(map(math.radians, p)) for p in (a, b))
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2)))

    return {(i, j): d for i, p in enumerate(points) for j, o in enumerate(obs) if None not in p + o and (d := far(p, o)) <= radius}


@pytest.mark.parametrize("radius", [40.0, 900.0, 4000.0, 25000.0])
def test_within_radius_equals_all_pairs(spark, radius):
    r = random.Random(3)
    edges = [(0.0, 90.0), (120.0, -90.0), (180.0, 0.0), (-180.0, 0.1), (359.95, 45.0), (0.05, 45.0), (10.0, 89.9), (190.0, 89.9)]
    points, obs = ([*edges, (None, 1.0), *((r.uniform(-180, 360), math.degrees(math.asin(r.uniform(-1, 1)))) for _ in range(60))] for _ in range(2))
    tables = [spark.createDataFrame([(i, *p) for i, p in enumerate(x)], f"{k} long, lon double, lat double") for x, k in ((points, "p"), (obs, "o"))]
    got = nearby.within_radius(*tables, "p", "o", radius).collect()
    want = near_pairs(points, obs, radius)
    assert len(got) == len(want) and {(x.p, x.o): pytest.approx(x.distance_km, abs=1e-6) for x in got} == want
    with pytest.raises(ValueError):
        nearby.within_radius(*tables, "p", "o", 0.0)


def test_distance_to_a_null_place_is_null(spark):
    assert values(spark, d=geometry.haversine_km(F.lit(None).cast("double"), F.lit(1.0), 0.0, 0.0)).d is None


def test_local_analysis_weighs_by_distance(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 90.0, 0.0)], "cell long, lon double, lat double")
    members = spark.createDataFrame([(c, m, float(m)) for c in (1, 2) for m in range(4)], "cell long, member int, value double")
    obs = spark.createDataFrame([(7, 0.0, 4.0, 9.0, 1.0)], "obs_id long, lon double, lat double, observed double, variance double")
    simulated = spark.createDataFrame([(7, m, float(m)) for m in range(4)], "obs_id long, member int, simulated double")
    got = {(x.cell, x.member): x.analysis for x in nearby.local_analysis(points, members, obs, simulated, "cell", 1000.0).collect()}
    z = 6371.0 * math.radians(4.0) / 500.0
    weight = -(z**5) / 4 + z**4 / 2 + 5 * z**3 / 8 - 5 * z**2 / 3 + 1
    spread = 5 / 3
    mean = 1.5 + spread / (spread + 1 / weight) * (9 - 1.5)
    assert sum(got[1, m] for m in range(4)) / 4 == pytest.approx(mean)
    assert [got[2, m] for m in range(4)] == [0, 1, 2, 3]


def test_groupings(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", 7.0), (3, "a", None), (4, "a", 7.0), (5, "b", 1.0)], "Location long, s string, p double")
    spec = {"group variables": ["s"], "sort variable": "p", "sort order": "descending"}
    assert {r.Location: r._level for r in profiles.levels(df, spec).collect()} == {2: 1, 4: 2, 1: 3, 3: 4, 5: 1}
    for bad, error in (({"sort variable": "p"}, KeyError), (spec | {"sort orde": 1}, KeyError), (spec | {"sort order": "up"}, ValueError)):
        with pytest.raises(error):
            profiles.grouping(bad)


def test_stream_in_batches_equals_the_walk(spark, tmp_path):
    from obsq.streaming.thinning import thin_stream

    r = random.Random(5)
    rows = sorted((r.randint(0, 40000), i, r.choice("ab")) for i in range(200))
    for k in range(4):
        part = spark.createDataFrame(rows[k * 50 : k * 50 + 50] + ([(None, 900, "a")] if k == 1 else []), "s long, l long, g string").withColumn("t", F.timestamp_seconds("s")).drop("s")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    kept = thin_stream(stream, "g", "t", "l", 1800, "10 minutes")
    kept.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    got = sorted((x.g, x.l) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    want, last = [], {}
    for s, l, g in rows:
        if g not in last or s - last[g] >= 1800:
            want.append((g, l))
            last[g] = s
    assert got == sorted(want)


def test_loose_json_is_read(spark):
    assert config.load("{ 'a': 1,  # one\n  \"b\": [1, 2,],\n}") == {"a": 1, "b": [1, 2]}


def test_local_analysis_makes_no_row_of_a_pair(spark, monkeypatch):
    """Sums over blocks give what one solve for each point gives, with other members, missing values and copies."""
    monkeypatch.setattr(nearby, "BLOCK", 7)
    monkeypatch.delattr(nearby, "within_radius")
    r = random.Random(9)
    spot = lambda: (r.uniform(-30, 30), r.uniform(-20, 20))
    where = {c: spot() for c in range(40)}
    of = {c: [1, 2, 3, 3] if c % 5 == 0 else [1, 2, 3, 4] for c in where}
    x = {c: [r.gauss(0, 2) for _ in of[c]] for c in where}
    obs = {i: (*spot(), None if i == 3 else r.gauss(0, 2), 0.0 if i == 4 else r.uniform(1, 4)) for i in range(50)}
    y = {(i, m): r.gauss(0, 2) for i in obs for m in (1, 2, 3, 4) if (i, m) not in ((5, 4), (6, 1))}
    points = spark.createDataFrame([(c, *p) for c, p in where.items()] + [(98, None, 1.0)], "cell long, lon double, lat double")
    members = spark.createDataFrame([(c, m, v) for c in where for m, v in zip(of[c], x[c])] + [(c, m, 1.0 * m) for c in (98, 99) for m in (1, 2)], "cell long, member int, value double")
    rows = [(i, *o) for i, o in obs.items()]
    seen = spark.createDataFrame(rows + rows[:9], "obs_id long, lon double, lat double, observed double, variance double")
    simulated = spark.createDataFrame([(*k, v) for k, v in y.items()], "obs_id long, member int, simulated double")
    got = nearby.local_analysis(points, members, seen, simulated, "cell", 1500.0, 1.1)
    found = {}
    for v in got.collect():
        found.setdefault(v.cell, []).append(v.analysis)
    near = near_pairs([where[c] for c in range(40)], [obs[i][:2] for i in range(50)], 1500.0)
    for c in where:
        use = [(i, d) for (p, i), d in sorted(near.items()) if p == c and i not in (3, 4) and all((i, m) in y for m in of[c])]
        z = np.array([d / 750.0 for _, d in use])
        w = np.where(z <= 1, -(z**5) / 4 + z**4 / 2 + z**3 * 5 / 8 - z**2 * 5 / 3 + 1, z**5 / 12 - z**4 / 2 + z**3 * 5 / 8 + z**2 * 5 / 3 - 5 * z + 4 - 2 / (3 * np.maximum(z, 0.1)))
        use, w = [i for (i, _), k in zip(use, w) if k > nearby.LEAST_WEIGHT], w[w > nearby.LEAST_WEIGHT]
        order = sorted(range(4), key=lambda k: (of[c][k], x[c][k]))
        want = ensemble.transform(np.array([x[c][k] for k in order]), np.array([[y[i, of[c][k]] for k in order] for i in use]).reshape(len(use), 4), np.array([obs[i][2] for i in use]), np.array([obs[i][3] for i in use]) / w, 1.1)
        assert sorted(found[c]) == pytest.approx(sorted(want.tolist()), abs=1e-9)
    assert sorted(found[98]) == sorted(found[99]) == [1.0, 2.0]


def test_within_radius_decides_by_cosines_and_keeps_distances(spark):
    r = random.Random(4)
    tables = [spark.createDataFrame([(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(120)], f"{k} long, lon double, lat double") for k in "po"]
    near = nearby.within_radius(*tables, "p", "o", 2000.0)
    optimized = near._jdf.queryExecution().optimizedPlan().toString()
    assert "_px" in optimized  # the cosine is in the join's condition
    a, b = (x.select(x.columns[0], F.col("lon").alias(f"lon{k}"), F.col("lat").alias(f"lat{k}")) for k, x in zip("po", tables))
    want = a.join(b).select("p", "o", geometry.haversine_km(F.col("lonp"), F.col("latp"), F.col("lono"), F.col("lato")).alias("d")).where("d <= 2000")
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, want.collect()))
