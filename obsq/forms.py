"""Queries of functions, mappings and operators in the forms that configurations write, each with SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsq.functions import named, scalars
from obsq.operators import filters, hops, stats
from obsq.operators.space import ObsSpace
from obsq.plans import mapping
from obsq.plans.pipeline import dispatch
from obsq.queries import LOC, events, loc, messages, query, r6

C = F.col
U, V, P, Q = "(l_quantity - 25.0)", "(l_linenumber - 3.0)", "(l_discount * 100 - 5.0)", "(l_tax * 100 - 4.0)"
SPEED, MODEL = f"sqrt({U} * {U} + {V} * {V})", f"sqrt({P} * {P} + {Q} * {Q})"


def winds(t) -> DataFrame:
    """Order lines as winds, under the names that wind functions read by themselves."""
    made = {
        "loc": loc(), "ObsValue/windEastward": C("l_quantity") - 25.0, "ObsValue/windNorthward": C("l_linenumber") - 3.0,
        "HofX/windEastward": C("l_discount") * 100 - 5.0, "HofX/windNorthward": C("l_tax") * 100 - 4.0, "MetaData/expectedError": C("l_quantity"),
        "ObsType/windEastward": C("l_linenumber"), "Err/windEastward": C("l_tax") * 100, "Factor/CLWRetMW_ObsValue": C("l_discount"), "Factor/CLWRetMW_HofX": C("l_tax"),
        "Factor/ObsErrorFactorPressureCheck_windEastward": C("l_discount") * 10 + 1.0, "Factor/ObsErrorFactorLatRad": C("l_tax") + 1.0,
    }
    return t("lineitem").select(*(c.alias(n) for n, c in made.items()))


def function(name: str, **options):
    return named.resolve({"name": f"ObsFunction/{name}", "options": {k.replace("__", " "): v for k, v in options.items()}})


@query(f"SELECT {LOC}, round({SPEED}, 6) AS speed, round(CASE WHEN {SPEED} < 0.1 THEN 100.0 ELSE (10.0 - 0.1 * l_quantity) / {SPEED} END, 6) AS ratio FROM lineitem")
def wind_speed_forms(t):
    """Velocity and SatWindsErrnormCheck by name alone, in both spellings."""
    return winds(t).select("loc", r6(named.resolve("Velocity@ObsFunction")).alias("speed"), r6(named.resolve({"name": "ObsFunction/SatWindsErrnormCheck"})).alias("ratio"))


@query(f"""WITH d AS (SELECT {LOC}, {SPEED} AS o, {MODEL} AS m, degrees(atan2(-{U}, -{V})) AS a, degrees(atan2(-{P}, -{Q})) AS b FROM lineitem),
e AS (SELECT *, abs(a - b) - 360.0 * floor(abs(a - b) / 360.0) AS x FROM d)
SELECT loc, round(CASE WHEN least(o, m) < 0.5 THEN 0.0 ELSE least(x, 360.0 - x) END, 6) AS angle FROM e""")
def wind_angle_form(t):
    return winds(t).select("loc", r6(function("WindDirAngleDiff", minimum_uv=0.5)).alias("angle"))


@query(f"""SELECT {LOC}, round(CASE WHEN {SPEED} < 1.5 THEN 0.0 ELSE sqrt(({U} - {P}) * ({U} - {P}) + ({V} - {Q}) * ({V} - {Q}))
 - sqrt(({U} + {P}) * ({U} + {P}) + ({V} + {Q}) * ({V} + {Q})) END, 6) AS ambiguity FROM lineitem""")
def ambiguity_check(t):
    return winds(t).select("loc", r6(function("ScatWindsAmbiguityCheck", minimum_uv=1.5)).alias("ambiguity"))


@query(f"""SELECT {LOC}, round(CASE WHEN l_linenumber BETWEEN 1 AND 3 THEN 2.0 * greatest(1.4, least(6.1, l_tax * 100)) WHEN l_linenumber = 5 THEN 3.0 * greatest(1.0, least(4.0, l_tax * 100)) END
 * CASE WHEN {SPEED} < {MODEL} THEN 0.7 ELSE 1.0 END, 6) AS most FROM lineitem""")
def speed_bias_check(t):
    """The threshold of WindsSPDBCheck for a variable: tighter for winds that are slower than the simulated ones."""
    return winds(t).select("loc", r6(function("WindsSPDBCheck", wndtype=["1-3", 5], cgross=[2.0, 2.0, 2.0, 3.0], error_min=[1.4, 1.4, 1.4, 1.0], error_max=[6.1, 6.1, 6.1, 4.0], variable="windEastward")).alias("most"))


@query(f"SELECT {LOC}, round(0.5 * (l_discount + l_tax), 6) AS mean, CASE WHEN (l_discount > 0.05) = (l_tax > 0.05) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS same FROM lineitem")
def cloud_water_forms(t):
    """CLWRetSymmetricMW and CLWMatchIndexMW over retrievals that the input has as columns."""
    channels = {"clwret_ch238": 1, "clwret_ch314": 2}
    of = [{"name": "CLWRetMW@ObsFunction", "options": channels | {"clwret_types": [x]}} for x in ("ObsValue", "HofX")]
    mean = function("CLWRetSymmetricMW", **channels, clwret_types=["ObsValue", "HofX"])
    same = function("CLWMatchIndexMW", channels="1-1", clwobs_function=of[0], clwbkg_function=of[1], clwret_clearsky=[0.05])
    return winds(t).select("loc", r6(mean).alias("mean"), same[0].alias("same"))


@query(f"SELECT {LOC}, round(l_tax * 100 * (l_discount * 10 + 1.0) * (l_tax + 1.0), 6) AS err FROM lineitem")
def supplied_factors(t):
    """Errors inflated by two factors that the input has as columns."""
    cols = {n: C(f"`{n}`") for n in winds(t).columns if n != "loc"} | {"Location": C("loc")}
    space = ObsSpace.of(winds(t), cols, ["windEastward"])
    for name, options in (("ObsErrorFactorPressureCheck", {"variable": "windEastward", "inflation factor": 4.0}), ("ObsErrorFactorLatRad", {"latitude_parameters": [25.0, 0.25, 0.04, 3.0]})):
        space = filters.apply(space, {"filter": "Perform Action", "action": {"name": "inflate error", "inflation variable": {"name": f"ObsFunction/{name}", "options": options}}})
    return space.df.select(C("Location").alias("loc"), r6(C("`Err/windEastward`")).alias("err"))


SPEC = {
    "exports": {"subsets": ["A", "N"], "variables": {"id": {"query": "*/ID"}, "p": {"query": "*/P", "type": "double"}}},
    "outputs": [{"name": "loc", "source": "variables/id"}, {"name": "p", "source": "variables/p"}],
}


@query(f"SELECT {LOC}, l_extendedprice::DOUBLE AS p FROM lineitem WHERE l_returnflag IN ('A', 'N')")
def subset_filter(t):
    """Messages of the subsets that a mapping exports."""
    return mapping.compile_mapping(t("lineitem").select(C("l_returnflag").alias("subset"), loc().alias("ID"), C("l_extendedprice").alias("P")), SPEC)


@query("SELECT 'Location' AS dimension, count(DISTINCT l_orderkey) AS size FROM lineitem UNION ALL SELECT 'Level', max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def mapping_dimensions(t):
    return mapping.dimensions(messages(t), {"dimensions": [{"name": "Level", "path": "*/LEVELS"}]})


@query("""SELECT o_orderkey AS loc, make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), (o_orderkey % 24)::BIGINT, (o_custkey % 60)::BIGINT, 0.0) AS by_parts,
 TIMESTAMP '2024-05-27 00:00:00' + to_seconds((o_custkey % 7200) * 60) AS by_offset FROM orders""")
def timestamps(t):
    """Times from parts, and from an offset in minutes to a reference time."""
    parts = {"YEAR": F.year("o_orderdate"), "MNTH": F.month("o_orderdate"), "DAYS": F.dayofmonth("o_orderdate"), "HOUR": C("o_orderkey") % 24, "MINU": C("o_custkey") % 60, "DHR": C("o_custkey") % 7200}
    m = t("orders").select(C("o_orderkey").alias("loc"), *(c.cast("int").alias(n) for n, c in parts.items()))
    spec = {"timestamp": {"datetime": {k: f"*/{q}" for k, q in (("year", "YEAR"), ("month", "MNTH"), ("day", "DAYS"), ("hour", "HOUR"), ("minute", "MINU"))}}}
    offset = {"timestamp": {"timeoffset": {"timeOffset": "*/DHR", "referenceTime": "2024-05-27T00:00:00Z", "transforms": [{"scale": 60}]}}}
    return m.select("loc", *(mapping.variable(m.schema, s).cast("timestamp_ntz").alias(n) for n, s in (("by_parts", spec), ("by_offset", offset))))


@query("SELECT event_id, user_id AS station, value FROM events WHERE user_id < 20")
def print_filter_data(t):
    spec = {"filter": "Print Filter Data", "message": "x", "variables": [{"variable": "MetaData/station"}, {"variable": "ObsValue/x"}], "where": [{"variable": "MetaData/station", "maxvalue": 19}]}
    return filters.filter_data(filters.apply(events(t), spec), spec).toDF("event_id", "station", "value")


@query(f"""SELECT {LOC}, round(l_extendedprice + (l_quantity - l_linenumber * 10) * 0.0065, 6) AS t, round(l_extendedprice * power((280.0 + (l_quantity - l_linenumber * 10) * 0.0065) / 280.0, 9.80665 / (287.05 * 0.0065)), 4) AS p FROM lineitem""")
def surface_corrections(t):
    """A field and a pressure of the surface, carried from the model's height to a station's."""
    height, station = C("l_quantity"), C("l_linenumber") * 10
    p = hops.surface_pressure_corrected(C("l_extendedprice"), F.lit(280.0), height, station)
    return t("lineitem").select(loc().alias("loc"), r6(hops.surface_corrected(C("l_extendedprice"), height, station)).alias("t"), F.round(p, 4).alias("p"))


@query(f"""WITH h AS (SELECT {LOC}, l_extendedprice / 1000.0 AS y, l_quantity AS g, l_tax AS f, l_discount * 100 AS x FROM lineitem)
SELECT loc, round(g * f, 6) AS identity, round(CASE WHEN x <= 2 THEN f WHEN x <= 6 THEN f + (x - 2.0) / 4.0 * (g - f) ELSE g END, 6) AS profile, round(y - g * f, 6) AS omb FROM h""")
def composite_operator(t):
    """hofx4d with two operators: a scaled field, and a profile at a coordinate."""
    df = t("lineitem").select(
        loc().alias("Location"), (C("l_extendedprice") / 1000.0).alias("ObsValue/a"), C("l_quantity").alias("ObsValue/b"), C("l_quantity").alias("GeoVaLs/a"), C("l_tax").alias("MetaData/scale"),
        F.array("l_tax", "l_quantity").alias("GeoVaLs/b"), F.array(F.lit(2.0), F.lit(6.0)).alias("GeoVaLs/air_pressure"), (C("l_discount") * 100).alias("MetaData/pressure"),
    )
    space = ObsSpace.of(df, {c: C(f"`{c}`") for c in df.columns}, ["a", "b"])
    parts = [{"name": "Identity", "variables": [{"name": "a"}], "hofx scaling field": "scale"}, {"name": "VertInterp", "variables": [{"name": "b"}]}]
    done = dispatch("HofX4D", space, {"obs operator": {"name": "Composite", "components": parts}})
    return done.df.select(C("Location").alias("loc"), r6(C("`HofX/a`")).alias("identity"), r6(C("`HofX/b`")).alias("profile"), r6(C("`ombg/a`")).alias("omb"))


@query(f"SELECT {LOC}, round(l_extendedprice - l_quantity, 6) AS a_minus_b, round(l_quantity - l_tax, 6) AS b_minus_c, CASE WHEN l_linenumber <= 3 AND l_tax > 0.02 THEN l_extendedprice END AS passed FROM lineitem")
def column_transforms(t):
    """Transforms of diagnostics: an expression, for each of two pairs of columns, and values where conditions hold."""
    df = t("lineitem").withColumn("loc", loc())
    pairs = stats.for_each(df, lambda d, new, x, y: stats.arithmetic(d, new, "round(x - y, 6)", {"x": x, "y": y}), new=["a_minus_b", "b_minus_c"], x=["l_extendedprice", "l_quantity"], y=["l_quantity", "l_tax"])
    return stats.accept_where(pairs, "passed", "l_extendedprice", ["`l_linenumber` <= 3", "`l_tax` > 0.02"]).select("loc", "a_minus_b", "b_minus_c", "passed")


@query(f"SELECT {LOC}, round(radians(l_quantity), 6) AS rad, 1.5::FLOAT AS filled FROM lineitem")
def radians_and_fill(t):
    return t("lineitem").select(loc().alias("loc"), r6(scalars.radians(C("l_quantity"))).alias("rad"), scalars.filled(1.5).alias("filled"))
