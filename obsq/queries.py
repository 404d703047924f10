"""A query for each operator over the driver's tables, which stand in for observations, with SQL that gives the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsq.functions import geometry, named, predicates, scalars
from obsq.operators import ensemble, filters, hops, nearby, profiles, stats, thinning
from obsq.operators.space import ObsSpace
from obsq.plans import mapping
from obsq.plans.pipeline import Pipeline
from obsq.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
C = F.col


def query(sql: str | None = None):
    """Register a function (table -> DataFrame) under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def r6(c):
    return F.round(c, 6)


def events(t, errors: bool = False) -> ObsSpace:
    """Events as observations: the mean of their type stands for what was simulated, a ramp in the station for the error."""
    e = t("events")
    mean = e.groupBy("event_type").agg(F.avg("value").alias("h"))  # a row for each type
    cols = {"Location": C("event_id"), "MetaData/dateTime": C("ts"), "MetaData/station": C("user_id"), "MetaData/type": C("event_type"), "ObsValue/x": C("value"), "HofX/x": C("h")}
    space = ObsSpace.of(e.join(F.broadcast(mean), "event_type"), cols, ["x"])
    if errors:
        space = filters.apply(space, {"filter": "Perform Action", "action": {"name": "assign error", "error function": {"name": "ObsFunction/ObsErrorModelRamp", "options": {"xvar": "MetaData/station", "x0": 10, "x1": 100, "err0": 5, "err1": 50}}}})
    return space


EV = """e AS (SELECT event_id, ts, user_id, event_type, value AS y, avg(value) OVER (PARTITION BY event_type) AS h,
  CASE WHEN user_id <= 10 THEN 5.0 WHEN user_id >= 100 THEN 50.0 ELSE 5.0 + 45.0 * (user_id - 10) / 90.0 END AS s FROM events)"""


def state(space: ObsSpace, *more: str) -> DataFrame:
    return space.df.select(C("Location").alias("event_id"), C("`QC/x`").alias("qc"), *(C(f"`{m}`").alias(m.split("/")[-1].lower() if m.count("/") < 2 else m.split("/")[1].lower()) for m in more))


def lines(t) -> ObsSpace:
    """Order lines as observations of a price, at a pressure (quantity), with a mark (line number)."""
    key = (C("l_orderkey") * 8 + C("l_linenumber")).alias("Location")
    cols = {"MetaData/pressure": C("l_quantity"), "ObsValue/p": C("l_extendedprice"), "QualityMarker/p": C("l_linenumber"), "MetaData/type": C("l_returnflag")}
    return ObsSpace.of(t("lineitem"), cols, ["p"], keep=[key])


def one(spec: dict):
    return lambda t: state(filters.apply(events(t, True), spec))


@query(f"""WITH {EV}, q AS (SELECT *, CASE WHEN y < 0 OR y > 400 THEN 15 WHEN abs(y - h) > 3 * s THEN 19 ELSE 0 END AS qc FROM e)
SELECT event_type, count(*) AS nobs, count(*) FILTER (qc = 0) AS npass, round(sum(CASE WHEN qc = 0 THEN ((y - h) / s) * ((y - h) / s) END), 4) AS jo,
 round(min(y - h), 6) AS min_omb, round(max(y - h), 6) AS max_omb, round(stddev_pop(y - h), 6) AS std_omb FROM q GROUP BY event_type""")
def qc_min_slice(t):
    s = Pipeline.of({"obs filters": [{"filter": "Bounds Check", "minvalue": 0, "maxvalue": 400}, {"filter": "Background Check", "threshold": 3.0}]}).run(events(t, True))
    d = s.departure("x")
    ok = s.passed("x")
    return s.df.groupBy(C("`MetaData/type`").alias("event_type")).agg(
        F.count("*").alias("nobs"), F.count(F.when(ok, 1)).alias("npass"), F.round(F.sum(F.when(ok, F.pow(d / C("`Err/x`"), 2))), 4).alias("jo"), r6(F.min(d)).alias("min_omb"), r6(F.max(d)).alias("max_omb"), r6(F.stddev_pop(d)).alias("std_omb")
    )


@query("SELECT event_id, CASE WHEN value < 5 OR value > 300 THEN 15 ELSE 0 END AS qc FROM events")
def bounds_check(t):
    return one({"filter": "Bounds Check", "minvalue": 5, "maxvalue": 300})(t)


@query("SELECT l_orderkey * 8 + l_linenumber AS loc, CASE WHEN l_quantity < 5 OR l_quantity > 40 THEN 15 ELSE 0 END AS qc FROM lineitem")
def bounds_check_test_variable(t):
    s = filters.apply(lines(t), {"filter": "Bounds Check", "filter variables": [{"name": "p"}], "test variables": [{"name": "MetaData/pressure"}], "minvalue": 5, "maxvalue": 40})
    return s.df.select(C("Location").alias("loc"), C("`QC/p`").alias("qc"))


for _name, _spec, _test in (
    ("background_check_sigma", {"threshold": 3.0}, "abs(y - h) > 3 * s"),
    ("background_check_absolute", {"absolute threshold": 50.0}, "abs(y - h) > 50"),
    ("background_check_min_of_both", {"threshold": 3.0, "absolute threshold": 60.0}, "abs(y - h) > least(3 * s, 60)"),
    ("background_check_function", {"function absolute threshold": [{"name": "ObsFunction/WindsSPDBCheck", "options": {"type": "MetaData/station", "error": "Err/x", "wndtype": "0-200", "cgross": [2.5] * 201, "error_min": [10.0] * 201, "error_max": [30.0] * 201}}]}, "abs(y - h) > CASE WHEN user_id BETWEEN 0 AND 200 THEN 2.5 * greatest(10, least(30, s)) END"),
):
    QUERIES[_name] = (lambda spec: lambda spark, d: one({"filter": "Background Check"} | spec)(lambda n: spark.read.parquet(f"{d}/{n}.parquet")))(_spec)
    SQL[_name] = f"WITH {EV} SELECT event_id, CASE WHEN {_test} THEN 19 ELSE 0 END AS qc FROM e"


@query("SELECT event_id, CASE WHEN user_id BETWEEN 20 AND 99 AND value <= 200 THEN 0 ELSE 14 END AS qc FROM events")
def domain_check(t):
    return one({"filter": "Domain Check", "where": [{"variable": {"name": "MetaData/station"}, "is_in": "20-99"}, {"variable": {"name": "ObsValue/x"}, "maxvalue": 200}]})(t)


@query("SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN 12 ELSE 0 END AS qc FROM events")
def reject_list(t):
    return one({"filter": "RejectList", "where": [{"variable": {"name": "MetaData/type"}, "is_in": ["error", "signup"]}]})(t)


@query("""SELECT e.event_id, CASE WHEN l.user_id IS NOT NULL THEN 0 ELSE 12 END AS qc FROM events e
LEFT JOIN (SELECT DISTINCT c_custkey AS user_id, CASE c_nationkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'error' ELSE 'signup' END AS event_type FROM customer) l
ON e.user_id = l.user_id AND e.event_type = l.event_type""")
def accept_list(t):
    """Everything is rejected, and what a list of (type, station) names is accepted again."""
    kinds = F.array(*map(F.lit, ("click", "view", "purchase", "error", "signup")))
    listed = t("customer").select(C("c_custkey").alias("MetaData/station"), F.element_at(kinds, F.pmod("c_nationkey", F.lit(5)) + 1).alias("MetaData/type")).distinct().withColumn("listed", F.lit(1))
    s = filters.apply(events(t), {"filter": "RejectList"})
    s = ObsSpace(s.df.join(listed, ["MetaData/station", "MetaData/type"], "left"), s.variables)
    return state(filters.apply(s, {"filter": "AcceptList", "where": [{"variable": {"name": "listed"}, "value": "is_valid"}]}))


@query(f"WITH {EV} SELECT event_id, 0 AS qc, round(CASE WHEN event_type = 'view' THEN s * 1.5 ELSE s END, 6) AS x FROM e")
def blacklist_action(t):
    s = filters.apply(events(t, True), {"filter": "BlackList", "where": [{"variable": {"name": "MetaData/type"}, "is_in": ["view"]}], "action": {"name": "inflate error", "inflation factor": 1.5}})
    return s.df.select(C("Location").alias("event_id"), C("`QC/x`").alias("qc"), r6(C("`Err/x`")).alias("x"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice - s < -50000 OR o_totalprice - s > 50000 THEN 17 WHEN s IS NULL THEN 0 ELSE 0 END AS qc
FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def difference_check(t):
    total = t("lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("GeoVaLs/total"))
    df = t("orders").join(total, C("o_orderkey") == C("l_orderkey"), "left").select(C("o_orderkey").alias("Location"), C("o_totalprice").alias("ObsValue/x"), "`GeoVaLs/total`")
    s = filters.apply(ObsSpace(df, ("x",)).started(), {"filter": "Difference Check", "reference": "GeoVaLs/total", "value": "ObsValue/x", "minvalue": -50000, "maxvalue": 50000})
    return s.df.select(C("Location").alias("o_orderkey"), C("`QC/x`").alias("qc"))


@query("SELECT event_id FROM events WHERE (user_id BETWEEN 4 AND 15 OR user_id IN (20, 25)) AND value >= 10 AND value <= 150")
def where_range_set(t):
    return events(t).df.where(predicates.where([{"variable": "MetaData/station", "is_in": "4-15, 20, 25"}, {"variable": "x@ObsValue", "minvalue": 10, "maxvalue": 150}])).select(C("Location").alias("event_id"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderkey & 512) <> 0 OR (o_orderkey & 4) <> 0")
def where_bitset(t):
    return t("orders").where(predicates.where([{"variable": "o_orderkey", "any_bit_set_of": "2, 9"}])).select("o_orderkey")


@query("SELECT event_id, user_id % 7 <> 0 AND value < 100 AS valid, user_id % 7 = 0 OR value >= 100 AS missing FROM events")
def where_is_valid(t):
    e = t("events").withColumn("v", F.when((C("user_id") % 7 != 0) & (C("value") < 100), C("value")))
    return e.select("event_id", predicates.where([{"variable": "v", "value": "is_valid"}]).alias("valid"), predicates.where([{"variable": "v", "value": "is_not_valid"}]).alias("missing"))


@query("SELECT event_id FROM events WHERE event_type NOT IN ('view', 'click') OR user_id NOT BETWEEN 10 AND 50")
def where_not_in(t):
    return t("events").where(predicates.where([{"variable": "event_type", "is_not_in": ["view", "click"]}, {"variable": "user_id", "is_not_in": "10-50"}], "or")).select("event_id")


@query("SELECT event_id FROM events WHERE user_id > 10 AND user_id < 80 AND event_type = 'view'")
def where_open_interval(t):
    return t("events").where(predicates.where([{"variable": "user_id", "min_exclusive": 10, "max_exclusive": 80}, {"variable": "event_type", "is_in": ["view"]}])).select("event_id")


@query("""SELECT l_orderkey * 8 + l_linenumber AS loc, round(CASE WHEN q >= 50 THEN 1.1 WHEN q >= 30 THEN 1.1 + (50 - q) * 0.02 WHEN q >= 10 THEN 1.5 + (30 - q) * 0.05 ELSE 2.5 END, 6) AS err
FROM (SELECT *, l_quantity AS q FROM lineitem)""")
def assign_error_stepwise(t):
    o = {"xvar": {"name": "MetaData/pressure"}, "xvals": [50, 30, 10], "errors": [1.1, 1.5, 2.5]}
    s = filters.apply(lines(t), {"filter": "Perform Action", "action": {"name": "assign error", "error function": {"name": "ObsFunction/ObsErrorModelStepwiseLinear", "options": o}}})
    return s.df.select(C("Location").alias("loc"), r6(C("`Err/p`")).alias("err"))


@query(f"WITH {EV} SELECT event_id, round(s, 6) AS err FROM e")
def assign_error_ramp(t):
    return events(t, True).df.select(C("Location").alias("event_id"), r6(C("`Err/x`")).alias("err"))


@query(f"WITH {EV} SELECT event_id, round(CASE WHEN y > 100 THEN s * (0.5 * y + 0.1 * user_id) ELSE s END, 6) AS err FROM e")
def inflate_error(t):
    f = {"name": "ObsFunction/Arithmetic", "options": {"variables": [{"name": "ObsValue/x"}, {"name": "MetaData/station"}], "coefs": [0.5, 0.1]}}
    s = filters.apply(events(t, True), {"filter": "Perform Action", "where": [{"variable": {"name": "ObsValue/x"}, "min_exclusive": 100}], "action": {"name": "inflate error", "inflation variable": f}})
    return s.df.select(C("Location").alias("event_id"), r6(C("`Err/x`")).alias("err"))


@query(f"WITH {EV} SELECT event_id, CASE WHEN abs(y - h) > 2 * greatest(10, least(30, s)) THEN 19 ELSE 0 END AS qc, round(s, 6) AS err FROM e")
def clamp_restore(t):
    """The error is kept aside, held within bounds for the gross check, and put back."""
    clamp = [
        {"filter": "Variable Assignment", "assignments": [{"name": "TempObsErrorData/x", "source variable": "Err/x", "type": "double"}]},
        {"filter": "Perform Action", "where": [{"variable": "TempObsErrorData/x", "maxvalue": 10}], "action": {"name": "assign error", "error parameter": 10}},
        {"filter": "Perform Action", "where": [{"variable": "TempObsErrorData/x", "minvalue": 30}], "action": {"name": "assign error", "error parameter": 30}},
        {"filter": "Background Check", "threshold": 2.0},
        {"filter": "Perform Action", "action": {"name": "assign error", "error parameter": "TempObsErrorData/x"}},
    ]
    s = Pipeline.of({"obs filters": clamp}).run(events(t, True))
    return s.df.select(C("Location").alias("event_id"), C("`QC/x`").alias("qc"), r6(C("`Err/x`")).alias("err"))


@query("SELECT l_orderkey * 8 + l_linenumber AS loc, round((2.0 * l_extendedprice - 3.0 * l_quantity) * 0.5, 6) AS made FROM lineitem WHERE l_quantity > 10")
def variable_assignment_arithmetic(t):
    f = {"name": "ObsFunction/Arithmetic", "options": {"variables": ["ObsValue/p", "MetaData/pressure"], "coefs": [2.0, -3.0], "total coefficient": 0.5}}
    s = filters.apply(lines(t), {"filter": "Variable Assignment", "where": [{"variable": "MetaData/pressure", "min_exclusive": 10}], "assignments": [{"name": "made@DerivedVariables", "function": f, "type": "double"}]})
    return s.df.where("`DerivedVariables/made` IS NOT NULL").select(C("Location").alias("loc"), r6(C("`DerivedVariables/made`")).alias("made"))


@query(f"WITH {EV} SELECT event_id, CASE WHEN y > 200 THEN 15 ELSE 0 END AS qc, abs(y - h) > 50 AND y <= 200 AS far FROM e")
def diagnostic_flags(t):
    p = [
        {"filter": "Create Diagnostic Flags", "flags": [{"name": "Far", "initial value": False}]},
        {"filter": "Bounds Check", "maxvalue": 200},
        {"filter": "Background Check", "absolute threshold": 50, "action": {"name": "set", "flag": "Far", "ignore": "rejected observations"}},
    ]
    return state(Pipeline.of({"obs filters": p}).run(events(t)), "Diag/Far/x")


@query(f"WITH {EV} SELECT event_id, CASE WHEN user_id > 140 THEN 12 WHEN y > 300 THEN 15 WHEN event_type = 'error' THEN 12 WHEN abs(y - h) > 2 * s THEN 19 ELSE 0 END AS qc FROM e")
def staged_pipeline(t):
    """The deferred background check comes last, after the post stage's own list."""
    p = {
        "obs post filters": [{"filter": "RejectList", "where": [{"variable": "MetaData/type", "is_in": ["error"]}]}],
        "obs prior filters": [{"filter": "Bounds Check", "maxvalue": 300}],
        "obs pre filters": [{"filter": "RejectList", "where": [{"variable": "MetaData/station", "min_exclusive": 140}]}],
        "obs filters": [],
    }
    staged = Pipeline.of(p)
    staged.post.append({"filter": "Background Check", "threshold": 2.0, "defer to post": True})
    return state(staged.run(events(t, True)))


@query("SELECT event_id, CASE WHEN value > 100 THEN 15 ELSE 0 END AS qc FROM events")
def iteration_gate(t):
    p = [{"filter": "Bounds Check", "maxvalue": 50, "apply at iterations": "0"}, {"filter": "Bounds Check", "maxvalue": 100, "apply at iterations": "1-2"}]
    return state(Pipeline.of({"obs filters": p}).run(events(t), iteration=1))


@query("SELECT l_orderkey * 8 + l_linenumber AS loc, CASE WHEN l_linenumber > 3 THEN 11 ELSE 0 END AS qc FROM lineitem")
def pre_qc(t):
    s = filters.apply(lines(t), {"filter": "PreQC", "maxvalue": 3})
    return s.df.select(C("Location").alias("loc"), C("`QC/p`").alias("qc"))


@query("""WITH RECURSIVE k AS (
 SELECT user_id, min({'t': ts, 'l': event_id}) AS m FROM events GROUP BY user_id
 UNION ALL
 SELECT user_id, m FROM (SELECT k.user_id, min({'t': e.ts, 'l': e.event_id}) AS m FROM k JOIN events e ON e.user_id = k.user_id AND e.ts >= k.m.t + INTERVAL 6 HOUR GROUP BY k.user_id))
SELECT m.l AS event_id FROM k""")
def temporal_thinning(t):
    s = filters.apply(events(t), {"filter": "Temporal Thinning", "min_spacing": "PT6H", "category_variable": {"name": "MetaData/station"}})
    return s.df.where("`QC/x` = 0").select(C("Location").alias("event_id"))


@query("""WITH s AS (SELECT *, TIMESTAMP '2024-01-15 00:00:00' AS z FROM events), n AS (
 SELECT user_id, min({'d': abs(epoch_us(ts) - epoch_us(z)), 't': ts, 'l': event_id}) AS m FROM s GROUP BY user_id),
w AS (SELECT e.user_id, e.event_id, epoch_us(e.ts) - epoch_us(n.m.t) AS d, CASE WHEN e.ts < n.m.t THEN 0 ELSE 1 END AS side FROM events e JOIN n ON e.user_id = n.user_id),
b AS (SELECT user_id, side, event_id, abs(d) AS d FROM w UNION ALL SELECT user_id, 0, event_id, 0 FROM w WHERE d = 0),
g AS (SELECT user_id, side, list({'d': d, 'l': event_id} ORDER BY d, event_id) AS x FROM b GROUP BY user_id, side),
f AS (SELECT user_id, list_reduce(list_transform(x, lambda r: {'last': r.d, 'kept': [r.l]}), lambda a, r: CASE WHEN r.last - a.last >= 21600000000 THEN {'last': r.last, 'kept': a.kept || r.kept} ELSE a END) AS o FROM g)
SELECT DISTINCT unnest(o.kept) AS event_id FROM f""")
def temporal_thinning_seed(t):
    """From the row nearest to the analysis time, both ways."""
    s = filters.apply(events(t), {"filter": "Temporal Thinning", "min_spacing": "PT6H", "seed_time": "2024-01-15 00:00:00", "category_variable": {"name": "MetaData/station"}})
    return s.df.where("`QC/x` = 0").select(C("Location").alias("event_id"))


LONLAT = "c_custkey * 37 % 36000 / 100.0 AS lon, c_custkey * 17 % 18000 / 100.0 - 90.0 AS lat"


def places(t) -> DataFrame:
    return t("customer").select("c_custkey", ((C("c_custkey") * 37 % 36000) / 100.0).alias("lon"), ((C("c_custkey") * 17 % 18000) / 100.0 - 90.0).alias("lat"))


def hav(lon2: str, lat2: str) -> str:
    return f"12742.0 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({lat2})) * pow(sin(radians({lon2} - lon) / 2), 2))))"


@query(f"""WITH p AS (SELECT c_custkey, {LONLAT}), a AS (SELECT *, 180.0 * 1450.0 / (pi() * 6371.0) AS step FROM p), b AS (SELECT *, floor((lat + 90) / step) AS band FROM a),
c AS (SELECT *, (band + 0.5) * step - 90 AS mid FROM b), d AS (SELECT *, greatest(floor(cos(radians(mid)) * 360 / step), 1) AS n FROM c), e AS (SELECT *, least(floor(lon / (360 / n)), n - 1) AS k FROM d),
f AS (SELECT *, round({hav('((k + 0.5) * 360 / n)', 'mid')}, 6) AS dist FROM e)
SELECT c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY band, k ORDER BY dist, c_custkey) AS r FROM f) WHERE r = 1""".replace(LONLAT + ")", LONLAT + " FROM customer)"))
def cell_thinning(t):
    df = places(t).select(C("c_custkey").alias("Location"), C("lon").alias("MetaData/longitude"), C("lat").alias("MetaData/latitude"), C("lat").alias("ObsValue/x"))
    s = filters.apply(ObsSpace(df, ("x",)).started(), {"filter": "Gaussian Thinning", "horizontal_mesh": 1450})
    return s.df.where("`QC/x` = 0").select(C("Location").alias("c_custkey"))


DOWN = {"group variables": ["l_orderkey"], "sort variable": "l_quantity", "sort order": "descending"}


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS level FROM lineitem")
def profile_sort(t):
    return profiles.levels(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), DOWN, "l_linenumber", "level").drop("l_quantity")


@query("""SELECT l_orderkey, l_linenumber, round(lag(l_quantity) OVER w - l_quantity, 6) AS above, round(l_quantity - lead(l_quantity) OVER w, 6) AS below
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber)""")
def neighbour_spacing(t):
    above, below = profiles.spacing(C("l_quantity"), DOWN, "l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber", r6(above).alias("above"), r6(below).alias("below"))


def simple(name: str, tab: str, cols: Callable[[], dict], sql: str) -> None:
    """A query that is one projection of a table."""
    QUERIES[name] = lambda spark, d: spark.read.parquet(f"{d}/{tab}.parquet").select(*(c.alias(n) for n, c in cols().items()))
    SQL[name] = sql


LOC = "l_orderkey * 8 + l_linenumber AS loc"


# Columns can only be made in a session, so what a module holds are functions that make them.
def loc():
    return C("l_orderkey") * 8 + C("l_linenumber")


def qty():
    return C("l_quantity")


def price():
    return C("l_extendedprice")


simple("wind_components", "lineitem", lambda: {"loc": loc(), "u": F.round(scalars.wind_u(qty(), price()).cast("double"), 2), "v": F.round(scalars.wind_v(qty(), price()).cast("double"), 2)}, f"SELECT {LOC}, round((-l_quantity * sin(radians(l_extendedprice)))::FLOAT::DOUBLE, 2) AS u, round((-l_quantity * cos(radians(l_extendedprice)))::FLOAT::DOUBLE, 2) AS v FROM lineitem")
simple("velocity", "lineitem", lambda: {"loc": loc(), "speed": r6(named.resolve({"name": "ObsFunction/Velocity", "options": {"eastward": "l_quantity", "northward": "l_linenumber"}}))}, f"SELECT {LOC}, round(sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber), 6) AS speed FROM lineitem")
_dir = "(degrees(atan2(-{a}, -{b})) + 360.0) % 360.0"
simple(
    "angle_difference", "lineitem",
    lambda: {"loc": loc(), "angle": F.round(named.resolve({"name": "ObsFunction/WindDirAngleDiff", "options": {"u": "l_quantity", "v": "l_linenumber", "hofx_u": "l_suppkey", "hofx_v": "l_tax"}}), 4)},
    f"SELECT {LOC}, round(CASE WHEN least(sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber), sqrt(l_suppkey * l_suppkey + l_tax * l_tax)) < 0.0001 THEN 0 ELSE least(d, 360 - d) END, 4) AS angle FROM (SELECT *, abs({_dir.format(a='l_quantity', b='l_linenumber')} - {_dir.format(a='l_suppkey', b='l_tax')}) AS d FROM lineitem)",
)
simple("err_norm", "lineitem", lambda: {"loc": loc(), "ratio": r6(named.resolve({"name": "ObsFunction/SatWindsErrnormCheck", "options": {"u": "l_discount", "v": "l_tax", "expected error": "l_quantity"}}))}, f"SELECT {LOC}, round(CASE WHEN sqrt(l_discount * l_discount + l_tax * l_tax) < 0.1 THEN 100.0 ELSE (10.0 - 0.1 * l_quantity) / sqrt(l_discount * l_discount + l_tax * l_tax) END, 6) AS ratio FROM lineitem")
simple("scan_position", "lineitem", lambda: {"loc": loc(), "position": scalars.scan_position(price() / 4)}, f"SELECT {LOC}, (CASE WHEN (l_extendedprice / 4) % 1 > 0.5 THEN ceil(l_extendedprice / 4) ELSE floor(l_extendedprice / 4) END + 1)::INTEGER AS position FROM lineitem")
simple("half_even_round", "lineitem", lambda: {"loc": loc(), "rounded": scalars.round_half_even(qty() / 2)}, f"SELECT {LOC}, round_even(l_quantity / 2, 0) AS rounded FROM lineitem")
simple("longitude_wrap", "customer", lambda: {"c_custkey": C("c_custkey"), "east": r6(scalars.longitude_360(C("c_acctbal"))), "signed": r6(scalars.longitude_180(C("c_acctbal")))}, "SELECT c_custkey, round(((c_acctbal % 360) + 360) % 360, 6) AS east, round(CASE WHEN c_acctbal > 180 THEN c_acctbal - 360 ELSE c_acctbal END, 6) AS signed FROM customer")
simple("type_code", "events", lambda: {"event_id": C("event_id"), "code": scalars.type_code(C("user_id"), F.when(C("event_type") == "view", "windEastward").otherwise(C("event_type")))}, "SELECT event_id, CASE WHEN user_id < 100 THEN user_id + CASE WHEN event_type = 'view' THEN 200 ELSE 100 END ELSE user_id END AS code FROM events")
simple("mask_large", "lineitem", lambda: {"loc": loc(), "masked": scalars.mask_large(price(), 20000.0)}, f"SELECT {LOC}, CASE WHEN l_extendedprice <= 20000 THEN l_extendedprice END AS masked FROM lineitem")
simple("magnitude_bounds", "customer", lambda: {"c_custkey": C("c_custkey"), "low": r6(scalars.magnitude_floor(C("c_acctbal"))), "high": r6(scalars.magnitude_ceil(C("c_acctbal")))}, "SELECT c_custkey, round(CASE WHEN v = 0 THEN 0.0 ELSE floor(v / m) * m END, 6) AS low, round(CASE WHEN v = 0 THEN 0.0 ELSE ceil(v / m) * m END, 6) AS high FROM (SELECT c_custkey, c_acctbal AS v, CASE WHEN c_acctbal = 0 THEN NULL ELSE pow(10.0, floor(log10(abs(nullif(c_acctbal, 0))))) END AS m FROM customer)")
simple("theta_to_t", "lineitem", lambda: {"loc": loc(), "t": r6(scalars.temperature(F.lit(300.0) + qty(), F.lit(100.0) + qty() * 10))}, f"SELECT {LOC}, round((300.0 + l_quantity) / pow(1000.0 / (100.0 + l_quantity * 10), 0.286), 6) AS t FROM lineitem")
simple("unit_conversions", "lineitem", lambda: {"loc": loc(), "pa": r6(scalars.hpa_to_pa(qty())), "k": r6(scalars.celsius_to_kelvin(qty())), "cloud": r6(scalars.cloud_amount(qty())), "range_m": r6(scalars.gate_range(qty())), "rad": r6(F.radians(qty()))}, f"SELECT {LOC}, round(l_quantity * 100.0, 6) AS pa, round(l_quantity + 273.15, 6) AS k, round(100.0 - l_quantity, 6) AS cloud, round(l_quantity * 125.0, 6) AS range_m, round(radians(l_quantity), 6) AS rad FROM lineitem")
simple("departures", "lineitem", lambda: {"loc": loc(), "hofx": r6(scalars.simulated(price(), qty())), "percent": r6(scalars.percent_difference(price(), qty() - 10))}, f"SELECT {LOC}, round(-l_quantity + l_extendedprice, 6) AS hofx, round(CASE WHEN l_quantity = 10 THEN NULL ELSE 100.0 * (l_extendedprice - (l_quantity - 10)) / nullif(l_quantity - 10, 0) END, 6) AS percent FROM lineitem")
simple("masked_type", "events", lambda: {"event_id": C("event_id"), "kind": scalars.type_where_valid(F.when(C("value") > 50, C("value")), C("user_id"))}, "SELECT event_id, CASE WHEN value > 50 THEN user_id END AS kind FROM events")
simple("time_decode", "events", lambda: {"event_id": C("event_id"), "epoch": scalars.date_time(C("value") - 100, 1704067200)}, "SELECT event_id, trunc(value - 100)::BIGINT + 1704067200 AS epoch FROM events")
simple("cycle_strings", "orders", lambda: {"o_orderkey": C("o_orderkey"), "day": F.substring(F.date_format("o_orderdate", "yyyyMMddHH"), 1, 8), "hour": F.substring(F.date_format("o_orderdate", "yyyyMMddHH"), 9, 2), "part": scalars.file_cycle(F.concat(F.lit("obs."), F.date_format("o_orderdate", "yyyyMMddHH"), F.lit(".nc4")))}, "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, strftime(o_orderdate, '%H') AS hour, strftime(o_orderdate, '%Y%m%d%H') AS part FROM orders")
simple("channel_slice", "embeddings", lambda: {"vec_id": C("vec_id"), "total": F.round(F.aggregate(scalars.channel_slice(C("embedding"), 7, 16), F.lit(0.0), lambda a, x: a + x.cast("double")), 4)}, "SELECT vec_id, round(list_sum(list_transform(list_slice(embedding, 7, 16), lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
simple("symmetric_match", "lineitem", lambda: {"loc": loc(), "mean": r6(named.resolve({"name": "ObsFunction/CLWRetSymmetricMW", "options": {"observed": "l_discount", "simulated": "l_tax"}})), "same": named.resolve({"name": "ObsFunction/CLWMatchIndexMW", "options": {"observed": "l_discount", "simulated": "l_tax", "clwret_clearsky": [0.05]}})[0]}, f"SELECT {LOC}, round(0.5 * (l_discount + l_tax), 6) AS mean, CASE WHEN (l_discount > 0.05) = (l_tax > 0.05) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS same FROM lineitem")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 09:00:00' AND ts < TIMESTAMP '2024-01-10 15:00:00'")
def window_filter(t):
    begin, end = scalars.cycle_window("2024011012", 6)
    return t("events").where((C("ts") >= F.lit(str(begin)).cast("timestamp")) & (C("ts") < F.lit(str(end)).cast("timestamp"))).select("event_id")


@query("SELECT event_type, count(*) AS n, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def obs_stats(t):
    return stats.summary(t("events"), ["event_type"], C("value"))


JO = f"WITH {EV}, j AS (SELECT event_type, count(*) FILTER (y <= 300) AS nobs, round(coalesce(sum(CASE WHEN y <= 300 THEN pow((y - h) / s, 2) END), 0), 4) AS jo, round(sum(CASE WHEN y <= 300 THEN pow((y - h) / s, 2) END) / count(*) FILTER (y <= 300), 4) AS jo_per_n, round(sqrt(avg(CASE WHEN y <= 300 THEN s * s END)), 4) AS err FROM e GROUP BY event_type)"


def costs(t) -> DataFrame:
    s = filters.apply(events(t, True), {"filter": "Bounds Check", "maxvalue": 300})
    return stats.jo(s.df.withColumnRenamed("MetaData/type", "event_type"), ["event_type"], C("`ObsValue/x`"), C("`HofX/x`"), C("`Err/x`"), s.passed("x"), 4)


@query(JO + " SELECT * FROM j")
def jo_by_space(t):
    return costs(t)


@query(JO + " SELECT round(sum(jo) + 100.0, 2) AS j FROM j")
def total_cost(t):
    """The background's part, 100 here, and that of all spaces."""
    return costs(t).agg(F.round(F.sum("jo") + 100.0, 2).alias("j"))


@query(JO + ", s AS (SELECT DISTINCT event_type FROM events UNION ALL SELECT 'sonde') SELECT event_type, coalesce(nobs, 0) AS nobs, coalesce(jo, 0) AS jo FROM s LEFT JOIN j USING (event_type)")
def empty_space(t):
    spaces = t("events").select("event_type").distinct().union(t("region").select(F.lit("sonde")).limit(1))
    return stats.with_empty(costs(t), spaces, "event_type").select("event_type", "nobs", "jo")


@query("SELECT l_returnflag, round(min(l_quantity), 6) AS min, round(max(l_quantity), 6) AS max, round(sqrt(avg(l_quantity * l_quantity)), 6) AS rms FROM lineitem GROUP BY l_returnflag")
def rms_by_field(t):
    return stats.rms(t("lineitem"), ["l_returnflag"], C("l_quantity"))


@query("SELECT s_nationkey, round(sqrt(sum(s_acctbal * s_acctbal)), 4) AS norm FROM supplier GROUP BY s_nationkey")
def bias_norm(t):
    return t("supplier").groupBy("s_nationkey").agg(F.round(stats.norm(C("s_acctbal")), 4).alias("norm"))


EMB = "SELECT vec_id, label, unnest(range(1, 65)) AS channel, unnest(embedding)::DOUBLE AS v FROM embeddings"


@query(f"SELECT channel, count(v) AS tbCount, round(avg(v), 6) AS tbMean, round(min(v), 6) AS tbMin, round(max(v), 6) AS tbMax, round(stddev_pop(v), 6) AS tbStd FROM ({EMB}) GROUP BY channel")
def channel_stats(t):
    return stats.channel_stats(t("embeddings"), "embedding", "tb").withColumn("channel", C("channel").cast("long"))


@query(f"SELECT channel, count(*) FILTER (abs(v) <= 1) AS a, count(*) FILTER (abs(v) <= 2) AS b, count(*) FILTER (abs(v) <= 2) - count(*) FILTER (abs(v) <= 1) AS difference FROM ({EMB}) GROUP BY channel")
def channel_pass_counts(t):
    v = F.abs(C("value").cast("double"))
    a, b = F.count(F.when(v <= 1, 1)), F.count(F.when(v <= 2, 1))
    return stats.by_channel(t("embeddings"), "embedding").groupBy(C("channel").cast("long").alias("channel")).agg(a.alias("a"), b.alias("b"), (b - a).alias("difference"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 2.0 OR x < -2.0)) > 0 AS rejected FROM embeddings")
def cross_channel_reject(t):
    return t("embeddings").select("vec_id", F.exists("embedding", lambda x: (x > 2.0) | (x < -2.0)).alias("rejected"))


@query("SELECT event_type AS kind, count(*) FILTER (value <= 300) - count(*) FILTER (value <= 200) AS difference FROM events GROUP BY event_type")
def qc_count_difference(t):
    """How many more pass the wider of two bounds, for each type."""

    def passed(most: int, name: str) -> DataFrame:
        s = filters.apply(events(t), {"filter": "Bounds Check", "maxvalue": most})
        return s.df.groupBy(C("`MetaData/type`").alias("kind")).agg(F.count_if(C("`QC/x`") == 0).alias(name))

    return passed(300, "wide").join(passed(200, "narrow"), "kind").select("kind", (C("wide") - C("narrow")).alias("difference"))


@query("SELECT l_partkey, count(*) AS members, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_partkey")
def ensemble_mean(t):
    return ensemble.moments(t("lineitem"), ["l_partkey"], C("l_quantity")).drop("variance")


@query("SELECT l_partkey, count(*) AS members, round(var_pop(l_quantity), 6) AS variance FROM lineitem GROUP BY l_partkey")
def ensemble_variance(t):
    return ensemble.moments(t("lineitem"), ["l_partkey"], C("l_quantity")).drop("mean")


def perturbed(t) -> DataFrame:
    """Quantities of a part as the prior, discounted ones as the posterior."""
    w = W.partitionBy("l_partkey")
    x = t("lineitem").withColumn("a", C("l_quantity") * (1 - C("l_discount")))
    return x.select(loc().alias("loc"), (C("l_quantity") - F.avg("l_quantity").over(w)).alias("xb"), (C("a") - F.avg("a").over(w)).alias("xa"), F.stddev_pop("l_quantity").over(w).alias("sb"), F.stddev_pop("a").over(w).alias("sa"))


PERT = f"WITH x AS (SELECT *, l_quantity * (1 - l_discount) AS a FROM lineitem), p AS (SELECT {LOC}, l_quantity - avg(l_quantity) OVER w AS xb, a - avg(a) OVER w AS xa, stddev_pop(l_quantity) OVER w AS sb, stddev_pop(a) OVER w AS sa FROM x WINDOW w AS (PARTITION BY l_partkey))"


@query(PERT + " SELECT loc, round(CASE WHEN sa = 0 THEN xa ELSE xa * (1 + 0.95 * (sb - sa) / sa) END, 5) AS x FROM p")
def rtps(t):
    return perturbed(t).select("loc", F.round(ensemble.rtps(C("xa"), C("sb"), C("sa"), 0.95), 5).alias("x"))


@query(PERT + " SELECT loc, round(0.4 * xa + 0.6 * xb, 9) AS x FROM p")
def rtpp(t):
    return perturbed(t).select("loc", F.round(ensemble.rtpp(C("xa"), C("xb"), 0.6), 9).alias("x"))


@query("SELECT l_partkey, round(0.15 * 9.0 + 0.85 * var_pop(l_quantity), 6) AS variance FROM lineitem GROUP BY l_partkey")
def hybrid_blend(t):
    return t("lineitem").groupBy("l_partkey").agg(r6(ensemble.hybrid_variance(F.lit(9.0), F.var_pop("l_quantity"), 0.15)).alias("variance"))


@query("SELECT (CASE WHEN l_quantity = 50 THEN 100 ELSE floor(l_quantity / 0.5) + 1 END)::INTEGER AS bin, count(*) AS count FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def histogram_100(t):
    return stats.histogram(t("lineitem"), C("l_quantity"), 0.0, 50.0)


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY l_returnflag")
def regression(t):
    return stats.regression(t("lineitem"), ["l_returnflag"], C("l_quantity"), C("l_extendedprice")).select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


BANDS = [(0, 10, 1000.0), (10, 25, 20000.0), (25, 40, 40000.0)]


@query(f"WITH b AS (SELECT * FROM (VALUES {', '.join(map(str, BANDS))}) AS b(lo, hi, most)) SELECT {LOC}, most, CASE WHEN l_extendedprice > most THEN 19 ELSE 0 END AS qc FROM lineitem LEFT JOIN b ON l_quantity >= lo AND l_quantity < hi".replace(LOC + ", most", LOC + ", most::DOUBLE AS most"))
def band_lookup(t):
    """A table of bands, three rows, in place of a filter for each."""
    x = t("lineitem")
    bands = x.sparkSession.createDataFrame(BANDS, "lo int, hi int, most double")
    j = x.join(F.broadcast(bands), (C("l_quantity") >= C("lo")) & (C("l_quantity") < C("hi")), "left")
    return j.select(loc().alias("loc"), "most", F.when(C("l_extendedprice") > C("most"), 19).otherwise(0).alias("qc"))


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 2")
def id_lookup(t):
    """An id that the dimension lacks gives null."""
    return t("supplier").join(t("nation").where("n_regionkey <> 2"), C("s_nationkey") == C("n_nationkey"), "left").select("s_suppkey", "n_name")


@query("SELECT s_nationkey, n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (0, 1) GROUP BY ALL")
def split_by_id(t):
    dim = t("nation").where("n_regionkey IN (0, 1)").select(C("n_nationkey").alias("s_nationkey"), "n_name")
    return files.split_by(t("supplier"), dim, "s_nationkey").groupBy("s_nationkey", "n_name").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 1))")
def anti_excluded(t):
    dim = t("nation").where("n_regionkey IN (0, 1)")
    return t("supplier").join(dim, C("s_nationkey") == C("n_nationkey"), "left_anti").select("s_suppkey")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) > 1")
def self_duplicates(t):
    return files.duplicates(t("events"), ["user_id", "event_type"])


POLYGON = [(20.0, -60.0), (200.0, -75.0), (300.0, 10.0), (180.0, 20.0), (250.0, 80.0), (40.0, 50.0)]


def polygon_sql(corners) -> str:
    edges = ", ".join(f"({x1!r}, {y1!r}, {x2!r}, {y2!r})" for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]))
    return f"WITH p AS (SELECT c_custkey, {LONLAT} FROM customer), e AS (SELECT x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM (VALUES {edges}) AS v(x1, y1, x2, y2)) SELECT c_custkey, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS inside FROM p, e GROUP BY c_custkey"


@query(polygon_sql(POLYGON))
def point_in_polygon(t):
    return places(t).select("c_custkey", geometry.in_polygon(C("lon"), C("lat"), POLYGON).alias("inside"))


@query(polygon_sql(geometry.shrink(POLYGON, 0.1)))
def hull_shrink(t):
    return places(t).select("c_custkey", geometry.in_polygon(C("lon"), C("lat"), geometry.shrink(POLYGON, 0.1)).alias("inside"))


@query(f"WITH p AS (SELECT c_custkey, {LONLAT} FROM customer) SELECT count(*) FILTER (d <= 5000) AS included, count(*) FILTER (d > 5000) AS excluded, count(*) AS total FROM (SELECT {hav('262.5', '38.5')} AS d FROM p)")
def domain_counts(t):
    return files.subset(places(t), geometry.in_circle(C("lon"), C("lat"), (262.5, 38.5), 5000) == 1)[1]


@query(f"WITH p AS (SELECT c_custkey, {LONLAT} FROM customer) SELECT c_custkey, CASE WHEN {hav('262.5', '38.5')} <= 2500 THEN 1 ELSE 0 END AS inside FROM p")
def circle_domain(t):
    return places(t).select("c_custkey", geometry.in_circle(C("lon"), C("lat"), (262.5, 38.5), 2500).alias("inside"))


@query(f"""SELECT loc, round(CASE WHEN z <= 1 THEN -pow(z, 5) / 4 + pow(z, 4) / 2 + pow(z, 3) * 5 / 8 - pow(z, 2) * 5 / 3 + 1
WHEN z <= 2 THEN pow(z, 5) / 12 - pow(z, 4) / 2 + pow(z, 3) * 5 / 8 + pow(z, 2) * 5 / 3 - 5 * z + 4 - 2 / (3 * nullif(z, 0)) ELSE 0 END, 6) AS weight FROM (SELECT {LOC}, l_quantity / 20.0 AS z FROM lineitem)""")
def gaspari_cohn(t):
    return t("lineitem").select(loc().alias("loc"), r6(geometry.gaspari_cohn(C("l_quantity"), 40.0)).alias("weight"))


@query(f"""SELECT loc, round(CASE WHEN q <= 5 THEN 300 WHEN q <= 20 THEN 300 + (ln(q) - ln(5)) / (ln(20) - ln(5)) * -20 WHEN q <= 45 THEN 280 + (ln(q) - ln(20)) / (ln(45) - ln(20)) * -30 ELSE 250 END, 5) AS h
FROM (SELECT {LOC}, l_quantity AS q FROM lineitem)""")
def vert_interp(t):
    levels, values = (F.array(*(F.lit(float(v)) for v in x)) for x in ((45, 20, 5), (250, 280, 300)))
    return t("lineitem").select(loc().alias("loc"), F.round(hops.vert_interp(values, levels, C("l_quantity"), "log-linear"), 5).alias("h"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 2.0)) * 0.007886131, 5) AS du FROM embeddings")
def layer_integral(t):
    two = F.transform("embedding", lambda x: F.lit(2.0))
    return t("embeddings").select("vec_id", F.round(hops.layer_sum(F.transform("embedding", lambda x: x.cast("double")), two, 0.007886131), 5).alias("du"))


@query(f"SELECT {LOC}, round(1.5 + 0.2 * l_discount + 0.1 * radians(l_linenumber * 3.0 - 10) + 0.05 * pow(radians(l_linenumber * 3.0 - 10), 2), 6) AS bias FROM lineitem")
def bias_predictors(t):
    p = C("l_linenumber")
    b = hops.bias([F.lit(1.0), C("l_discount"), hops.scan_angle(p, 3.0, -10, 1), hops.scan_angle(p, 3.0, -10, 2)], [1.5, 0.2, 0.1, 0.05])
    return t("lineitem").select(loc().alias("loc"), r6(b).alias("bias"))


def messages(t) -> DataFrame:
    """Orders as nested messages with their lines as repetitions."""
    gate = F.struct(C("l_linenumber").alias("LVL"), C("l_quantity").alias("POB"), C("l_extendedprice").alias("TOB"))
    lines_ = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(gate)).alias("LEVELS"))
    return lines_.select(F.struct(C("l_orderkey").alias("SID"), F.when(C("l_orderkey") % 3 == 0, C("l_orderkey") * 1.5).alias("CLATH"), (C("l_orderkey") * 0.5).alias("CLAT")).alias("HEAD"), "LEVELS")


@query("SELECT l_orderkey AS station, l_linenumber AS level, l_quantity * 100.0 AS pressure, l_extendedprice + 273.15 AS t FROM lineitem".replace("l_quantity * 100.0", "round(l_quantity * 100.0, 6)").replace("l_extendedprice + 273.15", "round(l_extendedprice + 273.15, 6)"))
def nested_path_flatten(t):
    spec = {
        "exports": {
            "group_by_variable": "pressure",
            "variables": {"sid": {"query": "*/HEAD/SID"}, "level": {"query": "*/LEVELS/LVL"}, "pressure": {"query": "*/LEVELS/POB", "transforms": [{"scale": 100.0}]}, "t": {"query": "*/LEVELS/TOB", "type": "double", "transforms": [{"offset": 273.15}]}},
        },
        "outputs": [{"name": "station", "source": "variables/sid"}, {"name": "level", "source": "variables/level"}, {"name": "pressure", "source": "variables/pressure", "units": "Pa"}, {"name": "t", "source": "variables/t", "units": "K"}],
    }
    return mapping.compile_mapping(messages(t), spec).withColumns({"pressure": r6(C("pressure")), "t": r6(C("t"))})


@query("SELECT l_orderkey AS station, coalesce(CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey * 1.5 END, l_orderkey * 0.5)::DOUBLE AS lat, min({'n': l_linenumber, 'q': l_quantity, 'p': l_extendedprice}).q AS first FROM lineitem GROUP BY l_orderkey")
def path_alternatives(t):
    m = messages(t)
    return m.select(mapping.first_of(m.schema, "*/HEAD/SID").alias("station"), mapping.first_of(m.schema, ["*/HEAD/NONE", "*/HEAD/CLATH", "*/HEAD/CLAT"]).cast("double").alias("lat"), mapping.path(m.schema, "*/LEVELS{1}/POB").alias("first"))


@query(f"WITH {EV} SELECT event_id, round(CASE WHEN abs(y - h) <= 2 * s THEN y - h END, 6) AS ombg_passed FROM e")
def accept_where_diag(t):
    """A copied field, missing where a condition on state doesn't hold."""
    s = filters.apply(events(t, True), {"filter": "Background Check", "threshold": 2.0})
    return s.df.select(C("Location").alias("event_id"), r6(F.when(s.passed("x"), s.departure("x"))).alias("ombg_passed"))


@query("SELECT a, b FROM (SELECT least(user_id, event_id % 50) AS a, greatest(user_id, event_id % 50) AS b FROM events) GROUP BY a, b HAVING count(*) = 1")
def edge_toggle(t):
    """Edges that occur once: an edge of two triangles is inside."""
    e = t("events").select(F.least("user_id", C("event_id") % 50).alias("a"), F.greatest("user_id", C("event_id") % 50).alias("b"))
    return e.groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 1").drop("n")


@query("SELECT count(DISTINCT user_id) AS stations, min(ts) AS first, max(ts) AS last FROM events")
def unique_and_range(t):
    return t("events").agg(F.countDistinct("user_id").alias("stations"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 1")
def first_observation(t):
    return t("events").orderBy("event_id").limit(1).select("event_id", "value")


@query("SELECT a.l_partkey, a.l_suppkey, round(sum(a.l_quantity), 6) AS increment FROM (SELECT l_partkey, l_suppkey, CASE WHEN l_linenumber = 2 THEN l_quantity ELSE -l_quantity END AS l_quantity FROM lineitem WHERE l_linenumber IN (1, 2)) a GROUP BY ALL HAVING count(*) > 1")
def level_increment(t):
    """Analysis (line 2) less background (line 1) where a cell has both, at one level."""
    x = t("lineitem").where(C("l_linenumber").isin(1, 2)).withColumn("d", F.when(C("l_linenumber") == 2, C("l_quantity")).otherwise(-C("l_quantity")))
    return x.groupBy("l_partkey", "l_suppkey").agg(r6(F.sum("d")).alias("increment"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("SELECT 'event' AS space, event_id AS loc, value AS x, NULL::DOUBLE AS p FROM events UNION ALL SELECT 'supplier', s_suppkey, NULL, s_acctbal FROM supplier")
def concatenated_spaces(t):
    a = t("events").select(F.lit("event").alias("space"), C("event_id").alias("loc"), C("value").alias("x"))
    b = t("supplier").select(F.lit("supplier").alias("space"), C("s_suppkey").alias("loc"), C("s_acctbal").alias("p"))
    return a.unionByName(b, allowMissingColumns=True)


def stations(t) -> DataFrame:
    """Suppliers as stations."""
    return t("supplier").select("s_suppkey", ((C("s_suppkey") * 53 % 36000) / 100.0).alias("lon"), ((C("s_suppkey") * 29 % 18000) / 100.0 - 90.0).alias("lat"), "s_acctbal")


@query(f"""WITH p AS (SELECT c_custkey, {LONLAT} FROM customer), o AS (SELECT s_suppkey, s_suppkey * 53 % 36000 / 100.0 AS lon2, s_suppkey * 29 % 18000 / 100.0 - 90.0 AS lat2 FROM supplier),
d AS (SELECT c_custkey, s_suppkey, {hav('lon2', 'lat2')} AS x FROM p, o)
SELECT c_custkey, s_suppkey, round(x, 6) AS distance_km FROM d WHERE x <= 1500""")
def within_radius(t):
    """Stations within the radius of each point, over the poles and the date line."""
    near = nearby.within_radius(stations(t), places(t), "s_suppkey", "c_custkey", 1500.0)  # the smaller side looks around
    # Rounded as SQL does it: F.round() makes a decimal of every value.
    return near.select("c_custkey", "s_suppkey", (F.floor(C("distance_km") * 1e6 + 0.5) / 1e6).alias("distance_km"))


@query()
def letkf_local(t):
    """Analyses at customers' places from the stations around them, with members made from both tables' balances."""
    member = F.explode(F.sequence(F.lit(1), F.lit(4)))
    points = places(t).withColumnRenamed("c_custkey", "cell")
    members = t("customer").select(C("c_custkey").alias("cell"), member.alias("member"), (C("c_acctbal") / 100).alias("b")).select("cell", "member", (C("b") + C("member") * (C("cell") % 7 + 1)).alias("value"))
    obs = stations(t).select(C("s_suppkey").alias("obs_id"), "lon", "lat", (C("s_acctbal") / 100 + 3.0).alias("observed"), F.lit(4.0).alias("variance"))
    simulated = stations(t).select(C("s_suppkey").alias("obs_id"), member.alias("member"), (C("s_acctbal") / 100).alias("b")).select("obs_id", "member", (C("b") + C("member") * (C("obs_id") % 5 + 1)).alias("simulated"))
    return nearby.local_analysis(points, members, obs, simulated, "cell", 1500.0)


def streaming_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's rows that are kept, with the batch form over the same table."""
    from obsq.streaming.thinning import thin_stream

    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    # Each file is a batch of the stream; the sink's table is what the query returns.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", C("ts").cast("timestamp"))
    top = files.shared_folder(spark, "thinned")
    kept = thin_stream(stream, "user_id", "ts", "event_id", 6 * 3600)
    sink = kept.writeStream.format("parquet").option("path", f"{top}/rows").option("checkpointLocation", f"{top}/checkpoint")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{top}/rows")


QUERIES["streaming_thinning"] = streaming_thinning
SQL["streaming_thinning"] = SQL["temporal_thinning"].replace("SELECT m.l AS event_id FROM k", "SELECT user_id, m.t AS ts, m.l AS event_id FROM k")
