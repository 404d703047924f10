"""Queries of states, pairs of tables, tiles, analyses and figure layers, each with SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsq.functions.geometry import EARTH_KM
from obsq.operators import filters, pairs, variational
from obsq.operators.space import ObsSpace
from obsq.plans import diagnostics
from obsq.plans.pipeline import dispatch
from obsq.queries import EV, LOC, LONLAT, events, loc, places, query, r6
from obsq.sources import states

C = F.col


@query(f"""SELECT {LOC}, 'pressure' AS field, l_quantity::DOUBLE AS value FROM lineitem UNION ALL SELECT {LOC}, 'tracer', l_tax FROM lineitem""")
def state_long_form(t):
    """Two fields of a state, a row for each."""
    df = t("lineitem").select(loc().alias("loc"), C("l_quantity").alias("pressure"), C("l_tax").alias("tracer"))
    return states.long_form(df, ["pressure", "tracer"], ["loc"])


@query("""SELECT l_orderkey, max(l_quantity) FILTER (l_linenumber = 1) AS a, max(l_quantity) FILTER (l_linenumber = 2) AS b FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey, l_partkey""")
def state_wide_form(t):
    """Fields as columns, null where the state lacks them."""
    kind = F.when(C("l_linenumber") == 1, "a").otherwise("b")
    state = t("lineitem").where("l_linenumber <= 2").groupBy("l_orderkey", "l_partkey", kind.alias("field")).agg(F.max("l_quantity").alias("value"))
    return states.wide_form(state, ["a", "b"], ["l_orderkey", "l_partkey"]).drop("l_partkey")


@query(f"""WITH c AS (SELECT n_nationkey % 7 + 1 AS channel, 'p' || (n_nationkey // 7) AS predictor, n_regionkey * 0.25 AS value FROM nation),
w AS (SELECT channel, sum(value) FILTER (predictor = 'p0') AS a, sum(value) FILTER (predictor = 'p1') AS b FROM c WHERE channel < 7 GROUP BY channel)
SELECT {LOC}, round(coalesce(a, 0) + coalesce(b, 0) * l_discount, 6) AS bias FROM lineitem LEFT JOIN w ON channel = l_linenumber""")
def bias_coefficients(t):
    """Predictors with the coefficients of a channel; a channel without any has no bias."""
    n = t("nation").select((C("n_nationkey") % 7 + 1).alias("channel"), F.concat(F.lit("p"), F.floor(C("n_nationkey") / 7).cast("string")).alias("predictor"), (C("n_regionkey") * 0.25).alias("value"))
    df = t("lineitem").select(loc().alias("loc"), C("l_linenumber").alias("channel"), "l_discount")
    return states.with_bias(df, n.where("channel < 7"), {"p0": F.lit(1.0), "p1": C("l_discount")}).select("loc", r6(C("bias")).alias("bias"))


@query(f"""SELECT a.l_orderkey, a.l_partkey, round(a.x - b.x, 6) AS increment FROM (SELECT l_orderkey, l_partkey, max(l_quantity) AS x FROM lineitem GROUP BY ALL) a
JOIN (SELECT l_orderkey, l_partkey, min(l_extendedprice) AS x FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey""")
def analysis_increment(t):
    """Analysis less background where both have the place."""
    key = ["l_orderkey", "l_partkey"]
    a = t("lineitem").groupBy(*key).agg(F.max("l_quantity").alias("x"))
    b = t("lineitem").where("l_linenumber > 1").groupBy(*key).agg(F.min("l_extendedprice").alias("x"))
    return pairs.increment(a, b, key, "x").withColumn("increment", r6(C("increment")))


@query("SELECT c_custkey FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_custkey * 37 % 36000 <> s_suppkey * 37 % 18000 OR c_custkey % 5 = 0 AND s_suppkey <> 0")
def positions_apart(t):
    """Places that two tables give differently."""
    a = t("customer").select(C("c_custkey").alias("k"), (C("c_custkey") * 37 % 36000).alias("lon"), (C("c_custkey") % 5).alias("lat"))
    b = t("supplier").select(C("s_suppkey").alias("k"), (C("s_suppkey") * 37 % 18000).alias("lon"), F.when(C("s_suppkey") % 5 == 0, F.when(C("s_suppkey") == 0, 0)).otherwise(C("s_suppkey") % 5).alias("lat"))
    return pairs.apart(a, b, ["k"], "lon", "lat").select(C("k").alias("c_custkey"))


REACH = f"degrees(500.0 / {EARTH_KM})"


@query(f"""WITH p AS (SELECT c_custkey, {LONLAT} FROM customer), r AS (SELECT *, abs(lat) + {REACH} >= 90 AS polar FROM p),
a AS (SELECT *, CASE WHEN polar THEN 180.0 ELSE degrees(asin(least(1.0, sin(radians({REACH})) / cos(radians(lat))))) END AS aside FROM r),
x AS (SELECT DISTINCT * FROM (SELECT *, unnest(CASE WHEN polar OR aside * 2 + 30 >= 360 THEN range(0, 12) ELSE list_transform(range(floor((lon - aside) / 30)::BIGINT, floor((lon + aside) / 30)::BIGINT + 1), lambda c: (c + 12) % 12) END) AS tile_x FROM a)),
y AS (SELECT *, unnest(range(least(greatest(floor((lat - {REACH} + 90) / 30), 0), 5)::BIGINT, least(greatest(floor((lat + {REACH} + 90) / 30), 0), 5)::BIGINT + 1)) AS tile_y FROM x)
SELECT c_custkey, tile_x::INTEGER AS tile_x, tile_y::INTEGER AS tile_y, NOT (tile_x = floor(lon / 30) AND tile_y = least(floor((lat + 90) / 30), 5)) AS ghost FROM y""")
def halo_tiles(t):
    """Places in tiles of 30 degrees with a halo of 500 km."""
    return pairs.halo(places(t), "lon", "lat", 30, 500.0).select("c_custkey", "tile_x", "tile_y", "ghost")


@query("""WITH d AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice / 1000.0) AS m FROM orders GROUP BY o_custkey)
SELECT c_custkey AS cell, round(c_acctbal / 100.0 + coalesce((m - c_acctbal / 100.0) / 2.0 / (1.0 / (c_custkey % 3 + 1) + 0.5), 0), 4) AS analysis FROM customer LEFT JOIN d ON o_custkey = c_custkey""")
def variational_analysis(t):
    """Orders as observations of their customer; a cell's observations count half as much as one together."""
    cells = t("customer").select(C("c_custkey").alias("cell"), (C("c_acctbal") / 100.0).alias("background"), (C("c_custkey") % 3 + 1).cast("double").alias("variance"))
    crowd = t("orders").groupBy("o_custkey").agg((F.count("*") * 2.0).alias("variance"))
    obs = t("orders").join(crowd, "o_custkey").select(C("o_orderkey").alias("obs_id"), (C("o_totalprice") / 1000.0).alias("observed"), "variance")
    weights = t("orders").select(C("o_orderkey").alias("obs_id"), C("o_custkey").alias("cell"), F.lit(1.0).alias("weight"))
    return variational.minimise(cells, obs, weights, reduction=1e-9).state.select("cell", F.round("analysis", 4).alias("analysis"))


@query(f"WITH {EV} SELECT user_id AS longitude, event_id AS latitude, round(y - h, 6) AS data FROM e WHERE abs(y - h) <= 2 * s")
def map_layer(t):
    """What a map of departures that passed would show."""
    s = dispatch("HofX4D", events(t, True), {"obs filters": [{"filter": "Background Check", "threshold": 2.0}]}, departures="oman")
    shown = s.df.withColumn("passed", F.when(s.passed("x"), r6(C("`oman/x`"))))
    return diagnostics.layer(shown, {"type": "MapScatter", "longitude": {"variable": "MetaData/station"}, "latitude": {"variable": "Location"}, "data": {"variable": "passed"}})


@query("""WITH m AS (SELECT min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer)
SELECT CASE WHEN low < 0 AND high > 0 THEN -greatest(-low, high) ELSE low END AS vmin, CASE WHEN low < 0 AND high > 0 THEN greatest(-low, high) ELSE high END AS vmax FROM m""")
def layer_limits(t):
    return diagnostics.limits(t("customer"), "c_acctbal")


@query(f"WITH {EV} SELECT event_id, round(h, 6) AS field FROM e")
def saved_fields(t):
    """Simulated fields by location, as they are saved beside a run."""
    s = filters.apply(events(t), {"filter": "Bounds Check", "maxvalue": 300})
    df = ObsSpace(s.df.withColumnRenamed("HofX/x", "GeoVaLs/x"), s.variables).df
    return states.simulated_fields(df).select(C("Location").alias("event_id"), r6(C("`GeoVaLs/x`")).alias("field"))
