"""The registered queries of the engine, each with the SQL that a second engine answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angles as A
from ..functions import geo as G
from ..operators import contracts, cycles, grid, kernels, minutes, pairing, scoring, sequences, surveys, wind
from ..sources import listings, rejects
from ..streaming import streams
from . import proxies as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, doubles: str = "", longs: str = "", places: int = 6):
    """Registers a query under its function's name; doubles and longs of the result are rounded and cast alike on both sides."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf: P.rounded(fn(spark, sf), places)
        if sql:
            ORACLES[fn.__name__] = P.rounded_sql(sql, doubles.split(), longs.split(), places) if doubles or longs else sql
        return fn

    return add


OBS, SAMPLES, OTHER = "click", "view", "purchase"


def sql_signed(a: str, b: str) -> str:
    d = f"fmod({a} - {b}, 360)"
    return f"CASE WHEN {d} > 180 THEN {d} - 360 WHEN {d} <= -180 THEN {d} + 360 ELSE {d} END"


# ---- pairing

PAIRED_SQL = f"""SELECT o.id, o.station, s.id AS sample_id, s.speed AS mod_speed, s.from_deg AS mod_from, o.speed AS obs_speed, o.from_deg AS obs_from, o.calm, epoch_us(s.time) - epoch_us(o.time) AS offset_us
 FROM {P.wind_sql(OBS)} o LEFT JOIN {P.wind_sql(SAMPLES)} s ON s.station = o.station AND abs(epoch_us(s.time) - epoch_us(o.time)) <= 600000000
 QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY abs(epoch_us(s.time) - epoch_us(o.time)), s.id) = 1"""


def paired(spark, sf):
    got = pairing.nearest_in_time(P.wind(spark, sf, OBS), P.wind(spark, sf, SAMPLES), ["station"], "time", "id", 600, ["speed", "from_deg"], "id")
    return got.select("id", "station", "sample_id", F.col("sample_speed").alias("mod_speed"), F.col("sample_from_deg").alias("mod_from"), F.col("speed").alias("obs_speed"), F.col("from_deg").alias("obs_from"), "calm", "offset_us")


@query(f"SELECT * REPLACE (CAST(sample_id AS DOUBLE) AS sample_id, CAST(offset_us AS DOUBLE) AS offset_us) FROM ({PAIRED_SQL})", "mod_speed mod_from obs_speed obs_from")
def pair_nearest(spark, sf):
    return paired(spark, sf).withColumns({c: F.col(c).cast("double") for c in ("sample_id", "offset_us")})


NEAREST_ANY_SQL = f"""SELECT o.id, epoch_us(s.time) - epoch_us(o.time) AS nearest_us, s.id AS nearest_seq FROM {P.wind_sql(OBS)} o LEFT JOIN {P.wind_sql(SAMPLES)} s ON s.station = o.station
 QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY abs(epoch_us(s.time) - epoch_us(o.time)), s.id) = 1"""


@query(f"SELECT * FROM ({NEAREST_ANY_SQL}) WHERE nearest_us IS NULL OR abs(nearest_us) > 600000000")
def pair_unmatched(spark, sf):
    got = pairing.nearest_either_side(P.wind(spark, sf, OBS), P.wind(spark, sf, SAMPLES), ["station"], "time", "id")
    return got.select("id", "nearest_us", "nearest_seq").where("nearest_us is null or abs(nearest_us) > 600000000")


@query(f"SELECT station, count(*) AS n, count(offset_us) AS matched, avg(offset_us / 1e6) AS mean_offset, max(abs(offset_us)) / 1e6 AS most FROM ({PAIRED_SQL}) GROUP BY station", "mean_offset most")
def pair_offset_stats(spark, sf):
    return paired(spark, sf).groupBy("station").agg(F.count("*").alias("n"), F.count("offset_us").alias("matched"), F.avg(F.col("offset_us") / 1e6).alias("mean_offset"), (F.max(F.abs("offset_us")) / 1e6).alias("most"))


@query(f"SELECT o.id, (epoch_us(s.time) - epoch_us(o.time)) / 1e6 AS asof_s, CAST(s.id AS DOUBLE) AS asof_seq FROM {P.wind_sql(OBS)} o LEFT JOIN {P.wind_sql(SAMPLES)} s ON s.station = o.station AND s.time <= o.time QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY s.time DESC NULLS LAST, s.id) = 1", "asof_s")
def pair_asof_backward(spark, sf):
    return pairing.as_of(P.wind(spark, sf, OBS), P.wind(spark, sf, SAMPLES), ["station"], "time", "id").select("id", (F.col("asof_us") / 1e6).alias("asof_s"), F.col("asof_seq").cast("double"))


@query(f"""SELECT o.id, count(s.id) AS n, avg(CASE WHEN s.calm THEN 0 ELSE -s.speed * sin(radians(s.from_deg)) END) AS e, avg(CASE WHEN s.calm THEN 0 ELSE -s.speed * cos(radians(s.from_deg)) END) AS nn
 FROM {P.wind_sql(OBS)} o LEFT JOIN {P.wind_sql(SAMPLES)} s ON s.station = o.station AND abs(epoch_us(s.time) - epoch_us(o.time)) <= 1800000000 GROUP BY o.id""", "e nn", "n")
def band_vector_mean(spark, sf):
    part = lambda f: F.avg(F.when(F.col("calm"), 0.0).otherwise(f("speed", "from_deg")))
    got = pairing.band(P.wind(spark, sf, OBS).select("id", "station", "time"), P.wind(spark, sf, SAMPLES), ["station"], "time", 1800, "id", [F.count("*").alias("n"), part(A.east).alias("e"), part(A.north).alias("nn")], ["speed", "from_deg", "calm"])
    return got.select("id", F.coalesce("n", F.lit(0)).alias("n"), "e", "nn")


@query(f"""SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS shared, count(*) FILTER (WHERE b IS NULL) AS only_a, count(*) FILTER (WHERE a IS NULL) AS only_b, max(abs(a - b)) AS worst, avg(abs(a - b)) AS mean_gap FROM
 (SELECT station, date_trunc('hour', time) AS h, avg(speed) AS a FROM {P.wind_sql(OBS)} GROUP BY ALL) x FULL OUTER JOIN (SELECT station, date_trunc('hour', time) AS h, avg(speed) AS b FROM {P.wind_sql(OTHER)} GROUP BY ALL) y USING (station, h)""", "worst mean_gap")
def provider_agreement(spark, sf):
    hour = lambda k: P.wind(spark, sf, k).groupBy("station", F.date_trunc("hour", "time").alias("h")).agg(F.avg("speed").alias("speed"))
    j = pairing.same_time(hour(OBS), hour(OTHER), ["station", "h"], ["speed"])
    gap = F.abs(F.col("a.speed") - F.col("b.speed"))
    return j.agg(F.count_if(F.col("side") == "both").alias("shared"), F.count_if(F.col("side") == "a").alias("only_a"), F.count_if(F.col("side") == "b").alias("only_b"), F.max(gap).alias("worst"), F.avg(gap).alias("mean_gap"))


# ---- scores

def score_sql(src: str, by: str = "", scale: str = "1.0", extra: str = "") -> str:
    return f"""WITH p AS (SELECT *, mod_speed * {scale} AS ms FROM {src}), e AS (SELECT *, ms - obs_speed AS se,
  CASE WHEN ms IS NOT NULL AND NOT calm AND obs_from IS NOT NULL AND obs_speed >= 1 AND mod_from IS NOT NULL THEN {sql_signed('mod_from', 'obs_from')} END AS de,
  CASE WHEN ms IS NOT NULL AND (calm OR obs_from IS NOT NULL) AND mod_from IS NOT NULL THEN
   pow(-ms * sin(radians(mod_from)) - CASE WHEN calm THEN 0 ELSE -obs_speed * sin(radians(obs_from)) END, 2) + pow(-ms * cos(radians(mod_from)) - CASE WHEN calm THEN 0 ELSE -obs_speed * cos(radians(obs_from)) END, 2) END AS ve FROM p)
 SELECT {by + ',' if by else ''} count(se) AS n, avg(se) AS bias, CASE WHEN count(se) > 0 THEN count(*) FILTER (WHERE se IS NOT NULL AND calm) * {scoring.CALM_CEILING} / count(se) ELSE 0 END AS bias_censoring, avg(abs(se)) AS mae, sqrt(avg(se * se)) AS rmse,
  avg(CASE WHEN se IS NOT NULL THEN obs_speed END) AS mean_observed, avg(ms) FILTER (WHERE se IS NOT NULL) AS mean_modelled, count(de) AS dir_n,
  CASE WHEN abs(sum(sin(radians(de)))) < 1e-12 AND abs(sum(cos(radians(de)))) < 1e-12 THEN NULL ELSE degrees(atan2(sum(sin(radians(de))), sum(cos(radians(de))))) END AS dir_bias, avg(abs(de)) AS dir_mae, sqrt(avg(de * de)) AS dir_rmse,
  count(*) FILTER (WHERE abs(de) <= 30) AS within_30, count(ve) AS vec_n, sqrt(avg(ve)) AS vec_rmse, count(*) FILTER (WHERE se IS NOT NULL AND calm) AS calm,
  count(*) FILTER (WHERE ms IS NOT NULL AND NOT calm AND obs_from IS NOT NULL AND obs_speed < 1) AS light, count(*) FILTER (WHERE ms IS NOT NULL AND NOT calm AND (obs_from IS NULL OR (obs_speed >= 1 AND mod_from IS NULL))) AS no_direction{extra}
 FROM e {'GROUP BY ' + by if by else ''}"""


SCORE_D = "bias bias_censoring mae rmse mean_observed mean_modelled dir_bias dir_mae dir_rmse vec_rmse"


@query(score_sql(P.PAIRS_SQL, extra=", count(DISTINCT station || '@' || line) AS distinct_samples"), SCORE_D)
def score_overall(spark, sf):
    return scoring.score(P.pairs(spark, sf), sample=F.concat_ws("@", "station", "line"))


@query(score_sql(P.PAIRS_SQL, "class"), SCORE_D)
def score_by_class(spark, sf):
    return scoring.score(P.pairs(spark, sf), ["class"])


@query(score_sql(P.PAIRS_SQL, "station"), SCORE_D)
def score_by_station(spark, sf):
    return scoring.score(P.pairs(spark, sf), ["station"])


@query(score_sql(f"({PAIRED_SQL})", "station"), SCORE_D)
def pair_and_score(spark, sf):
    return scoring.score(paired(spark, sf), ["station"])


SCALE_SQL = f"(SELECT sum(obs_speed) FILTER (WHERE mod_speed IS NOT NULL) / sum(mod_speed) FROM {P.PAIRS_SQL})"


@query(f"SELECT class, CASE WHEN sum(mod_speed) > 0 THEN sum(obs_speed) FILTER (WHERE mod_speed IS NOT NULL) / sum(mod_speed) END AS scale FROM {P.PAIRS_SQL} GROUP BY class", "scale")
def debias_scale(spark, sf):
    return scoring.ratio_scale(P.pairs(spark, sf), ["class"])


@query(score_sql(P.PAIRS_SQL, "class", SCALE_SQL), SCORE_D)
def score_debiased(spark, sf):
    p = P.pairs(spark, sf)
    return scoring.score(p.crossJoin(F.broadcast(scoring.ratio_scale(p))), ["class"], scale=F.col("scale"))


STATS_SQL = f"SELECT station, run, count(*) AS n, sum(obs_speed) AS o, sum(mod_speed) AS m, sum(obs_speed * obs_speed) AS oo, sum(mod_speed * mod_speed) AS mm, sum(obs_speed * mod_speed) AS om FROM {P.PAIRS_SQL} WHERE mod_speed IS NOT NULL GROUP BY station, run"


@query(f"SELECT * FROM ({STATS_SQL}) WHERE n >= 6", "o m oo mm om", places=3)
def site_suffstats(spark, sf):
    return scoring.sums(P.pairs(spark, sf), ["station", "run"]).where("n >= 6")


def jack_sql(debias: bool) -> str:
    k = lambda p: f"({p}o / {p}m)" if debias else "1.0"
    r = lambda p: f"sqrt(greatest(({k(p)} * {k(p)} * {p}mm - 2 * {k(p)} * {p}om + {p}oo) / {p}n, 0))"
    g = "SELECT station, sum(n) n, sum(o) o, sum(m) m, sum(oo) oo, sum(mm) mm, sum(om) om FROM (" + STATS_SQL + ") GROUP BY station"
    left = ", ".join(f"t.all_{x} - g.{x} AS rest_{x}" for x in scoring.NAMES)
    tot = ", ".join(f"sum({x}) AS all_{x}" for x in scoring.NAMES)
    return f"SELECT station, n, rest_n AS n_remaining, {r('all_')} AS \"full\", {r('rest_')} AS without, {r('rest_')} - {r('all_')} AS delta FROM (SELECT g.*, t.*, {left} FROM ({g}) g, (SELECT {tot} FROM ({g})) t)"


@query(jack_sql(False).replace('"full"', "full_rmse"), "full_rmse without delta", "n n_remaining")
def jackknife_station(spark, sf):
    return scoring.leave_one_out(P.pairs(spark, sf), "station").withColumnRenamed("full", "full_rmse")


@query(jack_sql(True).replace('"full"', "full_rmse"), "full_rmse without delta", "n n_remaining")
def jackknife_debiased(spark, sf):
    return scoring.leave_one_out(P.pairs(spark, sf), "station", debias=True).withColumnRenamed("full", "full_rmse")


@query(f"SELECT count(*) AS groups, max(full_rmse) AS full_rmse, (SELECT without FROM j ORDER BY without LIMIT 1 OFFSET (SELECT (count(*) - 1) // 2 FROM j)) AS median_without, min(without) AS least_without, max(without) AS most_without, max(delta) AS max_delta, arg_max(station, delta) AS carrying FROM j", "full_rmse median_without least_without most_without max_delta")
def leverage_station(spark, sf):
    return scoring.leverage(scoring.leave_one_out(P.pairs(spark, sf), "station"), "station").withColumnRenamed("full", "full_rmse")


ORACLES["leverage_station"] = ORACLES["leverage_station"].replace("FROM (SELECT count(*) AS groups", "FROM (WITH j AS (" + jack_sql(False).replace('"full"', "full_rmse") + ") SELECT count(*) AS groups", 1)

RUN_SQL = {r: f"(SELECT * FROM ({STATS_SQL}) WHERE run = '{r}' AND n >= 6)" for r in "OF"}


def run(spark, sf, r):
    return scoring.sums(P.pairs(spark, sf).where(F.col("run") == r), ["station"])


def part_sql(k: str) -> str:
    return f"sqrt(sum(({k}) * ({k}) * e.mm - 2 * ({k}) * e.om + e.oo) / sum(e.n))"


TRANSFER = f"FROM {RUN_SQL['O']} e JOIN (SELECT station, om / mm AS k FROM {RUN_SQL['F']}) f USING (station)"


@query(f"SELECT count(*) AS groups, sum(e.n) AS n, {part_sql('1.0')} AS raw, {part_sql(f'(SELECT sum(e.om) / sum(e.mm) {TRANSFER})')} AS pooled, {part_sql('k')} AS transferred, {part_sql('e.om / e.mm')} AS hindsight {TRANSFER}", "raw pooled transferred hindsight", "n")
def scale_transfer(spark, sf):
    return scoring.transfer(run(spark, sf, "F"), run(spark, sf, "O"), "station")


OFFSETS = f"FROM (SELECT *, (m - o) / n AS b, (mm - 2 * om + oo) / n AS s2 FROM {RUN_SQL['O']}) e JOIN (SELECT station, (m - o) / n AS k FROM {RUN_SQL['F']}) f USING (station)"


def off_sql(c: str) -> str:
    return f"sqrt(greatest(sum(n * (s2 - 2 * ({c}) * b + ({c}) * ({c}))) / sum(n), 0))"


@query(f"SELECT count(*) AS groups, {off_sql('0')} AS raw, {off_sql(f'(SELECT sum(n * b) / sum(n) {OFFSETS})')} AS pooled, {off_sql('k')} AS transferred, {off_sql('b')} AS hindsight {OFFSETS}", "raw pooled transferred hindsight")
def offset_transfer(spark, sf):
    return scoring.offset_transfer(run(spark, sf, "F"), run(spark, sf, "O"), "station")


@query(f"SELECT count(*) AS groups, corr(a.om / a.mm, b.om / b.mm) AS r FROM {RUN_SQL['F']} a JOIN {RUN_SQL['O']} b USING (station)", "r")
def repeatability_r(spark, sf):
    return scoring.repeatability(run(spark, sf, "F"), run(spark, sf, "O"), "station")


HOLD = f"SELECT e.station, e.n, e.oo, e.mm, e.om, f.om / f.mm AS k, f.om AS fom, f.mm AS fmm, ln(f.om / f.mm) AS y, p.elevation / 1000 AS x FROM {RUN_SQL['O']} e JOIN {RUN_SQL['F']} f USING (station) JOIN {P.PLACES_SQL} p ON p.id = e.station WHERE f.om / f.mm > 0"


@query(f"""WITH u AS ({HOLD}), v AS (SELECT a.station, (SELECT sum(b.fom) / sum(b.fmm) FROM u b WHERE b.station <> a.station) AS others, (SELECT regr_intercept(b.y, b.x) + regr_slope(b.y, b.x) * a.x FROM u b WHERE b.station <> a.station) AS ly FROM u a)
 SELECT count(*) AS groups, sqrt(sum(mm - 2 * om + oo) / sum(n)) AS raw, sqrt(sum(others * others * mm - 2 * others * om + oo) / sum(n)) AS pooled, sqrt(sum(exp(ly) * exp(ly) * mm - 2 * exp(ly) * om + oo) / sum(n)) AS predicted_rmse, sqrt(sum(k * k * mm - 2 * k * om + oo) / sum(n)) AS own FROM u JOIN v USING (station)""", "raw pooled predicted_rmse own")
def holdout_loo(spark, sf):
    x = P.places(spark, sf).select(F.col("id").alias("station"), (F.col("elevation") / 1000).alias("x"))
    return scoring.holdout(run(spark, sf, "F"), run(spark, sf, "O"), x, "station")


@query("SELECT station, arg_min(candidate, (without, seq)) AS winner FROM (" + f"SELECT station, 'raw' AS candidate, 0 AS seq, without FROM ({jack_sql(False)}) UNION ALL SELECT station, 'debiased', 1, without FROM ({jack_sql(True)})" + ") GROUP BY station")
def leverage_winners(spark, sf):
    p = P.pairs(spark, sf)
    folds = [scoring.leave_one_out(p, "station", debias=b).select("station", F.lit(n).alias("candidate"), F.lit(s).alias("seq"), "without") for b, n, s in ((False, "raw", 0), (True, "debiased", 1))]
    return scoring.winners(folds[0].unionByName(folds[1]), "station", "candidate", "seq")


@query(f"SELECT class, degrees(atan2(sum(sin(radians(d))), sum(cos(radians(d))))) AS circular_bias, avg(d) AS arithmetic_bias, count(d) AS n FROM (SELECT class, {sql_signed('mod_from', 'obs_from')} AS d FROM {P.PAIRS_SQL}) GROUP BY class", "circular_bias arithmetic_bias")
def circular_bias(spark, sf):
    d = P.pairs(spark, sf).withColumn("d", A.signed_gap("mod_from", "obs_from"))
    return d.groupBy("class").agg(A.circular_mean("d").alias("circular_bias"), F.avg("d").alias("arithmetic_bias"), F.count("d").alias("n"))


# ---- stations

BOX = {"west": -106.5, "south": 38.0, "east": -103.5, "north": 40.0}
HAV = "2 * 6371008.8 * asin(sqrt(least(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2), 1)))"


@query(f"SELECT id, {HAV.format(a='39.0', b='lat', c='-105.0', d='lon')} AS distance FROM {P.PLACES_SQL} ORDER BY distance, id LIMIT 25", "distance", places=3)
def stations_nearest_k(spark, sf):
    return P.places(spark, sf).select("id", G.haversine(F.lit(39.0), F.lit(-105.0), "lat", "lon").alias("distance")).orderBy("distance", "id").limit(25)


@query(f"SELECT nation, count(*) AS n, avg(elevation) AS mean_elevation FROM {P.PLACES_SQL} WHERE lat BETWEEN {BOX['south']} AND {BOX['north']} AND lon BETWEEN {BOX['west']} AND {BOX['east']} GROUP BY nation", "mean_elevation", "nation")
def stations_in_box(spark, sf):
    return P.places(spark, sf).where(G.in_box("lat", "lon", BOX)).groupBy("nation").agg(F.count("*").alias("n"), F.avg("elevation").alias("mean_elevation"))


LATEST = f"SELECT station, time, speed, id, CASE WHEN speed > 12 THEN 'implausible' END AS code FROM {P.wind_sql(OBS)}"


@query(f"""SELECT k.station, r.time AS "time", r.speed, CASE WHEN r.station IS NULL THEN coalesce(w.code, 'no-report') END AS reason FROM (SELECT DISTINCT user_id % 30 AS station FROM events) k
 LEFT JOIN (SELECT * FROM ({LATEST}) WHERE code IS NULL QUALIFY row_number() OVER (PARTITION BY station ORDER BY time DESC, id) = 1) r USING (station)
 LEFT JOIN (SELECT station, arg_max(code, id) AS code FROM ({LATEST}) WHERE code IS NOT NULL GROUP BY station) w USING (station)""", "speed")
def stations_latest_with_reason(spark, sf):
    o = P.wind(spark, sf, OBS).withColumn("code", F.when(F.col("speed") > 12, "implausible"))
    keys = P.table(spark, sf, "events").select((F.col("user_id") % 30).alias("station")).distinct()
    return sequences.latest_or_reason(keys, rejects.kept(o), rejects.rejected(o), "station", "time", "id", ["speed"]).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query(f"""SELECT p.id, place, distance FROM {P.PLACES_SQL} p LEFT JOIN (SELECT a.id, b.id AS place, {HAV.replace('6371008.8', '6371.0').format(a='a.lat', b='b.lat', c='a.lon', d='b.lon')} AS distance FROM {P.PLACES_SQL} a JOIN {P.PLACES_SQL} b ON a.id <> b.id
 WHERE distance <= 20 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY floor(distance * 1e6 + 0.5), b.id) = 1) q USING (id)""", "distance")
def nearest_station_crosswalk(spark, sf):
    p = P.places(spark, sf)
    b = p.select(F.col("id").alias("place"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    d = F.when(F.col("id") != F.col("place"), A.round_up(G.haversine("lat", "lon", "p_lat", "p_lon", G.EARTH_KM), 6))
    return pairing.nearest_place(p, b, "id", d, "place", ["place"], 20.0, 0.3).select("id", "place", "distance")


@query(f"SELECT id, CASE WHEN abs(elevation - (1500 + (id % 13) * 40)) > 50 THEN 'elevation-disagrees' END AS code FROM {P.PLACES_SQL}")
def elevation_check(spark, sf):
    return P.places(spark, sf).select("id", G.elevation_check("elevation", 1500 + (F.col("id") % 13) * 40).alias("code"))


@query(f"SELECT nation, id FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY elevation, id) - 1 AS i, count(*) OVER (PARTITION BY nation) AS n FROM {P.PLACES_SQL}) WHERE list_contains([floor(k * (n - 1) / 2.0 + 0.5)::BIGINT FOR k IN range(0, 3)], i)", "", "nation")
def spread_sample(spark, sf):
    return sequences.spread(P.places(spark, sf), ["nation"], ["elevation", "id"], 3).select("nation", "id")


# ---- minutes

LAG_SQL = f"SELECT b.minute - a.minute AS lag, a.speed, a.from_deg, b.speed AS speed2, b.from_deg AS from2 FROM {P.MINUTES_SQL} a JOIN {P.MINUTES_SQL} b ON a.station = b.station AND b.minute BETWEEN a.minute AND a.minute + 30"
GAP2 = "(fmod(fmod(from2 - from_deg + 180, 360) + 360, 360) - 180)"
CURVE_SQL = f"""SELECT lag, count(*) AS n, sqrt(avg(pow(speed2 - speed, 2))) AS speed_rms, sqrt(avg(pow(-speed2 * sin(radians(from2)) + speed * sin(radians(from_deg)), 2) + pow(-speed2 * cos(radians(from2)) + speed * cos(radians(from_deg)), 2))) AS vector_rms,
 count(*) FILTER (WHERE speed > {minutes.STEADY} AND speed2 > {minutes.STEADY}) AS dir_n, sqrt(avg({GAP2} * {GAP2}) FILTER (WHERE speed > {minutes.STEADY} AND speed2 > {minutes.STEADY})) AS dir_rms FROM ({LAG_SQL}) GROUP BY lag"""


def curve(spark, sf):
    return minutes.decorrelation(P.minutes(spark, sf), 30)


@query(CURVE_SQL, "speed_rms vector_rms dir_rms")
def decorrelation_curve(spark, sf):
    return curve(spark, sf)


@query(f"SELECT sqrt(avg(speed_rms * speed_rms)) AS rms, count(*) AS lags FROM ({CURVE_SQL}) WHERE lag BETWEEN 1 AND 15", "rms")
def over_window(spark, sf):
    return minutes.over_window(curve(spark, sf), 15)


@query(f"SELECT sqrt(avg(c.speed_rms * c.speed_rms)) AS rms, avg(lag) AS mean_offset, max(lag) AS max_offset, count(*) AS n FROM (SELECT o_orderkey % 30 AS lag FROM orders) JOIN ({CURVE_SQL}) c USING (lag)", "rms mean_offset")
def at_offsets(spark, sf):
    return minutes.at_offsets(curve(spark, sf), P.table(spark, sf, "orders").select((-(F.col("o_orderkey") % 30)).alias("offset")))


@query(f"SELECT arg_min(CASE WHEN v = b THEN CAST(lag AS DOUBLE) ELSE lag - 1 + (0.5 - b) / (v - b) END, lag) AS crossing FROM (SELECT lag, speed_rms AS v, coalesce(lag(speed_rms) OVER (ORDER BY lag), 0) AS b FROM ({CURVE_SQL})) WHERE lag >= 1 AND v >= 0.5", "crossing")
def crossing_level(spark, sf):
    return minutes.crossing(curve(spark, sf), 0.5)


@query(f"""SELECT station, minute, sqrt(e * e + n * n) AS speed, fmod(degrees(atan2(-e, -n)) + 360, 360) AS from_deg, sqrt(e * e + n * n) <= {minutes.STEADY} AS calm FROM (SELECT station, minute, avg(-speed * sin(radians(from_deg))) OVER w AS e, avg(-speed * cos(radians(from_deg))) OVER w AS n, count(*) OVER w AS k
 FROM {P.MINUTES_SQL} WINDOW w AS (PARTITION BY station ORDER BY minute RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE k = 10""", "speed from_deg", places=4)
def block_mean(spark, sf):
    return minutes.block_mean(P.minutes(spark, sf), 10)


@query(f"""SELECT CAST(b.bin AS BIGINT) AS bin, count(lag) AS n, sqrt(avg(pow(speed2 - speed, 2))) AS rms, avg((speed + speed2) / 2) AS mean_speed, CASE WHEN avg((speed + speed2) / 2) > 0 THEN sqrt(avg(pow(speed2 - speed, 2))) / avg((speed + speed2) / 2) END AS relative
 FROM (SELECT unnest([0, 1, 2, 3]) AS bin) b LEFT JOIN (SELECT *, CASE WHEN (speed + speed2) / 2 >= 6 THEN 3 WHEN (speed + speed2) / 2 >= 4 THEN 2 WHEN (speed + speed2) / 2 >= 2 THEN 1 ELSE 0 END AS bin FROM ({LAG_SQL}) WHERE lag = 30) USING (bin) GROUP BY b.bin""", "rms mean_speed relative")
def by_speed_regime(spark, sf):
    return minutes.by_speed(P.minutes(spark, sf))


@query(f"""WITH r AS (SELECT *, minute % 60 AS i, minute - minute % 60 AS past FROM {P.MINUTES_SQL}), m AS (SELECT station, minute AS mark, speed AS s FROM {P.MINUTES_SQL} WHERE minute % 60 = 0),
 j AS (SELECT r.*, CASE WHEN i < 30 THEN a.s ELSE b.s END - speed AS near, a.s + (b.s - a.s) * i / 60 - speed AS line FROM r LEFT JOIN m a ON a.station = r.station AND a.mark = past LEFT JOIN m b ON b.station = r.station AND b.mark = past + 60)
 SELECT count(near) AS nearest_n, sqrt(avg(near * near)) AS nearest_rms, count(line) AS line_n, sqrt(avg(line * line)) AS line_rms FROM j""", "nearest_rms line_rms")
def whole_hour(spark, sf):
    return minutes.whole_hour(P.minutes(spark, sf))


BY_STATION = CURVE_SQL.replace("SELECT lag,", "SELECT station, lag,", 1).replace("SELECT b.minute", "SELECT a.station, b.minute").replace("GROUP BY lag", "GROUP BY station, lag")


@query(f"SELECT lag, sqrt(sum(n * speed_rms * speed_rms) / sum(n)) AS speed_rms, sqrt(sum(n * vector_rms * vector_rms) / sum(n)) AS vector_rms, sum(n) AS n FROM ({BY_STATION}) GROUP BY lag", "speed_rms vector_rms", "n")
def pooled_curve(spark, sf):
    return minutes.pooled(minutes.decorrelation(P.minutes(spark, sf), 30, ["station"]))


# ---- sequences

@query("SELECT user_id % 20 AS station, event_type AS mode, n AS times, CAST(sum(n) OVER (PARTITION BY user_id % 20) AS BIGINT) AS \"of\" FROM (SELECT user_id % 20 AS user_id, event_type, count(*) AS n, min(event_id) AS s FROM events GROUP BY user_id % 20, event_type) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) = 1")
def mode_first_seen(spark, sf):
    e = P.table(spark, sf, "events").select((F.col("user_id") % 20).alias("station"), "event_type", "event_id")
    return scoring.first_seen_mode(e, ["station"], "event_type", "event_id")


@query("""SELECT station, CAST(min(h) AS TIMESTAMP) - INTERVAL 2 HOURS AS "begin", CAST(max(h) AS TIMESTAMP) + INTERVAL 2 HOURS AS finish, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY h ROWS UNBOUNDED PRECEDING) AS g FROM
 (SELECT *, CASE WHEN h > lag(h) OVER (PARTITION BY station ORDER BY h) + INTERVAL 2 HOURS THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT user_id AS station, date_trunc('hour', ts) AS h FROM events WHERE event_type = 'click'))) GROUP BY station, g""")
def coalesce_windows(spark, sf):
    e = P.table(spark, sf, "events").where("event_type = 'click'").select(F.col("user_id").alias("station"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).distinct()
    two = F.expr("interval 2 hours")
    return sequences.merge_windows(e, ["station"], "h", two, two)


@query("""SELECT station, min(a) AS "begin", max(b) AS finish, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY station ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 300 THEN 1 ELSE 0 END AS new
 FROM (SELECT l_suppkey AS station, l_orderkey * 10 AS a, l_orderkey * 10 + l_partkey AS b FROM lineitem))) GROUP BY station, g""")
def merge_ranges(spark, sf):
    r = P.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("station"), (F.col("l_orderkey") * 10).alias("a"), (F.col("l_orderkey") * 10 + F.col("l_partkey")).alias("b"))
    return sequences.merge_ranges(r, ["station"], "a", "b", 300)


@query("SELECT o_custkey AS file, o_orderkey AS start, CAST(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS DOUBLE) AS last FROM orders")
def idx_end_offsets(spark, sf):
    o = P.table(spark, sf, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("start"))
    return sequences.open_ends(o, ["file"], "start").withColumn("last", F.col("last").cast("double"))


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) = 1")
def newest_per_key(spark, sf):
    return sequences.newest(P.table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT count(*) AS n, median(abs(step)) AS median_step FROM (SELECT speed - lag(speed) OVER (PARTITION BY station ORDER BY h) AS step, h - lag(h) OVER (PARTITION BY station ORDER BY h) AS d FROM (SELECT user_id % 20 AS station, date_trunc('hour', ts) AS h, avg(value / 10) AS speed FROM events GROUP BY ALL)) WHERE d = INTERVAL 1 HOUR", "median_step")
def median_motion(spark, sf):
    h = P.wind(spark, sf, None).groupBy("station", F.date_trunc("hour", "time").alias("h")).agg(F.avg("speed").alias("speed"))
    return sequences.steps(h, ["station"], "h", "speed", 3600).agg(F.count("*").alias("n"), F.median(F.abs("step")).alias("median_step"))


@query("SELECT class, max(v) FILTER (WHERE i = least(floor(n * 0.05), n - 1)) AS p5, max(v) FILTER (WHERE i = least(floor(n * 0.95), n - 1)) AS p95 FROM (SELECT l_returnflag AS class, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY class", "p5 p95", places=2)
def rank_percentiles(spark, sf):
    return scoring.by_rank(P.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("class"), "l_extendedprice"), ["class"], "l_extendedprice", {"p5": 0.05, "p95": 0.95})


# ---- rasters

STENCIL = f"""SELECT *, lag(w) OVER d AS nw, lag(z) OVER d AS n, lag(e) OVER d AS ne, lead(w) OVER d AS sw, lead(z) OVER d AS s, lead(e) OVER d AS se FROM (SELECT *, lag(z) OVER a AS w, lead(z) OVER a AS e FROM {P.RASTER_SQL} WINDOW a AS (PARTITION BY domain, "row" ORDER BY col)) WINDOW d AS (PARTITION BY domain, col ORDER BY "row")"""
OK9 = "(z + nw + n + ne + w + e + sw + s + se) IS NOT NULL"
GX, GY = f"(((ne + 2 * e + se) - (nw + 2 * w + sw)) / {8 * P.CELL})", f"(((nw + 2 * n + ne) - (sw + 2 * s + se)) / {8 * P.CELL})"
SLOPE_SQL = f"""SELECT domain, "row", col, CASE WHEN {OK9} THEN degrees(atan(sqrt({GX} * {GX} + {GY} * {GY}))) END AS slope_deg, CASE WHEN {OK9} AND NOT ({GX} = 0 AND {GY} = 0) THEN fmod(degrees(atan2(-{GX}, -{GY})) + 360, 360) END AS aspect_deg FROM ({STENCIL})"""


def stencil(spark, sf):
    return grid.neighbours(P.raster(spark, sf))


def sloped(spark, sf):
    return grid.slope_aspect(stencil(spark, sf), P.CELL, P.CELL)


@query(SLOPE_SQL, "slope_deg aspect_deg", "row col")
def slope_aspect(spark, sf):
    return sloped(spark, sf).select("domain", "row", "col", "slope_deg", "aspect_deg")


C2 = P.CELL * P.CELL
CURV_PARTS = f"SELECT *, ((e + w) / 2 - z) / {C2} AS cd, ((n + s) / 2 - z) / {C2} AS ce, (-nw + ne + sw - se) / {4 * C2} AS cf, (e - w) / {2 * P.CELL} AS cg, (n - s) / {2 * P.CELL} AS ch FROM ({STENCIL})"


@query(f"""SELECT domain, "row", col, CASE WHEN {OK9} THEN -2 * (cd + ce) END AS total_curv, CASE WHEN {OK9} AND cg * cg + ch * ch > 0 THEN -2 * (cd * cg * cg + ce * ch * ch + cf * cg * ch) / (cg * cg + ch * ch) END AS profile_curv,
 CASE WHEN {OK9} AND cg * cg + ch * ch > 0 THEN -2 * (cd * ch * ch + ce * cg * cg - cf * cg * ch) / (cg * cg + ch * ch) END AS plan_curv FROM ({CURV_PARTS})""", "total_curv profile_curv plan_curv", "row col")
def curvature(spark, sf):
    return grid.curvature(stencil(spark, sf), P.CELL, P.CELL).select("domain", "row", "col", "total_curv", "profile_curv", "plan_curv")


SQUARES = " + ".join(f"pow({k} - z, 2)" for k in grid.EIGHT)


@query(f"""SELECT domain, "row", col, CASE WHEN {OK9} THEN greatest(z, nw, n, ne, w, e, sw, s, se) - least(z, nw, n, ne, w, e, sw, s, se) END AS relief, CASE WHEN {OK9} THEN sqrt({SQUARES}) END AS tri, CASE WHEN {OK9} THEN z - (nw + n + ne + w + e + sw + s + se) / 8 END AS tpi FROM ({STENCIL})""", "relief tri tpi", "row col")
def roughness_tri_tpi(spark, sf):
    return grid.roughness(stencil(spark, sf)).select("domain", "row", "col", "relief", "tri", "tpi")


@query(f"""SELECT domain, max(g) AS steepest, count(*) FILTER (WHERE degrees(atan(g)) > 45) / count(g) AS past_limit FROM (SELECT domain, greatest(abs(lead(z) OVER (PARTITION BY domain, "row" ORDER BY col) - z), abs(lead(z) OVER (PARTITION BY domain, col ORDER BY "row") - z)) / {P.CELL} AS g FROM {P.RASTER_SQL}) GROUP BY domain""", "steepest past_limit")
def ground_slope(spark, sf):
    return grid.ground_slope(P.raster(spark, sf), P.CELL, P.CELL)


SHADE = "greatest(CASE WHEN aspect_deg IS NULL THEN sin(radians(45)) ELSE sin(radians(45)) * cos(radians(slope_deg)) + cos(radians(45)) * sin(radians(slope_deg)) * cos(radians(315 - aspect_deg)) END, 0)"


@query(f"""SELECT domain, "row", col, CASE WHEN slope_deg IS NOT NULL THEN {SHADE} END AS shade FROM ({SLOPE_SQL})""", "shade", "row col")
def hillshade(spark, sf):
    return grid.hillshade(sloped(spark, sf)).select("domain", "row", "col", "shade")


@query(f"""SELECT CASE WHEN slope_deg IS NULL THEN 0 ELSE CAST(floor(1 + 254 * {SHADE} + 0.5) AS BIGINT) // 16 END AS band, count(*) AS cells FROM ({SLOPE_SQL}) GROUP BY band""", "", "band")
def shade_bytes(spark, sf):
    return grid.hillshade(sloped(spark, sf)).groupBy(F.floor(F.col("shade_byte") / 16).alias("band")).agg(F.count("*").alias("cells"))


@query(f"""SELECT domain, "row" // 4 AS "row", col // 4 AS col, avg(z) AS z FROM {P.RASTER_SQL} GROUP BY domain, "row" // 4, col // 4""", "z", "row col")
def coarsen_blocks(spark, sf):
    return grid.coarsen(P.raster(spark, sf), 4)


OFFSETS3 = grid.disc(65.0, P.CELL, P.CELL)


@query(f"""SELECT domain, a."row", a.col, CASE WHEN a."row" >= 2 AND a."row" < (SELECT count(*) FROM embeddings) - 2 AND a.col >= 2 AND a.col < 62 AND count(b.z) >= {0.9 * len(OFFSETS3)} THEN sum(b.z) / count(b.z) END AS disc_mean
 FROM {P.RASTER_SQL} a CROSS JOIN (SELECT unnest([{', '.join(str(r) for r, _ in OFFSETS3)}]) AS dr, unnest([{', '.join(str(c) for _, c in OFFSETS3)}]) AS dc) o LEFT JOIN {P.RASTER_SQL} b ON b."row" = a."row" + dr AND b.col = a.col + dc AND b.domain = a.domain GROUP BY a.domain, a."row", a.col""".replace("SELECT domain, a", "SELECT a.domain, a"), "disc_mean", "row col")
def disc_mean(spark, sf):
    cells = P.raster(spark, sf)
    return grid.disc_mean(cells, P.extent(cells), 65.0, P.CELL, P.CELL).select("domain", "row", "col", "disc_mean")


@query(f"""SELECT domain, "row", col, z, CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 WHEN c IS NOT NULL THEN 2 END AS source FROM (SELECT r.domain, r."row", r.col, r.z AS a, s.z AS b, t.z AS c, coalesce(r.z, s.z, t.z) AS z FROM {P.RASTER_SQL} r
 LEFT JOIN (SELECT domain, "row" + 1 AS "row", col, z FROM {P.RASTER_SQL}) s USING (domain, "row", col) LEFT JOIN (SELECT domain, "row", col + 1 AS col, z FROM {P.RASTER_SQL}) t USING (domain, "row", col))""", "z source", "row col")
def mosaic_fill(spark, sf):
    a = P.raster(spark, sf)
    return grid.mosaic([a, a.withColumn("row", F.col("row") + 1), a.withColumn("col", F.col("col") + 1)]).withColumn("source", F.col("source").cast("double"))


POINTS = "SELECT p_partkey AS id, (p_partkey * 0.37) % 499 - 0.25 AS y, (p_partkey * 0.71) % 63 - 0.25 AS x FROM part"


def points(spark, sf):
    return P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("d").alias("domain"), ((F.col("p_partkey") * F.lit(0.37)) % 499 - 0.25).alias("y"), ((F.col("p_partkey") * F.lit(0.71)) % 63 - 0.25).alias("x"))


@query(f"""WITH q AS (SELECT id, y, x, least(greatest(y, 0), h - 1) AS yy, least(greatest(x, 0), 63) AS xx, h FROM (SELECT p_partkey AS id, fmod(p_partkey * 0.37::DOUBLE, 499) - 0.25 AS y, fmod(p_partkey * 0.71::DOUBLE, 63) - 0.25 AS x, (SELECT count(*) FROM embeddings) AS h FROM part)),
 k AS (SELECT id, least(floor(yy), h - 2) AS r, least(floor(xx), 62) AS c, yy, xx FROM q), m AS (SELECT k.id, count(*) AS n, count(z) AS have, sum(z * abs(1 - i - (yy - r)) * abs(1 - j - (xx - c))) AS z FROM k, (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j) o LEFT JOIN {P.RASTER_SQL} g ON g."row" = r + i AND g.col = c + j WHERE NOT (i = 0 AND yy - r = 1) AND NOT (j = 0 AND xx - c = 1) GROUP BY k.id)
 SELECT id, CASE WHEN n = have THEN z END AS z FROM q LEFT JOIN m USING (id)""", "z")
def bilinear_sample(spark, sf):
    cells = P.raster(spark, sf)
    p = points(spark, sf).crossJoin(F.broadcast(P.extent(cells).select("height", "width")))
    return grid.sample(p, cells, ["z"]).select("id", "z")


@query(f"""SELECT domain, "row", col, a.z - b.z AS anomaly FROM {P.RASTER_SQL} a LEFT JOIN (SELECT domain, "row", col, avg(z) OVER (PARTITION BY domain, "row" ORDER BY col ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS z FROM {P.RASTER_SQL}) b USING (domain, "row", col)""", "anomaly", "row col")
def anomaly_residual(spark, sf):
    from pyspark.sql import Window

    cells = P.raster(spark, sf)
    ref = cells.withColumn("z", F.avg("z").over(Window.partitionBy("domain", "row").orderBy("col").rowsBetween(-2, 2)))
    return grid.anomaly(cells, ref).select("domain", "row", "col", "anomaly")


TILES = "SELECT -109 + n_nationkey * 0.21::DOUBLE AS west, 37 + (n_nationkey % 7) * 0.3::DOUBLE AS south, -109 + n_nationkey * 0.21::DOUBLE + 0.5 AS east, 37 + (n_nationkey % 7) * 0.3::DOUBLE + 0.4 AS north FROM nation"


@query(f"""SELECT box_id, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM ({TILES}) t WHERE lon BETWEEN t.west AND t.east AND lat BETWEEN t.south AND t.north)) / count(*) AS coverage FROM
 (SELECT id AS box_id, lon + (j + 0.5) / 8 AS lon, lat + (i + 0.5) / 8 AS lat FROM {P.PLACES_SQL}, (SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, 8)) AS j)) GROUP BY box_id""", "coverage")
def coverage_fraction(spark, sf):
    b = P.places(spark, sf).select(F.col("id").alias("box_id"), F.col("lon").alias("west"), F.col("lat").alias("south"), (F.col("lon") + 1).alias("east"), (F.col("lat") + 1).alias("north"))
    k = F.col("n_nationkey")
    t = P.table(spark, sf, "nation").select((-109 + k * 0.21).alias("west"), (37 + (k % 7) * 0.3).alias("south")).select("*", (F.col("west") + 0.5).alias("east"), (F.col("south") + 0.4).alias("north"))
    return grid.coverage(b, t, 8)


# ---- wind over terrain

SLOPE_CURV = f"""SELECT domain, "row", col, CASE WHEN {OK9} THEN degrees(atan(sqrt({GX} * {GX} + {GY} * {GY}))) END AS slope_deg, CASE WHEN {OK9} AND NOT ({GX} = 0 AND {GY} = 0) THEN fmod(degrees(atan2(-{GX}, -{GY})) + 360, 360) END AS aspect_deg, CASE WHEN {OK9} THEN -2 * (((e + w) / 2 - z) / {C2} + ((n + s) / 2 - z) / {C2}) END AS total_curv FROM ({STENCIL})"""
WEIGHTS_SQL = f"SELECT *, radians(slope_deg) / (2 * max(abs(radians(slope_deg))) OVER (PARTITION BY domain)) AS w_slope, total_curv / (2 * max(abs(total_curv)) OVER (PARTITION BY domain)) AS w_curv FROM ({SLOPE_CURV})"


def weighted(spark, sf):
    st = grid.curvature(sloped(spark, sf), P.CELL, P.CELL).select("domain", "row", "col", "slope_deg", "aspect_deg", "total_curv")
    return wind.weights(st)


@query(f"""SELECT domain, "row", col, w_slope, w_curv FROM ({WEIGHTS_SQL})""", "w_slope w_curv", "row col")
def terrain_weights(spark, sf):
    return weighted(spark, sf).select("domain", "row", "col", "w_slope", "w_curv")


FACING = "CASE WHEN aspect_deg IS NULL THEN 0 ELSE w_slope * cos(radians(250 - aspect_deg)) END"


@query(f"""SELECT domain, "row", col, CASE WHEN w_slope IS NOT NULL AND w_curv IS NOT NULL THEN greatest(1 + 0.5 * {FACING} + 0.5 * w_curv, 0) END AS factor, CASE WHEN w_slope IS NOT NULL AND w_curv IS NOT NULL THEN CASE WHEN aspect_deg IS NULL THEN 0 ELSE -0.5 * ({FACING}) * degrees(sin(radians(2 * (aspect_deg - 250)))) END END AS turn_deg FROM ({WEIGHTS_SQL})""", "factor turn_deg", "row col")
def downscale_field(spark, sf):
    return wind.spread(weighted(spark, sf), F.lit(6.0), F.lit(250.0)).select("domain", "row", "col", "factor", "turn_deg")


MSG = """(SELECT 'v' || (l_suppkey % 3) AS volume, CASE WHEN l_linenumber % 2 = 0 THEN 'UGRD' ELSE 'VGRD' END AS param, CAST(10 * (l_linenumber // 2) AS VARCHAR) AS level, l_suppkey // 3 AS i, l_partkey % 40 AS j, l_quantity - 25 AS value, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"""


@query(f"""SELECT volume, level, i, j, CASE WHEN u IS NOT NULL AND v IS NOT NULL THEN u END AS u, CASE WHEN u IS NOT NULL AND v IS NOT NULL THEN v END AS v FROM (SELECT volume, level, i, j, max(value) FILTER (WHERE param = 'UGRD') AS u, max(value) FILTER (WHERE param = 'VGRD') AS v
 FROM (SELECT * FROM {MSG} QUALIFY row_number() OVER (PARTITION BY volume, param, level, i, j ORDER BY seq DESC, value DESC) = 1) GROUP BY ALL)""", "u v")
def volume_pivot(spark, sf):
    c = F.col
    m = P.table(spark, sf, "lineitem").select(F.concat(F.lit("v"), c("l_suppkey") % 3).alias("volume"), F.when(c("l_linenumber") % 2 == 0, "UGRD").otherwise("VGRD").alias("param"), (10 * F.floor(c("l_linenumber") / 2)).cast("string").alias("level"), F.lit("2024-01-01").cast("timestamp").alias("valid_time"), F.floor(c("l_suppkey") / 3).alias("i"), (c("l_partkey") % 40).alias("j"), (c("l_quantity") - 25).alias("value"), F.struct((c("l_orderkey") * 10 + c("l_linenumber")).alias("s"), c("l_quantity")).alias("seq"))
    return wind.volume(m).select("volume", "level", "i", "j", "u", "v")


@query("SELECT event_id, (event_id % 80) - 140.0 AS lon, u * cos(b) + v * sin(b) AS e, v * cos(b) - u * sin(b) AS n FROM (SELECT event_id, value / 10 AS u, (event_id % 13) - 6 AS v, radians((event_id % 80 - 140.0 + 97.5) * 0.6225) AS b FROM events)", "lon e n")
def grid_to_earth(spark, sf):
    e = P.table(spark, sf, "events").select("event_id", ((F.col("event_id") % 80) - 140.0).alias("lon"), (F.col("value") / 10).alias("u"), ((F.col("event_id") % 13) - 6).alias("v"))
    x, y = A.grid_to_earth("u", "v", "lon", -97.5, 0.6225)
    return e.select("event_id", "lon", x.alias("e"), y.alias("n"))


@query("SELECT p_partkey AS id, CASE WHEN z > r AND 10 > r THEN ln(10 / r) / ln(z / r) END AS factor, CASE WHEN z < 60 AND z > r THEN ln(60 / r) / ln(z / r) * (ln(10 / 0.03) / ln(60 / 0.03)) END AS exposure FROM (SELECT p_partkey, p_size + 0.5 AS z, 0.01 * (1 + p_partkey % 90) AS r FROM part)", "factor exposure")
def height_factor(spark, sf):
    p = P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 0.5).alias("z"), (0.01 * (1 + F.col("p_partkey") % 90)).alias("r"))
    return p.select("id", G.log_factor(F.lit(10.0), "z", "r").alias("factor"), G.exposure_factor(F.lit(10.0), "z", F.lit(0.03), "r").alias("exposure"))


@query(f"""SELECT landform, count(*) AS cells FROM (SELECT CASE WHEN p IS NULL OR slope_deg IS NULL THEN 'unknown' WHEN p >= 15 THEN 'ridge' WHEN p <= -15 THEN 'valley' WHEN slope_deg <= 5 THEN 'flat' ELSE 'slope' END AS landform FROM (SELECT slope_deg, CASE WHEN slope_deg IS NOT NULL THEN z - (nw + n + ne + w + e + sw + s + se) / 8 END AS p FROM ({STENCIL}) JOIN ({SLOPE_SQL}) USING (domain, "row", col))) GROUP BY landform""")
def landform_class(spark, sf):
    st = grid.roughness(sloped(spark, sf))
    return st.groupBy(G.landform("tpi", "slope_deg").alias("landform")).agg(F.count("*").alias("cells"))


@query("SELECT bearing, count(*) AS n FROM (SELECT ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][CAST(floor(((event_id * 37) % 360) / 22.5 + 0.5) AS BIGINT) % 16 + 1] AS bearing FROM events) GROUP BY bearing")
def compass_rose(spark, sf):
    return P.wind(spark, sf, None).groupBy(A.compass_point("from_deg").alias("bearing")).agg(F.count("*").alias("n"))


# ---- text, times, rejects

CODE_SQL = "CASE WHEN k IS NULL THEN 'bad-time' WHEN event_type = 'error' THEN 'bad-quality' WHEN value < 1 THEN 'no-wind' WHEN value / 10 > 20 THEN 'implausible' END"


@query(f"SELECT code, count(*) AS n FROM (SELECT {CODE_SQL} AS code FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)) GROUP BY code")
def reject_codes(spark, sf):
    e = P.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    code = rejects.first_failure([(F.col("k").isNull(), "bad-time"), (F.col("event_type") == "error", "bad-quality"), (F.col("value") < 1, "no-wind"), (F.col("value") / 10 > 20, "implausible")])
    return e.groupBy(code.alias("code")).agg(F.count("*").alias("n"))


@query(f"SELECT station, count(*) AS seen, count(*) FILTER (WHERE code IS NULL) AS kept, count(*) FILTER (WHERE code IS NOT NULL) AS rejected, count(*) FILTER (WHERE code IS NULL AND calm) AS calm, count(*) FILTER (WHERE code IS NULL) AS with_direction FROM (SELECT *, CASE WHEN speed > 12 THEN 'implausible' END AS code FROM {P.wind_sql(None)}) GROUP BY station")
def read_counts(spark, sf):
    return rejects.counts(P.wind(spark, sf, None).withColumn("code", F.when(F.col("speed") > 12, "implausible")), ["station"])


STRIP = "trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query("SELECT page_id, left(concat_ws(' - ', nullif(" + STRIP.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + ", ''), nullif(" + STRIP.format("regexp_extract(html, '(?is)<p[^>]*>(.*?)</p>', 1)") + ", '')), 300) AS summary, regexp_matches(lower(ltrim(html)), '^(<!doctype|<html|<\\?xml|<head|<body)') AS markup FROM pages")
def html_summary(spark, sf):
    return P.table(spark, sf, "pages").select("page_id", listings.page_summary("html").alias("summary"), listings.is_markup("html").alias("markup"))


@query("SELECT page_id, regexp_replace(url, '(?i)([?&](?:token|key|apikey|ref)=)[^&#]*', '\\1***', 'g') AS url FROM pages")
def url_redact(spark, sf):
    return P.table(spark, sf, "pages").select("page_id", listings.redacted("url").alias("url"))


@query("SELECT o_orderkey, sha256(concat_ws('|', CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority)) AS key FROM orders")
def cache_keys(spark, sf):
    return P.table(spark, sf, "orders").select("o_orderkey", listings.cache_key("o_custkey", "o_orderstatus", "o_orderpriority").alias("key"))


@query("SELECT event_id, trim(substring(line, 1, 8)) AS a, trim(substring(line, 9, 10)) AS b, TRY_CAST(trim(substring(line, 19, 8)) AS DOUBLE) AS v FROM (SELECT event_id, lpad(CAST(event_id AS VARCHAR), 8, ' ') || rpad(event_type, 10, ' ') || lpad(CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR), 8, ' ') AS line FROM events)", "v")
def fixed_width_parse(spark, sf):
    from ..sources.stations import cut, number

    line = F.concat(F.lpad(F.col("event_id").cast("string"), 8, " "), F.rpad("event_type", 10, " "), F.lpad(F.floor(F.col("value") * 100).cast("string"), 8, " "))
    return P.table(spark, sf, "events").select("event_id", line.alias("line")).select("event_id", cut("line", 1, 8).alias("a"), cut("line", 9, 18).alias("b"), number(cut("line", 19, 26)).alias("v"))


@query("SELECT event_id, date_trunc('hour', ts) - CASE WHEN event_id % 60 >= 30 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END + to_minutes(event_id % 60) AS at FROM events")
def transmit_minute_time(spark, sf):
    m = F.col("event_id") % 60
    t = F.unix_micros(F.date_trunc("hour", "ts").cast("timestamp")) + (m - F.when(m >= 30, 60).otherwise(0)) * 60_000_000
    return P.table(spark, sf, "events").select("event_id", F.timestamp_micros(t).cast("timestamp_ntz").alias("at"))


@query("SELECT event_id, ts - INTERVAL 150 SECONDS AS middle FROM events")
def interval_midpoint(spark, sf):
    return P.table(spark, sf, "events").select("event_id", (F.col("ts") - F.expr("interval 150 seconds")).alias("middle"))


# ---- continuous forms on a static table

@query(f"""SELECT station, date_trunc('hour', time) AS "begin", count(*) AS n, avg(speed) AS mean_speed, sqrt(pow(avg(-speed * sin(radians(from_deg))), 2) + pow(avg(-speed * cos(radians(from_deg))), 2)) AS vector_speed FROM {P.wind_sql(None)} GROUP BY station, date_trunc('hour', time)""", "mean_speed vector_speed")
def hourly_wind(spark, sf):
    return streams.hourly(P.wind(spark, sf, None)).drop("from_deg").withColumn("begin", F.col("begin").cast("timestamp_ntz"))


@query(f"""SELECT station, min(time) AS "begin", max(time) AS "last", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY time, id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN time > lag(time) OVER (PARTITION BY station ORDER BY time, id) + INTERVAL 2 HOURS THEN 1 ELSE 0 END AS new FROM {P.wind_sql(OBS)})) GROUP BY station, g""")
def session_bursts(spark, sf):
    return streams.bursts(P.wind(spark, sf, OBS)).select("station", F.col("begin").cast("timestamp_ntz").alias("begin"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


# ---- kernels: no SQL

def domains(spark, sf):
    """The raster cut in tiles of 32 x 32, filled, each a domain."""
    c = F.col
    r = P.raster(spark, sf)
    return r.select(F.concat_ws("-", F.floor(c("row") / 32), F.floor(c("col") / 32)).alias("domain"), (c("row") % 32).cast("int").alias("row"), (c("col") % 32).cast("int").alias("col"), F.coalesce("z", F.lit(0.0)).alias("z"))


@query()
def shelter_sx(spark, sf):
    sx = kernels.shelter_tiled(P.raster(spark, sf), P.CELL, P.CELL).withColumn("domain", F.concat_ws("-", "tile_row", "tile_col"))
    return sx.groupBy("domain", "sector_deg").agg(F.count("*").alias("cells"), F.avg("sx_deg").alias("mean_sx"))


@query()
def basis_combine(spark, sf):
    b = kernels.basis(domains(spark, sf), P.CELL, P.CELL)
    winds = spark.createDataFrame([(1, 3.0, 1.0), (2, -2.0, 4.0)], "wind_id int, e double, n double")
    f = wind.superpose(b, winds)
    return f.groupBy("wind_id", "domain").agg(F.count("*").alias("cells"), F.avg("speed").alias("mean_speed"), F.max("speed").alias("most"), F.bool_and("converged").alias("converged"))


@query()
def geodesic_line(spark, sf):
    lines = P.places(spark, sf).select(F.col("id").alias("line_id"), "lat", "lon", (F.col("id") * 17 % 360).cast("double").alias("bearing"), F.lit(2500.0).alias("length"), F.lit(400.0).alias("step"))
    return kernels.stations_along(lines)


# ---- cycles, products, profiles

@query("SELECT event_id, date_trunc('hour', ts - INTERVAL 75 MINUTES) AS cycle, CASE WHEN extract('hour' FROM date_trunc('hour', ts - INTERVAL 75 MINUTES)) % 6 = 0 THEN 48 ELSE 18 END AS longest FROM events", "", "longest")
def model_cycles(spark, sf):
    e = P.table(spark, sf, "events").select("event_id", cycles.latest_cycle("ts").alias("c"))
    return e.select("event_id", F.col("c").cast("timestamp_ntz").alias("cycle"), cycles.longest_lead("c").alias("longest"))


@query("SELECT cycle, lead_h, cycle + to_hours(lead_h) AS valid_time FROM (SELECT DISTINCT date_trunc('hour', ts) AS cycle FROM events) c, (SELECT unnest(range(0, 49)) AS lead_h) l WHERE lead_h <= least(CASE WHEN extract('hour' FROM cycle) % 6 = 0 THEN 48 ELSE 18 END, 24)", "", "lead_h")
def forecast_series(spark, sf):
    c = P.table(spark, sf, "events").select(F.date_trunc("hour", "ts").alias("cycle")).distinct()
    return cycles.series(c, "cycle", 24).select(F.col("cycle").cast("timestamp_ntz").alias("cycle"), "lead_h", F.col("valid_time").cast("timestamp_ntz").alias("valid_time"))


@query("SELECT l_suppkey AS box, arg_min(dataset, res) FILTER (WHERE cov >= 0.98) AS dataset FROM (SELECT l_suppkey, 'd' || l_linenumber AS dataset, l_linenumber AS res, avg(1 - l_discount / 4) AS cov FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def finest_dataset(spark, sf):
    c = P.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("box"), F.concat(F.lit("d"), "l_linenumber").alias("dataset"), F.col("l_linenumber").alias("res")).agg(F.avg(1 - F.col("l_discount") / 4).alias("cov"))
    return cycles.finest_covering(c, ["box"], "res", "cov", 0.98).select("box", "dataset")


@query(f"""SELECT id, metres, bearing, degrees(q) AS lat2, lon + degrees(atan2(sin(radians(bearing)) * sin(metres / 6371008.8) * cos(radians(lat)), cos(metres / 6371008.8) - sin(radians(lat)) * sin(q))) AS lon2
 FROM (SELECT *, asin(sin(radians(lat)) * cos(metres / 6371008.8) + cos(radians(lat)) * sin(metres / 6371008.8) * cos(radians(bearing))) AS q FROM {P.PLACES_SQL}, (SELECT unnest([800.0::DOUBLE, 1600.0]) AS metres), (SELECT unnest(range(0, 8)) * 45.0::DOUBLE AS bearing))""", "lat2 lon2 metres bearing")
def displaced_reads(spark, sf):
    return cycles.displaced_reads(P.places(spark, sf), [800.0, 1600.0]).select("id", "metres", "bearing", "lat2", "lon2")


def _axis_sql(x: str, axis: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {b} THEN {k} + greatest(({x} - {a}) / ({b} - {a}), 0)" for k, (a, b) in enumerate(zip(axis, axis[1:]))) + f" ELSE {len(axis) - 1} END"


HEIGHTS, RANGES = [2.0, 10.0, 30.0, 80.0], [0.0, 100.0, 250.0, 400.0, 900.0]


@query(f"""WITH q AS (SELECT p_partkey AS id, {_axis_sql('p_size * 2.0', HEIGHTS)} AS y, {_axis_sql('(p_partkey % 1000) * 1.0', RANGES)} AS x FROM part), c AS (SELECT *, least(floor(y), 2) AS i, least(floor(x), 3) AS j FROM q)
 SELECT id, ((i * 3 + j * j) * (1 - (x - j)) + (i * 3 + (j + 1) * (j + 1)) * (x - j)) * (1 - (y - i)) + (((i + 1) * 3 + j * j) * (1 - (x - j)) + ((i + 1) * 3 + (j + 1) * (j + 1)) * (x - j)) * (y - i) AS u FROM c""", "u")
def contract_sample(spark, sf):
    p = P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 2.0).alias("h"), ((F.col("p_partkey") % 1000) * 1.0).alias("r"))
    grids = [[float(i * 3 + j * j) for j in range(5)] for i in range(4)]
    lit = lambda a: F.array(*map(F.lit, a))
    p = p.withColumn("heights", lit(HEIGHTS)).withColumn("ranges", lit(RANGES)).withColumn("g", F.array(*[lit(g) for g in grids]))
    return p.select("id", contracts.sampled("g", "heights", "ranges", "h", "r").alias("u"))


@query("SELECT CASE WHEN p_size % 5 = 0 THEN 'unsupported-version' WHEN p_size % 7 = 0 THEN 'malformed-axis' WHEN p_size % 11 = 0 THEN 'out-of-range' END AS code, count(*) AS n FROM part GROUP BY code")
def contract_validate(spark, sf):
    s = F.col("p_size")
    text = F.format_string('{"schemaVersion":%d,"frame":"shooter","azimuthDeg":%d,"rangesYards":%s,"heightsAglFt":[2,10],"uFps":null,"vFps":[[1,2],[3,4]],"wFps":null,"source":"x","terrainResolutionM":null,"windSourceResolutionM":10,"confidence":0.5}', F.when(s % 5 == 0, 2).otherwise(1), F.when(s % 11 == 0, 400).otherwise(10), F.when(s % 7 == 0, "[5,1]").otherwise("[0,5]"))
    return contracts.validated(P.table(spark, sf, "part").select(text.alias("profile"))).groupBy("code").agg(F.count("*").alias("n"))


# ---- surveys

PI_PTS = "(SELECT p_partkey AS id, fmod(p_partkey * 0.37::DOUBLE, 499) AS y, fmod(p_partkey * 0.71::DOUBLE, 63) AS x, p_size * 1.0 AS z, (SELECT count(*) FROM embeddings) AS h FROM part)"


@query(f"""WITH d AS (SELECT id, y, x, CAST(floor(y) + dy AS INT) AS r, CAST(floor(x) + dx AS INT) AS c FROM {PI_PTS}, (SELECT unnest(range(-4, 5)) AS dy), (SELECT unnest(range(-4, 5)) AS dx)
  WHERE floor(y - 65 / 30.0) >= 0 AND ceil(y + 65 / 30.0) <= h - 1 AND floor(x - 65 / 30.0) >= 0 AND ceil(x + 65 / 30.0) <= 63), g AS (SELECT id, count(*) AS n, count(z) AS samples, avg(z) AS m FROM d LEFT JOIN {P.RASTER_SQL} t ON t."row" = r AND t.col = c WHERE pow((r - y) * 30, 2) + pow((c - x) * 30, 2) <= 65 * 65 GROUP BY id)
 SELECT p.id, CASE WHEN samples / n >= 0.9 THEN z - m END AS position FROM {PI_PTS} p LEFT JOIN g USING (id)""", "position")
def position_index(spark, sf):
    cells = P.raster(spark, sf)
    p = P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("d").alias("domain"), ((F.col("p_partkey") * F.lit(0.37)) % 499).alias("y"), ((F.col("p_partkey") * F.lit(0.71)) % 63).alias("x"), (F.col("p_size") * 1.0).cast("double").alias("z"))
    return surveys.position_index(p.crossJoin(F.broadcast(P.extent(cells).select("height", "width"))), cells, "id", 65.0, P.CELL, P.CELL).select("id", "position")


@query(f"""SELECT line, n, sqrt(greatest(mm - 2 * om + oo, 0) / n) AS rmse, om / mm AS scale, sqrt(greatest(om / mm * om / mm * mm - 2 * om / mm * om + oo, 0) / n) AS scaled_rmse, dir_bias, dir_rmse FROM (SELECT line, count(*) FILTER (WHERE mod_speed IS NOT NULL) AS n, sum(obs_speed * obs_speed) FILTER (WHERE mod_speed IS NOT NULL) AS oo, sum(mod_speed * mod_speed) AS mm, sum(obs_speed * mod_speed) AS om, avg(d) AS dir_bias, sqrt(avg(d * d)) AS dir_rmse
 FROM (SELECT *, CASE WHEN obs_speed >= 1 AND obs_from IS NOT NULL AND mod_speed IS NOT NULL THEN {sql_signed('mod_from', 'obs_from')} END AS d FROM {P.PAIRS_SQL}) GROUP BY line)""", "rmse scale scaled_rmse dir_bias dir_rmse", "line")
def model_gradient(spark, sf):
    return surveys.by_displacement(P.pairs(spark, sf), "line")


@query(f"""SELECT 'debiased' AS arm, max(b.f - a.f) AS difference, min(b.without - a.without) AS least, max(b.without - a.without) AS most, count(DISTINCT sign(b.without - a.without)) = 1 AS stable FROM (SELECT station, "full" AS f, without FROM ({jack_sql(False)})) a JOIN (SELECT station, "full" AS f, without FROM ({jack_sql(True)})) b USING (station)""", "difference least most")
def arms_compared(spark, sf):
    p = P.pairs(spark, sf)
    folds = scoring.leave_one_out(p, "station").withColumn("arm", F.lit("raw")).unionByName(scoring.leave_one_out(p, "station", debias=True).withColumn("arm", F.lit("debiased")))
    return surveys.arms(folds, "arm", "station", "raw")


@query(f"SELECT avg(g) AS gain, count(g) AS groups FROM (SELECT station, avg(abs(mod_speed - obs_speed)) AS g FROM {P.PAIRS_SQL} GROUP BY station)", "gain")
def mean_gain(spark, sf):
    return surveys.mean_gain(P.pairs(spark, sf), "station", F.abs(F.col("mod_speed") - F.col("obs_speed")))


@query(f"""SELECT domain, "row", col, z FROM {P.RASTER_SQL} WHERE "row" % CAST(ceil(sqrt((SELECT count(*) FROM embeddings) * 64 / 500.0)) AS INT) = 0 AND col % CAST(ceil(sqrt((SELECT count(*) FROM embeddings) * 64 / 500.0)) AS INT) = 0""", "z", "row col")
def stride_sample(spark, sf):
    cells = P.raster(spark, sf)
    return surveys.strided(cells, P.extent(cells), 500)


@query("""SELECT o_custkey, state, count(*) AS n FROM (SELECT o_custkey, CASE WHEN age > 1800 OR r > 900 THEN 'gone' WHEN age > 300 THEN 'stale' ELSE 'fresh' END AS state FROM (SELECT o_custkey, (epoch_us(TIMESTAMP '2001-01-01') - epoch_us(d)) / 86400000000 AS age, row_number() OVER (ORDER BY d DESC, o_custkey) AS r FROM (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY o_custkey))) GROUP BY ALL""")
def retained_listings(spark, sf):
    r = surveys.retained(P.table(spark, sf, "orders"), "o_custkey", "o_orderdate", F.lit("2001-01-01").cast("timestamp"), 300, 1800, 900)
    return r.groupBy("o_custkey", "state").agg(F.count("*").alias("n"))
