"""Registered queries of short-time spectra, the sky and its aspects, lead and lag, mutual information and warping clusters, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periodica.functions.storage import checkpointed
from periodica.operators import autoencoder, cleaning, cycles, ephemeris, features, information, models, modes, ranking, relations, spectral, spectrogram, stability, warping
from periodica.plans.queries import BARS_SQL, KEYS, NUMBERED_SQL, PEAKS_SQL, W, order_bars, rounded, sql, table
from periodica.sources import bars as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, build: Callable[[DataFrame], DataFrame], keys: list[str], values: list[str], inner: str | None, base: str = BARS_SQL) -> None:
    """Register an operator over daily order bars; sums with 0 leave no negative zeros."""
    QUERIES[name] = lambda spark, sf_dir: rounded(build(order_bars(spark, sf_dir)), keys, values).withColumns({v: F.col(v) + 0.0 for v in values})
    if inner:
        ORACLES[name] = sql(inner, keys, values, base)


DETRENDED_SQL = f"""select series_id, ts, bar, n, close - intercept - slope * bar as x from (select *, count(*) over (partition by series_id) as n from ({NUMBERED_SQL}))
  join (select series_id, regr_slope(close, bar) as slope, regr_intercept(close, bar) as intercept from ({NUMBERED_SQL}) group by 1) using (series_id)"""


def windows_sql(step: int, more: int) -> str:
    """Power of every hopping window of 64 bars and frequency k / 64 by its plain sums; windows end at least more bars before the end of the series."""
    return f"""select series_id, begin, k, pow(sum(v * cos(2 * pi() * ((k * place) % 64) / 64)), 2) + pow(sum(v * sin(2 * pi() * ((k * place) % 64) / 64)), 2) as power from
  (select series_id, {step} * j as begin, bar - {step} * j as place, x * (0.5 - 0.5 * cos(2 * pi() * (bar - {step} * j) / 63)) as v, unnest(range(1, 33)) as k
  from (select *, unnest(range(greatest(0, ceil((bar - 63) / {step}.0))::bigint, floor(bar / {step}.0)::bigint + 1)) as j from ({DETRENDED_SQL})) where {step} * j + 64 + {more} <= n) group by 1, 2, 3"""


BANDS = {"short": (8, 16), "medium": (16, 32), "long": (32, 64)}
add("short_time_energy", lambda b: spectrogram.band_energy(cleaning.detrend_linear(b)), KEYS, [f"energy_{b}" for b in BANDS], f"""select series_id, ts, {', '.join(f'case when count(*) over w >= 100 then e_{b} / (max(e_{b}) over w + 1e-10) end as energy_{b}' for b in BANDS)}
  from (select z.series_id, z.ts, {', '.join(f'coalesce(e_{b}, 0) as e_{b}' for b in BANDS)} from ({DETRENDED_SQL}) z left join
  (select series_id, begin + 64 as bar, {', '.join(f'sum(case when k >= {low} and k < {high} then power else 0 end) as e_{b}' for b, (low, high) in BANDS.items())} from ({windows_sql(5, 1)}) group by 1, 2) e on e.series_id = z.series_id and e.bar = z.bar)
  window w as ({W} rows between 99 preceding and current row)""")
add("spectrogram", lambda b: spectrogram.spectrogram(cleaning.detrend_linear(b)).withColumnRenamed("window", "hop"), ["series_id", "hop", "ts", "k"], ["period", "frequency", "power"], f"""select p.series_id, (begin // 16)::int as hop, z.ts, k::int as k, 64.0 / k as period, k / 64.0 as frequency, power / max(power) over (partition by p.series_id) as power
  from ({windows_sql(16, 0)}) p join ({DETRENDED_SQL}) z on z.series_id = p.series_id and z.bar = p.begin + 63""")


def turn(x: str) -> str:
    return f"((({x}) % 360) + 360) % 360"


def half_turn(x: str) -> str:
    return f"(((({x} + 180) % 360) + 360) % 360 - 180)"


def sky_sql(dates: str) -> str:
    """CTEs up to sky (ts, shift, body, place, lon, lat, helio_lon, dec), for shift 0 and a day before (1); dates gives ts."""
    rows = ", ".join(f"('{b}', {', '.join(map(str, v))})" for b, v in ephemeris.ELEMENTS.items())
    arguments = ", ".join(f"radians({turn(f'{a} + {b} * t')}) as {n}" for n, (a, b) in zip("dmnf", ephemeris.MOON_ARGUMENTS[1:], strict=True))
    series = lambda terms: " + ".join(f"{c} * sin({' + '.join(f'{k} * {n}' for n, k in zip('dmnf', ks, strict=True) if k)})" for c, *ks in terms)
    newton = "".join(f", kepler_{i + 1} as (select * exclude (x), x - (x - e * sin(x) - m) / (1 - e * cos(x)) as x from kepler_{i})" for i in range(7))
    order = ", ".join(f"('{b}', {i})" for i, b in enumerate(ephemeris.BODIES))
    tilt = f"radians({ephemeris.OBLIQUITY[0]} + {ephemeris.OBLIQUITY[1]} * t)"
    return f"""dates as (select distinct ts from ({dates})), moments as (select ts, shift, (date_diff('second', timestamp '2000-01-01 12:00:00', ts) / 86400.0 - shift) / 36525 as t from dates, (values (0), (1)) as s(shift)),
elements(body, a0, a1, e0, e1, i0, i1, l0, l1, w0, w1, n0, n1) as (values {rows}), places(body, place) as (values {order}),
kepler_0 as (select ts, shift, t, body, a0 + a1 * t as a, e0 + e1 * t as e, radians(i0 + i1 * t) as i, radians(w0 + w1 * t - n0 - n1 * t) as w, radians(n0 + n1 * t) as n, radians({half_turn('(l0 + l1 * t - w0 - w1 * t)')}) as m, m as x from moments, elements){newton},
helio as (select ts, shift, t, body, (cos(w) * cos(n) - sin(w) * sin(n) * cos(i)) * u + (-sin(w) * cos(n) - cos(w) * sin(n) * cos(i)) * v as x, (cos(w) * sin(n) + sin(w) * cos(n) * cos(i)) * u + (-sin(w) * sin(n) + cos(w) * cos(n) * cos(i)) * v as y,
  sin(w) * sin(i) * u + cos(w) * sin(i) * v as z from (select *, a * (cos(x) - e) as u, a * sqrt(1 - e * e) * sin(x) as v from kepler_7)),
seen as (select p.ts, p.shift, p.t, case p.body when 'earth' then 'sun' else p.body end as body, case p.body when 'earth' then -e.x else p.x - e.x end as gx, case p.body when 'earth' then -e.y else p.y - e.y end as gy, case p.body when 'earth' then -e.z else p.z - e.z end as gz,
  {turn(f'degrees(atan2(p.y, p.x)) + {ephemeris.PRECESSION} * p.t')} as helio_lon from helio p join helio e on e.ts = p.ts and e.shift = p.shift and e.body = 'earth'),
moons as (select ts, shift, t, {turn(f'{ephemeris.MOON_ARGUMENTS[0][0]} + {ephemeris.MOON_ARGUMENTS[0][1]} * t + {series(ephemeris.MOON_LONGITUDE)}')} as lon, {series(ephemeris.MOON_LATITUDE)} as lat from (select *, {arguments} from moments)),
bodies as (select ts, shift, t, body, {turn(f'degrees(atan2(gy, gx)) + {ephemeris.PRECESSION} * t')} as lon, degrees(atan2(gz, sqrt(gx * gx + gy * gy))) as lat, helio_lon from seen union all select ts, shift, t, 'moon', lon, lat, lon from moons),
sky as (select ts, shift, body, place, lon, lat, helio_lon, asin(sin(radians(lat)) * cos({tilt}) + cos(radians(lat)) * sin({tilt}) * sin(radians(lon))) as dec from bodies join places using (body)),
positions as (select a.ts, a.body, a.lon, a.lat, a.helio_lon, a.dec, {half_turn('(a.lon - b.lon)')} as speed, {half_turn('(a.helio_lon - b.helio_lon)')} as helio_speed from sky a join sky b on a.ts = b.ts and a.body = b.body and a.shift = 0 and b.shift = 1)"""


DAYS = lambda b: b.select("ts").distinct()
LAST = lambda b: b.agg(F.max("ts").alias("ts"))
ALL_DAYS, LAST_DAY = f"select ts from ({BARS_SQL})", f"select max(ts) as ts from ({BARS_SQL})"


def with_sky(dates: str, select: str) -> str:
    return f"with {sky_sql(dates)} {select}"


def angles(frame: str = "shift = 0") -> str:
    return f"select a.ts, a.body as body_a, b.body as body_b, a.place as i, b.place as j, abs({half_turn('(a.lon - b.lon)')}) as angle from sky a join sky b on a.ts = b.ts and a.shift = 0 and b.shift = 0 and a.place < b.place"


KINDS = ", ".join(f"({k}, '{n}', {a})" for k, (n, a) in enumerate(ephemeris.ASPECTS.items()))
add("sky_positions", lambda b: ephemeris.positions(DAYS(b)), ["ts", "body", "retrograde"], ["lon", "lat", "helio_lon", "speed", "helio_speed", "dec"], None)
ORACLES["sky_positions"] = with_sky(ALL_DAYS, "select ts, body, speed < 0 as retrograde, " + ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in ("lon", "lat", "helio_lon", "speed", "helio_speed", "dec")) + " from positions")
add("sky_aspects", lambda b: ephemeris.aspects(DAYS(b)), ["ts", "body_a", "body_b", "aspect", "active"], ["angle", "proximity"], None)
ORACLES["sky_aspects"] = with_sky(ALL_DAYS, f"select ts, body_a, body_b, aspect, abs(angle - exact) <= 5 as active, round(angle, 6) as angle, round(abs(angle - exact), 6) as proximity from ({angles()}), (values {KINDS}) as k(k, aspect, exact)")
add("current_sky", lambda b: ephemeris.current(LAST(b)), ["ts", "body", "sign", "is_retrograde"], ["longitude", "degree_in_sign", "speed", "declination"], None)
ORACLES["current_sky"] = with_sky(LAST_DAY, f"select ts, body, [{', '.join(repr(s) for s in ephemeris.SIGNS)}][1 + floor(lon / 30)::int] as sign, speed < 0 as is_retrograde, round(lon, 4) as longitude, round(lon % 30, 2) as degree_in_sign, round(speed, 4) as speed, round(degrees(dec), 4) as declination from positions")
add("upcoming_aspects", lambda b: ephemeris.upcoming(LAST(b)), ["as_of", "rank", "ts", "days_from_now", "body_a", "body_b", "aspect"], ["orb"], None)
ORACLES["upcoming_aspects"] = with_sky(f"select ts + to_days(unnest(range(30))::int) as ts from ({LAST_DAY})", f"""select as_of, row_number() over (order by days_from_now, i, j, k)::int as rank, ts, days_from_now, body_a, body_b, aspect, round(abs(angle - exact), 2) as orb
  from (select *, min(ts) over () as as_of, date_diff('day', min(ts) over (), ts)::int as days_from_now from ({angles()})), (values {KINDS}) as k(k, aspect, exact) where abs(angle - exact) <= 1 qualify rank <= 50""")
add("exact_aspects", lambda b: ephemeris.exact_aspects(DAYS(b)), ["ts", "body_a", "body_b", "aspect", "exact_ts"], ["error"], None)


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log returns of daily bars of all orders as one series, with their number among returns: (series_id, ts, bar, value)."""
    o = table(spark, sf_dir, "orders")
    bars = cleaning.returns(sources.from_ticks(o, F.lit("all"), o.o_orderdate, o.o_totalprice, o.o_orderkey)).where("log_return is not null")
    return bars.select("series_id", "ts", (F.row_number().over(Window.partitionBy("series_id").orderBy("ts")) - 1).alias("bar"), F.col("log_return").alias("value"))


def sky_lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = market(spark, sf_dir)
    found = ephemeris.features(returns.select("ts").distinct()).join(returns.select("series_id", "ts", "bar"), "ts").select("series_id", "feature", "bar", "value")
    return relations.lead_lag(found, returns)


def sky_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 lagged correlations of largest absolute r, with p corrected over all of them."""
    corrected = relations.false_discovery(checkpointed(sky_lead_lag(spark, sf_dir).where("pearson_p is not null")), "pearson_p")
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc(F.round(F.abs("pearson_r"), 9)), "feature", "lag"))
    parts = F.split("feature", "_", 2)
    out = corrected.withColumn("rank", place).where("rank <= 20").withColumn("body", parts[0]).withColumn("factor", parts[1])
    return rounded(out, ["rank", "body", "factor", "lag", "n", "is_significant"], ["pearson_r", "spearman_r", "corrected"])


def beta_sql(r: str, n: str, depth: int = 160) -> str:
    """Two-sided p of a correlation, by the continued fraction written out from the inside."""
    a, b, x = "a", "b", "x"
    fraction = "1.0"
    for i in range(depth, 0, -1):
        m = i // 2
        step = f"{m} * ({b} - {m}) * {x} / (({a} + {2 * m - 1}) * ({a} + {2 * m}))" if i % 2 == 0 else f"-({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + {2 * m}) * ({a} + {2 * m + 1}))"
        fraction = f"(1 + ({step}) / {fraction})"
    return f"exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) / a / {fraction}"


def p_sql(source: str, r: str, p: str) -> str:
    """source with the column p of r and n."""
    high = "(n - 2) / 2.0"
    near = f"(1 - {r} * {r}) < ({high} + 1) / ({high} + 2.5)"
    return f"""select * exclude (a, b, x, near), case when {r} is null then null when near then {beta_sql(r, 'n')} else 1 - ({beta_sql(r, 'n')}) end as {p}
  from (select *, {near} as near, case when {near} then {high} else 0.5 end as a, case when {near} then 0.5 else {high} end as b, case when {near} then 1 - {r} * {r} else {r} * {r} end as x from ({source}))"""


MARKET_SQL = "select ts, row_number() over (order by ts) - 1 as bar, r as value from (select ts, ln(close / lag(close) over (order by ts)) as r from (select date_trunc('day', o_orderdate)::timestamp as ts, arg_max(o_totalprice, o_orderkey) as close from orders group by 1)) where r is not null"
FEATURES_SQL = "select ts, body || '_' || name as feature, value from (select ts, body, lon, sin(radians(lon)) as lon_sin, cos(radians(lon)) as lon_cos, speed, abs(speed) as speed_abs, (speed < 0)::double as retrograde, dec from positions) unpivot (value for name in (lon, lon_sin, lon_cos, speed, speed_abs, retrograde, dec))"
LAGGED_SQL = f"""with {sky_sql(f'select ts from ({MARKET_SQL})')}, market as ({MARKET_SQL}), moved as (select feature, lag, f.value as x, m.value as y from (select f.feature, f.value, b.bar, unnest(range(-20, 21)) as lag from ({FEATURES_SQL}) f join market b using (ts)) f join market m on m.bar = f.bar + f.lag),
ranked as (select *, rank() over (partition by feature, lag order by x) + (count(*) over (partition by feature, lag, x) - 1) / 2.0 as rx, rank() over (partition by feature, lag order by y) + (count(*) over (partition by feature, lag, y) - 1) / 2.0 as ry from moved),
found as (select feature, lag, count(*) as n, case when stddev_pop(x) > 0 then corr(x, y) end as pearson_r, case when stddev_pop(rx) > 0 then corr(rx, ry) end as spearman_r from ranked group by 1, 2 having count(*) >= 30),
tested as ({p_sql(p_sql('select * from found', 'pearson_r', 'pearson_p'), 'spearman_r', 'spearman_p')})"""
RS = ["pearson_r", "pearson_p", "spearman_r", "spearman_p"]
QUERIES["sky_lead_lag"] = lambda spark, sf_dir: rounded(sky_lead_lag(spark, sf_dir), ["series_id", "feature", "lag", "n"], RS)
ORACLES["sky_lead_lag"] = f"{LAGGED_SQL} select 'all' as series_id, feature, lag::int as lag, n, {', '.join(f'round({c}, 6) as {c}' for c in RS)} from tested"
QUERIES["sky_correlations"] = sky_correlations
ORACLES["sky_correlations"] = f"""{LAGGED_SQL}, placed as (select *, count(*) over (order by pearson_p range between unbounded preceding and current row) as k, count(*) over () as m from tested where pearson_p is not null),
corrected as (select *, least(min(pearson_p * m / k) over (order by pearson_p desc range between unbounded preceding and current row), 1) as corrected from placed)
select row_number() over (order by round(abs(pearson_r), 9) desc, feature, lag)::int as rank, split_part(feature, '_', 1) as body, substr(feature, length(split_part(feature, '_', 1)) + 2) as factor, lag::int as lag, n, corrected <= 0.05 as is_significant,
  round(pearson_r, 6) as pearson_r, round(spearman_r, 6) as spearman_r, round(corrected, 6) as corrected from corrected qualify rank <= 20"""

WEEKLY = ["ret_1", "ret_5", "ret_20"]
add("mutual_information", lambda b: information.mutual_information(features.target(features.momentum(sources.resample(b, "week"))), WEEKLY), ["series_id", "feature", "n"], ["mutual_info", "mi_score"], f"""with weeks as (select series_id, date_trunc('week', ts) as ts, arg_max(close, ts) as close from bars group by 1, 2),
  long as (select series_id, feature, ts, value, target from (select series_id, ts, {', '.join(f'ln(close / lag(close, {k}) over ({W})) as ret_{k}' for k in (1, 5, 20))}, ln(lead(close, 5) over ({W}) / close) as target from weeks) unpivot (value for feature in ({', '.join(WEEKLY)})) where target is not null),
  scaled as (select series_id, feature, ts, value / stddev_pop(value) over s as x, target / stddev_pop(target) over s as y, count(*) over s as n from long window s as (partition by series_id, feature)),
  pairs as (select a.series_id, a.feature, a.ts, a.n, a.ts = b.ts as self, abs(a.x - b.x) as dx, abs(a.y - b.y) as dy from scaled a join scaled b on a.series_id = b.series_id and a.feature = b.feature),
  near as (select series_id, feature, ts, greatest(dx, dy) as r from pairs where not self qualify row_number() over (partition by series_id, feature, ts order by greatest(dx, dy)) = 3),
  counted as (select series_id, feature, ts, any_value(n) as n, count(*) filter (case when r = 0 then dx = 0 else dx < r end) as nx, count(*) filter (case when r = 0 then dy = 0 else dy < r end) as ny from pairs join near using (series_id, feature, ts) group by 1, 2, 3),
  harmonic as (select k + 1 as k, sum(1.0::double / greatest(k, 1) * (k > 0)::int) over (order by k) - 0.57721566490153286 as psi from range(0, 100000) as r(k)),
  info as (select series_id, feature, any_value(n) as n, greatest(0, any_value(hn.psi) + any_value(h3.psi) - avg(hx.psi) - avg(hy.psi)) as mutual_info from counted join harmonic hx on hx.k = nx join harmonic hy on hy.k = ny join harmonic hn on hn.k = n join harmonic h3 on h3.k = 3 group by 1, 2)
  select *, mutual_info / (max(mutual_info) over (partition by series_id) + 1e-10) as mi_score from info""")
add("warped_clusters", lambda b: warping.warped_clusters(models.hopping_windows(b)), ["series_id", "start_bar", "end_bar", "cluster"], ["similarity"], None)
add("empirical_modes", lambda b: modes.empirical_modes(cleaning.detrend_linear(b), "detrended"), [*KEYS, "mode", "is_rest"], ["value"], None)
add("mode_cycles", lambda b: modes.mode_cycles(cleaning.detrend_linear(b), "detrended"), ["series_id", "mode"], ["period", "frequency", "amplitude", "power", "confidence"], None)


def trained(bars: DataFrame) -> DataFrame:
    """Hopping windows with the embeddings of an autoencoder trained on all but the last of each series."""
    windows = models.hopping_windows(bars)
    return autoencoder.encoded(windows, autoencoder.train(windows))


def stability_of_detected(bars: DataFrame) -> DataFrame:
    flat = cleaning.detrend_linear(bars)
    return stability.detected_stability(flat, checkpointed(cycles.detect(flat, "detrended")), "detrended")


add("trained_embeddings", trained, ["series_id", "start_bar", "end_bar"], ["reconstruction_error", "anomaly_score"], None)
add("embedding_analogs", lambda b: autoencoder.embedding_analogs(trained(b)), ["series_id", "rank", "start_bar", "end_bar"], ["similarity"], None)
add("detected_cycle_stability", stability_of_detected, ["series_id", "place", "method", "cycle_rank", "n_windows", "half_life_bars", "is_significant", "is_stable", "n_stable"], ["period", "detection_rate", "power_mean", "power_std", "decay_per_year", "is_power", "oos_power", "oos_ratio", "percentile", "stability_score", "overall_score"], None)


def spectral_cycles(bars: DataFrame) -> DataFrame:
    """The strongest peaks of the periodogram, with ranks."""
    return spectral.score(spectral.peaks(spectral.periodogram(bars, "close"), "k", "power", 0.01).withColumn("confidence", F.lit(0.0)))


NAMES = ["ret_1", "ret_5", "ret_20", "cat_momentum_5_20", "cat_momentum_20_60", "cat_calendar_weekday"]
MIXED = lambda b: ranking.filled(features.target(features.calendar(features.momentum(b))).withColumnsRenamed({"momentum_5_20": NAMES[3], "momentum_20_60": NAMES[4], "weekday": NAMES[5]}), NAMES)
RETURN_SQL = {n: f"ln(close / lag(close, {n}) over ({W}))" for n in (1, 5, 20, 60)}
GAPS_SQL = f"select series_id, ts, ln(lead(close, 5) over ({W}) / close) as target, {RETURN_SQL[1]} as ret_1, {RETURN_SQL[5]} as ret_5, {RETURN_SQL[20]} as ret_20, {RETURN_SQL[5]} - {RETURN_SQL[20]} as cat_momentum_5_20, {RETURN_SQL[20]} - {RETURN_SQL[60]} as cat_momentum_20_60, (isodow(ts) - 1) / 6 as cat_calendar_weekday from bars"
FILLED_SQL = f"select series_id, ts, target, {', '.join(f'coalesce(last_value({n} ignore nulls) over ({W} rows between unbounded preceding and current row), 0) as {n}' for n in NAMES)} from ({GAPS_SQL})"
add("phase_features", lambda b: ranking.phase_features(b, spectral_cycles(b)), [*KEYS, "rank"], ["cycle_sin", "cycle_cos", "cycle_amplitude"], f"""with c as (select series_id, period, phase, 2 * sqrt(power) / n as amplitude, row_number() over (partition by series_id order by strength desc, period) as rank from (select *, round(least(0.6 * power / max(power) over (partition by series_id) + 0.09 + 0.1 * least(greatest(1 - abs(period - n / 4) / (n / 4), 0.1), 1), 1), 4) as strength from ({PEAKS_SQL})))
  select series_id, ts, rank, sin(2 * pi() * bar / period + phase) as cycle_sin, cos(2 * pi() * bar / period + phase) as cycle_cos, amplitude as cycle_amplitude from ({NUMBERED_SQL}) join c using (series_id) where rank <= 10""")
add("feature_matrix", MIXED, KEYS, [*NAMES, "target"], FILLED_SQL)
add("f_ranking", lambda b: ranking.f_ranking(MIXED(b), NAMES), ["series_id", "feature", "n"], ["f_score", "f_norm"], f"""select *, f_score / (max(f_score) over (partition by series_id) + 1e-10) as f_norm from (select series_id, feature, count(*) as n, coalesce(corr(value, target) ** 2 / (1 - corr(value, target) ** 2) * (count(*) - 2), 0) as f_score
  from (unpivot ({FILLED_SQL}) on {', '.join(NAMES)} into name feature value value) where target is not null group by 1, 2)""")
add("feature_ranking", lambda b: ranking.ranked(MIXED(b), NAMES), ["series_id", "place", "feature", "category"], ["rf_importance", "mi_score", "f_norm", "composite"], None)
add("category_importance", lambda b: ranking.category_importance(ranking.ranked(MIXED(b), NAMES)), ["series_id", "place", "category", "n_features"], ["importance"], None)
