"""Registered queries over bars built from orders, lineitem and events, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periodica.operators import cleaning, cycles, features, joins, models, patterns, relations, spectral, stability
from periodica.sources import bars as sources

DIGITS = 6
KEYS = ["series_id", "ts"]
BARS_SQL = """select o_orderpriority as series_id, date_trunc('day', o_orderdate)::timestamp as ts, arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) as high,
  min(o_totalprice) as low, arg_max(o_totalprice, o_orderkey) as close, count(o_totalprice)::double as volume from orders group by 1, 2"""
W = "partition by series_id order by ts"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices, a series for each priority."""
    o = table(spark, sf_dir, "orders")
    return sources.from_ticks(o, o.o_orderpriority, o.o_orderdate, o.o_totalprice, o.o_orderkey)


def rounded(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *[F.round(v, DIGITS).alias(v) for v in values])


def sql(inner: str, keys: list[str], values: list[str], base: str = BARS_SQL) -> str:
    """keys and rounded values of inner, a query that may use bars."""
    return f"with bars as ({base}) select {', '.join(keys)}, {', '.join(f'round({v}, {DIGITS}) as {v}' for v in values)} from ({inner})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, build: Callable[[DataFrame], DataFrame], keys: list[str], values: list[str], inner: str | None) -> None:
    """Register an operator over daily order bars."""
    QUERIES[name] = lambda spark, sf_dir: rounded(build(order_bars(spark, sf_dir)), keys, values)
    if inner:
        ORACLES[name] = sql(inner, keys, values)


def rows(n: int) -> str:
    return f"over ({W} rows between {n - 1} preceding and current row)"


def roll(how: str, x: str, n: int, least: int | None = None) -> str:
    return f"case when count({x}) {rows(n)} >= {least or n} then {how}({x}) {rows(n)} end"


def back(n: int, x: str = "close") -> str:
    return f"lag({x}, {n}) over ({W})"


PRICES = ["open", "high", "low", "close", "volume"]
RETURNS_SQL = f"select *, close / {back(1)} - 1 as simple_return, ln(close / {back(1)}) as log_return from bars"
NUMBERED_SQL = f"select *, row_number() over ({W}) - 1 as bar from bars"

add("daily_bars", lambda b: b, KEYS, PRICES, "select * from bars")
add("monthly_bars", lambda b: sources.resample(b, "month"), KEYS, PRICES, "select series_id, date_trunc('month', ts)::timestamp as ts, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, sum(volume) as volume from bars group by 1, 2")
add("weekly_bars", lambda b: sources.resample(b, "week"), KEYS, PRICES, "select series_id, date_trunc('week', ts)::timestamp as ts, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, sum(volume) as volume from bars group by 1, 2")
add("normalize_bars", lambda b: sources.normalize(b.select("series_id", F.col("ts").alias("Date"), F.col("close").alias("LTP"), F.col("high").alias("H"))), KEYS, PRICES, "select series_id, ts, close as open, high, close as low, close, 0.0 as volume from bars where close > 0")
add("bar_preview", lambda b: sources.preview(b, 10), ["series_id", "ts", "n", "total_bars", "first_ts", "last_ts"], ["close"], f"select *, row_number() over ({W}) as n, count(*) over (partition by series_id) as total_bars, min(ts) over (partition by series_id) as first_ts, max(ts) over (partition by series_id) as last_ts from bars qualify n <= 10")
add("returns", cleaning.returns, KEYS, ["simple_return", "log_return"], RETURNS_SQL)
add("winsorize", lambda b: cleaning.winsorize(b, share=0.01), KEYS, ["winsorized"], """select series_id, ts, least(greatest(close, low_cut), high_cut) as winsorized from (select *, max(case when p = cut then close end) over s as low_cut, max(case when p = n - cut - 1 then close end) over s as high_cut
  from (select *, row_number() over (partition by series_id order by close) - 1 as p, count(*) over (partition by series_id) as n, floor(0.01 * count(*) over (partition by series_id)) as cut from bars) window s as (partition by series_id))""")
add("iqr_clip", lambda b: cleaning.iqr_clip(b, width=0.5), KEYS, ["clipped"], """select series_id, ts, least(greatest(close, q1 - 0.5 * (q3 - q1)), q3 + 0.5 * (q3 - q1)) as clipped from bars join
  (select series_id, quantile_cont(close, 0.25) as q1, quantile_cont(close, 0.75) as q3 from bars group by 1) using (series_id)""")
add("detrend_linear", cleaning.detrend_linear, KEYS, ["detrended"], f"select series_id, ts, close - intercept - slope * bar as detrended from ({NUMBERED_SQL}) join (select series_id, regr_slope(close, bar) as slope, regr_intercept(close, bar) as intercept from ({NUMBERED_SQL}) group by 1) using (series_id)")
add("detrend_rolling", cleaning.detrend_rolling, KEYS, ["detrended"], f"select series_id, ts, coalesce(case when count(close) over r >= 63 then close - avg(close) over r end, 0) as detrended from bars window r as ({W} rows between 126 preceding and 125 following)")
add("detrend_quadratic", cleaning.detrend_quadratic, KEYS, ["detrended"], f"""select series_id, ts, close - avg(close) over s - t * sum(close * t) over s / sum(t * t) over s - q * sum(close * q) over s / sum(q * q) over s as detrended
  from (select *, t * t - avg(t * t) over (partition by series_id) as q from (select *, 2.0 * bar / max(bar) over (partition by series_id) - 1 as t from ({NUMBERED_SQL}))) window s as (partition by series_id)""")
add("detrend_hp", cleaning.detrend_hp, KEYS, ["detrended"], None)
for how, expression in (("zscore", "(close - avg(close) over s) / stddev_pop(close) over s"), ("minmax", "2 * (close - min(close) over s) / (max(close) over s - min(close) over s) - 1"), ("robust", "(close - quantile_cont(close, 0.5) over s) / (quantile_cont(close, 0.75) over s - quantile_cont(close, 0.25) over s)")):
    add(f"normalize_{how}", lambda b, how=how: cleaning.normalize(b, "close", how), KEYS, ["normalized"], f"select series_id, ts, {expression} as normalized from bars window s as (partition by series_id)")
VOLATILITY_SQL = f"select *, first_value(v ignore nulls) over ({W} rows between current row and unbounded following) as volatility from (select *, {roll('stddev_samp', 'log_return', 20, 10)} * sqrt(252) as v from ({RETURNS_SQL}))"
add("volatility", lambda b: cleaning.volatility(cleaning.returns(b)), KEYS, ["volatility"], VOLATILITY_SQL)
add("vol_adjusted", lambda b: cleaning.adjust(cleaning.volatility(cleaning.returns(b))), KEYS, ["vol_adjusted"], f"select series_id, ts, coalesce(log_return * least(0.16 / sqrt(252) / greatest(volatility / sqrt(252), 1e-8), 3), 0) as vol_adjusted from ({VOLATILITY_SQL})")
add("preprocess", cleaning.preprocess, KEYS, ["close", "log_return", "detrended", "normalized", "volatility", "vol_adjusted"], None)
add("series_summary", cleaning.summary, ["series_id", "n_bars", "first_ts", "last_ts"], ["min_close", "max_close", "mean_close", "total_return", "annual_volatility", "annual_return", "max_drawdown", "sharpe", "skewness", "kurtosis"], f"""select *, annual_return / (annual_volatility + 1e-10) as sharpe from (select series_id, count(*) as n_bars, min(ts) as first_ts, max(ts) as last_ts, min(close) as min_close, max(close) as max_close, avg(close) as mean_close,
  arg_max(close, ts) / arg_min(close, ts) - 1 as total_return, stddev_samp(log_return) * sqrt(252) as annual_volatility, avg(log_return) * 252 as annual_return, min(fall) as max_drawdown, skewness(log_return) as skewness, kurtosis(log_return) as kurtosis from (select *, (close - max(close) over ({W})) / max(close) over ({W}) as fall from ({RETURNS_SQL})) group by 1)""")

CALENDAR = ["weekday", "monthday", "month", "quarter", "week", "yearday", "weekday_sin", "weekday_cos", "month_sin", "week_cos", "yearday_sin"]
add("calendar_features", features.calendar, [*KEYS, "is_month_end", "is_quarter_end"], CALENDAR, """select series_id, ts, (ts::date = last_day(ts))::int as is_month_end, (ts::date = last_day(ts) and month(ts) % 3 = 0)::int as is_quarter_end, (isodow(ts) - 1) / 6 as weekday, day(ts) / 31 as monthday, month(ts) / 12 as month, quarter(ts) / 4 as quarter,
  weekofyear(ts) / 52 as week, dayofyear(ts) / 365 as yearday, sin(2 * pi() * (isodow(ts) - 1) / 7) as weekday_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) as weekday_cos, sin(2 * pi() * month(ts) / 12) as month_sin, cos(2 * pi() * weekofyear(ts) / 52) as week_cos, sin(2 * pi() * dayofyear(ts) / 252) as yearday_sin from bars""")
MOMENTUM = [*[f"ret_{n}" for n in features.HORIZONS], *[f"sign_{n}" for n in features.HORIZONS], "momentum_5_20", "momentum_20_60"]
add("momentum_features", features.momentum, KEYS, MOMENTUM, f"select *, {', '.join(f'sign(ret_{n})::double as sign_{n}' for n in features.HORIZONS)}, ret_5 - ret_20 as momentum_5_20, ret_20 - ret_60 as momentum_20_60 from (select series_id, ts, {', '.join(f'ln(close / {back(n)}) as ret_{n}' for n in features.HORIZONS)} from bars)")
ROLLING = [*[f"z_{n}" for n in (20, 60, 120)], *[f"vol_{n}" for n in (5, 10, 20, 40, 60, 120)], "vol_of_vol", "vol_ratio_5_20", "vol_ratio_20_60"]
add("rolling_features", features.rolling_moments, KEYS, ROLLING, f"""select *, {roll('stddev_samp', 'vol_20', 20)} as vol_of_vol, vol_5 / (vol_20 + 1e-10) as vol_ratio_5_20, vol_20 / (vol_60 + 1e-10) as vol_ratio_20_60 from (select series_id, ts,
  {', '.join(f'(close - ({roll("avg", "close", n)})) / (({roll("stddev_samp", "close", n)}) + 1e-10) as z_{n}' for n in (20, 60, 120))}, {', '.join(f'{roll("stddev_samp", "log_return", n)} as vol_{n}' for n in (5, 10, 20, 40, 60, 120))} from ({RETURNS_SQL}))""")
SHAPE = ["skew_20", "kurt_20", "skew_60", "kurt_60"]
add("rolling_shape", features.rolling_moments, KEYS, SHAPE, f"select series_id, ts, {', '.join(f'{roll(how, "log_return", n)} as {name}_{n}' for n in (20, 60) for how, name in (('skewness', 'skew'), ('kurtosis', 'kurt')))} from ({RETURNS_SQL})")
add("rsi", features.rsi, KEYS, ["rsi_7", "rsi_14", "rsi_21"], f"""select series_id, ts, {', '.join(f'case when {back(n)} is not null then 100 - 100 / (1 + ({roll("avg", "gain", n)}) / (({roll("avg", "loss", n)}) + 1e-10)) end as rsi_{n}' for n in (7, 14, 21))}
  from (select *, greatest(close - {back(1)}, 0) as gain, greatest({back(1)} - close, 0) as loss from bars)""")
BANDS = [f"{x}_{n}" for n in (20, 50) for x in ("upper", "lower", "percent_b", "bandwidth")]
add("bollinger", features.bollinger, KEYS, BANDS, "select series_id, ts, " + ", ".join(f"m{n} + w{n} as upper_{n}, m{n} - w{n} as lower_{n}, (close - m{n} + w{n}) / (2 * w{n} + 1e-10) as percent_b_{n}, 2 * w{n} / (m{n} + 1e-10) as bandwidth_{n}" for n in (20, 50)) + f" from (select *, {', '.join(f'{roll("avg", "close", n)} as m{n}, 2 * ({roll("stddev_samp", "close", n)}) as w{n}' for n in (20, 50))} from bars)")
add("true_range", features.true_range, KEYS, ["atr_14", "atr_share_14", "atr_20", "atr_share_20"], f"select *, atr_14 / close as atr_share_14, atr_20 / close as atr_share_20 from (select *, {', '.join(f'{roll("avg", "tr", n)} as atr_{n}' for n in (14, 20))} from (select *, greatest(high - low, abs(high - {back(1)}), abs(low - {back(1)})) as tr from bars))")
add("volume_and_range", features.volume_and_range, KEYS, ["volume_ratio", "volume_z", "range_place_20", "range_place_52"], f"select series_id, ts, volume / (({roll('avg', 'volume', 20)}) + 1e-10) as volume_ratio, (volume - ({roll('avg', 'volume', 20)})) / (({roll('stddev_samp', 'volume', 20)}) + 1e-10) as volume_z, " + ", ".join(f"(close - ({roll('min', 'low', n)})) / (({roll('max', 'high', n)}) - ({roll('min', 'low', n)}) + 1e-10) as range_place_{n}" for n in (20, 52)) + " from bars")
SPANS = (9, 12, 21, 26, 50, 55, 200)
NEXT_EMAS = ", ".join(f"n.close * {2 / (k + 1)!r} + e.e{k} * {1 - 2 / (k + 1)!r} as e{k}" for k in SPANS)
MACD_SQL = f"""with recursive n as materialized ({NUMBERED_SQL}), e as (select series_id, ts, bar, close, {', '.join(f'close as e{k}' for k in SPANS)}, 0.0::double as macd_signal from n where bar = 0
  union all select series_id, ts, bar, close, {', '.join(f'e{k}' for k in SPANS)}, (e12 - e26) * 0.2 + before * 0.8 from (select n.series_id, n.ts, n.bar, n.close, {NEXT_EMAS}, e.macd_signal as before from e join n on n.series_id = e.series_id and n.bar = e.bar + 1))
  select series_id, ts, e12 - e26 as macd, macd_signal, e12 - e26 - macd_signal as macd_histogram, (e9 - e21) / close as ema_spread_9_21, (e21 - e55) / close as ema_spread_21_55, (e50 - e200) / close as ema_spread_50_200 from e"""
add("macd", features.macd, KEYS, ["macd", "macd_signal", "macd_histogram", "ema_spread_9_21", "ema_spread_21_55", "ema_spread_50_200"], MACD_SQL)
LAGS = (1, 2, 3, 5, 10, 20)
add("rolling_autocorrelation", features.rolling_autocorrelation, KEYS, [f"autocorrelation_{n}" for n in LAGS], f"select series_id, ts, {', '.join(f'case when count(log_return) {rows(60)} >= 60 then corr(log_return, l{n}) {rows(60 - n)} end as autocorrelation_{n}' for n in LAGS)} from (select *, {', '.join(f'{back(n, "log_return")} as l{n}' for n in LAGS)} from ({RETURNS_SQL}))")
add("forward_target", features.target, KEYS, ["target"], f"select series_id, ts, ln(lead(close, 5) over ({W}) / close) as target from bars")
add("f_scores", lambda b: features.f_scores(features.target(features.momentum(b)), ["ret_5", "ret_20", "ret_60"]), ["series_id", "feature", "n"], ["f_score"], f"""select series_id, feature, count(*) as n, coalesce(corr(value, target) ** 2 / (1 - corr(value, target) ** 2) * (count(*) - 2), 0) as f_score from (unpivot (select series_id, ln(lead(close, 5) over ({W}) / close) as target,
  {', '.join(f'ln(close / {back(n)}) as ret_{n}' for n in (5, 20, 60))} from bars) on ret_5, ret_20, ret_60 into name feature value value) where target is not null group by 1, 2""")
SPECTRUM_SQL = f"""select series_id, k, n, k / n as frequency, n / k as period, atan2(im, re) as phase, (re * re + im * im) / max(re * re + im * im) over (partition by series_id) as power from (select series_id, n, k, sum(x * cos(2 * pi() * ((k * bar) % n) / n)) as re, -sum(x * sin(2 * pi() * ((k * bar) % n) / n)) as im
  from (select series_id, bar, n, close * (0.5 - 0.5 * cos(2 * pi() * bar / (n - 1))) as x, unnest(range((floor(n / 200.0) + 1)::bigint, ceil(n / 5.0)::bigint)) as k from (select *, count(*) over (partition by series_id) as n from ({NUMBERED_SQL}))) group by 1, 2, 3)"""
add("periodogram", lambda b: spectral.periodogram(b, "close"), ["series_id", "k", "n"], ["frequency", "period", "power"], SPECTRUM_SQL)
PEAKS_SQL = f"select * from (select *, lag(power) over p as a, lead(power) over p as b from ({SPECTRUM_SQL}) window p as (partition by series_id order by k)) where power > a and power > b and power >= 0.01"
add("spectral_peaks", lambda b: spectral.peaks(spectral.periodogram(b, "close"), "k", "power", 0.01), ["series_id", "k"], ["period", "power"], PEAKS_SQL)
add("scored_cycles", lambda b: spectral.score(spectral.peaks(spectral.periodogram(b, "close"), "k", "power", 0.01).withColumn("confidence", F.lit(0.0))), ["series_id", "rank"], ["period", "strength"], f"""select series_id, period, strength, row_number() over (partition by series_id order by strength desc, period) as rank from (select series_id, period,
  round(least(0.6 * power / max(power) over (partition by series_id) + 0.09 + 0.1 * least(greatest(1 - abs(period - n / 4) / (n / 4), 0.1), 1), 1), 4) as strength from ({PEAKS_SQL})) qualify rank <= 20""")
add("turning_points", lambda b: spectral.turning_points(spectral.peaks(spectral.periodogram(b, "close"), "k", "power", 0.01)), ["series_id", "k", "next_turning_point_bars", "turning_point_type"], ["period"], f"""select series_id, k, period, least(peak, trough) as next_turning_point_bars, case when peak <= trough then 'peak' else 'trough' end as turning_point_type from (select *, floor(((-phase) % tau + tau) % tau / tau * period)::bigint as peak, floor(((pi() - phase) % tau + tau) % tau / tau * period)::bigint as trough
  from (select *, 2 * pi() as tau from ({PEAKS_SQL})))""")
add("autocorrelation", lambda b: spectral.autocorrelation(b, "close", 40), ["series_id", "lag"], ["acf", "bound"], f"""with c as (select series_id, bar, count(*) over s as n, close - avg(close) over s as x from ({NUMBERED_SQL}) window s as (partition by series_id)), z as (select series_id, sum(x * x) as v from c group by 1)
  select a.series_id, b.bar - a.bar as lag, sum(a.x * b.x) / any_value(v) as acf, 1.96 / sqrt(any_value(a.n)) as bound from c a join c b on a.series_id = b.series_id and b.bar between a.bar + 1 and a.bar + 40 join z on z.series_id = a.series_id group by 1, 2""")
add("hurst", lambda b: cycles.hurst(b, "close"), ["series_id"], ["hurst"], f"""select series_id, least(greatest(regr_slope(ln(rs), ln(lag)), 0), 1) as hurst from (select series_id, lag, avg(r / s) as rs from (select series_id, lag, chunk, max(walk) - min(walk) as r, stddev_samp(x) as s from
  (select *, sum(x - m) over (partition by series_id, lag, chunk order by bar) as walk from (select series_id, bar, close as x, lag, bar // lag as chunk, avg(close) over (partition by series_id, lag, bar // lag) as m from (select *, unnest(range(10, least(n // 4, 200))) as lag from (select *, count(*) over (partition by series_id) as n from ({NUMBERED_SQL}))) where (bar // lag + 1) * lag < n)) group by 1, 2, 3) where s > 0 group by 1, 2) group by 1""")
EXTREMA_SQL = f"""select a.series_id, a.bar, a.ts, any_value(a.close) as close, case when count(*) filter (b.close >= a.close) = 0 then 'max' else 'min' end as kind from (select *, count(*) over (partition by series_id) as n from ({NUMBERED_SQL})) a
  join ({NUMBERED_SQL}) b on a.series_id = b.series_id and b.bar <> a.bar and b.bar between a.bar - greatest(3, n // 100) and a.bar + greatest(3, n // 100) where a.bar > 0 and a.bar < n - 1 group by 1, 2, 3 having count(*) filter (b.close >= a.close) = 0 or count(*) filter (b.close <= a.close) = 0"""
add("local_extrema", patterns.extrema, ["series_id", "bar", "ts", "kind"], ["close"], EXTREMA_SQL)
STEPS_SQL = f"select * from (select series_id, bar, (bar - lag(bar) over o) || ':' || kind as step from ({EXTREMA_SQL}) window o as (partition by series_id order by bar)) where step is not null"
add("turning_sequences", lambda b: patterns.turning_sequences(patterns.extrema(b), least=2), ["series_id", "length", "rank", "pattern", "occurrences", "first_bar"], [], f"""select *, row_number() over (partition by series_id, length order by occurrences desc, first_bar, pattern) as rank from (select series_id, length, pattern, count(*) as occurrences, min(bar) as first_bar
  from ({' union all '.join(f"select series_id, bar, {k} as length, array_to_string(list(step) over w, '>') as pattern from ({STEPS_SQL}) window w as (partition by series_id order by bar rows between current row and {k - 1} following) qualify count(*) over w = {k}" for k in (2, 3, 4))}) group by 1, 2, 3 having count(*) >= 2) qualify rank <= 3""")
OCCURRENCES = ["series_id", "pattern_id", "occurrence_count", "rank"]
add("shape_patterns", lambda b: patterns.pattern_statistics(patterns.shape_occurrences(b, widths=(20, 60))), OCCURRENCES, ["mean_duration", "similarity_threshold", "mean_forward_return", "std_forward_return", "hit_rate", "sharpe_like"], None)
add("motifs", patterns.motifs, ["series_id", "rank", "start_a", "start_b", "width"], ["distance", "similarity"], f"""with recursive moved as (select series_id, bar, list(close) over w as l, avg(close) over w as m, stddev_pop(close) over w as s, count(*) over w as c, count(*) over (partition by series_id) as total from ({NUMBERED_SQL}) window w as ({W} rows between current row and 9 following)),
  shapes as (select series_id, bar as i, list_transform(l, lambda x: (x - m) / s)::double[10] as v from moved where c = 10 and total >= 40),
  least as (select series_id, i, min(d) as d, arg_min(j, d) as j from (select a.series_id, a.i, b.i as j, sqrt(greatest(0, 20 - 2 * array_inner_product(a.v, b.v))) as d from shapes a join shapes b on a.series_id = b.series_id and abs(a.i - b.i) > 3) group by 1, 2),
  tried as (select *, row_number() over (partition by series_id order by round(d, 9), i) as place from least qualify place <= 10),
  steps as (select distinct series_id, 0::bigint as place, 0::bigint as rank, []::bigint[] as held, false as takes, 0::bigint as i, 0::bigint as j, 0::double as d from tried
    union all select series_id, place, rank + fits::int, case when fits then list_concat(held, [i, j]) else held end, fits, i, j, d from (select t.series_id, t.place, s.rank, s.held, t.i::bigint as i, t.j::bigint as j, t.d, abs(t.i - t.j) >= 10 and len(list_filter(s.held, lambda t0: (t.i >= t0 - 5 and t.i < t0 + 5) or (t.j >= t0 - 5 and t.j < t0 + 5))) = 0 as fits from steps s join tried t on t.series_id = s.series_id and t.place = s.place + 1))
  select series_id, rank, i as start_a, j as start_b, 10 as width, d as distance, 1 / (1 + d) as similarity from steps where takes and rank <= 5""")
add("regimes", lambda b: patterns.regimes(b), [*KEYS, "bar", "state"], ["log_return"], None)
add("volatility_runs", patterns.volatility_runs, ["series_id", "state", "start_bar", "end_bar"], ["duration"], f"""select series_id, state, min(bar) as start_bar, max(bar) as end_bar, max(bar) - min(bar) as duration from (select *, bar - row_number() over (partition by series_id, state order by bar) as island from
  (select *, case when z > 1 then 'high' when z < -0.5 then 'low' end as state from (select *, (v - avg(v) over s) / (stddev_samp(v) over s + 1e-10) as z from (select *, row_number() over ({W}) - 1 as bar, {roll('stddev_samp', 'log_return', 20)} as v from ({RETURNS_SQL})) window s as (partition by series_id))) where state is not null) group by series_id, state, island""")
add("forward_returns", patterns.forward_returns, KEYS, ["forward_5", "forward_20"], f"select series_id, ts, {', '.join(f'case when count(log_return) over (w rows between 1 following and {h} following) = {h} then sum(log_return) over (w rows between 1 following and {h} following) end as forward_{h}' for h in (5, 20))} from ({RETURNS_SQL}) window w as ({W})")
add("regime_statistics", lambda b: patterns.regime_statistics(cleaning.returns(b).where("log_return is not null").withColumn("state", F.month("ts"))), ["series_id", "state", "bars", "label"], ["mean_return", "deviation", "share", "sharpe"], f"""select *, bars / sum(bars) over (partition by series_id) as share, mean_return / (deviation + 1e-10) as sharpe, case when mean_return > 0.001 and deviation < 0.01 then 'trending_up_low_vol' when mean_return > 0.001 then 'trending_up_high_vol' when mean_return < -0.001 and deviation < 0.01 then 'trending_down_low_vol' when mean_return < -0.001 then 'trending_down_high_vol' else 'sideways_consolidation' end as label
  from (select series_id, month(ts) as state, count(*) as bars, avg(log_return) as mean_return, stddev_pop(log_return) as deviation from ({RETURNS_SQL}) where log_return is not null group by 1, 2)""")
add("analogs", relations.analogs, ["series_id", "rank", "start_bar", "end_bar"], ["similarity"], None)
VALUES = lambda b: b.select("series_id", "ts", F.col("close").alias("value"))
add("lag_correlation", lambda b: relations.lag_correlation(VALUES(b), VALUES(b)).where("series_id < other_id"), ["series_id", "other_id", "lag", "n"], ["r"], """with p as (select a.series_id, b.series_id as other_id, a.close as value, b.close as other, row_number() over (partition by a.series_id, b.series_id order by a.ts) as bar from bars a join bars b on a.ts = b.ts and a.series_id < b.series_id)
  select a.series_id, a.other_id, lag, count(*) as n, corr(a.value, b.other) as r from p a join (select *, unnest(range(-20, 21)) as lag from p) b on a.series_id = b.series_id and a.other_id = b.other_id and a.bar = b.bar + lag group by 1, 2, 3 having count(*) >= 30""")
HORIZONS = (5, 10, 20, 60)
add("historical_analogs", relations.historical_analogs, ["series_id", "rank", "start_bar", "end_bar", "start_ts", "end_ts", "direction"], ["similarity", "distance", *[f"forward_{h}" for h in HORIZONS]], None)
add("analog_projection", lambda b: relations.analog_projection(relations.historical_analogs(b)), ["series_id", "n_analogs"], [*[f"projected_{h}" for h in HORIZONS], "confidence"], None)
add("false_discovery", lambda b: relations.false_discovery(b.select("series_id", "ts", (F.floor(F.pmod(F.col("close"), F.lit(100.0)) * 10) / 1000).alias("p")), by=("series_id",), level=0.2), [*KEYS, "is_significant"], ["p", "corrected"], f"""select series_id, ts, p, corrected, corrected <= 0.2 as is_significant from (select series_id, ts, p, least(min(p * m / k) over (partition by series_id order by p desc range between unbounded preceding and current row), 1) as corrected
  from (select *, count(*) over (partition by series_id order by p range between unbounded preceding and current row) as k, count(*) over (partition by series_id) as m from (select series_id, ts, floor((close % 100) * 10) / 1000 as p from bars)))""")
add("welch", lambda b: spectral.welch(b, "close"), ["series_id", "k", "length"], ["period", "power"], f"""with z as (select series_id, bar, close as x, n, least(256, n // 2) as length from (select *, count(*) over (partition by series_id) as n from ({NUMBERED_SQL}))),
  g as (select *, bar - part * (length - length // 2) as place from (select *, unnest(range((n - length) // (length - length // 2) + 1)) as part from z) where bar between part * (length - length // 2) and part * (length - length // 2) + length - 1),
  w as (select series_id, length, part, place, (x - avg(x) over (partition by series_id, part)) * (0.5 - 0.5 * cos(2 * pi() * place / length)) as v from g),
  p as (select series_id, length, k, avg(re * re + im * im) * case when 2 * k = length then 1 else 2 end as p from (select series_id, length, part, k, sum(v * cos(2 * pi() * ((k * place) % length) / length)) as re, sum(v * sin(2 * pi() * ((k * place) % length) / length)) as im from (select *, unnest(range(1, length // 2 + 1)) as k from w) group by 1, 2, 3, 4) group by 1, 2, 3)
  select series_id, k, length, length / k as period, p / max(p) over (partition by series_id) as power from p""")
add("lomb_scargle", lambda b: spectral.lomb_scargle(b, "close"), ["series_id", "k"], ["period", "power"], f"""select series_id, j as k, 1 / (0.005 + j * 0.195 / 499) as period, (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * (cc * ss - cs * cs)) as power from (select series_id, j, covar_pop(x, x) as yy, covar_pop(x, cos(a)) as yc, covar_pop(x, sin(a)) as ys, covar_pop(cos(a), cos(a)) as cc, covar_pop(sin(a), sin(a)) as ss, covar_pop(cos(a), sin(a)) as cs
  from (select series_id, close as x, j, 2 * pi() * (0.005 + j * 0.195 / 499) * bar as a from (select *, unnest(range(500)) as j from ({NUMBERED_SQL}))) group by 1, 2)""")
add("hopping_windows", lambda b: models.hopping_windows(b).select("series_id", "start_bar", F.posexplode("window").alias("place", "z")), ["series_id", "start_bar", "place"], ["z"], f"""select series_id, start_bar, place, (close - m) / s as z from (select *, bar - start_bar as place, avg(close) over (partition by series_id, start_bar) as m, stddev_pop(close) over (partition by series_id, start_bar) as s
  from (select b.*, start_bar from (select *, count(*) over (partition by series_id) as n from ({NUMBERED_SQL})) b join (select unnest(range(0, 100000, 5)) as start_bar) on bar between start_bar and start_bar + 19 and start_bar < n - 20)) where s > 1e-8""")
add("variance_thirds", lambda b: stability.variance_thirds(cleaning.returns(b)), ["series_id"], ["v1", "v2", "v3", "ratio_12", "ratio_23", "variance_stability"], f"""select *, least(greatest(1 - 0.5 * abs(1 - ratio_12), 0), 1) as variance_stability from (select *, round(v1 / (v2 + 1e-10), 4) as ratio_12, round(v2 / (v3 + 1e-10), 4) as ratio_23 from (select series_id, var_pop(log_return) filter (part < 0.25) as v1, var_pop(log_return) filter (part >= 0.25 and part < 0.75) as v2, var_pop(log_return) filter (part >= 0.75) as v3
  from (select series_id, log_return, (row_number() over ({W}) - 1) / count(*) over (partition by series_id) as part from ({RETURNS_SQL})) group by 1))""")
CYCLES = [5.0, 20.0, 60.0]


def fixed_cycles(b: DataFrame) -> DataFrame:
    return b.select("series_id").distinct().withColumn("period", F.explode(F.array(*map(F.lit, CYCLES))))


DETRENDED = lambda b: cleaning.detrend_linear(b)
FOUND = ["period", "frequency", "amplitude", "power", "phase", "confidence", "strength"]
add("detected_cycles", lambda b: cycles.detect(DETRENDED(b), "detrended"), ["series_id", "rank", "method", "next_turning_point_bars", "turning_point_type"], [*FOUND, "period_calendar"], None)
add("consensus_cycles", lambda b: cycles.consensus(spectral.score(cycles.candidates(DETRENDED(b), "detrended"), 1000)), ["series_id", "method", "n_found"], FOUND, None)
add("stationarity", stability.stationarity, ["series_id", "is_stationary_adf", "is_stationary_kpss"], ["adf_p", "kpss_p"], None)
add("cycle_stability", lambda b: stability.stability(DETRENDED(b), fixed_cycles(b), "detrended"), ["series_id", "n_windows", "half_life_bars", "is_significant", "is_stable"], ["period", "detection_rate", "power_mean", "oos_ratio", "percentile", "stability_score"], None)
add("histogram", lambda b: joins.histogram(b, "close", 20), ["series_id", "bin", "n"], ["low", "high"], """select series_id, bin, any_value(least_value + bin * step) as low, any_value(least_value + (bin + 1) * step) as high, count(*) as n from (select *, least(floor((close - least_value) / step), 19)::int as bin from (select *, (most_value - least_value) / 20 as step
  from (select *, min(close) over (partition by series_id) as least_value, max(close) over (partition by series_id) as most_value from bars))) group by 1, 2""")
add("outlier_counts", lambda b: joins.outlier_counts(b, "close", 0.5), ["series_id", "n", "outliers"], [], """select series_id, count(close) as n, count(*) filter (close < q1 - 0.5 * (q3 - q1) or close > q3 + 0.5 * (q3 - q1)) as outliers from bars join
  (select series_id, quantile_cont(close, 0.25) as q1, quantile_cont(close, 0.75) as q3 from bars group by 1) using (series_id) group by 1""")
add("as_of_monthly_close", lambda b: joins.as_of(b.select("series_id", "ts", "close"), sources.resample(b, "week").select("series_id", "ts", F.col("close").alias("week_close")), ["series_id"]), KEYS, ["close", "week_close"], "select a.series_id, a.ts, a.close, w.week_close from bars a asof left join (select series_id, date_trunc('week', ts)::timestamp as ts, arg_max(close, ts) as week_close from bars group by 1, 2) w on a.series_id = w.series_id and a.ts >= w.ts")
add("price_bands", lambda b: joins.within_intervals(b, b.sparkSession.createDataFrame([(i, 60000.0 * i, 60000.0 * i + 90000.0) for i in range(8)], "band int, low_price double, high_price double"), "close", "low_price", "high_price", 30000.0).groupBy("series_id", "band").agg(F.count("*").alias("n")), ["series_id", "band", "n"], [], "select series_id, band, count(*) as n from bars join (select i::int as band, 60000.0 * i as low_price, 60000.0 * i + 90000.0 as high_price from range(8) t(i)) on close between low_price and high_price group by 1, 2")
POWERS_SQL = """powers as (select series_id, part, n, k, pow(sum(v * cos(2 * pi() * ((k * place) % n) / n)), 2) + pow(sum(v * sin(2 * pi() * ((k * place) % n) / n)), 2) as power
    from (select *, close * (0.5 - 0.5 * cos(2 * pi() * place / (n - 1))) as v, unnest(range(n // 2 + 1)) as k from parts where n >= 10) group by 1, 2, 3, 4),
  shares as (select series_id, part, n, period, coalesce(sum(power) filter (abs(k - ceil(n / period - 0.5)) <= 1), 0) / (sum(power) + 1e-10) as power from powers, (select unnest([5.0, 20.0, 60.0])::double as period) group by 1, 2, 3, 4)"""
COUNTED_SQL = f"select series_id, bar, close, count(*) over (partition by series_id) as total from ({NUMBERED_SQL})"
add("walk_forward", lambda b: stability.walk_forward(b, fixed_cycles(b)), ["series_id", "n_windows", "half_life_bars"], ["period", "detection_rate", "period_cv", "power_mean", "power_std", "decay_per_year"], f"""with sized as (select *, greatest(n // 4, 10) as step from (select *, greatest(total // 5, 60) as n from ({COUNTED_SQL}))),
  begins as (select series_id, n, step, unnest(range(0, greatest(total - n, 0), step)) as begin from (select distinct series_id, total, n, step from sized)),
  parts as (select z.series_id, begin // z.step as part, z.n, bar - begin as place, close from sized z join begins b on z.series_id = b.series_id and bar between begin and begin + z.n - 1), {POWERS_SQL},
  judged as (select *, power > 0.01 and n >= greatest(20, 3 * period) as hit from shares),
  trends as (select series_id, period, count(*) as tested, count(*) filter (hit) as hits, avg(power) filter (hit) as power_mean, stddev_pop(power) filter (hit) as power_std, regr_slope(power, part) as slope, regr_intercept(power, part) as intercept from judged group by 1, 2)
  select series_id, period, n_windows, coalesce(hits, 0) / n_windows as detection_rate, case when hits > 0 then 0 else 1 end as period_cv, coalesce(power_mean, 0) as power_mean, coalesce(power_std, 0) as power_std, case when tested >= 4 then -slope * 252 / step else 0 end as decay_per_year,
    case when tested >= 4 and slope < 0 and intercept > 0 then floor(intercept / (2 * -slope) * step)::bigint end as half_life_bars
  from (select distinct series_id, step, greatest((total - n) // step, 1) as n_windows from sized) cross join (select unnest([5.0, 20.0, 60.0])::double as period) left join trends using (series_id, period)""")
add("out_of_sample", lambda b: stability.out_of_sample(b, fixed_cycles(b)), ["series_id"], ["period", "is_power", "oos_power", "oos_ratio"], f"""with cut as (select *, floor(total * 0.7)::bigint as border from ({COUNTED_SQL})),
  parts as (select series_id, (bar >= border)::int as part, case when bar < border then border else total - border end as n, case when bar < border then bar else bar - border end as place, close from cut), {POWERS_SQL}
  select series_id, period, is_power, oos_power, least(greatest(oos_power / (is_power + 1e-10), 0), 2) as oos_ratio from (select series_id, period, max(power) filter (part = 0) as is_power, max(power) filter (part = 1) as oos_power from shares group by 1, 2)""")
add("shape_clusters", lambda b: models.shape_clusters(models.hopping_windows(b)), ["series_id", "start_bar", "end_bar", "cluster"], ["similarity"], None)
add("linear_embeddings", lambda b: models.linear_embeddings(models.hopping_windows(b)), ["series_id", "start_bar", "end_bar"], ["reconstruction_error", "anomaly_score"], None)
add("forest_importance", lambda b: models.forest_importance(features.target(features.momentum(b)), ["ret_1", "ret_5", "ret_20", "momentum_5_20"]), ["feature"], ["importance"], None)


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return rounded(sources.from_ticks(e, e.event_type, e.ts, e.value, e.event_id, "hour"), KEYS, PRICES)


def line_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return rounded(sources.from_ticks(t, F.concat("l_returnflag", "l_linestatus"), t.l_shipdate, t.l_extendedprice, F.struct("l_orderkey", "l_linenumber", "l_extendedprice")), KEYS, PRICES)


def nation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", sources.instrument_class(F.col("p_name")).alias("kind"))


QUERIES |= {"hourly_event_bars": event_bars, "daily_line_bars": line_bars, "instrument_classes": nation_kinds}
ORACLES |= {
    "hourly_event_bars": sql("select * from bars", KEYS, PRICES, "select event_type as series_id, date_trunc('hour', ts)::timestamp as ts, arg_min(value, event_id) as open, max(value) as high, min(value) as low, arg_max(value, event_id) as close, count(value)::double as volume from events group by 1, 2"),
    "daily_line_bars": sql("select * from bars", KEYS, PRICES, "select l_returnflag || l_linestatus as series_id, date_trunc('day', l_shipdate)::timestamp as ts, arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) as open, max(l_extendedprice) as high, min(l_extendedprice) as low, arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) as close, count(l_extendedprice)::double as volume from lineitem group by 1, 2"),
    "instrument_classes": "select p_partkey, case when regexp_matches(upper(p_name), 'BTC|ETH|USDT|BNB') then 'crypto' when regexp_matches(upper(p_name), 'USD|EUR|GBP|JPY|FOREX') then 'forex' when regexp_matches(upper(p_name), 'GOLD|SILVER|OIL|CRUDE|XAU|XAG') then 'commodity' when upper(p_name) in ('^NSEI', '^BSESN', '^NSEBANK', 'NIFTY', 'BANKNIFTY') then 'index' else 'stock' end as kind from part",
}
