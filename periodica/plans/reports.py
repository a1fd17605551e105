"""Registered queries of forward statistics of patterns, provider routes, requests, reports and aligned bars, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.functions.storage import checkpointed
from periodica.operators import cleaning, cycles, features, joins, patterns, ranking, relations, report, spectral, stability
from periodica.plans.queries import BARS_SQL, EXTREMA_SQL, KEYS, NUMBERED_SQL, ORACLES as CORE_SQL, PEAKS_SQL, RETURNS_SQL, W, order_bars, roll, rounded, sql, table
from periodica.plans.research import MIXED, NAMES, spectral_cycles
from periodica.sources import bars as sources
from periodica.sources import routing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, build: Callable[[DataFrame], DataFrame], keys: list[str], values: list[str], inner: str | None, base: str = BARS_SQL) -> None:
    """Register an operator over daily order bars; base is the SQL of the bars it makes of them. Sums with 0 leave no negative zeros."""
    QUERIES[name] = lambda spark, sf_dir: rounded(build(order_bars(spark, sf_dir)), keys, values).withColumns({v: F.col(v) + 0.0 for v in values})
    if inner:
        ORACLES[name] = sql(inner, keys, values, base)


AHEAD_SQL = f"select *, case when bar + 5 < n then sum(log_return) over ({W} rows between current row and 4 following) end as forward_5 from (select *, row_number() over ({W}) - 1 as bar, count(*) over (partition by series_id) as n from ({RETURNS_SQL}))"
STATISTICS = ["mean_duration", "similarity_threshold", "mean_forward_return", "std_forward_return", "hit_rate", "sharpe_like"]


def statistics_sql(occurrences: str) -> str:
    return f"""select *, row_number() over (partition by series_id order by sharpe_like * occurrence_count desc, pattern_id) as rank from (select *, mean_forward_return / std_forward_return as sharpe_like from (select series_id, pattern_id, count(*) as occurrence_count, avg(end_bar - start_bar) as mean_duration,
  1.0 as similarity_threshold, coalesce(avg(forward_5), 0) as mean_forward_return, coalesce(stddev_pop(forward_5), 0) + 1e-10 as std_forward_return, coalesce(avg((forward_5 > 0)::int), 0) as hit_rate from ({occurrences}) group by 1, 2)) qualify rank <= 20"""


VOLATILE_SQL = f"""select series_id, pattern_id, min(bar) as start_bar, max(bar) as end_bar, min(ts) as start_ts, max(ts) as end_ts, arg_max(coalesce(forward_5, 'nan'::double), bar) as ahead
  from (select *, bar - row_number() over (partition by series_id, pattern_id order by bar) as island from (select *, case when z > 1 then 'volcycle_high_vol' when z < -0.5 then 'volcycle_low_vol' end as pattern_id from (select *, (v - avg(v) over s) / (stddev_samp(v) over s + 1e-10) as z
  from (select *, first_value(raw ignore nulls) over ({W} rows between current row and unbounded following) as v from (select *, {roll('stddev_samp', 'log_return', 20)} as raw from ({AHEAD_SQL}))) window s as (partition by series_id))) where pattern_id is not null) group by series_id, pattern_id, island"""
VOLATILE_SQL = f"select *, case when not isnan(ahead) then ahead end as forward_5 from ({VOLATILE_SQL}) qualify count(*) over (partition by series_id, pattern_id) >= 3"
add("volatility_cycles", patterns.volatility_cycles, ["series_id", "pattern_id", "start_bar", "end_bar", "start_ts", "end_ts"], ["forward_5"], VOLATILE_SQL)
add("volatility_cycle_statistics", lambda b: patterns.pattern_statistics(patterns.volatility_cycles(b)), ["series_id", "pattern_id", "occurrence_count", "rank"], STATISTICS, statistics_sql(VOLATILE_SQL))
STEP_SQL = "(lead(bar, {k}) over o - lead(bar, {j}) over o) || ':' || lead(kind, {k}) over o"
TURNS_SQL = f"select * from (select *, count(*) over (partition by series_id) - 1 as steps, count(*) filter (kind = 'max') over (partition by series_id) as tops from ({EXTREMA_SQL})) where steps >= 4 and tops >= 3 and steps + 1 - tops >= 3"
RUNS_SQL = " union all ".join(
    f"""select * from (select *, count(*) over (partition by series_id, pattern_id) as c, min(start_bar) over (partition by series_id, pattern_id) as f from (select series_id, {n} as length, bar as start_bar, lead(bar, {n}) over o as end_bar, {" || '>' || ".join(STEP_SQL.format(k=k, j=k - 1) for k in range(1, n + 1))} as pattern_id
  from ({TURNS_SQL}) where steps >= {2 * n} window o as (partition by series_id order by bar)) where end_bar is not null) qualify dense_rank() over (partition by series_id order by c desc, f) <= 3 and c >= 3"""
    for n in (2, 3, 4)
)
TURNED_SQL = f"select r.series_id, r.pattern_id, r.length, r.start_bar, r.end_bar, a.forward_5 from ({RUNS_SQL}) r join ({AHEAD_SQL}) a on a.series_id = r.series_id and a.bar = r.end_bar"
WEEKS_SQL = f"select series_id, date_trunc('week', ts)::timestamp as ts, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, sum(volume) as volume from ({BARS_SQL}) group by 1, 2"
WEEKLY_TURNS = lambda b: patterns.turning_cycles(sources.resample(b, "week"))
add("turning_cycles", WEEKLY_TURNS, ["series_id", "pattern_id", "length", "start_bar", "end_bar"], ["forward_5"], TURNED_SQL, WEEKS_SQL)
add("turning_cycle_statistics", lambda b: patterns.pattern_statistics(WEEKLY_TURNS(b)), ["series_id", "pattern_id", "occurrence_count", "rank"], STATISTICS, statistics_sql(TURNED_SQL), WEEKS_SQL)

add("yearly_volatility", features.rolling_moments, KEYS, [f"vol_year_{n}" for n in (5, 10, 20, 40, 60, 120)], f"select series_id, ts, {', '.join(f'{roll("stddev_samp", "log_return", n)} * sqrt(252) as vol_year_{n}' for n in (5, 10, 20, 40, 60, 120))} from ({RETURNS_SQL})")
FENCES_SQL = "select series_id, quantile_cont({x}, 0.25) as q1, quantile_cont({x}, 0.75) as q3 from ({t}) group by 1"
CLIPPED_SQL = f"select series_id, ts, least(greatest(close, q1 - 3 * (q3 - q1)), q3 + 3 * (q3 - q1)) as close from bars join ({FENCES_SQL.format(x='close', t='select * from bars')}) using (series_id)"
CLIPPED_RETURNS_SQL = f"select *, ln(close / lag(close) over ({W})) as log_return from ({CLIPPED_SQL})"
add("preprocess_metadata", report.metadata, ["series_id", "n_bars", "start_ts", "end_ts", "missing_filled", "outliers_clipped"], ["min_close", "max_close", "annualized_vol"], f"""select series_id, count(*) as n_bars, min(ts) as start_ts, max(ts) as end_ts, 0::bigint as missing_filled, count(*) filter (clipped <> log_return) as outliers_clipped, min(close) as min_close, max(close) as max_close, avg(volatility) * sqrt(252) as annualized_vol
  from (select *, first_value(v ignore nulls) over ({W} rows between current row and unbounded following) as volatility from (select *, {roll('stddev_samp', 'clipped', 20, 10)} * sqrt(252) as v from (select *, case when log_return is not null then least(greatest(log_return, q1 - 3 * (q3 - q1)), q3 + 3 * (q3 - q1)) end as clipped
  from ({CLIPPED_RETURNS_SQL}) join ({FENCES_SQL.format(x='log_return', t=CLIPPED_RETURNS_SQL)}) using (series_id)))) group by 1""")

STRONG_SQL = f"""select *, row_number() over (partition by series_id order by strength desc, period) as rank from (select *, period as period_calendar, 2 * sqrt(power) / n as amplitude,
  round(least(0.6 * power / max(power) over (partition by series_id) + 0.09 + 0.1 * least(greatest(1 - abs(period - n / 4) / (n / 4), 0.1), 1), 1), 4) as strength from ({PEAKS_SQL})) qualify rank <= 20"""
STRONG = lambda b: spectral_cycles(b).withColumn("period_calendar", report.calendar_period(F.col("period"), "1d"))
FIELDS = ["period", "period_calendar", "frequency", "amplitude", "power", "phase", "strength"]
add("cycle_rows", lambda b: report.serialised(STRONG(b)), ["series_id", "rank"], FIELDS, f"select series_id, rank, {', '.join(f'round_even({c}, {report.DIGITS[c]}) as {c}' for c in FIELDS)} from ({STRONG_SQL})")
LABEL_SQL = "case when period_calendar >= 365 then printf('%.1fY', period_calendar / 365) when period_calendar >= 30 then floor(period_calendar / 30 + 0.5)::bigint || 'M' when period_calendar >= 7 then floor(period_calendar / 7 + 0.5)::bigint || 'W' else floor(period_calendar + 0.5)::bigint || 'D' end"
STRENGTH_SQL = "case when strength >= 0.7 then 'High' when strength >= 0.4 then 'Medium' else 'Low' end"
add("cycle_labels", lambda b: STRONG(b).withColumns({"strength_label": report.strength_label(F.col("strength")), "period_label": report.period_label(F.col("period_calendar"))}), ["series_id", "rank", "strength_label", "period_label"], ["strength"], f"select *, {STRENGTH_SQL} as strength_label, {LABEL_SQL} as period_label from ({STRONG_SQL})")
add("dominant_cycles", lambda b: report.dominant_by_bucket(STRONG(b)), ["series_id", "place", "bucket"], ["period", "strength"], f"select *, row_number() over (partition by series_id order by strength desc, period) as place from (select *, {LABEL_SQL} as bucket from ({STRONG_SQL}) qualify row_number() over (partition by series_id, bucket order by strength desc, period) = 1) qualify place <= 5")
add("hurst_labels", lambda b: cycles.hurst(b, "close").withColumn("label", report.hurst_label(F.col("hurst"))), ["series_id", "label"], ["hurst"], None)
ORACLES["hurst_labels"] = f"select *, case when hurst > 0.55 then 'Trending (persistent)' when hurst < 0.45 then 'Mean-reverting' else 'Random walk' end as label from ({CORE_SQL['hurst']})"


def cycle_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's section on the strongest cycles, of the periodogram."""
    return report.key_findings(spectral_cycles(order_bars(spark, sf_dir)).withColumn("method", F.lit("periodogram")))


def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report: detected cycles, those that last, the outlook of past analogs, and features by their composite score."""
    b = order_bars(spark, sf_dir)
    flat = cleaning.detrend_linear(b)
    found = checkpointed(cycles.detect(flat, "detrended"))
    lasting = stability.detected_stability(flat, found, "detrended")
    outlook = relations.analog_projection(relations.historical_analogs(b))
    return report.key_findings(found, lasting, outlook, ranking.ranked(MIXED(b), NAMES))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text read as a request; those in English count as of the free plan."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(report.requested_modules(F.col("text"), d.lang == "en"), ",").alias("modules"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: their names in capitals, with an ending by their size, and a broker by their price."""
    p = table(spark, sf_dir, "part")
    ending = F.when(p.p_size < 10, ".NS").when(p.p_size < 20, "/USDT").when(p.p_size < 30, ".BO").otherwise("")
    broker = F.when(p.p_retailprice >= 950, "dhan").when(p.p_retailprice >= 930, "other")
    symbol = F.concat(F.upper("p_name"), ending)
    return p.select("p_partkey", symbol.alias("symbol"), routing.suggested(symbol, broker).alias("provider"))


def provider_bars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Daily bars of every part from three providers (by the lines' return flags), and the providers wanted first."""
    t = table(spark, sf_dir, "lineitem")
    source = F.when(t.l_returnflag == "A", "zerodha").when(t.l_returnflag == "N", "stooq").otherwise("twelve_data")
    priced = sources.from_ticks(t, F.concat_ws("@", t.l_partkey, source), t.l_shipdate, t.l_extendedprice, F.struct("l_orderkey", "l_linenumber", "l_extendedprice"))
    parts = F.split("series_id", "@")
    bars = priced.withColumn("source", parts[1]).withColumn("series_id", parts[0])
    return bars, t.select(F.col("l_partkey").cast("string").alias("series_id"), F.lit("zerodha").alias("primary"))


def provider_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.routes(*provider_bars(spark, sf_dir), sessions=("twelve_data",)).withColumn("attempts", F.array_join("attempts", ","))


def routed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(routing.routed(*provider_bars(spark, sf_dir)), ["series_id", "ts", "source", "fell_back"], ["close"])


def merged_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(routing.same_time(provider_bars(spark, sf_dir)[0], ["stooq", "zerodha"]), ["series_id", "ts", "source"], ["close"])


def status_bars(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Daily bars of finished and of open orders."""
    o = table(spark, sf_dir, "orders")
    return [sources.from_ticks(o.where(o.o_orderstatus == s), o.o_orderpriority, o.o_orderdate, o.o_totalprice, o.o_orderkey) for s in ("F", "O")]


def on_bars(how: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str], values: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(how(*status_bars(spark, sf_dir)), keys, values)


QUERIES |= {
    "cycle_findings": cycle_findings, "summary_report": summary_report, "requested_modules": requests, "suggested_providers": symbols, "provider_routes": provider_routes, "routed_bars": routed_bars, "merged_bars": merged_bars,
    "aligned_bars": on_bars(lambda f, o: joins.aligned(f, o, ["close", "volume"], ("done", "open")), KEYS, ["close_done", "close_open", "volume_done", "volume_open"]),
    "present_bars": on_bars(joins.present, KEYS, ["close"]), "absent_bars": on_bars(joins.absent, KEYS, ["close"]),
    "set_sizes": on_bars(joins.set_sizes, ["series_id", "n_either", "n_both", "n_left", "n_right"], []),
}


def modules_sql() -> str:
    """requested_modules: for each module the first group that asks for it, in order."""
    asked = lambda words: "(" + " or ".join(f"contains(t, '{w}')" for w in words) + ")"
    places = [(m, 10 * g + i, asked(words)) for g, (words, modules) in enumerate(report.REQUESTS) for i, m in enumerate(modules)]
    rows = " union all ".join(f"select doc_id, lang, '{m}' as module, {place} as place from d where {test}" for m, place, test in places)
    return f"""with d as (select doc_id, lang, lower(text) as t from documents), asked as (select doc_id, lang, 'preprocessing' as module, -1 as place from d union all {rows}), firsts as (select doc_id, lang, module, min(place) as place from asked group by all)
  select doc_id, string_agg(module, ',' order by place) as modules from firsts where coalesce(lang, '') <> 'en' or module in ('preprocessing', 'cycle_detection') group by 1"""


PROVIDED_SQL = """select l_partkey::varchar as series_id, date_trunc('day', l_shipdate)::timestamp as ts, case l_returnflag when 'A' then 'zerodha' when 'N' then 'stooq' else 'twelve_data' end as source,
  arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) as close from lineitem group by 1, 2, 3"""


def routes_sql(sessions: bool) -> str:
    """The first of zerodha, yahoo, stooq, twelve_data and alpha_vantage with 10 bars; twelve_data only with a session."""
    return f"""select s.series_id, case when a >= 10 then 'zerodha' when o >= 10 then 'stooq' {"when t >= 10 then 'twelve_data'" if sessions else ''} end as provider, coalesce(a < 10, true) as fell_back, 'zerodha' || case when a >= 10 then '' when o >= 10 then ',yahoo,stooq' {"when t >= 10 then ',yahoo,stooq,twelve_data'" if sessions else ''} else ',yahoo,stooq,twelve_data,alpha_vantage' end as attempts
  from (select series_id, count(*) filter (source = 'zerodha') as a, count(*) filter (source = 'stooq') as o, count(*) filter (source = 'twelve_data') as t from ({PROVIDED_SQL}) group by 1) s"""


STATUS_SQL = {n: f"({BARS_SQL.replace('from orders', f"from orders where o_orderstatus = '{s}'")})" for n, s in (("f", "F"), ("o", "O"))}
SYMBOL_SQL = "upper(p_name) || case when p_size < 10 then '.NS' when p_size < 20 then '/USDT' when p_size < 30 then '.BO' else '' end"
FINDINGS_SQL = f"""select series_id, 'dominant_cycles' as section, rank as place, printf('Dominant cycle detected: %.0f bars (strength=%.2f, method=periodogram)', round_even(period, 0), strength) as finding from ({STRONG_SQL}) where rank <= 5"""
ORACLES |= {
    "cycle_findings": f"with bars as ({BARS_SQL}) {FINDINGS_SQL}",
    "requested_modules": modules_sql(),
    "suggested_providers": f"select p_partkey, symbol, case when contains(symbol, '/') then 'ccxt' when (symbol like '%.NS' or symbol like '%.BO') and p_retailprice >= 950 then 'dhan' else 'yahoo' end as provider from (select p_partkey, p_retailprice, {SYMBOL_SQL} as symbol from part)",
    "provider_routes": routes_sql(True),
    "routed_bars": f"select b.series_id, b.ts, b.source, r.fell_back, round(b.close, 6) as close from ({PROVIDED_SQL}) b join ({routes_sql(False)}) r on r.series_id = b.series_id and r.provider = b.source",
    "merged_bars": f"select series_id, ts, source, round(close, 6) as close from ({PROVIDED_SQL}) qualify row_number() over (partition by series_id, ts order by case source when 'stooq' then 1 when 'zerodha' then 2 else 3 end) = 1",
    "aligned_bars": f"select series_id, ts, round(f.close, 6) as close_done, round(o.close, 6) as close_open, f.volume as volume_done, o.volume as volume_open from {STATUS_SQL['f']} f full join {STATUS_SQL['o']} o using (series_id, ts)",
    "present_bars": f"select f.series_id, f.ts, round(f.close, 6) as close from {STATUS_SQL['f']} f semi join {STATUS_SQL['o']} o using (series_id, ts)",
    "absent_bars": f"select f.series_id, f.ts, round(f.close, 6) as close from {STATUS_SQL['f']} f anti join {STATUS_SQL['o']} o using (series_id, ts)",
    "set_sizes": f"select series_id, count(*) as n_either, count(*) filter (f and o) as n_both, count(*) filter (not o) as n_left, count(*) filter (not f) as n_right from (select series_id, ts, bool_or(side = 1) as f, bool_or(side = 2) as o from (select series_id, ts, 1 as side from {STATUS_SQL['f']} union all select series_id, ts, 2 from {STATUS_SQL['o']}) group by 1, 2) group by 1",
}
SHAPED_SQL = f"""select *, case when s < 1e-8 then list_transform(l, lambda x: 0.0) else list_transform(l, lambda x: (x - m) / s) end as z from (select series_id, bar, ts, count(*) over (partition by series_id) as n, list(close) over w as l, avg(close) over w as m, stddev_pop(close) over w as s, count(*) over w as c
  from ({NUMBERED_SQL}) window w as ({W} rows between current row and {{more}} following)) where c = {{more}} + 1"""
ORACLES["analogs"] = sql(f"""select series_id, start_bar, start_bar + 19 as end_bar, similarity, row_number() over (partition by series_id order by similarity desc, start_bar) as rank from (select a.series_id, a.bar as start_bar, list_dot_product(a.z, q.z) / 20 as similarity
  from ({SHAPED_SQL.format(more=19)}) a join ({SHAPED_SQL.format(more=19)}) q on a.series_id = q.series_id and q.bar = q.n - 20 and a.bar % 5 = 0 and a.bar + 40 <= a.n where a.s * sqrt(20) > 1e-8) qualify rank <= 5""", ["series_id", "rank", "start_bar", "end_bar"], ["similarity"])
PAST_SQL = f"""with recursive shaped as materialized ({SHAPED_SQL.format(more=60)}), apart as materialized (select a.series_id, a.bar, list_distance(a.z, q.z) as d from shaped a join shaped q on a.series_id = q.series_id and q.bar = q.n - 61 and a.bar < q.bar - 90),
  picks as (select distinct series_id, 0 as rank, []::bigint[] as held, -1::bigint as pick, 0::double as d from apart
    union all select series_id, rank + 1, list_append(held, pick), pick, d from (select p.series_id, p.rank, p.held, arg_min(a.bar, a.d) as pick, min(a.d) as d from picks p join apart a on a.series_id = p.series_id where p.rank < 50 and len(list_filter(p.held, lambda h: abs(h - a.bar) < 30)) = 0 group by 1, 2, 3)),
  scaled as (select *, max(d) over (partition by series_id) + 1e-10 as largest from picks where rank > 0), z as (select *, count(*) over (partition by series_id) as n from ({NUMBERED_SQL}))
  select p.series_id, p.rank, p.pick as start_bar, p.pick + 60 as end_bar, a.ts as start_ts, b.ts as end_ts, least(greatest(1 - p.d / largest, 0), 1) as similarity, p.d as distance, {', '.join(f'case when p.pick + 60 + {h} < a.n - 1 then ln(f{h}.close / b.close) else 0 end as forward_{h}' for h in (5, 10, 20, 60))}
  from scaled p join z a on a.series_id = p.series_id and a.bar = p.pick join z b on b.series_id = p.series_id and b.bar = p.pick + 60 {' '.join(f'left join z f{h} on f{h}.series_id = p.series_id and f{h}.bar = p.pick + 60 + {h}' for h in (5, 10, 20, 60))} where p.rank <= 10"""
AHEADS = [f"forward_{h}" for h in (5, 10, 20, 60)]
ORACLES["historical_analogs"] = sql(f"select *, case when forward_5 > 0.005 then 'up' when forward_5 < -0.005 then 'down' else 'sideways' end as direction from ({PAST_SQL})", ["series_id", "rank", "start_bar", "end_bar", "start_ts", "end_ts", "direction"], ["similarity", "distance", *AHEADS])
ORACLES["analog_projection"] = sql(f"""select series_id, n_analogs, least(greatest(1 - 10 * spread, 0.1), 0.99) as confidence, {', '.join(f'total_{h} / (weight + 1e-10) as projected_{h}' for h in (5, 10, 20, 60))}
  from (select series_id, count(*) as n_analogs, stddev_pop(forward_5) as spread, sum(similarity) as weight, {', '.join(f'sum(similarity * forward_{h}) as total_{h}' for h in (5, 10, 20, 60))} from ({PAST_SQL}) group by 1)""", ["series_id", "n_analogs"], [*[f"projected_{h}" for h in (5, 10, 20, 60)], "confidence"])
