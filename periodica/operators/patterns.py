"""Patterns: extrema, turning-point sequences, volatility runs, forward returns, regimes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions.rolling import along, rolling, whole
from periodica.functions.series import finite, per_series, windows, z_scored
from periodica.operators.cleaning import numbered, returns


def extrema(bars: DataFrame, column: str = "close", order: int | None = None) -> DataFrame:
    """Bars above (max) or below (min) all order bars on either side, a hundredth of the series but 3 at least if not given; no bar at an end of the series qualifies."""
    if order is not None:
        before, after = along().rowsBetween(-order, -1), along().rowsBetween(1, order)
        x = F.col(column)
        kind = F.when((x > F.max(x).over(before)) & (x > F.max(x).over(after)), "max").when((x < F.min(x).over(before)) & (x < F.min(x).over(after)), "min")
        return numbered(bars).withColumn("kind", kind).where("kind is not null").select("series_id", "bar", "ts", "kind", column)

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame[column].to_numpy(float)
        wide, n = max(3, len(x) // 100), len(x)
        near = windows(np.concatenate([np.full(wide, np.nan), x, np.full(wide, np.nan)]), 2 * wide + 1)
        others = np.delete(near, wide, axis=1)
        inside = (np.arange(n) > 0) & (np.arange(n) < n - 1)
        with np.errstate(invalid="ignore"):
            top = inside & (np.where(np.isnan(others), -np.inf, others).max(axis=1, initial=-np.inf) < x)
            bottom = inside & (np.where(np.isnan(others), np.inf, others).min(axis=1, initial=np.inf) > x)
        at = np.flatnonzero(top | bottom)
        return pd.DataFrame({"bar": at, "ts": frame["ts"].iloc[at].to_numpy(), "kind": np.where(top[at], "max", "min"), column: x[at]})

    return per_series(bars, [column], find, f"bar int, ts timestamp_ntz, kind string, {column} double")


def turning_sequences(found: DataFrame, lengths: tuple[int, ...] = (2, 3, 4), least: int = 3, top: int = 3) -> DataFrame:
    """The most frequent runs of each of lengths of steps, as in steps_runs."""
    out = [steps_runs(found, n, least, top).withColumn("length", F.lit(n)) for n in lengths]
    return reduce(DataFrame.union, out)


def steps_runs(found: DataFrame, length: int = 2, least: int = 3, top: int = 3) -> DataFrame:
    """The most frequent runs of length steps (bars to, and kind of, the next extremum) of each series."""
    step = F.concat_ws(":", F.col("bar") - F.lag("bar").over(Window.partitionBy("series_id").orderBy("bar")), "kind")
    steps = found.withColumn("step", F.when(F.lag("bar").over(Window.partitionBy("series_id").orderBy("bar")).isNotNull(), step)).where("step is not null")
    order = Window.partitionBy("series_id").orderBy("bar")
    runs = steps.withColumn("last", F.lead("step", length - 1).over(order)).withColumn("pattern", F.array_join(F.array(*[F.lead("step", k).over(order) for k in range(length)]), ">", "")).where("last is not null")
    counts = runs.groupBy("series_id", "pattern").agg(F.count("*").alias("occurrences"), F.min("bar").alias("first_bar")).where(F.col("occurrences") >= least)
    return counts.withColumn("rank", F.row_number().over(whole().orderBy(F.desc("occurrences"), "first_bar", "pattern"))).where(F.col("rank") <= top)


def volatility_runs(bars: DataFrame, high: float = 1.0, low: float = -0.5) -> DataFrame:
    """Runs of bars whose rolling volatility stands high above or below its own mean: islands of equal state."""
    out = numbered(returns(bars)).withColumn("v", rolling("log_return", 20, F.stddev_samp))
    z = (F.col("v") - F.avg("v").over(whole())) / (F.stddev_samp("v").over(whole()) + 1e-10)
    out = out.withColumn("state", F.when(z > high, "high").when(z < low, "low")).where("state is not null")
    island = F.col("bar") - F.row_number().over(Window.partitionBy("series_id", "state").orderBy("bar"))
    runs = out.withColumn("island", island).groupBy("series_id", "state", "island").agg(F.min("bar").alias("start_bar"), F.max("bar").alias("end_bar"))
    return runs.select("series_id", "state", "start_bar", "end_bar", (F.col("end_bar") - F.col("start_bar")).alias("duration"))


def _ahead(h: int) -> Column:
    """Sum of the log returns of a bar and the h - 1 after it, null within h bars of the end of the series."""
    return F.when(F.col("bar") + h < F.count("*").over(whole()), F.sum("log_return").over(along().rowsBetween(0, h - 1)))


def volatility_cycles(bars: DataFrame, high: float = 1.0, low: float = -0.5, least: int = 3) -> DataFrame:
    """Occurrences of high and of low volatility: (series_id, pattern_id, start_bar, end_bar, start_ts, end_ts, similarity, forward_5), of kinds with at least least of them in a series.

    As in volatility_runs, but the bars before the first rolling deviation take that one; forward_5 sums 5 log returns from the last bar of a run on.
    """
    v, later = rolling("log_return", 20, F.stddev_samp), along().rowsBetween(0, Window.unboundedFollowing)
    out = numbered(returns(bars)).withColumn("_v", v).withColumn("_v", F.first("_v", ignorenulls=True).over(later)).withColumn("_ahead", _ahead(5))
    z = (F.col("_v") - F.avg("_v").over(whole())) / (F.stddev_samp("_v").over(whole()) + 1e-10)
    out = out.withColumn("_z", z).withColumn("pattern_id", F.when(F.col("_z") > high, "volcycle_high_vol").when(F.col("_z") < low, "volcycle_low_vol")).where("pattern_id is not null")
    island = F.col("bar") - F.row_number().over(Window.partitionBy("series_id", "pattern_id").orderBy("bar"))
    runs = out.withColumn("_island", island).groupBy("series_id", "pattern_id", "_island").agg(
        F.min("bar").alias("start_bar"), F.max("bar").alias("end_bar"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.lit(1.0).alias("similarity"), F.max_by("_ahead", "bar").alias("forward_5")
    )
    return runs.drop("_island").withColumn("_n", F.count("*").over(Window.partitionBy("series_id", "pattern_id"))).where(F.col("_n") >= least).drop("_n")


def turning_cycles(bars: DataFrame, column: str = "close", lengths: tuple[int, ...] = (2, 3, 4), least: int = 3, top: int = 3) -> DataFrame:
    """Occurrences of repeating runs of steps between extrema: (series_id, pattern_id, length, start_bar, end_bar, similarity, forward_5), of the top most frequent runs of each length with at least least of them.

    A run begins at an extremum and names the bars to, and the kind of, each of the next ones; ties go to the run seen first. Series of fewer than 3 maxima or minima, or
    of fewer steps than 4 or twice the length, give none. forward_5 sums 5 log returns from the last bar on.
    """
    order, each = Window.partitionBy("series_id").orderBy("bar"), whole()
    sums = numbered(returns(bars)).withColumn("forward_5", _ahead(5)).select("series_id", F.col("bar").alias("end_bar"), "forward_5")
    found = extrema(bars, column).withColumn("_steps", F.count("*").over(each) - 1).where("_steps >= 4")
    found = found.withColumn("_tops", F.count_if(F.col("kind") == "max").over(each)).where("_tops >= 3 and _steps + 1 - _tops >= 3")
    bar, kind = [F.lead("bar", k).over(order) for k in range(max(lengths) + 1)], [F.lead("kind", k).over(order) for k in range(max(lengths) + 1)]
    steps = [F.concat_ws(":", bar[k] - bar[k - 1], kind[k]) for k in range(1, max(lengths) + 1)]
    runs = [F.struct(F.lit(n).alias("length"), bar[n].alias("end_bar"), F.concat_ws(">", *steps[:n]).alias("pattern_id")) for n in lengths]
    runs = found.select("series_id", F.col("bar").alias("start_bar"), "_steps", F.array(*runs).alias("_runs")).select("series_id", "start_bar", "_steps", F.inline("_runs"))
    same, of_length = Window.partitionBy("series_id", "length", "pattern_id"), Window.partitionBy("series_id", "length")
    runs = runs.where("end_bar is not null and _steps >= 2 * length").withColumn("_n", F.count("*").over(same)).withColumn("_first", F.min("start_bar").over(same))
    runs = runs.withColumn("_place", F.dense_rank().over(of_length.orderBy(F.desc("_n"), "_first"))).where((F.col("_n") >= least) & (F.col("_place") <= top))
    return runs.join(sums, ["series_id", "end_bar"]).select("series_id", "pattern_id", "length", "start_bar", "end_bar", F.lit(1.0).alias("similarity"), "forward_5")


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Sum of the next log returns; null where the series ends before."""
    out = returns(bars)
    ahead = lambda h: along().rowsBetween(1, h)
    return out.withColumns({f"forward_{h}": F.when(F.count("log_return").over(ahead(h)) == h, F.sum("log_return").over(ahead(h))) for h in horizons})


def regime_label(mean: Column, deviation: Column) -> Column:
    """Bounds of mean and deviation of daily returns, and the labels."""
    return F.when((mean > 0.001) & (deviation < 0.01), "trending_up_low_vol").when(mean > 0.001, "trending_up_high_vol").when((mean < -0.001) & (deviation < 0.01), "trending_down_low_vol").when(mean < -0.001, "trending_down_high_vol").otherwise("sideways_consolidation")


def regime_statistics(states: DataFrame) -> DataFrame:
    """Count, share, mean, deviation, Sharpe ratio and label of each state of (series_id, state, log_return)."""
    out = states.groupBy("series_id", "state").agg(F.count("*").alias("bars"), F.avg("log_return").alias("mean_return"), F.stddev_pop("log_return").alias("deviation"))
    out = out.withColumn("share", F.col("bars") / F.sum("bars").over(whole())).withColumn("sharpe", F.col("mean_return") / (F.col("deviation") + 1e-10))
    return out.withColumn("label", regime_label(F.col("mean_return"), F.col("deviation")))


def nearest_windows(bars: DataFrame, column: str = "close", width: int = 10, block: int = 4096) -> DataFrame:
    """(series_id, start, other, distance): for each window of width bars the nearest by z-scored distance that begins more than a quarter of a width away (ties: the earlier).

    The windows of a series are cut into blocks of block windows, each with a halo of width - 1 values; every two blocks are one tile of the triangle
    over all pairs and a task of its own, which gives the least distance of its rows and of its columns. Tiles are met by an equi-join on their two
    numbers, so the work of a long series spreads over tasks and none holds more than two blocks. Gaps are left out before; flat windows are
    at distance 0 from each other and at the root of width from others; series of fewer than 4 width values give none.
    """
    rows = bars.select("series_id", "ts", F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x) and abs(x) < double('infinity')")
    rows = rows.withColumn("bar", F.row_number().over(Window.partitionBy("series_id").orderBy("ts")) - 1).withColumn("total", F.count("*").over(whole())).where(F.col("total") >= 4 * width)
    blocks = F.ceil((F.col("total") - width + 1) / block).cast("int")
    first, last = F.greatest(F.ceil((F.col("bar") - block - width + 2) / block), F.lit(0)), F.least(F.floor(F.col("bar") / block), blocks - 1)
    parts = rows.withColumn("blocks", blocks).withColumn("at", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    parts = parts.groupBy("series_id", "at", "blocks").agg(F.array_sort(F.collect_list(F.struct("bar", "x"))).alias("_v")).select("series_id", "at", "blocks", F.col("_v.x").alias("values"))
    tiles = parts.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("series_id", "at", F.least("at", "_o").alias("low"), F.greatest("at", "_o").alias("high"), "values")

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at", ignore_index=True)
        shapes = [z_scored(windows(np.asarray(v, float), width)) for v in frame["values"]]
        begin, out = frame["at"].to_numpy() * block, []
        rows, columns = shapes[0], shapes[-1]
        flat = ~columns.any(axis=1)
        best, at = np.full(len(columns), np.inf), np.zeros(len(columns), np.int64)
        for low in range(0, len(rows), 512):
            part = rows[low : low + 512]
            still = ~part.any(axis=1)
            square = np.maximum(2 * width - 2 * (part @ columns.T), 0)
            square[still[:, None] ^ flat[None, :]] = width
            square[still[:, None] & flat[None, :]] = 0
            own, others = begin[0] + np.arange(low, low + len(part)), begin[-1] + np.arange(len(columns))
            square[np.abs(own[:, None] - others[None, :]) <= -(-width // 4)] = np.inf
            out.append(pd.DataFrame({"start": own, "square": square.min(axis=1), "other": others[square.argmin(axis=1)]}))
            if len(shapes) > 1:
                least = square.argmin(axis=0)
                value = square[least, np.arange(len(columns))]
                better = value < best
                best[better], at[better] = value[better], own[least[better]]
        if len(shapes) > 1:
            out.append(pd.DataFrame({"start": begin[1] + np.arange(len(columns)), "square": best, "other": at}))
        return pd.concat(out).assign(series_id=frame["series_id"].iloc[0])[["series_id", "start", "square", "other"]]

    found = tiles.groupBy("series_id", "low", "high").applyInPandas(tile, "series_id string, start long, square double, other long").where("square < double('infinity')")
    return found.groupBy("series_id", "start").agg(F.min(F.struct("square", "other")).alias("_m")).select("series_id", "start", F.col("_m.other").alias("other"), F.sqrt("_m.square").alias("distance"))


def motifs(bars: DataFrame, column: str = "close", width: int = 10, top: int = 5, tried: int = 10, block: int = 4096) -> DataFrame:
    """Pairs of windows of width bars most alike by shape (z-scored distance), nearest first: of the tried windows of least distance to any other, those whose two places lie width apart or more and are not within half a width of one taken before."""
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.round("distance", 9), "start"))
    least = nearest_windows(bars, column, width, block).withColumn("place", place).where(F.col("place") <= tried)

    def taken(frame: pd.DataFrame) -> pd.DataFrame:
        rows, held = [], []
        for r in frame.sort_values("place").itertuples():
            if abs(r.start - r.other) >= width and not any(t - width // 2 <= p < t + width // 2 for t in held for p in (r.start, r.other)):
                held += [r.start, r.other]
                rows.append((r.series_id, len(rows) + 1, r.start, r.other, width, r.distance, 1 / (1 + r.distance)))
        return pd.DataFrame(rows[:top], columns=["series_id", "rank", "start_a", "start_b", "width", "distance", "similarity"])

    return least.groupBy("series_id").applyInPandas(taken, "series_id string, rank int, start_a int, start_b int, width int, distance double, similarity double")


def k_means(x: np.ndarray, k: int, seed: int = 42, tries: int = 5, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Labels of the best of some seeded runs, started at points drawn by their squared distance from those before, and their sum of squared distances."""
    random, best = np.random.default_rng(seed), (np.zeros(len(x), int), np.inf)
    for _ in range(tries):
        centre = x[[random.integers(len(x))]]
        while len(centre) < k:
            far = ((x[:, None] - centre[None]) ** 2).sum(axis=2).min(axis=1)
            centre = np.vstack([centre, x[random.choice(len(x), p=far / far.sum()) if far.sum() > 0 else random.integers(len(x))]])
        for _ in range(rounds):
            square = (x * x).sum(axis=1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(axis=1)
            label = square.argmin(axis=1)
            new = np.array([x[label == c].mean(axis=0) if (label == c).any() else centre[c] for c in range(k)])
            if np.allclose(new, centre):
                break
            centre = new
        loss = float(square.min(axis=1).sum())
        if loss < best[1]:
            best = (label, loss)
    return best


def silhouette(x: np.ndarray, label: np.ndarray, most: int = 500, seed: int = 42) -> float:
    """Mean silhouette of at most most points, drawn by seed."""
    some = np.random.default_rng(seed).permutation(len(x))[:most]
    x, label = x[some], label[some]
    names = np.unique(label)
    if len(names) < 2:
        return -1.0
    apart = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    sums = np.stack([apart[:, label == c].sum(axis=1) for c in names], axis=1)
    counts = np.array([(label == c).sum() for c in names])
    own = np.searchsorted(names, label)
    inside = sums[np.arange(len(x)), own] / np.maximum(counts[own] - 1, 1)
    means = sums / counts
    means[np.arange(len(x)), own] = np.inf
    outside = means.min(axis=1)
    return float(np.where(counts[own] > 1, (outside - inside) / np.maximum(np.maximum(outside, inside), 1e-12), 0).mean())


def shape_occurrences(bars: DataFrame, column: str = "close", widths: tuple[int, ...] = (10, 20, 40, 60, 120), least: int = 3, k: int | None = None) -> DataFrame:
    """(series_id, pattern_id, width, cluster, start_bar, end_bar, similarity, forward_5, forward_20): z-scored windows at every quarter width, in clusters of each series and width; similarity is the cosine with the cluster's mean.

    The number of clusters, 2 to min(12, windows / 5), has the largest silhouette if k is not given; clusters of fewer than least windows and widths of a third of the series or more are left out.
    """

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        x, out = finite(frame[column]), []
        steps = np.concatenate([[0.0], np.log(x[1:] / x[:-1])]) if len(x) and (x > 0).all() else np.full(len(x), np.nan)
        total = np.concatenate([[0.0], np.cumsum(np.nan_to_num(steps))])
        for width in widths:
            step = max(1, width // 4)
            starts = np.arange(0, max(0, len(x) - width), step)
            if width >= len(x) // 3 or not len(starts):
                continue
            rows = windows(x, width)[starts]
            lively = rows.std(axis=1) >= 1e-8
            starts, rows = starts[lively], z_scored(rows[lively])
            if len(rows) < 2 * least:
                continue
            clusters = k or (max(range(2, min(min(12, len(rows) // 5) + 1, len(rows))), key=lambda c: silhouette(rows, k_means(rows, c)[0]), default=2) if len(rows) >= 10 else 2)
            label = k_means(rows, clusters, tries=10)[0]
            for c in range(clusters):
                own = np.flatnonzero(label == c)
                if len(own) < least:
                    continue
                mean = rows[own].mean(axis=0)
                cosine = rows[own] @ mean / np.maximum(np.linalg.norm(rows[own], axis=1) * np.linalg.norm(mean), 1e-10)
                for i, s in zip(own, cosine, strict=True):
                    end = int(starts[i]) + width
                    ahead = [float(total[end + h] - total[end]) if end + h < len(x) else None for h in (5, 20)]
                    out.append((f"shape_w{width}_c{c}", width, c, int(starts[i]), end, float(s), *ahead))
        return pd.DataFrame(out, columns=["pattern_id", "width", "cluster", "start_bar", "end_bar", "similarity", "forward_5", "forward_20"])

    return per_series(bars, [column], find, "pattern_id string, width int, cluster int, start_bar int, end_bar int, similarity double, forward_5 double, forward_20 double")


def pattern_statistics(occurrences: DataFrame, most: int = 20) -> DataFrame:
    """Per pattern of (series_id, pattern_id, start_bar, end_bar, similarity, forward_5): number, mean duration, lower quartile of similarity, and mean, deviation, hit rate and Sharpe-like ratio of forward returns; ranked by that ratio times the number."""
    ahead = F.col("forward_5")
    out = occurrences.groupBy("series_id", "pattern_id").agg(
        F.count("*").alias("occurrence_count"), F.avg(F.col("end_bar") - F.col("start_bar")).alias("mean_duration"), F.percentile("similarity", F.lit(0.25)).alias("similarity_threshold"),
        F.coalesce(F.avg(ahead), F.lit(0.0)).alias("mean_forward_return"), (F.coalesce(F.stddev_pop(ahead), F.lit(0.0)) + 1e-10).alias("std_forward_return"), F.coalesce(F.avg((ahead > 0).cast("double")), F.lit(0.0)).alias("hit_rate"),
    )
    out = out.withColumn("sharpe_like", F.col("mean_forward_return") / F.col("std_forward_return"))
    place = F.row_number().over(whole().orderBy(F.desc(F.col("sharpe_like") * F.col("occurrence_count")), "pattern_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= most)


def hidden_states(x: np.ndarray, states: int, seed: int = 42, rounds: int = 50, least_gain: float = 1e-2) -> np.ndarray:
    """Most likely states of a Gaussian hidden Markov model with full covariances, fitted by expectation and maximization from clusters of the rows; states are numbered by the mean of the first column."""
    n, d = x.shape
    label = k_means(x, states, seed)[0]
    start, move = np.full(states, 1 / states), np.full((states, states), 1 / states)
    weight = np.eye(states)[label] + 1e-6
    seen, likely = -np.inf, label
    for _ in range(rounds):
        mass = weight.sum(axis=0)
        mean = weight.T @ x / mass[:, None]
        spread = [((x - m) * w[:, None]).T @ (x - m) / s + 1e-3 * np.eye(d) for m, w, s in zip(mean, weight.T, mass, strict=True)]
        log_density = np.stack([-0.5 * (np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) + np.linalg.slogdet(c)[1] + d * np.log(2 * np.pi)) for m, c in zip(mean, spread, strict=True)], axis=1)
        base = log_density.max(axis=1)
        density = np.exp(log_density - base[:, None])
        ahead, scale, back = np.zeros((n, states)), np.zeros(n), np.ones((n, states))
        now = start * density[0]
        for t in range(n):
            now = (now @ move) * density[t] if t else now
            scale[t] = now.sum()
            now = now / scale[t]
            ahead[t] = now
        for t in range(n - 2, -1, -1):
            back[t] = move @ (density[t + 1] * back[t + 1]) / scale[t + 1]
        weight = ahead * back
        weight /= weight.sum(axis=1, keepdims=True)
        met = move * (ahead[:-1].T @ (density[1:] * back[1:] / scale[1:, None]))
        start, move = weight[0], met / met.sum(axis=1, keepdims=True)
        now_seen = float(np.log(scale).sum() + base.sum())
        if now_seen - seen < least_gain:
            break
        seen = now_seen
    best, came = np.log(start + 1e-300) + log_density[0], np.zeros((n, states), int)
    for t in range(1, n):
        step = best[:, None] + np.log(move + 1e-300)
        came[t] = step.argmax(axis=0)
        best = step.max(axis=0) + log_density[t]
    likely = np.zeros(n, int)
    likely[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        likely[t - 1] = came[t][likely[t]]
    rank = np.argsort(np.argsort(mean[:, 0]))
    return rank[likely]


def regimes(bars: DataFrame, states: int = 3, seed: int = 42) -> DataFrame:
    """(series_id, bar, ts, log_return, state): hidden states of each series by its log return, 20-bar volatility (filled backwards) and 5-bar mean return, all standardized; series of fewer than 30 returns give none."""

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        step = np.log(frame["close"] / frame["close"].shift(1))
        rows = pd.DataFrame({"r": step, "v": step.rolling(20).std().bfill(), "m": step.rolling(5).mean().fillna(0.0)})
        ok = rows.notna().all(axis=1) & np.isfinite(rows).all(axis=1)
        x = rows[ok].to_numpy()
        if len(x) < 30:
            return pd.DataFrame(columns=["bar", "ts", "log_return", "state"])
        deviation = x.std(axis=0)
        state = hidden_states((x - x.mean(axis=0)) / np.where(deviation > 0, deviation, 1.0), states, seed)
        return pd.DataFrame({"bar": np.flatnonzero(ok), "ts": frame["ts"][ok], "log_return": x[:, 0], "state": state})

    return per_series(bars, ["close"], find, "bar int, ts timestamp_ntz, log_return double, state int")
