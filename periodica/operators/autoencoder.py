"""A convolutional autoencoder of window shapes, trained by Spark: tasks work out gradients, the driver sums them and takes the step; its embeddings, errors and analogs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions.rolling import whole
from periodica.functions.storage import checkpointed

#: Layers in order: kind, stride, and whether the activation follows. The fourth gives the embedding.
LAYERS = (("conv", 1, True), ("conv", 2, True), ("conv", 2, True), ("dense", 1, False), ("dense", 1, False), ("spread", 2, True), ("spread", 2, True), ("spread", 1, False))
CODE = 4


def gathered(x: np.ndarray, stride: int) -> np.ndarray:
    """Neighbourhoods of three places, with zeros beyond the ends, at every stride: (rows, length, channels) to (rows, length / stride, 3 channels)."""
    near = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (1, 1), (0, 0))), 3, axis=1)[:, ::stride]
    return near.reshape(*near.shape[:2], -1)


def scattered(x: np.ndarray, stride: int) -> np.ndarray:
    """The adjoint of gathered: sums of what the neighbourhoods give back to each place."""
    n, short, wide = x.shape
    x, out = x.reshape(n, short, wide // 3, 3), np.zeros((n, short * stride + 2, wide // 3))
    for k in range(3):
        out[:, k : k + stride * (short - 1) + 1 : stride] += x[..., k]
    return out[:, 1:-1]


def bent(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian error linear units, by their hyperbolic-tangent form, and their slope."""
    c = math.sqrt(2 / math.pi)
    t = np.tanh(c * (x + 0.044715 * x**3))
    return 0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * c * (1 + 3 * 0.044715 * x * x)


def started(width: int, latent: int, channels: tuple[int, int, int], seed: int) -> list[np.ndarray]:
    """Weights and offsets of all layers, uniform within the root of one over the inputs; width is a multiple of 4."""
    if width % 4:
        raise ValueError("width must be a multiple of 4")
    a, b, c = channels
    flat, random, out = c * (width // 4), np.random.default_rng(seed), []
    for rows, columns, inputs, offsets in ((3, a, 3, a), (3 * a, b, 3 * a, b), (3 * b, c, 3 * b, c), (flat, latent, flat, latent), (latent, flat, latent, flat), (3 * b, c, 3 * c, b), (3 * a, b, 3 * b, a), (3, a, 3 * a, 1)):
        out += [random.uniform(-1, 1, (rows, columns)) / math.sqrt(inputs), np.zeros(offsets)]
    return out


def forward(weights: list[np.ndarray], x: np.ndarray, upto: int = len(LAYERS)) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray | None]]]:
    """What layer upto gives for rows x, and for each layer its input (for conv its neighbourhoods) and the slope of its activation."""
    now, kept = x[:, :, None], []
    for i, (kind, stride, active) in enumerate(LAYERS[:upto]):
        w, offset = weights[2 * i], weights[2 * i + 1]
        if kind == "conv":
            now = gathered(now, stride)
        elif kind == "dense" and i < CODE:
            now = now.reshape(len(x), -1)
        elif kind == "spread" and now.ndim == 2:
            now = now.reshape(len(x), -1, w.shape[1])
        given, slope = now, None
        now = (scattered(now @ w.T, stride) if kind == "spread" else now @ w) + offset
        if active:
            now, slope = bent(now)
        kept.append((given, slope))
    return now, kept


def gradient(weights: list[np.ndarray], x: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Sum over rows of the mean squared error of their reconstruction, and its gradient."""
    out, kept = forward(weights, x)
    off = out[:, :, 0] - x
    back, found = (2 / x.shape[1]) * off[:, :, None], [np.zeros(0)] * len(weights)
    for i in range(len(LAYERS) - 1, -1, -1):
        kind, stride, _ = LAYERS[i]
        w, (given, slope) = weights[2 * i], kept[i]
        if slope is not None:
            back = back.reshape(slope.shape) * slope
        found[2 * i + 1] = back.reshape(-1, back.shape[-1]).sum(axis=0)
        if kind == "spread":
            back = gathered(back, stride)
            found[2 * i] = back.reshape(-1, back.shape[-1]).T @ given.reshape(-1, given.shape[-1])
            back = back @ w
            if LAYERS[i - 1][0] == "dense":
                back = back.reshape(len(x), -1)
        else:
            found[2 * i] = given.reshape(-1, given.shape[-1]).T @ back.reshape(-1, back.shape[-1])
            back = back @ w.T
            if kind == "conv":
                back = scattered(back, stride)
            elif i == CODE - 1:
                back = back.reshape(len(x), -1, weights[2 * i - 2].shape[1])
    return float((off * off).sum() / x.shape[1]), found


@dataclass
class Autoencoder:
    """Weights of the best round, the mean losses of every round on the training part and on the held-out tail, and the best round."""

    weights: list[np.ndarray]
    train_losses: list[float] = field(default_factory=list)
    held_losses: list[float] = field(default_factory=list)
    best_round: int = 0


def with_tail(windows: DataFrame, tail: float = 0.15) -> DataFrame:
    """Adds held: whether a window is in the last share tail of its series, in time."""
    order = Window.partitionBy("series_id").orderBy("start_bar")
    return windows.withColumn("held", F.row_number().over(order) > F.floor(F.count("*").over(whole()) * (1 - tail)))


def train(
    windows: DataFrame, latent: int = 8, channels: tuple[int, int, int] = (8, 16, 32), rounds: int = 30, slices: int = 4, rate: float = 0.005, decay: float = 1e-4, patience: int = 10, tail: float = 0.15, tasks: int = 8, seed: int = 42
) -> Autoencoder:
    """An autoencoder of windows (series_id, start_bar, window: no nulls, all of one width, a multiple of 4), of all series together.

    The last share tail of each series in time is held out. Every round goes over all other windows in slices, dealt by a hash
    of series and start. For each slice the tasks sum the gradient over their rows and the driver adds the sums, in the order of
    tasks: at most tasks times the number of weights reach it, whatever the rows. Steps are Adam's with decoupled weight decay and gradients of
    norm 1 at most; the rate falls as half a cosine over the rounds. Training ends when the held-out loss has not fallen for
    patience rounds, and the weights of the best round are kept. Windows lie in a checkpoint by task and in order, so reruns with the same number of tasks agree and lost
    executors cost one step. No windows: the weights as they were drawn, no rounds; no held-out ones: the training loss decides.
    """
    place = F.xxhash64("series_id", "start_bar", F.lit(seed))
    rows = with_tail(windows, tail).select("series_id", "start_bar", "window", "held", F.pmod(place, F.lit(slices)).cast("int").alias("slice"), F.pmod(F.shiftright(place, 20), F.lit(tasks)).alias("task"))
    rows = checkpointed(rows.repartition(tasks, "task").sortWithinPartitions("task", "series_id", "start_bar").drop("task"))
    first = rows.select(F.size("window").alias("n")).head()
    weights = started(first.n if first else 4, latent, channels, seed)
    if not first:
        return Autoencoder(weights)

    def summed(part: DataFrame, now: list[np.ndarray]) -> tuple[list[int], list[float], list[np.ndarray]]:
        """Rows and losses (training, held out) and the gradient of the training rows, over all tasks."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, loss, total = [0, 0], [0.0, 0.0], [np.zeros_like(w) for w in now]
            for frame in frames:
                for low in range(0, len(frame), 1024):
                    some = frame.iloc[low : low + 1024]
                    x, held = np.stack(some["window"].to_numpy()), some["held"].to_numpy(bool)
                    n[0], n[1] = n[0] + int((~held).sum()), n[1] + int(held.sum())
                    if held.any():
                        loss[1] += float(((forward(now, x[held])[0][:, :, 0] - x[held]) ** 2).sum() / x.shape[1])
                    if not held.all():
                        more, found = gradient(now, x[~held])
                        loss[0] += more
                        total = [a + b for a, b in zip(total, found, strict=True)]
            yield pd.DataFrame({"at": [TaskContext.get().partitionId()], "n": [n[0]], "m": [n[1]], "loss": [loss[0]], "held": [loss[1]], "total": [np.concatenate([t.ravel() for t in total]).tobytes()]})

        got = sorted(part.select("window", "held").mapInPandas(run, "at int, n long, m long, loss double, held double, total binary").collect(), key=lambda r: r["at"])
        flat, out, at = sum(np.frombuffer(r["total"]) for r in got), [], 0
        for w in now:
            out.append(flat[at : at + w.size].reshape(w.shape))
            at += w.size
        return [sum(r["n"] for r in got), sum(r["m"] for r in got)], [sum(r["loss"] for r in got), sum(r["held"] for r in got)], out

    model, best = Autoencoder(weights), math.inf
    mean, square, step, since = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0, 0
    for turn in range(rounds):
        pace, loss, n = rate * (1 + math.cos(math.pi * turn / rounds)) / 2, 0.0, 0
        for s in range(slices):
            counts, losses, found = summed(rows.where(f"slice = {s} and not held"), weights)
            n, loss = n + counts[0], loss + losses[0]
            if not counts[0]:
                continue
            found = [g / counts[0] for g in found]
            size = math.sqrt(sum(float((g * g).sum()) for g in found))
            step += 1
            for i, g in enumerate(found):
                g = g * min(1.0, 1.0 / (size + 1e-6))
                mean[i], square[i] = 0.9 * mean[i] + 0.1 * g, 0.999 * square[i] + 0.001 * g * g
                moved = mean[i] / (1 - 0.9**step) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
                weights[i] = weights[i] * (1 - pace * decay) - pace * moved
        counts, losses, _ = summed(rows.where("held"), weights)
        model.train_losses.append(loss / max(n, 1))
        model.held_losses.append(losses[1] / counts[1] if counts[1] else model.train_losses[-1])
        if model.held_losses[-1] < best:
            best, since, model.best_round, model.weights = model.held_losses[-1], 0, turn, [w.copy() for w in weights]
        elif (since := since + 1) >= patience:
            break
    return model


def encoded(windows: DataFrame, model: Autoencoder) -> DataFrame:
    """Adds to each window its embedding, the mean squared error of its reconstruction, and that error scaled to 0..1 within its series as anomaly_score."""
    weights = model.weights

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), 1024):
                some = frame.iloc[low : low + 1024]
                x = np.stack(some["window"].to_numpy())
                off = forward(weights, x)[0][:, :, 0] - x
                yield some.assign(embedding=list(forward(weights, x, CODE)[0]), reconstruction_error=(off * off).mean(axis=1))

    kind = "series_id string, start_bar long, end_bar long, window array<double>"
    rows = windows.select(F.col("series_id").cast("string"), F.col("start_bar").cast("long"), F.col("end_bar").cast("long"), "window")
    out = rows.mapInPandas(run, f"{kind}, embedding array<double>, reconstruction_error double")
    low, high = F.min("reconstruction_error").over(whole()), F.max("reconstruction_error").over(whole())
    return out.withColumn("anomaly_score", (F.col("reconstruction_error") - low) / (high - low + 1e-10))


def embedding_analogs(coded: DataFrame, top: int = 10, separation: int = 30) -> DataFrame:
    """Past windows of each series whose embeddings are most like that of its last window, by cosine: (series_id, rank, start_bar, end_bar, similarity).

    Only windows that end separation bars before the last one begins, or earlier, take part. Of windows that begin within separation bars of
    each other the nearest stays (ties: the earlier). Embeddings of length 0 have similarity 0. One row per window meets its series' query by an
    equi-join; only starts and similarities go to the grouped choice.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    rows = coded.select("series_id", "start_bar", "end_bar", "embedding", dot("embedding", "embedding").alias("_l"))
    last = rows.groupBy("series_id").agg(F.max_by(F.struct("start_bar", "embedding", "_l"), "start_bar").alias("q"))
    met = rows.join(last, "series_id").where(F.col("end_bar") <= F.col("q.start_bar") - separation)
    met = met.select("series_id", "start_bar", "end_bar", F.coalesce(F.try_divide(dot("embedding", "q.embedding"), F.sqrt(F.col("_l") * F.col("q._l"))), F.lit(0.0)).alias("similarity"))

    def picked(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["similarity", "start_bar"], ascending=[False, True], ignore_index=True)
        start, left, out = frame["start_bar"].to_numpy(), np.ones(len(frame), bool), []
        while len(out) < top and left.any():
            at = int(left.argmax())
            out.append(at)
            left &= np.abs(start - start[at]) >= separation
        return frame.iloc[out].assign(rank=np.arange(1, len(out) + 1))[["series_id", "rank", "start_bar", "end_bar", "similarity"]]

    return met.groupBy("series_id").applyInPandas(picked, "series_id string, rank int, start_bar long, end_bar long, similarity double")
