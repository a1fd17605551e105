import numpy as np
import pytest

from periodica.operators import autoencoder, models

KIND = "series_id string, start_bar long, end_bar long, window array<double>"


def test_gradient_equals_differences():
    random = np.random.default_rng(1)
    weights = autoencoder.started(8, 3, (2, 3, 4), 5)
    weights = [w + random.standard_normal(w.shape) * 0.1 for w in weights]
    x = random.standard_normal((5, 8))
    loss, found = autoencoder.gradient(weights, x)
    assert loss == pytest.approx(((autoencoder.forward(weights, x)[0][:, :, 0] - x) ** 2).mean(axis=1).sum())
    for i, g in enumerate(found):
        assert g.shape == weights[i].shape
        for at in {tuple(random.integers(0, s) for s in g.shape) for _ in range(4)}:
            up, down = [w.copy() for w in weights], [w.copy() for w in weights]
            up[i][at] += 1e-5
            down[i][at] -= 1e-5
            assert g[at] == pytest.approx((autoencoder.gradient(up, x)[0] - autoencoder.gradient(down, x)[0]) / 2e-5, rel=1e-4, abs=1e-7)


def waves(n=1200, width=16):
    """Windows of one tone whose frequency and phase vary: two numbers say all, but no two lines do."""
    random, rows = np.random.default_rng(3), []
    for i in range(n):
        x = np.sin(2 * np.pi * np.arange(width) / random.uniform(8, 16) + random.uniform(0, 2 * np.pi))
        rows.append((f"s{i % 2}", i // 2, i // 2 + width, ((x - x.mean()) / x.std()).tolist()))
    return rows


def test_training_beats_principal_components_and_repeats(spark):
    rows = waves()
    windows = spark.createDataFrame(rows, KIND).repartition(5)
    how = {"latent": 3, "rounds": 25, "rate": 0.02, "tasks": 4}
    model = autoencoder.train(windows, **how)
    again = autoencoder.train(windows.repartition(3), **how)
    assert model.held_losses == again.held_losses and all((a == b).all() for a, b in zip(model.weights, again.weights, strict=True))
    assert model.held_losses[model.best_round] == min(model.held_losses)
    held = {(r.series_id, r.start_bar) for r in autoencoder.with_tail(windows).where("held").collect()}
    assert held == {(s, b) for s in ("s0", "s1") for b in range(510, 600)}
    x = np.array([r[3] for r in rows])
    late = np.array([(r[0], r[1]) in held for r in rows])
    mean = x[~late].mean(axis=0)
    axes = np.linalg.svd(x[~late] - mean, full_matrices=False)[2][:3]
    linear = (((x[late] - mean) - (x[late] - mean) @ axes.T @ axes) ** 2).mean()
    assert model.held_losses[model.best_round] < 0.8 * linear
    coded = autoencoder.encoded(windows, model).collect()
    off = {(r.series_id, r.start_bar): r.reconstruction_error for r in coded}
    assert np.mean([off[k] for k in held]) == pytest.approx(model.held_losses[model.best_round], rel=1e-9)
    assert all(len(r.embedding) == 3 and 0 <= r.anomaly_score <= 1 for r in coded)


def test_nothing_to_train(spark):
    none = spark.createDataFrame([], KIND)
    model = autoencoder.train(none)
    assert model.held_losses == [] and autoencoder.encoded(none, model).count() == 0
    with pytest.raises(ValueError):
        autoencoder.started(10, 2, (1, 1, 1), 0)


def test_embedding_analogs_equal_a_plain_search(spark):
    random = np.random.default_rng(8)
    rows = [(s, 5 * i, 5 * i + 20, random.standard_normal(6).tolist()) for s in ("a", "b") for i in range(90)]
    rows[3] = (*rows[3][:3], [0.0] * 6)
    rows += [("short", 0, 20, [1.0] * 6), ("short", 5, 25, [1.0] * 6)]
    coded = spark.createDataFrame(rows, "series_id string, start_bar long, end_bar long, embedding array<double>").repartition(4)
    got = {}
    for r in autoencoder.embedding_analogs(coded, top=6).orderBy("series_id", "rank").collect():
        got.setdefault(r.series_id, []).append((r.rank, r.start_bar, r.end_bar, pytest.approx(r.similarity)))
    assert set(got) == {"a", "b"}
    for s in got:
        own = [r for r in rows if r[0] == s]
        q, want = np.array(own[-1][3]), []
        cosine = {r[1]: np.array(r[3]) @ q / max(np.linalg.norm(r[3]) * np.linalg.norm(q), 1e-300) for r in own if r[2] <= own[-1][1] - 30}
        while cosine and len(want) < 6:
            at = max(cosine, key=lambda k: (cosine[k], -k))
            want.append((len(want) + 1, at, at + 20, cosine[at]))
            cosine = {k: v for k, v in cosine.items() if abs(k - at) >= 30}
        assert want == got[s]


def test_windows_of_bars_go_in(spark):
    bars = spark.createDataFrame([("a", f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", float(np.sin(i / 3))) for i in range(240)], "series_id string, ts string, close double").selectExpr("series_id", "to_timestamp_ntz(ts) as ts", "close")
    windows = models.hopping_windows(bars)
    model = autoencoder.train(windows, latent=2, channels=(2, 2, 2), rounds=2, slices=1, tasks=2)
    assert len(model.held_losses) == 2
    assert autoencoder.encoded(windows, model).count() == windows.count()
