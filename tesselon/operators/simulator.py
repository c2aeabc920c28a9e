"""A stochastic linear network of layers, simulated for a grid of settings.

Each setting is a row; settings are dealt to tasks, and a task integrates all runs
of its settings together, as columns of one state matrix.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layers:
    """Fixed values of the published four-layer sweep."""

    sizes: tuple = (2, 3, 4, 5)
    decay: float = 12.7
    intra: float = 0.25
    inter: float = 1.85
    intra_asymmetry: float = 0.0
    inter_scales: tuple = (0.8, 0.6, 0.1)
    noise: float = 0.15
    slow_drive: float = 1.0
    slow_frequency: float = 0.1
    input_amplitude: float = 0.0
    input_frequency: float = 0.85
    dt: float = 0.005
    offsets: tuple = field(default=(0.0, 0.0, 0.0, 0.0))

    @property
    def layer(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def jacobian(p: Layers, epsilon: float) -> np.ndarray:
    """J of dx/dt = J x (M1). Row: target, column: source. A backward weight that isn't
    positive is left out."""
    layer = p.layer
    n = len(layer)
    target, source = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    step = layer[target] - layer[source]
    chain = (step == 0) & (np.abs(target - source) == 1)
    asymmetry = np.where(step == 0, p.intra_asymmetry, 0.0)
    gap = np.minimum(layer[target], layer[source])
    between = np.abs(step) == 1
    scales = np.append(p.inter_scales, 0.0)
    asymmetry = np.where(between, scales[gap] * epsilon, asymmetry)
    forward = np.where(step == 0, target > source, step > 0)
    base = np.where(chain, p.intra, np.where(between, p.inter, 0.0))
    weight = base * np.where(forward, 1 + asymmetry, 1 - asymmetry)
    weight = np.where(~forward & (weight <= 0), 0.0, weight)
    return weight - np.diag(p.decay + np.asarray(p.offsets)[layer])


def simulate(p: Layers, epsilon: float, seeds: list[int], n_steps: int, by_layer: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(stimulus, signals[run, step, node]) by Euler-Maruyama with a slow sine drive of
    random phase for each layer (M2, M7); by_layer: the layers' means instead of nodes."""
    j, layer = jacobian(p, epsilon), p.layer
    generators = [np.random.default_rng(s) for s in seeds]
    phase = np.stack([g.uniform(0, 2 * np.pi, len(p.sizes)) for g in generators])
    time = np.arange(n_steps) * p.dt
    stimulus = np.sin(2 * np.pi * p.input_frequency * time)
    out = np.empty((len(seeds), n_steps, len(p.sizes) if by_layer else len(layer)))
    mean = np.eye(len(p.sizes))[layer] / np.array(p.sizes)
    x = np.zeros((len(seeds), len(layer)))
    first = layer == 0
    block = 1000
    for a in range(0, n_steps, block):
        z = np.stack([g.standard_normal((min(block, n_steps - a), len(layer))) for g in generators])
        for k in range(z.shape[1]):
            slow = p.slow_drive * np.sin(2 * np.pi * p.slow_frequency * time[a + k] + phase)
            x = x + p.dt * (x @ j.T + slow[:, layer] + first * p.input_amplitude * stimulus[a + k]) + p.noise * np.sqrt(p.dt) * z[:, k]
            out[:, a + k] = x @ mean if by_layer else x
    return stimulus, out


def layer_means(p: Layers, signals: np.ndarray) -> np.ndarray:
    return np.stack([signals[..., p.layer == k].mean(axis=-1) for k in range(len(p.sizes))], axis=-1)


def layer_windows(means: np.ndarray, width: int, step: int) -> np.ndarray:
    """Correlations of layers in sliding windows: [window, layer, layer], NaN where
    undefined (M3)."""
    w = np.lib.stride_tricks.sliding_window_view(means, width, axis=0)[::step]
    c = w - w.mean(axis=2, keepdims=True)
    cov = np.einsum("wit,wjt->wij", c, c)
    sd = np.sqrt(np.einsum("wii->wi", cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        return cov / (sd[:, :, None] * sd[:, None, :])


def gain(stimulus: np.ndarray, signals: np.ndarray) -> np.ndarray:
    """|cov(signal, stimulus)| / var(stimulus) of each node (M4)."""
    s = stimulus - stimulus.mean()
    power = (s * s).mean()
    return np.abs((signals - signals.mean(axis=0)).T @ s / len(s)) / power if power else np.full(signals.shape[1], np.nan)


def spectrum(j: np.ndarray) -> tuple[float, float]:
    """(largest real part of the eigenvalues, Frobenius norm of J'J - JJ') (M5)."""
    return float(np.linalg.eigvals(j).real.max()), float(np.linalg.norm(j.T @ j - j @ j.T))


def sweep(spark: SparkSession, epsilons: list[float], runs: int, n_steps: int, window_s: float = 3.0, step_s: float = 1.5, seed: int = 3526228248, p: Layers = Layers(), tasks: int | None = None) -> DataFrame:
    """epsilon, run, layer, mean_fc, sd_fc, temporal_sd, gain, fcv, spectral_abscissa,
    nonnormality of every run (M3-M6, M8, M10). Seeds are spawned from one."""
    children = np.random.SeedSequence(seed).spawn(len(epsilons) * runs)
    rows = [(float(e), r, int(children[i * runs + r].generate_state(1)[0])) for i, e in enumerate(epsilons) for r in range(runs)]
    grid = spark.createDataFrame(rows, "epsilon double, run int, seed long").repartition(tasks or max(1, len(epsilons)), "epsilon")
    width, step = round(window_s / p.dt), round(step_s / p.dt)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        e = float(g["epsilon"].iloc[0])
        stimulus, signals = simulate(p, e, g["seed"].tolist(), n_steps)
        abscissa, nonnormal = spectrum(jacobian(p, e))
        out = []
        for k, r in enumerate(g["run"]):
            c = layer_windows(layer_means(p, signals[k]), width, step)
            g_nodes = gain(stimulus, signals[k])
            for layer in range(len(p.sizes)):
                others = np.delete(c[:, layer], layer, axis=1)
                state = np.nanmean(others, axis=1)
                out.append((e, int(r), layer + 1, np.nanmean(state), np.nanstd(others), np.nanmean(np.nanstd(others, axis=0)), np.nanmean(g_nodes[p.layer == layer]), np.nanstd(state), abscissa, nonnormal))
        return pd.DataFrame(out, columns=_SWEEP)

    return grid.groupBy("epsilon").applyInPandas(run, "epsilon double, run int, layer int, mean_fc double, sd_fc double, temporal_sd double, gain double, fcv double, spectral_abscissa double, nonnormality double")


_SWEEP = ["epsilon", "run", "layer", "mean_fc", "sd_fc", "temporal_sd", "gain", "fcv", "spectral_abscissa", "nonnormality"]


def layer_traces(spark: SparkSession, epsilons: list[float], runs: int, n_steps: int, burn_in: float = 0.15, seed: int = 20260530, p: Layers = Layers()) -> DataFrame:
    """epsilon, run, layer, frame, value of layer means after the burn-in (M7)."""
    rows = [(float(e), r, seed + 1000 * i + r) for i, e in enumerate(epsilons) for r in range(runs)]
    grid = spark.createDataFrame(rows, "epsilon double, run int, seed long").repartition(len(epsilons), "epsilon")
    skip = int(n_steps * burn_in)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        e = float(g["epsilon"].iloc[0])
        means = layer_means(p, simulate(p, e, g["seed"].tolist(), n_steps)[1])[:, skip:]
        r, f, k = np.meshgrid(g["run"].to_numpy(), np.arange(means.shape[1]), np.arange(means.shape[2]), indexing="ij")
        return pd.DataFrame({"epsilon": e, "run": r.ravel(), "layer": k.ravel() + 1, "frame": f.ravel(), "value": means.ravel()})

    return grid.groupBy("epsilon").applyInPandas(run, "epsilon double, run int, layer int, frame long, value double")


def layer_states(spark: SparkSession, epsilons: list[float], runs: int, n_steps: int, burn_in: float = 0.15, window_s: float = 3.0, step_s: float = 1.5, seed: int = 20260530, p: Layers = Layers()) -> DataFrame:
    """epsilon, run, layer, win, state: the mean correlation of each layer with the others
    in every window of a long simulation after the burn-in (M7, M8). A task integrates one
    epsilon and keeps layer means only."""
    rows = [(float(e), r, seed + round(e * 1000) * 1000 + r) for e in epsilons for r in range(runs)]
    grid = spark.createDataFrame(rows, "epsilon double, run int, seed long").repartition(len(epsilons), "epsilon")
    skip, width, step = int(n_steps * burn_in), max(8, round(window_s / p.dt)), max(1, round(step_s / p.dt))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        e, out = float(g["epsilon"].iloc[0]), []
        means = simulate(p, e, g["seed"].tolist(), n_steps, True)[1]
        for k, r in enumerate(g["run"]):
            c = layer_windows(means[k, skip:], width, step)
            for layer in range(len(p.sizes)):
                state = np.nanmean(np.delete(c[:, layer], layer, axis=1), axis=1)
                out.append(pd.DataFrame({"epsilon": e, "run": int(r), "layer": layer + 1, "win": np.arange(len(state)), "state": state}))
        return pd.concat(out)

    return grid.groupBy("epsilon").applyInPandas(run, "epsilon double, run int, layer int, win int, state double")


def potential_curves(values: DataFrame, by: list[str], run: str, value: str, bins: int = 100, grid: int = 180, floor: float = 1e-9) -> DataFrame:
    """by, run, point, x, u: each run's potential over edges that the runs of a group
    share, on an even grid by linear interpolation between bin centres, null outside, and
    shifted to 0 at its minimum (M9, M12, W12)."""
    from tesselon.operators.sequence import gaussian, padded_edges

    e = padded_edges(values, by, value, bins)
    inside = values.join(F.broadcast(e), by).where((F.col(value) >= F.col("low")) & (F.col(value) <= F.col("high")) & (F.col("width") > 0))  # one row a group
    n = inside.groupBy(*by, run, "low", "high", "width", F.least(F.floor((F.col(value) - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    a = n.groupBy(*by, run, "low", "high", "width").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("total"))
    keys = [*by, run, "low", "high", "width"]
    density = a.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / (F.col("total") * F.col("width"))).alias("d"))
    u = density.select(*keys, F.transform(gaussian("d"), lambda d: -F.log(F.greatest(d, F.lit(floor)))).alias("u"))
    place = lambda i: i * (F.col("high") - F.col("low")) / (F.lit(grid - 1) * F.col("width")) - 0.5
    at = lambda t: F.get("u", F.floor(t).cast("int")) + (t - F.floor(t)) * (F.get("u", F.least(F.floor(t) + 1, F.lit(bins - 1)).cast("int")) - F.get("u", F.floor(t).cast("int")))
    curve = u.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.when((place(i) >= 0) & (place(i) <= bins - 1), at(place(i)))).alias("u"))
    low = curve.withColumn("__least", F.array_min("u")).select(*keys, "__least", F.posexplode("u").alias("point", "u"))
    return low.select(*by, run, "point", (F.col("low") + F.col("point") * (F.col("high") - F.col("low")) / (grid - 1)).alias("x"), (F.col("u") - F.col("__least")).alias("u"))


def potential(values: DataFrame, by: list[str], value: str, bins: int = 60, floor: float = 1e-9) -> DataFrame:
    """by, bin, x, u: minus log of the smoothed density over padded percentile edges,
    shifted to 0 at its minimum (M9, A19, W8, W20)."""
    from tesselon.operators.sequence import gaussian, padded_edges

    e = padded_edges(values, by, value, bins)
    inside = values.join(e, by).where((F.col(value) >= F.col("low")) & (F.col(value) <= F.col("high")) & (F.col("width") > 0))
    n = inside.groupBy(*by, "low", "width", F.least(F.floor((F.col(value) - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    a = n.groupBy(*by, "low", "width").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("total"))
    density = a.select(*by, "low", "width", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / (F.col("total") * F.col("width"))).alias("d"))
    u = density.select(*by, "low", "width", F.transform(gaussian("d"), lambda d: -F.log(F.greatest(d, F.lit(floor)))).alias("u"))
    rows = u.select(*by, "low", "width", F.posexplode(F.transform("u", lambda v: v - F.array_min("u"))).alias("bin", "u"))
    return rows.select(*by, "bin", (F.col("low") + (F.col("bin") + 0.5) * F.col("width")).alias("x"), "u")


def mean_sem(df: DataFrame, by: list[str], value: str, ddof: int = 1) -> DataFrame:
    """by, mean, sem over runs (M13); ddof 0 divides the population deviation."""
    sd = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (sd / F.sqrt(F.count(value))).alias("sem"))
