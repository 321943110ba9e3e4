"""Support vector regression on lags: kernels by random Fourier features, the loss minimised in shared scans.

The state is one row per component: the coefficients of every cell of the grid. A scan reads blocks
of rows once, adds up each cell's weighted products map-side, one partial row per component and
task, and solves a small system per component and cell.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions.expr import div
from almanac.operators.models import N_LAGS, lag_design
from almanac.plans import scans
from almanac.plans.lineage import cut

KEYS = ["station_code", "station"]
CKEYS = [*KEYS, "component"]
BLOCK = 1024
FEATURES = 32
SCANS = 12
SEED = 11
# The costs tried, and the width of the tube; kernel widths are multiples of one by the number of inputs.
COSTS = (0.1, 1.0, 10.0)
WIDTHS = (0.5, 2.0)
TUBES = (0.1,)
LEAST_COST = 0.1


def grid(costs=COSTS, widths=WIDTHS, tubes=TUBES) -> list[tuple[float, float, float]]:
    """(cost, gamma, epsilon) of every cell; gamma is for standardised inputs."""
    return [(float(c), float(w) / (N_LAGS + 2), float(e)) for c, w, e in itertools.product(costs, widths, tubes)]


def features(x: np.ndarray, gamma: float, n: int, seed: int = SEED) -> np.ndarray:
    """One, then ``n`` cosines whose products approach exp(-gamma |x - x'|^2)."""
    rng = np.random.default_rng(seed)
    directions, shifts = rng.standard_normal((x.shape[1], n)), rng.uniform(0, 2 * np.pi, n)
    return np.c_[np.ones(len(x)), np.sqrt(2 / n) * np.cos(x @ directions * np.sqrt(2 * gamma) + shifts)]


def smoothing(turn: int) -> float:
    """How far from its corners the loss is rounded off in a scan."""
    return max(0.3 * 0.6 ** turn, 1e-3)


def scaled_design(comp: DataFrame, keys: list[str] = CKEYS) -> tuple[DataFrame, DataFrame]:
    """Rows of :func:`almanac.operators.models.lag_design` standardised by their training part, as blocks, and the scales.

    Blocks: (keys, block, x flat, y, weight, train), arrays in the order of pos. Scales: (keys, n, mean, sd), inputs then target.
    Columns that don't vary are divided by one.
    """
    design = cut(lag_design(comp, keys=keys))
    width = N_LAGS + 2
    v = [F.col("x")[i] for i in range(width)] + [F.col("y")]
    train = F.col("part") == "train"
    moments = design.where(train).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in v]).alias("mean"),
        F.array(*[F.when(F.stddev_pop(c) > 1e-12, F.stddev_pop(c)).otherwise(1.0) for c in v]).alias("sd"))
    scales = cut(moments)
    z = [div(c - F.col("mean")[i], F.col("sd")[i]) for i, c in enumerate(v)]
    rows = design.join(scales, keys).select(
        *keys, F.floor(F.col("pos") / BLOCK).alias("block"),
        F.struct("pos", F.array(*z[:-1]).alias("x"), z[-1].alias("y"), "weight", train.alias("train")).alias("row"))
    packed = rows.groupBy(*keys, "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    out = packed.select(*keys, "block", F.flatten("rows.x").alias("x"), F.col("rows.y").alias("y"),
                        F.col("rows.weight").alias("weight"), F.col("rows.train").alias("train"))
    return cut(out.repartition(*keys).sortWithinPartitions(*keys, "block")), scales


def _cell_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray, epsilon: float, delta: float) -> np.ndarray:
    """Products of a quadratic that lies above the tube's loss and meets it at ``beta``: matrix, right side, loss."""
    u = y - z @ beta
    above = 0.5 / np.sqrt((u - epsilon) ** 2 + delta ** 2)
    below = 0.5 / np.sqrt((u + epsilon) ** 2 + delta ** 2)
    a = (z * (w * (above + below))[:, None]).T @ z
    b = z.T @ (w * (above * (y - epsilon) + below * (y + epsilon)))
    return np.concatenate([a[np.triu_indices(len(a))], b, [(w * np.maximum(np.abs(u) - epsilon, 0)).sum()]])


def _measures(z: np.ndarray, y: np.ndarray, w: np.ndarray, train: np.ndarray, beta: np.ndarray, epsilon: float) -> np.ndarray:
    """Loss, rows outside the tube or on it, squares and rows of both parts."""
    u = y - z @ beta
    t = train
    return np.array([(w * np.maximum(np.abs(u) - epsilon, 0))[t].sum(), (np.abs(u[t]) >= epsilon - 1e-3).sum(),
                     (u[t] ** 2).sum(), t.sum(), (u[~t] ** 2).sum(), (~t).sum()], float)


def _scan(blocks: DataFrame, state: DataFrame, cells: list, n: int, turn: int | None, keys: list[str]) -> DataFrame:
    """(keys, sums): partial sums of all cells, one row per run of a component's blocks in a task. ``turn`` None: measures."""
    kinds = dict(blocks.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def block_sums(x, y, w, train, betas) -> np.ndarray:
        x, y = np.reshape(x, (len(y), -1)), np.asarray(y, float)
        w, train = np.asarray(w, float), np.asarray(train, bool)
        betas = np.reshape(betas, (len(cells), n + 1))
        kernels = {g: features(x, g, n) for g in {g for _, g, _ in cells}}
        out = []
        for (_, g, e), beta in zip(cells, betas):
            if turn is None:
                out.append(_measures(kernels[g], y, w, train, beta, e))
            else:
                out.append(_cell_sums(kernels[g][train], y[train], w[train], beta, e, smoothing(turn)))
        return np.concatenate(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        for pdf in batches:
            out = []
            for key, *arrays in zip(pdf[keys].itertuples(index=False, name=None), pdf["x"], pdf["y"], pdf["weight"], pdf["train"], pdf["betas"]):
                own = block_sums(*arrays)
                if key != at:
                    if at is not None:
                        out.append((*at, total))
                    at, total = key, own
                else:
                    total = total + own
            if out:
                yield pd.DataFrame(out, columns=[*keys, "sums"])
        if at is not None:
            yield pd.DataFrame([(*at, total)], columns=[*keys, "sums"])

    return blocks.join(state.select(*keys, "betas"), keys).mapInPandas(run, f"{head}, sums array<double>")


def _summed(pdf: pd.DataFrame, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.stack(pdf["sums"].to_numpy()), starts, axis=0)


def _step(partials: DataFrame, state: DataFrame, cells: list, n: int, keys: list[str]) -> DataFrame:
    """The next state: every cell's quadratic solved; the intercept bears no penalty."""
    kinds = dict(state.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    size = n + 1
    upper = np.triu_indices(size)
    penalty = np.diag(np.r_[1e-9, np.ones(n)])

    def solve(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = []
        for sums, factor in zip(_summed(pdf, starts), pdf["cost_factor"].to_numpy()[starts]):
            betas = []
            for (cost, _, _), own in zip(cells, sums.reshape(len(cells), -1)):
                a = np.zeros((size, size))
                a[upper] = own[:len(upper[0])]
                a += np.triu(a, 1).T
                c = _cost(cost, factor)
                betas.append(np.linalg.solve(penalty + c * a, c * own[len(upper[0]):-1]))
            out.append(np.concatenate(betas))
        return pdf.iloc[starts][[*keys, "cost_factor"]].assign(betas=out)

    rows = partials.join(state.select(*keys, "cost_factor"), keys)
    return scans.whole_groups(rows, keys, [], solve, f"{head}, cost_factor double, betas array<double>")


def _cost(cost: float, factor: float) -> float:
    return cost if factor == 1 else max(LEAST_COST, cost * factor)


def support_vector_grid(comp: DataFrame, props: DataFrame | None = None, cells: list | None = None, n: int = FEATURES, turns: int = SCANS,
                        keys: list[str] = CKEYS) -> DataFrame:
    """(keys, cost, gamma, epsilon, objective, n_train, support, train_mse, test_mse, coefficients) of every cell and component.

    Each cell minimises half the squared coefficients plus cost times the weighted sum of errors beyond
    epsilon, on standardised lags (:func:`scaled_design`); errors are those of the standardised target.
    ``n`` random cosines stand for the kernel exp(-gamma |x - x'|^2). ``support`` counts the training rows on the
    tube's edge or outside.

    Every one of ``turns`` scans replaces the loss by a quadratic above it that touches it at the present
    coefficients, so the objective falls, up to the rounding of :func:`smoothing`, and serves all cells. With
    ``props`` (keys, dominant_frequency, variance) fast and strongly varying components get a smaller cost. Components
    without training rows have no model.
    """
    cells = cells or grid()
    blocks, scales = scaled_design(comp, keys)
    factor = F.lit(1.0)
    series = scales.select(*keys)
    if props is not None:
        factor = (F.when(F.col("dominant_frequency") > 0.01, 0.5).otherwise(1.0) * F.when(F.col("variance") > 0.1, 0.7).otherwise(1.0))
        series = series.join(props.select(*keys, "dominant_frequency", "variance"), keys)
    zero = F.array_repeat(F.lit(0.0), len(cells) * (n + 1))
    state = cut(series.select(*keys, factor.cast("double").alias("cost_factor"), zero.alias("betas")))
    for turn in range(turns):
        state = cut(_step(_scan(blocks, state, cells, n, turn, keys), state, cells, n, keys))
    kinds = dict(state.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def measure(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = []
        first = pdf.iloc[starts]
        for row, sums in zip(first.itertuples(index=False), _summed(pdf, starts)):
            betas = np.reshape(row.betas, (len(cells), n + 1))
            for (cost, g, e), beta, (loss, support, train, k, test, held) in zip(cells, betas, sums.reshape(len(cells), -1)):
                c = _cost(cost, row.cost_factor)
                scale = row.sd[-1] ** 2
                out.append((*[getattr(row, k) for k in keys], c, g, e, beta[1:] @ beta[1:] / 2 + c * loss, int(k), int(support),
                            train / max(k, 1) * scale, test / held * scale if held else None, beta))
        return pd.DataFrame(out, columns=[*keys, "cost", "gamma", "epsilon", "objective", "n_train", "support", "train_mse", "test_mse", "coefficients"])

    rows = _scan(blocks, state, cells, n, None, keys).join(state, keys).join(scales.select(*keys, "sd"), keys)
    return scans.whole_groups(rows, keys, [], measure, f"{head}, cost double, gamma double, epsilon double, objective double, n_train long, "
                              "support long, train_mse double, test_mse double, coefficients array<double>")


def support_vector_fit(comp: DataFrame, props: DataFrame | None = None, keys: list[str] = CKEYS, **options) -> DataFrame:
    """The cell with the smallest hold-out error of every component (on a tie the smallest cost, gamma, epsilon), and ``tried``."""
    tried = support_vector_grid(comp, props, keys=keys, **options)
    columns = [c for c in tried.columns if c not in keys]
    pick = F.struct(F.coalesce("test_mse", F.lit(float("inf"))), "cost", "gamma", "epsilon")
    return tried.groupBy(*keys).agg(*[F.min_by(c, pick).alias(c) for c in columns], F.count(F.lit(1)).alias("tried"))


def support_vector_rows(comp: DataFrame, models: DataFrame, n: int = FEATURES, keys: list[str] = CKEYS) -> DataFrame:
    """(keys, pos, y, predicted, part) of every row with all lags, in the series' own units, for :func:`support_vector_fit` models."""
    blocks, scales = scaled_design(comp, keys)
    kinds = dict(blocks.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = np.reshape(row.x, (len(row.y), -1))
                found = features(x, row.gamma, n) @ np.asarray(row.coefficients)
                back = lambda v: np.asarray(v) * row.sd[-1] + row.mean[-1]  # noqa: E731, B023
                yield pd.DataFrame({**{k: getattr(row, k) for k in keys}, "block": row.block, "at": np.arange(len(x)), "y": back(row.y),
                                    "predicted": back(found), "part": np.where(row.train, "train", "test")})

    rows = blocks.join(scales, keys).join(models.select(*keys, "gamma", "coefficients"), keys)
    out = rows.mapInPandas(run, f"{head}, block long, at long, y double, predicted double, part string")
    # A component's first row comes after its lags; later blocks begin at multiples of BLOCK.
    first = F.greatest(F.col("block") * BLOCK, F.lit(N_LAGS + 1))
    return out.select(*keys, (first + F.col("at")).alias("pos"), "y", "predicted", "part")
