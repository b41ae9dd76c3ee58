"""Baseline forecasters fitted and applied as set-based jobs.

Each forecaster turns sample rows into the same rows plus ``y_pred`` (prices of
the target block). The two naive ones read blocks the sample already carries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.config import LEVEL_MIN_ABS, RIDGE_ALPHAS, SeriesSpec, Settings
from loomgrid.functions import calendar
from loomgrid.functions.scaling import invert_array
from loomgrid.operators.stats import block_partials, mean_of


class Naive24:
    """Every step repeats the same step of the origin block."""

    name = "naive24"

    def fit(self, samples: DataFrame, silver: DataFrame | None = None) -> "Naive24":
        return self

    def predict(self, samples: DataFrame) -> DataFrame:
        return samples.withColumn("y_pred", F.col("last_block"))


class Naive168:
    """Every step repeats the block ``week_lag`` blocks before the target.

    The block is carried by the sample, so it is available even where the input
    window is shorter. A sample without that block gets a null forecast.
    """

    name = "naive168"

    def fit(self, samples: DataFrame, silver: DataFrame | None = None) -> "Naive168":
        return self

    def predict(self, samples: DataFrame) -> DataFrame:
        return samples.withColumn("y_pred", F.col("week_block"))


@dataclass
class SeasonalMA:
    """Circular day-of-year level times an hourly shape, both per series.

    History is first reduced to (series, day of year) and (series, weekday,
    season); the level window then joins each of at most 366 rows to the days it
    serves, so no range join over the history is needed.
    """

    spec: SeriesSpec = field(default_factory=SeriesSpec)
    half_window: int = 15
    history_years: int = 2
    name: str = "seasonal_ma"
    levels: DataFrame | None = None
    means: DataFrame | None = None
    shapes: DataFrame | None = None

    def fit(self, samples: DataFrame, silver: DataFrame) -> "SeasonalMA":
        """Learn levels and shapes from the history of the train and val period."""
        cutoff = samples.where(F.col("split").isin("train", "val")).agg(
            F.max("target_date").alias("d")
        )
        return self.fit_until(silver, cutoff)

    def fit_until(self, silver: DataFrame, cutoff: DataFrame) -> "SeasonalMA":
        """Learn from the years before ``cutoff``, a one-row relation of one date."""
        keys, n = list(self.spec.keys), self.spec.steps_per_block
        last = cutoff.scalar()
        recent = silver.where(
            (F.col("fecha") <= last)
            & (F.col("fecha") > F.add_months(last, -12 * self.history_years))
        )
        days = block_partials(recent, self.spec, steps=True).where(F.col("n") == n)
        days = days.select(
            *keys,
            mean_of("s", "n").alias("level"),
            F.dayofyear("fecha").alias("doy"),
            F.weekday("fecha").alias("dow"),
            calendar.season_of(F.col("fecha")).alias("season"),
            "steps",
        )
        by_doy = days.groupBy(*keys, "doy").agg(
            F.sum("level").alias("s"), F.count("*").alias("n")
        )
        self.means = by_doy.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("overall"))
        served = F.filter(
            F.sequence(F.lit(1), F.lit(366)),
            lambda t: calendar.circular_doy_distance(t, F.col("doy")) <= self.half_window,
        )
        self.levels = (
            by_doy.withColumn("doy", F.explode(served))
            .groupBy(*keys, "doy")
            .agg((F.sum("s") / F.sum("n")).alias("near"))
        )
        ratio = F.transform("steps", lambda s: s["pml"] / F.col("level"))
        usable = days.where(F.abs("level") >= LEVEL_MIN_ABS).select(
            *keys, "dow", "season", ratio.alias("r")
        )
        self.shapes = usable.groupBy(*keys, "dow", "season").agg(
            F.array(*[F.avg(F.get("r", F.lit(i))) for i in range(n)]).alias("shape")
        )
        return self

    def predict(self, samples: DataFrame) -> DataFrame:
        keys, n = list(self.spec.keys), self.spec.steps_per_block
        rows = samples.withColumns(
            {
                "doy": F.dayofyear("target_date"),
                "dow": F.weekday("target_date"),
                "season": calendar.season_of(F.col("target_date")),
            }
        )
        rows = (
            rows.join(self.levels, [*keys, "doy"], "left")
            .join(self.means, keys, "left")
            .join(self.shapes, [*keys, "dow", "season"], "left")
        )
        level = F.coalesce("near", "overall")
        shape = F.coalesce("shape", F.array_repeat(F.lit(1.0), n))
        return rows.withColumn("y_pred", F.transform(shape, lambda r: r * level)).drop(
            "doy", "dow", "season", "near", "overall", "shape"
        )


def ridge_design(spec: SeriesSpec, settings: Settings, metadata: bool = False) -> Column:
    """Lagged blocks, one mean per input block, calendar and level inputs."""
    n, w = spec.steps_per_block, settings.input_blocks
    z = F.col("z_pml")

    def block(i: int) -> Column:
        return F.slice(z, i * n + 1, n)

    means = F.array(
        *[F.aggregate(block(i), F.lit(0.0), lambda acc, v: acc + v) / n for i in range(w)]
    )
    doubles = "array<double>"
    parts = [block(w - 1), block(w - 2), block(max(w - settings.week_lag, 0)), means]
    parts += [F.col("X_cal").cast(doubles), F.col("X_level").cast(doubles)]
    if metadata:
        parts.append(F.col("X_meta").cast(doubles))
    return F.concat(*parts)


def complete(column: str) -> Column:
    return ~F.exists(column, lambda v: v.isNull() | F.isnan(v))


def gram_table(rows: DataFrame, strata: list[str], n_inputs: int, n_targets: int) -> DataFrame:
    """Cross-product sums of ``[1, x, y]`` per stratum, one row per matrix row.

    Each task reduces its samples to one small matrix per stratum; matrices are
    then summed with map-side combining. Strata must be few (splits, folds).
    Samples with an unknown input or target are left out.
    """
    size = 1 + n_inputs + n_targets
    columns = [f"c{j}" for j in range(size)]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            groups = batch.groupby(strata, sort=False) if strata else [((), batch)]
            for key, part in groups:
                x = np.vstack(part["x"].to_numpy())
                y = np.vstack(part["t"].to_numpy())
                v = np.hstack([np.ones((len(x), 1)), x, y])
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums.get(key, 0.0) + v.T @ v
        for key, total in sums.items():
            frame = pd.DataFrame(total, columns=columns)
            frame.insert(0, "row", np.arange(size, dtype="int32"))
            for name, value in zip(reversed(strata), reversed(key)):
                frame.insert(0, name, value)
            yield frame

    labels = "".join(f"{s} string, " for s in strata)
    schema = f"{labels}row int, " + ", ".join(f"{c} double" for c in columns)
    known = rows.where(complete("x") & complete("t")).select(*strata, "x", "t")
    return (
        known.mapInPandas(partial, schema)
        .groupBy(*strata, "row")
        .agg(F.array(*[F.sum(c) for c in columns]).alias("cells"))
    )


def collect_grams(table: DataFrame, strata: list[str]) -> dict[tuple, np.ndarray]:
    """Matrices by stratum; their size depends on the design only."""
    out: dict[tuple, dict[int, list[float]]] = {}
    for r in table.collect():
        out.setdefault(tuple(r[s] for s in strata), {})[r["row"]] = r["cells"]
    return {k: np.array([rows[i] for i in sorted(rows)]) for k, rows in out.items()}


def solve_ridge(gram: np.ndarray, n_inputs: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Centred ridge coefficients (inputs x targets) and intercepts from one matrix."""
    n = gram[0, 0]
    if n == 0:
        raise ValueError("no samples to fit")
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] - n * np.outer(mean, mean)
    xx = centred[:n_inputs, :n_inputs] + alpha * np.eye(n_inputs)
    coef = np.linalg.solve(xx, centred[:n_inputs, n_inputs:])
    return coef, mean[n_inputs:] - mean[:n_inputs] @ coef


def predict_linear(rows: DataFrame, models: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Add ``z_hats``: one target array per model, computed in Arrow batches."""
    stacked = np.hstack([c for c, _ in models])
    offset = np.concatenate([b for _, b in models])
    width = len(models[0][1])

    @F.pandas_udf("array<array<double>>")
    def apply(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        z = np.vstack(x.to_numpy()).astype(float) @ stacked + offset
        return pd.Series(z.reshape(len(x), -1, width).tolist())

    usable = F.when(complete("x"), F.col("x")).otherwise(
        F.array_repeat(F.lit(float("nan")), stacked.shape[0])
    )
    return rows.withColumn("z_hats", apply(usable))


def predict_chosen(rows: DataFrame, choice: str, models: dict[int, list[tuple]]) -> DataFrame:
    """Add ``z_hats``: one target array for each of the models that a row's ``choice`` names."""
    stacked = {i: (np.hstack([c for c, _ in m]), np.concatenate([b for _, b in m])) for i, m in models.items()}
    first = next(iter(models.values()))
    width, inputs = len(first[0][1]), first[0][0].shape[0]

    @F.pandas_udf("array<array<double>>")
    def apply(x: pd.Series, place: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        values, out = np.vstack(x.to_numpy()).astype(float), np.empty((len(x), len(first), width))
        for i in place.unique():
            here, (coef, intercept) = (place == i).to_numpy(), stacked[i]
            out[here] = (values[here] @ coef + intercept).reshape(-1, len(first), width)
        return pd.Series(out.tolist())

    usable = F.when(complete("x"), F.col("x")).otherwise(F.array_repeat(F.lit(float("nan")), inputs))
    return rows.withColumn("z_hats", apply(usable, choice))


def price_of(z: Column) -> Column:
    """Prices of a z array; an array with an unknown input becomes null."""
    prices = invert_array(z, F.col("mu"), F.col("sigma"))
    return F.when(~F.exists(z, lambda v: F.isnan(v)), prices)


def price_errors(z_hats: str) -> Column:
    """Absolute price error of a sample under each of its z forecasts, as an array."""

    def error(z: Column) -> Column:
        gaps = F.zip_with(price_of(z), F.col("y_price"), lambda p, t: F.abs(p - t))
        return F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v)

    return F.transform(z_hats, error)


def validation_errors(
    rows: DataFrame, models: list[tuple[np.ndarray, np.ndarray]]
) -> list[float]:
    """Mean absolute price error of each model over the rows, in one pass."""
    scored = predict_linear(rows, models).select(price_errors("z_hats").alias("errors"))
    row = scored.agg(*[F.avg(F.get("errors", F.lit(i))) for i in range(len(models))]).first()
    return [float("inf") if v is None else v for v in row]


@dataclass
class RidgeLags:
    """Ridge regression on lagged z-scores, calendar and level inputs.

    One pass sums the cross products of train and val; every penalty is solved
    from the train matrix, the best one on validation error is refitted on the sum
    of both matrices without another pass over the inputs.
    """

    spec: SeriesSpec = field(default_factory=SeriesSpec)
    settings: Settings = field(default_factory=Settings)
    alphas: tuple[float, ...] = RIDGE_ALPHAS
    metadata: bool = False
    name: str = "linear_lags"
    alpha: float | None = None
    coef: np.ndarray | None = None
    intercept: np.ndarray | None = None

    def n_inputs(self, samples: DataFrame) -> int:
        n, w = self.spec.steps_per_block, self.settings.input_blocks
        return 3 * n + w + 10 + 3 + (self.n_meta(samples) if self.metadata else 0)

    @staticmethod
    def n_meta(samples: DataFrame) -> int:
        return int(samples.select(F.max(F.size("X_meta"))).first()[0])

    def design(self, samples: DataFrame) -> DataFrame:
        x = ridge_design(self.spec, self.settings, self.metadata)
        return samples.withColumns({"x": x, "t": F.col("y").cast("array<double>")})

    def choose(
        self, train: np.ndarray, val: np.ndarray | None, n_inputs: int, val_rows: DataFrame
    ) -> "RidgeLags":
        """Pick the penalty and refit from matrices already summed."""
        self.alpha = self.alphas[len(self.alphas) // 2]
        total = train
        if val is not None:
            models = [solve_ridge(train, n_inputs, a) for a in self.alphas]
            errors = validation_errors(val_rows, models)
            self.alpha = self.alphas[int(np.argmin(errors))]
            total = train + val
        self.coef, self.intercept = solve_ridge(total, n_inputs, self.alpha)
        return self

    def fit(self, samples: DataFrame, silver: DataFrame | None = None) -> "RidgeLags":
        rows = self.design(samples.where(F.col("split").isin("train", "val")))
        p = self.n_inputs(samples)
        table = gram_table(rows, ["split"], p, self.spec.steps_per_block)
        grams = collect_grams(table, ["split"])
        if ("train",) not in grams:
            raise ValueError("no training samples")
        val = grams.get(("val",))
        return self.choose(grams[("train",)], val, p, rows.where(F.col("split") == "val"))

    def predict(self, samples: DataFrame) -> DataFrame:
        rows = predict_linear(self.design(samples), [(self.coef, self.intercept)])
        return rows.withColumn("y_pred", price_of(F.col("z_hats")[0])).drop("x", "t", "z_hats")


BASELINES = ("naive24", "naive168", "seasonal_ma", "linear_lags")

SequenceModel = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
_LOADED: dict[str, SequenceModel] = {}


def _resident(name: str, load: Callable[[], SequenceModel]) -> SequenceModel:
    """Model kept by the Python worker, so it is loaded once rather than per batch."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


@dataclass
class BatchScorer:
    """Score samples with a supplied pre-trained sequence model.

    ``load`` returns a callable ``(seq, cal, level) -> z``; it runs on the workers,
    once each, and its output is inverted with the frozen statistics.
    """

    load: Callable[[], SequenceModel]
    name: str = "sequence_model"

    def fit(self, samples: DataFrame, silver: DataFrame | None = None) -> "BatchScorer":
        return self

    def predict(self, samples: DataFrame) -> DataFrame:
        name, load = self.name, self.load

        @F.pandas_udf("array<double>")
        def infer(seq: pd.Series, cal: pd.Series, level: pd.Series) -> pd.Series:
            model = _resident(name, load)
            steps = np.stack([np.vstack(s) for s in seq]).astype("float32")
            z = model(
                steps,
                np.vstack(cal.to_numpy()).astype("float32"),
                np.vstack(level.to_numpy()).astype("float32"),
            )
            return pd.Series(list(np.asarray(z, dtype=float)))

        z = infer("X_seq", "X_cal", "X_level")
        return samples.withColumn("z_hat", z).withColumn(
            "y_pred", price_of(F.col("z_hat"))
        ).drop("z_hat")
