"""Ridge regressions with effects of groups (zones) and of the entities in them (nodes).

An effect is the weight of a one-hot input, under the same penalty as any other weight. The one-hot
columns are never built: an entity's column meets only its own samples, so its weight is eliminated
from the normal equations by the sums over its samples, and a group's by the sums of its entities.
What remains has the size of the other inputs. Sums, eliminations and effects are rows of tables;
the driver holds one matrix per fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.forecasters import complete

Weights = tuple[np.ndarray, np.ndarray]


def _summed(column: str, size: int) -> Column:
    """Sum of arrays of the same length, cell by cell."""
    return F.array(*[F.sum(F.get(column, F.lit(i))) for i in range(size)]).alias(column)


def effect_sums(rows: DataFrame, keys: list[str], n_inputs: int, n_targets: int) -> DataFrame:
    """``(keys, v)``: sums of ``[1, x, t]`` over the samples of each key.

    Samples with an unknown input or target are left out, as from ``gram_table``.
    """
    known = rows.where(complete("x") & complete("t"))
    v = F.concat(F.array(F.lit(1.0)), F.col("x"), F.col("t"))
    return known.select(*keys, v.alias("v")).groupBy(*keys).agg(_summed("v", 1 + n_inputs + n_targets))


def total_sums(rows: DataFrame, size: int) -> DataFrame:
    """``(fit, alpha, grp, entity, v)`` with the rows of one entity in one fit added up."""
    return rows.groupBy("fit", "alpha", "grp", "entity").agg(_summed("v", size))


def _shrunk(column: str, n: Column, alpha: Column) -> Column:
    return F.transform(column, lambda c: c * (alpha / (n + alpha)))


def levels(sums: DataFrame, size: int, grouped: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sums that a fit's effects are eliminated by: groups alone, entities, and groups behind their entities.

    ``sums`` holds ``(fit, alpha, grp, entity, v)``, one row per entity of a fit. Groups for which
    ``grouped`` does not hold have no effect of their own, their entities have.
    """
    n = F.get("v", F.lit(0))
    fits = ["fit", "alpha", "grp"]
    alone = sums.where(grouped).groupBy(*fits).agg(_summed("v", size))
    behind = sums.where(grouped).withColumn("v", _shrunk("v", n, F.col("alpha")))
    return alone, sums, behind.groupBy(*fits).agg(_summed("v", size))


def eliminated(terms: DataFrame, size: int) -> DataFrame:
    """``(kind, fit, row, cells)``: what the elimination of effects takes from a fit's matrix.

    ``terms`` holds ``(kind, fit, alpha, v)``. Every task reduces its rows to one matrix per fit.
    """
    columns = [f"c{j}" for j in range(size)]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, part in batch.groupby(["kind", "fit"], sort=False):
                v = np.vstack(part["v"].to_numpy())
                weight = 1.0 / (v[:, 0] + part["alpha"].to_numpy())
                taken[key] = taken.get(key, 0.0) + v.T @ (v * weight[:, None])
        for (kind, fit), total in taken.items():
            frame = pd.DataFrame(total, columns=columns)
            frame.insert(0, "row", np.arange(size, dtype="int32"))
            frame.insert(0, "fit", fit)
            frame.insert(0, "kind", kind)
            yield frame

    schema = "kind string, fit int, row int, " + ", ".join(f"{c} double" for c in columns)
    sums = terms.select("kind", "fit", "alpha", "v").mapInPandas(partial, schema)
    return sums.groupBy("kind", "fit", "row").agg(F.array(*[F.sum(c) for c in columns]).alias("cells"))


def solve_reduced(gram: np.ndarray, taken: np.ndarray, n_inputs: int, alpha: float) -> Weights:
    """Weights of the inputs (inputs x targets) and intercepts, once the effects are eliminated."""
    left = gram - taken
    u = 1 + n_inputs
    penalty = alpha * np.eye(u)
    penalty[0, 0] = 0.0
    solved = np.linalg.solve(left[:u, :u] + penalty, left[:u, u:])
    return solved[1:], solved[0]


def effects(terms: DataFrame, weights: dict[int, Weights], n_targets: int) -> DataFrame:
    """Adds ``effect``, the weight of a term given those of the inputs, one value per target.

    ``terms`` holds ``(fit, alpha, v)`` and, for entities, ``outer``, the effect of their group.
    """
    solved = {fit: np.vstack([b[None, :], c]) for fit, (c, b) in weights.items()}
    nested = "outer" in terms.columns

    def work(fit: pd.Series, alpha: pd.Series, v: pd.Series, outer: pd.Series | None = None) -> pd.Series:
        if not len(fit):
            return pd.Series([], dtype=object)
        v, out = np.vstack(v.to_numpy()), np.empty((len(fit), n_targets))
        if outer is not None:
            v[:, -n_targets:] -= v[:, :1] * np.vstack(outer.to_numpy())
        for f in fit.unique():
            rows = (fit == f).to_numpy()
            left = v[rows, -n_targets:] - v[rows, :-n_targets] @ solved[f]
            out[rows] = left / (v[rows, :1] + alpha.to_numpy()[rows, None])
        return pd.Series(out.tolist())

    if nested:

        @F.pandas_udf("array<double>")
        def apply(fit: pd.Series, alpha: pd.Series, v: pd.Series, outer: pd.Series) -> pd.Series:
            return work(fit, alpha, v, outer)

    else:

        @F.pandas_udf("array<double>")
        def apply(fit: pd.Series, alpha: pd.Series, v: pd.Series) -> pd.Series:
            return work(fit, alpha, v)

    told = terms.where(F.col("fit").isin([int(f) for f in weights]))
    return told.withColumn("effect", apply(*["fit", "alpha", "v"] + ["outer"] * nested))


def by_label(effect_rows: DataFrame, labels: list[str], name: str) -> DataFrame:
    """``(labels, name)``: effects by model number, at most one for each model."""
    pairs = F.collect_list(F.struct("model", "effect"))
    return effect_rows.groupBy(*labels).agg(F.map_from_entries(pairs).alias(name))


def add_effects(z_hats: Column, *maps: Column) -> Column:
    """Forecasts of all models plus their effects; a label without one adds nothing."""

    def moved(z: Column, i: Column) -> Column:
        for effect_of in maps:
            found = F.try_element_at(effect_of, i)
            z = F.when(found.isNull(), z).otherwise(F.zip_with(z, found, lambda a, b: a + b))
        return z

    return F.transform(z_hats, moved)
