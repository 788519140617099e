"""Training tables for all species in one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.functions.geo import Grid
from habitspark.operators import folds, raster, sampling, selection, spatial
from habitspark.plans.scale import attach, stored


@dataclass(frozen=True)
class TrainingPlan:
    grid: Grid
    predictors: list[str] = field(default_factory=lambda: list(S.PREDICTORS))
    n_background: int = S.N_BACKGROUND
    radius_km: float = S.ACCESSIBLE_KM
    n_folds: int = S.N_FOLDS
    seed: int = S.SEED


def build(presences: DataFrame, layers: DataFrame, plan: TrainingPlan) -> tuple[DataFrame, DataFrame]:
    """Training rows of every species and the predictors chosen for each.

    ``presences(species, lon, lat)``; ``layers(row, col, lon, lat, land, <predictors>)``.
    Background comes from the land within reach of a species' own presences. Rows keep
    all predictors but must be complete in the chosen ones.
    """
    names = list(plan.predictors)
    # written once: the sizes of its groups are looked at before it is sampled
    area = stored(spatial.accessible_cells(presences, layers.filter("land").select("row", "col", "lon", "lat"), radius_km=plan.radius_km))
    background = sampling.jitter(sampling.sample_cells(area, ["species"], plan.n_background, plan.seed), plan.grid, ["species"], plan.seed)
    points = sampling.presence_background(presences.select("species", "lon", "lat"), background.select("species", "lon", "lat"))
    # written once: selection, folds and weights all read these rows
    sampled = stored(raster.sample(points, layers, plan.grid, names))
    chosen = selection.select_predictors(sampled.filter("presence = 1"), names, ["species"])
    usable = keep_complete(sampled, chosen, names)
    placed = folds.spatial_folds(usable, plan.n_folds)
    return sampling.case_weights(placed), chosen


def keep_complete(df: DataFrame, chosen: DataFrame, names: list[str]) -> DataFrame:
    """Rows that have a value for every predictor chosen for their species."""
    lists = chosen.groupBy("species").agg(F.collect_set("predictor").alias("_chosen"))
    t = attach(df, lists, ["species"])
    ok = F.lit(True)
    for n in names:
        ok = ok & (F.col(n).isNotNull() | ~F.array_contains("_chosen", n))
    return t.filter(ok).drop("_chosen")
