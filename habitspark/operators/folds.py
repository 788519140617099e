"""Spatial cross-validation folds: clusters of presences, all groups at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.operators.audit import fold_balance, folds_with_presence
from habitspark.plans.scale import attach, group_rows_limit, hash_unit, stored


def _projection(presences: DataFrame, key: str) -> DataFrame:
    """Longitude scale per group from the mean latitude of its presences."""
    scale = F.greatest(F.cos(F.radians(F.avg("lat"))), F.lit(1e-3))
    return presences.groupBy(key).agg(scale.alias("_scale"))


def _nearest(centres: str, x: Column, y: Column) -> Column:
    """(squared distance, cluster) of the closest entry of an array of centres."""
    ranked = F.transform(
        centres, lambda c: F.struct(((c["x"] - x) * (c["x"] - x) + (c["y"] - y) * (c["y"] - y)).alias("d"), c["cluster"].alias("cluster"))
    )
    return F.array_min(ranked)


def _pack(centres: DataFrame, key: str) -> DataFrame:
    return centres.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("cluster", "x", "y"))).alias("centres"))


def nearest_cluster(points: DataFrame, centres: DataFrame, scale: DataFrame | None = None, key: str = "species") -> DataFrame:
    """Number of the closest centre (``x``, ``y`` in scaled degrees) for each point."""
    t = attach(points, _pack(centres, key), [key], "left")
    x = F.col("lon")
    if scale is not None:
        t = attach(t, scale, [key], "left")
        x = x * F.col("_scale")
    found = _nearest("centres", x, F.col("lat"))["cluster"]
    return t.withColumn("cv_fold", F.coalesce(found, F.lit(0)).cast("int")).drop("centres", "_scale")


def _moved(x: np.ndarray, y: np.ndarray, w: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For every start and cluster: weight, weighted x and y, and summed squared distance of the places nearest to its centre."""
    starts, k, _ = centres.shape
    out = np.zeros((starts, k, 4))
    for s in range(starts):
        d = (x[:, None] - centres[s, :, 0]) ** 2 + (y[:, None] - centres[s, :, 1]) ** 2
        d[:, np.isnan(centres[s, :, 0])] = np.inf  # fewer places than clusters
        near = d.argmin(axis=1)
        for j, v in enumerate((w, w * x, w * y, w * d[np.arange(len(x)), near])):
            out[s, :, j] = np.bincount(near, v, k)
    return out


def _means(sums: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """New centres; one without places stays where it is."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(sums[:, :, :1] > 0, sums[:, :, 1:3] / sums[:, :, :1], centres)


def _settled(new: np.ndarray, old: np.ndarray, tolerance: float) -> bool:
    return not np.nanmax(np.abs(new - old), initial=0.0) > tolerance


def _best(centres: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The start with the smallest sum of squares, the first of equals (to twelve digits, as sums depend on their order)."""
    inertia = sums[:, :, 3].sum(axis=1)
    return centres[int(np.flatnonzero(inertia <= inertia.min() * (1 + 1e-12))[0])]


def _array(flat: Sequence[float], k: int) -> np.ndarray:
    return np.array(flat, float).reshape(-1, k, 2)


def _starts(places: DataFrame, key: str, k: int, n: int) -> DataFrame:
    """``n`` starts per group, each the ``k`` places with the smallest draws: column ``centres``, flat, null for missing places.

    Draws follow from the place and the number of the start. The rank limits rows per group before the shuffle.
    """
    drawn = places.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("draw", hash_unit(F.col("x"), F.col("y"), F.col("start"), seed=S.SEED))
    order = Window.partitionBy(key, "start").orderBy("draw", "x", "y")
    first = drawn.withColumn("cluster", F.row_number().over(order) - 1).filter(F.col("cluster") < k)
    per_start = first.groupBy(key, "start").agg(F.map_from_entries(F.collect_list(F.struct("cluster", F.struct("x", "y")))).alias("m"))
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.array(F.try_element_at("m", j)["x"], F.try_element_at("m", j)["y"])))
    ordered = F.array_sort(F.collect_list(F.struct("start", flat.alias("c"))))
    return per_start.groupBy(key).agg(F.flatten(F.transform(ordered, lambda s: s["c"])).alias("centres"))


def _in_one_task(places: DataFrame, starts: DataFrame, key: str, k: int, tolerance: float) -> DataFrame:
    """Rounds of groups whose places fit into a task."""

    def run(part: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({key: [], "centres": []})
        part = part.sort_values(["x", "y"])
        x, y, w = (part[c].to_numpy(float) for c in ("x", "y", "w"))
        centres = _array(start["centres"].iloc[0], k)
        while True:
            sums = _moved(x, y, w, centres)
            new = _means(sums, centres)
            if _settled(new, centres, tolerance):
                return pd.DataFrame({key: [part[key].iloc[0]], "centres": [_best(new, _moved(x, y, w, new)).ravel().tolist()]})
            centres = new

    kind = starts.schema[key].dataType.simpleString()
    return places.groupBy(key).cogroup(starts.groupBy(key)).applyInPandas(run, f"`{key}` {kind}, centres array<double>")


def _over_tasks(places: DataFrame, starts: DataFrame, key: str, k: int, tolerance: float) -> DataFrame:
    """Rounds of groups of any size: one pass over packed places a round, sums of all starts per group and task."""
    kind = starts.schema[key].dataType.simpleString()

    def pack(batches):
        for frame in batches:
            rows = [(g, part[["x", "y", "w"]].to_numpy(float).tobytes()) for g, part in frame.groupby(key, sort=False)]
            yield pd.DataFrame(rows, columns=[key, "xyw"])

    def add(batches):
        for frame in batches:
            rows = []
            for g, xyw, flat in frame[[key, "xyw", "centres"]].itertuples(index=False):
                x, y, w = np.frombuffer(xyw).reshape(-1, 3).T
                rows += [(g, i, float(v)) for i, v in enumerate(_moved(x, y, w, _array(flat, k)).ravel())]
            yield pd.DataFrame(rows, columns=[key, "i", "v"])

    def move(batches):
        for frame in batches:
            rows = []
            for r in frame.to_dict("records"):
                old, sums = _array(r["centres"], k), np.array(r["sums"], float).reshape(-1, k, 4)
                if r["settled"]:
                    rows.append((r[key], _best(old, sums).ravel().tolist(), True, True))
                else:
                    new = _means(sums, old)
                    rows.append((r[key], new.ravel().tolist(), _settled(new, old, tolerance), False))
            yield pd.DataFrame(rows, columns=[key, "centres", "settled", "done"])

    packed = stored(places.select(key, "x", "y", "w").mapInPandas(pack, f"`{key}` {kind}, xyw binary"))
    state = starts.withColumns({"settled": F.lit(False), "done": F.lit(False)})
    ended = []
    while True:
        state = stored(state)
        ended.append(state.filter("done").select(key, "centres"))
        state = state.filter("NOT done")
        if state.isEmpty():
            return reduce(DataFrame.unionByName, ended)
        added = attach(packed, state.select(key, "centres"), [key]).mapInPandas(add, f"`{key}` {kind}, i int, v double")
        sums = added.groupBy(key, "i").agg(F.sum("v").alias("v")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("sums"))
        state = state.join(sums, key).mapInPandas(move, f"`{key}` {kind}, centres array<double>, settled boolean, done boolean")


def presence_clusters(presences: DataFrame, k: int = S.N_FOLDS, starts: int = 10, tolerance: float = 1e-4, key: str = "species"):
    """Cluster centres per group and the longitude scale used.

    Presences are first combined to weighted localities. Of ``starts`` sets of starting centres, all carried together, the one
    with the smallest sum of squares is kept. Assignment and averaging alternate until no centre of any start moves by more than
    ``tolerance`` degrees; sums of squares fall in every round, so this ends. A group of at most
    ``habitspark.window.maxGroupRows`` localities goes through its rounds in one task, larger ones in passes over all
    tasks that add up sums per start and cluster. Both take the same steps.
    """
    scale = _projection(presences, key)
    places = presences.groupBy(key, "lon", "lat").agg(F.count(F.lit(1)).cast("double").alias("w"))
    places = attach(places, scale, [key]).select(key, (F.col("lon") * F.col("_scale")).alias("x"), F.col("lat").alias("y"), "w")
    places = stored(places)
    limit = group_rows_limit(presences.sparkSession)
    sizes = places.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    first = stored(_starts(places, key, k, starts).join(sizes, key))
    small, large = (first.filter(c) for c in (F.col("_n") <= limit, F.col("_n") > limit))
    found = []
    if not small.isEmpty():
        found.append(_in_one_task(attach(places, small.select(key), [key], "left_semi"), small.select(key, "centres"), key, k, tolerance))
    if not large.isEmpty():
        found.append(_over_tasks(attach(places, large.select(key), [key], "left_semi"), large.select(key, "centres"), key, k, tolerance))
    flat = reduce(DataFrame.unionByName, found) if found else first.select(key, "centres")
    point = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.struct(j.alias("cluster"), F.get("centres", 2 * j).alias("x"), F.get("centres", 2 * j + 1).alias("y")))
    rows = stored(flat.select(key, F.explode(point).alias("c")).select(key, "c.*").filter("x IS NOT NULL AND NOT isnan(x)"))
    return rows, scale


def spatial_folds(df: DataFrame, k: int = S.N_FOLDS, key: str = "species") -> DataFrame:
    """Fold of every row: presences by cluster, background by the nearest cluster centre.

    A group with fewer than k localities gets as many folds as localities, one without
    presences fold 0.
    """
    centres, scale = presence_clusters(df.filter("presence = 1"), k, key=key)
    return nearest_cluster(df.drop("cv_fold"), centres, scale, key)


def reassign(df: DataFrame, k: int = S.N_FOLDS, key: str = "species") -> tuple[DataFrame, DataFrame]:
    """New folds, and the number of folds holding presences before and after."""
    fresh = spatial_folds(df, k, key)
    before = folds_with_presence(fold_balance(df, [key]), [key]).select(key, F.col("folds_with_presence").alias("before"))
    after = folds_with_presence(fold_balance(fresh, [key]), [key]).select(key, F.col("folds_with_presence").alias("after"))
    return fresh, before.join(after, key)
