"""Record cleaning: scope, coordinates, duplicates, thinning, groups."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.functions.geo import in_bbox, origin_cell
from habitspark.plans.scale import attach, first_per_key, stored

EPS = 1e-9


def in_countries(countries: Iterable[str] = tuple(S.SOUTH_AMERICA)) -> Column:
    return F.col("country").isin(list(countries))


def scope(df: DataFrame, method: str = "country", countries=tuple(S.SOUTH_AMERICA), bbox=S.PREDICTION_BBOX) -> DataFrame:
    box = in_bbox(F.col("lon"), F.col("lat"), bbox)
    tests = {"country": in_countries(countries), "bbox": box, "both": in_countries(countries) & box}
    if method not in tests:
        raise ValueError(f"unknown scope method: {method}")
    return df.filter(tests[method])


def certain_enough(df: DataFrame, limit_m: float = S.MAX_UNCERTAINTY_M) -> DataFrame:
    return df.filter(F.col("uncertainty_m").isNull() | (F.col("uncertainty_m") <= limit_m))


def coordinate_defects() -> dict[str, Column]:
    """Defect flags; ``truncated`` counts a row only when nothing else is wrong with it."""
    lon, lat = F.col("lon"), F.col("lat")

    def whole(v: Column) -> Column:
        return F.abs(v) - F.floor(F.abs(v)) < EPS

    missing = lon.isNull() | lat.isNull()
    zero = F.coalesce((F.abs(lat) < EPS) & (F.abs(lon) < EPS), F.lit(False))
    outside = F.coalesce(F.abs(lat) > 90, F.lit(False)) | F.coalesce(F.abs(lon) > 180, F.lit(False))
    cut = F.coalesce(whole(lat) & whole(lon), F.lit(False)) & ~(missing | zero | outside)
    return {"missing": missing, "zero": zero, "out_of_range": outside, "truncated": cut}


def drop_suspicious(df: DataFrame) -> DataFrame:
    bad = F.lit(False)
    for flag in coordinate_defects().values():
        bad = bad | flag
    return df.filter(~bad)


def defect_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(f"n_{n}") for n, c in coordinate_defects().items()])


def deduplicate(df: DataFrame, keys: Sequence[str] = ("species", "lat", "lon")) -> DataFrame:
    return first_per_key(df, keys, [F.col("ingest_ord")])


def thin(df: DataFrame, step: float = S.GRID_STEP_DEG, prefer_certain: bool = False) -> DataFrame:
    """First record per species and lattice cell; optionally the most certain one."""
    cells = df.withColumns({"_cx": origin_cell(F.col("lon"), step), "_cy": origin_cell(F.col("lat"), step)})
    order = [F.col("ingest_ord")]
    if prefer_certain:
        order = [F.col("uncertainty_m").asc_nulls_last(), *order]
    return first_per_key(cells, ["species", "_cx", "_cy"], order).drop("_cx", "_cy")


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def group_label(n: Column, species: Column, cosmopolitan: Sequence[str], min_records: int) -> Column:
    return F.when(n < min_records, "C").when(species.isin(list(cosmopolitan)), "A").otherwise("B")


def species_groups(df: DataFrame, cosmopolitan: Sequence[str] = tuple(S.COSMOPOLITAN), min_records: int = S.MIN_RECORDS) -> DataFrame:
    counts = df.groupBy("species").agg(F.count(F.lit(1)).alias("n_records"))
    return counts.withColumn("group", group_label(F.col("n_records"), F.col("species"), cosmopolitan, min_records))


def label_groups(df: DataFrame, cosmopolitan=tuple(S.COSMOPOLITAN), min_records: int = S.MIN_RECORDS) -> DataFrame:
    """Tag every record with its species group; nothing is dropped."""
    groups = species_groups(df, cosmopolitan, min_records).select("species", "group")
    return attach(df, groups, ["species"])


def with_enough_records(df: DataFrame, min_records: int = S.MIN_RECORDS) -> DataFrame:
    counts = df.groupBy("species").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_records)
    return attach(df, counts.select("species"), ["species"])


def prune_mask() -> Column:
    """Background rows outside every climate the presences live in."""
    return (F.col("presence") == 0) & (
        F.coalesce(F.col("bio1") < S.PRUNE_BIO1_MIN, F.lit(False))
        | (F.abs("lat") > S.PRUNE_ABS_LAT_MAX)
        | F.coalesce(F.col("bio4") == 0, F.lit(False))
    )


def failed_topography(names: Sequence[str] = tuple(S.TERRAIN)) -> Column:
    flag = F.lit(True)
    for n in names:
        flag = flag & (F.col(n) == 0)
    return flag


def funnel(df: DataFrame, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    """Run cleaning steps and report before, after, dropped and share kept per step.

    Every step runs once: its rows are written, and both the next step and the counts read what was written.
    """
    stages = [df]
    for _, step in steps:
        stages.append(stored(step(stages[-1])))
    counts = [s.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "n") for i, s in enumerate(stages)]
    # one row per step from here on
    all_counts = reduce(DataFrame.unionByName, counts).agg(F.sort_array(F.collect_list(F.struct("i", "n")))["n"].alias("n"))
    names = F.array(*[F.lit(n) for n, _ in steps])
    placed = all_counts.select("n", F.posexplode(names).alias("at", "step"))
    before, after = F.get("n", F.col("at")), F.get("n", F.col("at") + 1)
    report = placed.select(
        (F.col("at") + 1).alias("step_no"),
        "step",
        before.alias("n_before"),
        after.alias("n_after"),
        (before - after).alias("n_dropped"),
        F.round(F.when(before > 0, F.lit(100.0) * after / before), 4).alias("pct_kept"),
    )
    return stages[-1], report
