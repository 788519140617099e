"""Evaluation metrics as grouped aggregates over labelled scores.

Every metric starts from ``score_counts``: positives and negatives per distinct score.
That step combines before the shuffle, so a group with many rows costs no more than
its distinct scores; ordered work on it goes through ``running_totals``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.plans.scale import attach, exact_quantiles, running_totals


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _big(name: str) -> Column:
    return F.col(name).cast("decimal(18,0)")


def score_counts(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "presence") -> DataFrame:
    y = F.col(label).cast("long")
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).alias("score"))
        .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    )


def roc_table(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "presence") -> DataFrame:
    """Distinct scores with running counts; ``tp`` and ``fp`` are the hits at >= score."""
    t = running_totals(score_counts(df, keys, score, label), keys, "score", ["pos", "neg"], source=df)
    return t.withColumns(
        {"tp": F.col("tot_pos") - F.col("cum_pos") + F.col("pos"), "fp": F.col("tot_neg") - F.col("cum_neg") + F.col("neg")}
    )


def both_classes() -> Column:
    return (F.max("tot_pos") > 0) & (F.max("tot_neg") > 0)


def _auc() -> Column:
    area = F.sum(_d("pos") * (_d("cum_neg") - _d("neg") / 2.0))
    return F.when(both_classes(), area / (F.max(_d("tot_pos")) * F.max(_d("tot_neg"))))


def _average_precision() -> Column:
    terms = F.sum(_d("pos") * _d("tp") / (_d("tp") + _d("fp")))
    return F.when(F.max("tot_pos") > 0, terms / F.max(_d("tot_pos")))


def auc(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Area under the ROC curve, ties one half; null with a single class."""
    return roc_table(df, keys, score).groupBy(*keys).agg(_auc().alias("auc"))


def average_precision(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    return roc_table(df, keys, score).groupBy(*keys).agg(_average_precision().alias("auc_pr"))


def _lead() -> Column:
    """TSS times P*N as an exact number, so that ties are real ties."""
    return _big("tp") * _big("tot_neg") - _big("fp") * _big("tot_pos")


def _roc_best() -> Column:
    return F.max(F.struct(_lead().alias("lead"), F.col("score").alias("score")))


def max_tss_roc(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Threshold of the largest TSS, the highest one on ties; infinity when none beats zero."""
    best = roc_table(df, keys, score).groupBy(*keys).agg(
        _roc_best().alias("b"), F.max(_d("tot_pos") * _d("tot_neg")).alias("pn")
    )
    better = (F.col("pn") > 0) & (F.col("b.lead") > 0)
    return best.select(
        *keys,
        F.when(better, F.col("b.score")).otherwise(F.lit(float("inf"))).alias("threshold"),
        F.when(better, F.col("b.lead").cast("double") / F.col("pn")).otherwise(F.lit(0.0)).alias("tss"),
    )


def max_tss_sweep(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Threshold of the largest TSS, the lowest one on ties; (0.5, 0) with a single class."""
    return _sweep(roc_table(df, keys, score), keys)


def _sweep(roc: DataFrame, keys: Sequence[str]) -> DataFrame:
    best = roc.groupBy(*keys).agg(
        F.max(F.struct(_lead().alias("lead"), (-F.col("score")).alias("minus"))).alias("b"),
        F.max(_d("tot_pos") * _d("tot_neg")).alias("pn"),
    )
    return best.select(
        *keys,
        F.when(F.col("pn") > 0, -F.col("b.minus")).otherwise(F.lit(0.5)).alias("threshold"),
        F.when(F.col("pn") > 0, F.col("b.lead").cast("double") / F.col("pn")).otherwise(F.lit(0.0)).alias("tss"),
    )


def thresholds(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """maxTSS, the tenth percentile and the minimum of the presence scores.

    Without presences the last two are zero.
    """
    top = max_tss_sweep(df, keys, score).select(*keys, F.col("threshold").alias("maxTSS"))
    pres = df.filter("presence = 1")
    p10 = exact_quantiles(pres, keys, score, {"p10": 0.1})
    low = pres.groupBy(*keys).agg(F.min(score).alias("min_train"))
    out = attach(attach(top, p10, keys, "left"), low, keys, "left")
    return out.fillna(0.0, ["p10", "min_train"])


def roc_thresholds(roc: DataFrame, keys: Sequence[str]) -> DataFrame:
    """maxTSS and p10 of ``thresholds`` from a ROC table that is at hand."""
    h = (F.col("tot_pos") - 1) * F.lit(0.1)
    low = F.floor(h)
    at = lambda place: F.min(F.when((F.col("tot_pos") > 0) & (F.col("cum_pos") >= place), F.col("score")))
    tenth = roc.groupBy(*keys).agg(at(low + 1).alias("lo"), at(F.least(low + 2, F.col("tot_pos"))).alias("hi"), F.max(h - low).alias("w"))
    p10 = F.coalesce(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w"), F.lit(0.0)).alias("p10")
    top = _sweep(roc, keys).select(*keys, F.col("threshold").alias("maxTSS"))
    return attach(top, tenth.select(*keys, p10), keys, "left")


def map_thresholds(suitability: DataFrame, at_presences: DataFrame, keys: Sequence[str], with_records: bool = True) -> DataFrame:
    """Heuristic thresholds of a map without a stored model.

    p10 comes from the values at presences, else from the whole map; maxTSS is twice p10
    within the map's range, or the map mean when no records are at hand.
    """
    whole = suitability.groupBy(*keys).agg(F.max("suitability").alias("top"), F.avg("suitability").alias("mean"))
    whole = attach(whole, exact_quantiles(suitability, keys, "suitability", {"map_p10": 0.1}), keys, "left")
    local = exact_quantiles(at_presences, keys, "suitability", {"pres_p10": 0.1})
    out = attach(whole, local, keys, "left").withColumn("p10", F.coalesce("pres_p10", "map_p10"))
    heuristic = F.least(F.greatest(F.col("p10") * 2.0, F.lit(0.0)), F.col("top"))
    return out.select(*keys, "p10", (heuristic if with_records else F.col("mean")).alias("maxTSS"))


def confusion(df: DataFrame, limits: DataFrame, keys: Sequence[str], score: str = "score", counts: DataFrame | None = None) -> DataFrame:
    """Counts at ``limits.threshold`` and the ratios made of them; ``counts`` per distinct score (or a ROC table) may be at hand."""
    c = attach(score_counts(df, keys, score) if counts is None else counts, limits.select(*keys, "threshold"), keys)
    hit = F.col("score") >= F.col("threshold")
    t = c.groupBy(*keys).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"),
    )
    return t.select("*", tss().alias("tss"), f1().alias("f1"), omission().alias("omission"))


def _share(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    ratio = F.when(whole > 0, part.cast("double") / whole.cast("double"))
    return ratio if empty is None else F.coalesce(ratio, F.lit(empty))


def tss() -> Column:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return _share(tp, tp + fn) + _share(tn, tn + fp) - F.lit(1.0)


def f1() -> Column:
    return _share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def omission() -> Column:
    return _share(F.col("fn"), F.col("tp") + F.col("fn"), None)


def omission_p10(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Share of presences below their own tenth percentile."""
    pres = df.filter((F.col("presence") == 1) & F.col(score).isNotNull())
    p10 = exact_quantiles(pres, keys, score, {"p10": 0.1})
    below = (F.col(score) < F.col("p10")).cast("long")
    return attach(pres, p10, keys).groupBy(*keys, "p10").agg(
        (F.sum(below).cast("double") / F.count(F.lit(1)).cast("double")).alias("or10")
    )


def brier(df: DataFrame, keys: Sequence[str], score: str = "score", clip: bool = True) -> DataFrame:
    s = F.col(score)
    p = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)) if clip else s
    gap = p - F.col("presence").cast("double")
    return df.filter(s.isNotNull()).groupBy(*keys).agg(F.avg(gap * gap).alias("brier"))


def calibration_curve(df: DataFrame, keys: Sequence[str], score: str = "score", n_bins: int = 10) -> DataFrame:
    """Observed share and mean score per occupied bin; an edge value counts to the lower bin."""
    p = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0))
    step = 1.0 / n_bins
    above = " + ".join(f"int(_p > {k * step!r}D)" for k in range(1, n_bins))
    return (
        df.filter(F.col(score).isNotNull())
        .select(*keys, p.alias("_p"), "presence")
        .groupBy(*keys, F.expr(above).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("presence").cast("double")).alias("prob_true"), F.avg("_p").alias("prob_pred"))
    )


def calibration_line(df: DataFrame, keys: Sequence[str], score: str = "score", n_bins: int = 10) -> DataFrame:
    """Least-squares line through the calibration curve; null with fewer than two bins."""
    spread = F.var_pop("prob_pred")
    slope = F.when((F.count(F.lit(1)) >= 2) & (spread > 0), F.covar_pop("prob_true", "prob_pred") / F.when(spread > 0, spread))
    return calibration_curve(df, keys, score, n_bins).groupBy(*keys).agg(
        slope.alias("calib_slope"), (F.avg("prob_true") - slope * F.avg("prob_pred")).alias("calib_intercept")
    )


def _rank_correlation(bins: DataFrame, keys: Sequence[str], x: str, y: str, min_bins: int) -> DataFrame:
    """Spearman correlation over a handful of bins per group."""
    part = Window.partitionBy(*keys)

    def ranked(c: str) -> Column:
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, c)).cast("double")
        return F.rank().over(part.orderBy(c)).cast("double") + (ties - 1.0) / 2.0

    return pearson(bins.select(*keys, ranked(x).alias("_x"), ranked(y).alias("_y")), keys, "_x", "_y", min_bins)


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str, min_rows: int = 2) -> DataFrame:
    """Correlation from plain sums: exact for ranks, null without variation."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = df.filter(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(a).alias("sx"),
        F.sum(b).alias("sy"),
        F.sum(a * b).alias("sxy"),
        F.sum(a * a).alias("sxx"),
        F.sum(b * b).alias("syy"),
    )
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    r = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)
    return sums.select(*keys, F.when((n >= min_rows) & (vx > 0) & (vy > 0), r).alias("r"))


def boyce_range(df: DataFrame, keys: Sequence[str], score: str = "score", n_bins: int = 10) -> DataFrame:
    """Boyce index over equal bins between the extreme scores, expected share from the background."""
    rows = df.filter(F.col(score).isNotNull())
    ends = rows.groupBy(*keys).agg(
        F.min(score).alias("lo"),
        F.max(score).alias("hi"),
        F.sum(F.col("presence").cast("long")).alias("n_pos"),
        F.sum(1 - F.col("presence").cast("long")).alias("n_neg"),
    )
    counts = attach(score_counts(df, keys, score), ends, keys)
    at = F.expr(" + ".join(f"int(score >= {float(k)}D * ((hi - lo) / {float(n_bins)}D) + lo)" for k in range(1, n_bins)))
    bins = counts.groupBy(*keys, at.alias("bin"), "n_pos", "n_neg").agg(
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.count_if((F.col("score") > F.col("lo")) & (F.col("score") < F.col("hi"))).alias("inner"),
    )
    third = F.sum("inner").over(Window.partitionBy(*keys)) > 0
    ratio = (_d("pos") / _d("n_pos")) / (_d("neg") / _d("n_neg"))
    used = bins.select("*", third.alias("three_values")).filter("three_values AND neg > 0 AND n_pos > 0")
    found = _rank_correlation(used.withColumn("ratio", ratio), keys, "bin", "ratio", 3)
    return attach(ends.select(*keys), found, keys, "left").withColumnRenamed("r", "boyce")


def boyce_unit_edges(n_bins: int = 20, bin_width: float | None = None) -> list[tuple[float, float]]:
    """Closed bins over [0, 1]: neighbouring bins share their edge."""
    if bin_width is not None:
        centres, c = [], bin_width / 2
        i = 0
        while c < 1.0:
            centres.append(c)
            i += 1
            c = bin_width / 2 + i * bin_width
        half = bin_width / 2
    else:
        half = 1.0 / n_bins / 2
        first, last = half, 1.0 - half
        step = (last - first) / (n_bins - 1)
        centres = [first + i * step for i in range(n_bins - 1)] + [last]
    return [(c - half, c + half) for c in centres]


def boyce_unit(df: DataFrame, keys: Sequence[str], score: str = "score", n_bins: int = 20, bin_width: float | None = None) -> DataFrame:
    """Boyce index over closed bins of [0, 1], expected share from all points."""
    s = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0))
    edges = boyce_unit_edges(n_bins, bin_width)
    clipped = df.filter(F.col(score).isNotNull()).select(*keys, s.alias("_s"), "presence")
    aggs = [
        F.expr(f"count_if(_s BETWEEN {lo!r}D AND {hi!r}D{extra}) AS {n}{i}")
        for i, (lo, hi) in enumerate(edges)
        for n, extra in (("a", ""), ("p", " AND presence = 1"))
    ]
    wide = clipped.groupBy(*keys).agg(F.expr("count(1) AS n_all"), F.expr("count_if(presence = 1) AS n_pos"), *aggs)
    rows = ", ".join(f"named_struct('bin', {i}, 'n', a{i}, 'pos', p{i})" for i in range(len(edges)))
    bins = wide.selectExpr(*keys, "n_all", "n_pos", f"inline(array({rows}))")
    ratio = (_d("pos") / _d("n_pos")) / (_d("n") / _d("n_all"))
    used = bins.filter("n > 0 AND n_pos > 0").withColumn("ratio", ratio)
    found = _rank_correlation(used, keys, "bin", "ratio", 5)
    return attach(wide.select(*keys), found, keys, "left").withColumnRenamed("r", "boyce")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their frequency and average rank."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    t = running_totals(counts, keys, value, ["n"], source=df)
    rank = _d("cum_n") - _d("n") + (_d("n") + 1.0) / 2.0
    return t.select(*keys, value, "n", rank.alias("avg_rank"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks, computed on distinct value pairs."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_w"))
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = average_ranks(rows, keys, x).select(*keys, x, F.col("avg_rank").alias("_rx"))
    ry = average_ranks(rows, keys, y).select(*keys, y, F.col("avg_rank").alias("_ry"))
    # the ranks can be as many as the rows: ordinary joins, no copies
    both = pairs.join(rx, [*keys, x]).join(ry, [*keys, y])
    a, b, w = F.col("_rx"), F.col("_ry"), _d("_w")
    sums = both.groupBy(*keys).agg(
        F.sum(w).alias("n"),
        F.sum(w * a).alias("sx"),
        F.sum(w * b).alias("sy"),
        F.sum(w * a * b).alias("sxy"),
        F.sum(w * a * a).alias("sxx"),
        F.sum(w * b * b).alias("syy"),
    )
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    r = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)
    return sums.select(*keys, F.when((vx > 0) & (vy > 0), r).alias("spearman"))


def discrimination(df: DataFrame, keys: Sequence[str], limits: DataFrame, score: str = "score", roc: DataFrame | None = None) -> DataFrame:
    """AUC, average precision, TSS and F1 per group in one pass over the ROC table, which may be at hand."""
    roc = attach(roc_table(df, keys, score) if roc is None else roc, limits.select(*keys, "threshold"), keys, "left")
    hit = F.col("score") >= F.col("threshold")
    t = roc.groupBy(*keys).agg(
        _auc().alias("auc"),
        _average_precision().alias("auc_pr"),
        F.max("threshold").alias("threshold"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"),
    )
    known = F.col("threshold").isNotNull()
    return t.select(
        *keys, "auc", "auc_pr", F.when(known, tss()).alias("tss"), F.when(known, f1()).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("n_pos"), (F.col("fp") + F.col("tn")).alias("n_neg"),
    )


def fold_metrics(df: DataFrame, groups: Sequence[str], fold: str, limits: DataFrame, score: str = "score") -> DataFrame:
    """AUC and TSS per fold that holds both classes; ``limits`` may be per group or per fold."""
    keys = [*groups, fold]
    limit_keys = [k for k in keys if k in limits.columns]
    scores = df.select(*keys, F.col(score).alias("score"), "presence")
    roc = attach(roc_table(scores, keys), limits.select(*limit_keys, "threshold"), limit_keys, "left")
    hit = F.col("score") >= F.col("threshold")
    t = roc.groupBy(*keys).agg(
        _auc().alias("auc"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"),
    )
    return t.filter("tp + fn > 0 AND fp + tn > 0").select(*keys, "auc", tss().alias("tss"))


def cross_fold_metrics(df: DataFrame, groups: Sequence[str], fold: str, folds: Sequence[int], score: str = "score") -> DataFrame:
    """AUC and TSS per fold that holds both classes, at the threshold of the largest TSS (the highest one on ties) in the other folds.

    A distinct score is one row with counts per fold, so training and held-out rows come from one table of running totals.
    A fold without rows outside it has no threshold and is left out.
    """
    y = F.col("presence").cast("long")
    rows = df.filter(F.col(score).isNotNull()).select(*groups, F.col(score).alias("score"), y.alias("_y"), F.col(fold).alias("_fold"))
    names = [f"{c}_{i}" for i in range(len(folds)) for c in ("pos", "neg")]
    inside = lambda f, value: F.sum(F.when(F.col("_fold") == f, value).otherwise(0))
    counts = rows.groupBy(*groups, "score").agg(
        *[c for i, f in enumerate(folds) for c in (inside(f, F.col("_y")).alias(f"pos_{i}"), inside(f, 1 - F.col("_y")).alias(f"neg_{i}"))]
    )
    roc = running_totals(counts, groups, "score", names, source=rows)
    roc = roc.withColumns({f"at_{n}": F.col(f"tot_{n}") - F.col(f"cum_{n}") + F.col(n) for n in names})

    def outside(prefix: str, label: str, i: int) -> Column:
        return sum((F.col(f"{prefix}{label}_{k}") for k in range(len(folds)) if k != i), F.lit(0))

    aggs = []
    for i in range(len(folds)):
        big = lambda c: c.cast("decimal(18,0)")  # noqa: E731  exact, so that ties are real ties
        lead = big(outside("at_", "pos", i)) * big(outside("tot_", "neg", i)) - big(outside("at_", "neg", i)) * big(outside("tot_", "pos", i))
        best = F.struct(lead.alias("lead"), F.col("score"), F.col(f"at_pos_{i}").alias("tp"), F.col(f"at_neg_{i}").alias("fp"))
        known = outside("", "pos", i) + outside("", "neg", i) > 0
        aggs += [
            F.max(F.when(known, best)).alias(f"best_{i}"),
            F.sum(_d(f"pos_{i}") * (_d(f"cum_neg_{i}") - _d(f"neg_{i}") / 2.0)).alias(f"area_{i}"),
            F.max(f"tot_pos_{i}").alias(f"p_{i}"),
            F.max(f"tot_neg_{i}").alias(f"n_{i}"),
        ]
    wide = roc.groupBy(*groups).agg(*aggs)
    each = [
        F.struct(F.lit(f).alias(fold), *[F.col(f"{c}_{i}").alias(c) for c in ("best", "area", "p", "n")]) for i, f in enumerate(folds)
    ]
    t = wide.select(*groups, F.inline(F.array(*each))).filter("p > 0 AND n > 0 AND best IS NOT NULL")
    hit = lambda c: F.when(F.col("best.lead") > 0, F.col(f"best.{c}")).otherwise(F.lit(0))
    t = t.withColumns({"tp": hit("tp"), "fp": hit("fp")}).withColumns({"fn": F.col("p") - F.col("tp"), "tn": F.col("n") - F.col("fp")})
    return t.select(*groups, fold, (F.col("area") / (_d("p") * _d("n"))).alias("auc"), tss().alias("tss"))


def fold_summary(per_fold: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean and population spread over folds."""
    return per_fold.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("auc").alias("auc_mean"),
        F.stddev_pop("auc").alias("auc_sd"),
        F.avg("tss").alias("tss_mean"),
        F.stddev_pop("tss").alias("tss_sd"),
    )


def regional(df: DataFrame, keys: Sequence[str], limits: DataFrame, region: str, score: str = "score", min_rows: int = 10) -> DataFrame:
    """Discrimination per region with enough rows and both classes."""
    groups = [*keys, region]
    per_region = attach(df.select(*groups).distinct(), limits, keys)
    t = discrimination(df, groups, per_region, score).filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    t = t.withColumn("n", F.col("n_pos") + F.col("n_neg")).filter(F.col("n") >= min_rows)
    return t.select(*groups, "n", "tss", "auc")


def region_column(df: DataFrame) -> str | None:
    return next((c for c in ("continent", "region", "country") if c in df.columns), None)


def metric_means(metrics: DataFrame) -> DataFrame:
    """Mean of each metric over species from the long table, nulls left out."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def compare_models(metrics: DataFrame, against: str = "ensemble") -> DataFrame:
    """Mean of a metric per algorithm and how often ``against`` is at least as good."""
    ours = metrics.filter(F.col("algo") == against).select("species", "metric", F.col("value").alias("ours"))
    both = metrics.filter(F.col("algo") != against).join(ours, ["species", "metric"])
    return both.groupBy("algo", "metric").agg(
        F.avg("value").alias("mean_algo"),
        F.avg("ours").alias("mean_ours"),
        F.count_if(F.col("ours") >= F.col("value")).alias("n_ours_at_least"),
        F.count(F.lit(1)).alias("n_species"),
    )


def by_boyce(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.coalesce(F.col("boyce"), F.lit(-1.0)).desc(), "species")


ALGORITHMS = S.ALGORITHMS
