"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.operators import ensemble as E
from habitspark.operators import metrics as M
from habitspark.suite import views as V
from habitspark.suite.registry import query
from habitspark.suite.views import with_views

K = ["species", "algo"]
KF = ["species", "algo", "cv_fold"]
R6 = 6

COUNTS = """counts AS (SELECT species, algo, score, sum(presence)::BIGINT AS pos, sum(1 - presence)::BIGINT AS neg
  FROM scored_long GROUP BY 1, 2, 3)"""
ROC = """roc AS (SELECT *, tot_pos - cum_pos + pos AS tp, tot_neg - cum_neg + neg AS fp FROM (
  SELECT *, (sum(pos) OVER run)::BIGINT AS cum_pos, (sum(neg) OVER run)::BIGINT AS cum_neg,
         (sum(pos) OVER grp)::BIGINT AS tot_pos, (sum(neg) OVER grp)::BIGINT AS tot_neg FROM counts
  WINDOW run AS (PARTITION BY species, algo ORDER BY score), grp AS (PARTITION BY species, algo)))"""
LONG = [V.SCORED_LONG, COUNTS, ROC]


def rounded(df, *skip):
    return df.withColumns({n: F.round(n, R6) for n, t in df.dtypes if t == "double" and n not in skip})


def auc_sql(keys: str, source: str = "scored_long") -> str:
    """AUC from average ranks of the presences."""
    return f"""SELECT {keys}, CASE WHEN max(p) > 0 AND max(n) > 0 THEN
      (sum(CASE WHEN presence = 1 THEN r ELSE 0 END) - max(p) * (max(p) + 1) / 2.0::DOUBLE) / (max(p) * max(n)) END AS auc FROM (
      SELECT {keys}, presence, rank() OVER (PARTITION BY {keys} ORDER BY score)::DOUBLE
             + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0::DOUBLE AS r,
             (sum(presence) OVER (PARTITION BY {keys}))::DOUBLE AS p,
             (sum(1 - presence) OVER (PARTITION BY {keys}))::DOUBLE AS n FROM {source}) GROUP BY {keys}"""


FOLD_AUC = f"fold_auc AS ({auc_sql('species, algo, cv_fold')})"


@query("m_auc", with_views([V.SCORED_LONG, FOLD_AUC], "SELECT species, algo, cv_fold, round(auc, 6) AS auc FROM fold_auc"))
def m_auc(spark, d):
    return rounded(M.auc(V.scored_long(spark, d), KF))


@query("m_auc_pr", with_views(LONG, "SELECT species, algo, round(sum(pos / tot_pos::DOUBLE * (tp / (tp + fp)::DOUBLE)), 6) AS auc_pr FROM roc GROUP BY 1, 2"))
def m_auc_pr(spark, d):
    return rounded(M.average_precision(V.scored_long(spark, d), K))


CONFUSION = """cm AS (SELECT species, algo, count(*) FILTER (presence = 1 AND score >= 0.5) AS tp,
  count(*) FILTER (presence = 0 AND score >= 0.5) AS fp, count(*) FILTER (presence = 1 AND score < 0.5) AS fn,
  count(*) FILTER (presence = 0 AND score < 0.5) AS tn FROM scored_long GROUP BY 1, 2)"""


@query(
    "m_confusion_tss",
    with_views([V.SCORED_LONG, CONFUSION], "SELECT species, algo, tp, fp, fn, tn, round(tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE - 1, 6) AS tss FROM cm"),
)
def m_confusion_tss(spark, d):
    s = V.scored_long(spark, d)
    limits = s.select(*K).distinct().withColumn("threshold", F.lit(0.5))
    return rounded(M.confusion(s, limits, K).drop("f1", "omission"))


@query("m_f1", with_views([V.SCORED_LONG, CONFUSION], "SELECT species, algo, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM cm"))
def m_f1(spark, d):
    s = V.scored_long(spark, d)
    limits = s.select(*K).distinct().withColumn("threshold", F.lit(0.5))
    return rounded(M.confusion(s, limits, K).select(*K, "f1"))


BEST_HIGH = """best AS (SELECT species, algo, score, lead, tot_pos * tot_neg AS pn FROM (
  SELECT *, tp * tot_neg - fp * tot_pos AS lead, row_number() OVER (PARTITION BY species, algo
  ORDER BY tp * tot_neg - fp * tot_pos DESC, score DESC) AS rn FROM roc) WHERE rn = 1)"""
BEST_LOW = BEST_HIGH.replace("score DESC", "score ASC").replace("best AS", "best_low AS")


@query("m_maxtss_roc", with_views([*LONG, BEST_HIGH], "SELECT species, algo, CASE WHEN lead > 0 THEN score ELSE 'inf'::DOUBLE END AS threshold, round(CASE WHEN lead > 0 THEN lead / pn::DOUBLE ELSE 0 END, 6) AS tss FROM best"))
def m_maxtss_roc(spark, d):
    return rounded(M.max_tss_roc(V.scored_long(spark, d), K), "threshold")


@query("m_maxtss_sweep", with_views([*LONG, BEST_LOW], "SELECT species, algo, score AS threshold, round(lead / pn::DOUBLE, 6) AS tss FROM best_low"))
def m_maxtss_sweep(spark, d):
    return rounded(M.max_tss_sweep(V.scored_long(spark, d), K), "threshold")


THRESHOLDS = """limits AS (SELECT b.species, b.algo, b.score AS "maxTSS", p.p10, p.min_train FROM best_low b JOIN (
  SELECT species, algo, quantile_cont(score, 0.1) AS p10, min(score) AS min_train FROM scored_long WHERE presence = 1 GROUP BY 1, 2) p
  USING (species, algo))"""


@query("m_thresholds", with_views([*LONG, BEST_LOW, THRESHOLDS], 'SELECT species, algo, round("maxTSS", 6) AS "maxTSS", round(p10, 6) AS p10, round(min_train, 6) AS min_train FROM limits'))
def m_thresholds(spark, d):
    return rounded(M.thresholds(V.scored_long(spark, d), K))


@query(
    "m_omission_or10",
    with_views(
        [V.SCORED_LONG],
        """SELECT species, algo, round(p10, 6) AS p10, round(count(*) FILTER (score < p10) / count(*)::DOUBLE, 6) AS or10 FROM
        (SELECT *, quantile_cont(score, 0.1) OVER (PARTITION BY species, algo) AS p10 FROM scored_long WHERE presence = 1)
        GROUP BY species, algo, p10""",
    ),
)
def m_omission_or10(spark, d):
    return rounded(M.omission_p10(V.scored_long(spark, d), K))


@query("m_brier", with_views([V.SCORED_LONG], "SELECT species, algo, round(avg((least(greatest(score, 0), 1) - presence) * (least(greatest(score, 0), 1) - presence)), 6) AS brier FROM scored_long GROUP BY 1, 2"))
def m_brier(spark, d):
    return rounded(M.brier(V.scored_long(spark, d), K))


CURVE = (
    "curve AS (SELECT species, algo, "
    + " + ".join(f"CAST(p > {k} * CAST(0.1 AS DOUBLE) AS INTEGER)" for k in range(1, 10))
    + """ AS bin, count(*) AS n, avg(presence) AS prob_true, avg(p) AS prob_pred
  FROM (SELECT *, least(greatest(score, 0), 1) AS p FROM scored_long) GROUP BY 1, 2, 3)"""
)


@query("m_calibration_curve", with_views([V.SCORED_LONG, CURVE], "SELECT species, algo, bin, n, round(prob_true, 6) AS prob_true, round(prob_pred, 6) AS prob_pred FROM curve"))
def m_calibration_curve(spark, d):
    return rounded(M.calibration_curve(V.scored_long(spark, d), K))


@query("m_calibration_line", with_views([V.SCORED_LONG, CURVE], "SELECT species, algo, round(regr_slope(prob_true, prob_pred), 6) AS calib_slope, round(regr_intercept(prob_true, prob_pred), 6) AS calib_intercept FROM curve GROUP BY 1, 2"))
def m_calibration_line(spark, d):
    return rounded(M.calibration_line(V.scored_long(spark, d), K))


RANKED = """ranked AS (SELECT *, rank() OVER (PARTITION BY species, algo ORDER BY ratio)::DOUBLE
  + (count(*) OVER (PARTITION BY species, algo, ratio) - 1) / 2.0::DOUBLE AS ry,
  rank() OVER (PARTITION BY species, algo ORDER BY bin)::DOUBLE AS rx FROM ratios)"""
BOYCE_OUT = """SELECT g.species, g.algo, round(r, 6) AS boyce FROM (SELECT DISTINCT species, algo FROM scored_long) g LEFT JOIN (
  SELECT species, algo, CASE WHEN count(*) >= {least} AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS r
  FROM ranked GROUP BY 1, 2) USING (species, algo)"""
BOYCE_RANGE = (
    """ends AS (SELECT species, algo, min(score) AS lo, max(score) AS hi, sum(presence)::DOUBLE AS np, sum(1 - presence)::DOUBLE AS nb,
  count(DISTINCT score) AS nd FROM scored_long GROUP BY 1, 2),
bins AS (SELECT species, algo, np, nb, """
    + " + ".join(f"CAST(score >= {k}::DOUBLE * ((hi - lo) / 10::DOUBLE) + lo AS INTEGER)" for k in range(1, 10))
    + """ AS bin, sum(presence)::DOUBLE AS pos, sum(1 - presence)::DOUBLE AS neg
  FROM scored_long JOIN ends USING (species, algo) WHERE nd >= 3 GROUP BY 1, 2, 3, 4, 5),
ratios AS (SELECT *, (pos / np) / (neg / nb) AS ratio FROM bins WHERE neg > 0)"""
)


@query("m_boyce_v4", with_views([V.SCORED_LONG, BOYCE_RANGE, RANKED], BOYCE_OUT.format(least=3)))
def m_boyce_v4(spark, d):
    return rounded(M.boyce_range(V.scored_long(spark, d), K))


BOYCE_UNIT = (
    "unit_bins(bin, lo, hi) AS (VALUES "
    + ", ".join(f"({i}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for i, (lo, hi) in enumerate(M.boyce_unit_edges()))
    + """),
totals AS (SELECT species, algo, sum(presence)::DOUBLE AS np, count(*)::DOUBLE AS na FROM scored_long GROUP BY 1, 2),
ratios AS (SELECT species, algo, bin, (sum(presence) / max(np)) / (count(*) / max(na)) AS ratio
  FROM scored_long JOIN totals USING (species, algo) JOIN unit_bins ON least(greatest(score, 0), 1) BETWEEN lo AND hi GROUP BY 1, 2, 3)"""
)


@query("m_boyce_cbi", with_views([V.SCORED_LONG, BOYCE_UNIT, RANKED], BOYCE_OUT.format(least=5)))
def m_boyce_cbi(spark, d):
    return rounded(M.boyce_unit(V.scored_long(spark, d), K))


@query(
    "m_avg_rank",
    with_views(
        [V.SCORED_LONG],
        """SELECT DISTINCT species, algo, score, count(*) OVER (PARTITION BY species, algo, score) AS n,
        rank() OVER (PARTITION BY species, algo ORDER BY score) + (count(*) OVER (PARTITION BY species, algo, score) - 1) / 2.0::DOUBLE AS avg_rank
        FROM scored_long WHERE algo <> 'maxent'""",
    ),
)
def m_avg_rank(spark, d):
    return M.average_ranks(V.scored_long(spark, d).filter("algo <> 'maxent'"), K, "score")


@query(
    "m_spearman",
    with_views(
        [V.SCORED],
        """SELECT species, round(corr(rx, ry), 6) AS spearman FROM (SELECT species,
        rank() OVER (PARTITION BY species ORDER BY glm) + (count(*) OVER (PARTITION BY species, glm) - 1) / 2.0::DOUBLE AS rx,
        rank() OVER (PARTITION BY species ORDER BY gam) + (count(*) OVER (PARTITION BY species, gam) - 1) / 2.0::DOUBLE AS ry
        FROM scored) GROUP BY species""",
    ),
)
def m_spearman(spark, d):
    return rounded(M.spearman(V.scored(spark, d), ["species"], "glm", "gam"))


MEAN5 = "((glm + gam + rf + gbm + maxent) / 5::DOUBLE)"
SPREAD = (
    "spread AS (SELECT species, sqrt(("
    + " + ".join(f"({a} - {MEAN5}) * ({a} - {MEAN5})" for a in S.ALGORITHMS)
    + ") / 4::DOUBLE) AS sd FROM scored)"
)


@query("m_algo_sd", with_views([V.SCORED, SPREAD], "SELECT species, round(avg(sd), 6) AS algo_sd_mean, round(median(sd), 6) AS algo_sd_median FROM spread GROUP BY species"))
def m_algo_sd(spark, d):
    return rounded(E.algorithm_spread(V.scored(spark, d), ["species"]))


CALLS = " + ".join(f"coalesce(CAST({a} >= 0.5 AS INTEGER), 0)" for a in S.ALGORITHMS)


@query(
    "m_binary_agreement",
    with_views([V.SCORED], f"""SELECT species, round(avg({CALLS}), 6) AS agreement_mean, 5 AS agreement_max,
    round(count(*) FILTER ({CALLS} = 5) * 100::DOUBLE / count(*), 6) AS unanimous_pct FROM scored GROUP BY species"""),
)
def m_binary_agreement(spark, d):
    s = V.scored(spark, d)
    limits = s.select("species").distinct().withColumn("threshold", F.lit(0.5))
    return rounded(E.agreement(s, limits, ["species"]))


TRAIN_BEST = """fold_counts AS (SELECT f.cv_fold, s.species, s.algo, s.score, sum(s.presence)::BIGINT AS pos, sum(1 - s.presence)::BIGINT AS neg
  FROM scored_long s, (SELECT DISTINCT cv_fold FROM scored_long) f WHERE s.cv_fold <> f.cv_fold GROUP BY 1, 2, 3, 4),
fold_roc AS (SELECT *, tot_pos - cum_pos + pos AS tp, tot_neg - cum_neg + neg AS fp FROM (
  SELECT *, (sum(pos) OVER run)::BIGINT AS cum_pos, (sum(neg) OVER run)::BIGINT AS cum_neg,
         (sum(pos) OVER grp)::BIGINT AS tot_pos, (sum(neg) OVER grp)::BIGINT AS tot_neg FROM fold_counts
  WINDOW run AS (PARTITION BY species, algo, cv_fold ORDER BY score), grp AS (PARTITION BY species, algo, cv_fold))),
train_best AS (SELECT species, algo, cv_fold, CASE WHEN lead > 0 THEN score ELSE 'inf'::DOUBLE END AS threshold FROM (
  SELECT *, tp * tot_neg - fp * tot_pos AS lead, row_number() OVER (PARTITION BY species, algo, cv_fold
  ORDER BY tp * tot_neg - fp * tot_pos DESC, score DESC) AS rn FROM fold_roc) WHERE rn = 1),
fold_tss AS (SELECT s.species, s.algo, s.cv_fold,
  count(*) FILTER (presence = 1 AND score >= threshold) / (count(*) FILTER (presence = 1))::DOUBLE
  + count(*) FILTER (presence = 0 AND score < threshold) / (count(*) FILTER (presence = 0))::DOUBLE - 1 AS tss
  FROM scored_long s JOIN train_best USING (species, algo, cv_fold) GROUP BY 1, 2, 3
  HAVING count(*) FILTER (presence = 1) > 0 AND count(*) FILTER (presence = 0) > 0)"""
WEIGHTS = """cv AS (SELECT species, algo, avg(tss) AS cv_tss FROM fold_tss GROUP BY 1, 2),
weights AS (SELECT species, algo, cv_tss, CASE WHEN sum(greatest(cv_tss, 0)) OVER (PARTITION BY species) = 0 THEN 1
  ELSE greatest(cv_tss, 0) END AS weight FROM cv)"""


def fold_table(spark, d):
    """AUC and TSS per fold, at the threshold of the rows outside it."""
    return M.cross_fold_metrics(V.scored_long(spark, d), K, "cv_fold", range(S.N_FOLDS))


@query("ag_fold_tss", with_views([V.SCORED_LONG, TRAIN_BEST, FOLD_AUC], "SELECT species, algo, cv_fold, round(auc, 6) AS auc, round(tss, 6) AS tss FROM fold_tss JOIN fold_auc USING (species, algo, cv_fold)"))
def ag_fold_tss(spark, d):
    """Held-out TSS at the threshold of the training folds."""
    return rounded(fold_table(spark, d))


@query("m_tss_weights", with_views([V.SCORED_LONG, TRAIN_BEST, WEIGHTS], "SELECT species, algo, round(cv_tss, 6) AS cv_tss, round(weight, 6) AS weight FROM weights"))
def m_tss_weights(spark, d):
    return rounded(E.tss_weights(fold_table(spark, d)))


@query(
    "m_tss_weights_equal",
    with_views(
        [V.SCORED_LONG, TRAIN_BEST, WEIGHTS],
        """SELECT species, algo, round(cv_tss, 6) AS cv_tss, round(CASE WHEN g = 0 THEN 1::DOUBLE / n ELSE CAST(cv_tss >= 0.01 AS INTEGER) / g::DOUBLE END, 6) AS weight
        FROM (SELECT *, sum(CAST(cv_tss >= 0.01 AS INTEGER)) OVER (PARTITION BY species) AS g, count(*) OVER (PARTITION BY species) AS n FROM cv)""",
    ),
)
def m_tss_weights_equal(spark, d):
    return rounded(E.equal_weights_above(fold_table(spark, d), limit=0.01))


ENS = (
    "wide_w AS (SELECT species, "
    + ", ".join(f"max(CASE WHEN algo = '{a}' THEN weight END) AS w_{a}" for a in S.ALGORITHMS)
    + " FROM weights GROUP BY species),\nens AS (SELECT s.*, ("
    + " + ".join(f"coalesce(w_{a} * {a}, 0)" for a in S.ALGORITHMS)
    + ") / nullif("
    + " + ".join(f"CASE WHEN {a} IS NULL THEN 0 ELSE w_{a} END" for a in S.ALGORITHMS)
    + ", 0) AS ensemble FROM scored s JOIN wide_w USING (species))"
)


@query("m_ensemble_score", with_views([V.SCORED_LONG, TRAIN_BEST, WEIGHTS, ENS], "SELECT species, cv_fold, presence, round(ensemble, 6) AS ensemble FROM ens"))
def m_ensemble_score(spark, d):
    e = E.with_ensemble(V.scored(spark, d), E.tss_weights(fold_table(spark, d)))
    return rounded(e.select("species", "cv_fold", "presence", "ensemble"))


@query(
    "jn_weights_lookup",
    with_views(
        [V.OCC, V.SCORED_LONG, TRAIN_BEST, WEIGHTS],
        """SELECT o.species, a.algo, round(coalesce(w.weight, 0), 6) AS weight FROM (SELECT DISTINCT species FROM occ) o,
        (VALUES ('glm'), ('gam'), ('rf'), ('gbm'), ('maxent')) AS a(algo) LEFT JOIN weights w ON w.species = o.species AND w.algo = a.algo AND w.algo <> 'rf'""",
    ),
)
def jn_weights_lookup(spark, d):
    w = E.tss_weights(fold_table(spark, d)).filter("algo <> 'rf'")
    return rounded(E.lookup_weights(V.occ(spark, d), w))


@query(
    "ag_fold_mean_sd",
    with_views(
        [V.SCORED_LONG, FOLD_AUC],
        """SELECT species, algo, count(*) AS n_folds, round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_sd,
        round(avg(tss), 6) AS tss_mean, round(stddev_pop(tss), 6) AS tss_sd FROM fold_auc JOIN (
        SELECT species, algo, cv_fold, count(*) FILTER (presence = 1 AND score >= 0.5) / (count(*) FILTER (presence = 1))::DOUBLE
        + count(*) FILTER (presence = 0 AND score < 0.5) / (count(*) FILTER (presence = 0))::DOUBLE - 1 AS tss
        FROM scored_long GROUP BY 1, 2, 3 HAVING min(presence) < max(presence)) USING (species, algo, cv_fold) GROUP BY 1, 2""",
    ),
)
def ag_fold_mean_sd(spark, d):
    s = V.scored_long(spark, d)
    limits = s.select(*K).distinct().withColumn("threshold", F.lit(0.5))
    return rounded(M.fold_summary(M.fold_metrics(s, K, "cv_fold", limits), K))


REGIONAL_SRC = """regions AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'east' ELSE 'west' END || CAST(l_linenumber AS VARCHAR) AS region,
  'Sp ' || lpad(CAST(l_suppkey % 16 AS VARCHAR), 2, '0') AS species, CAST(l_returnflag = 'R' AS INTEGER) AS presence,
  l_quantity / 50::DOUBLE AS score FROM lineitem)"""


@query(
    "ag_regional",
    with_views(
        [REGIONAL_SRC, f"region_auc AS ({auc_sql('species, region', 'regions')})"],
        """SELECT species, region, n, round(tss, 6) AS tss, round(auc, 6) AS auc FROM region_auc JOIN (
        SELECT species, region, count(*) AS n, count(*) FILTER (presence = 1 AND score >= 0.5) / (count(*) FILTER (presence = 1))::DOUBLE
        + count(*) FILTER (presence = 0 AND score < 0.5) / (count(*) FILTER (presence = 0))::DOUBLE - 1 AS tss FROM regions
        GROUP BY 1, 2 HAVING count(*) >= 10 AND min(presence) < max(presence)) USING (species, region)""",
    ),
)
def ag_regional(spark, d):
    li = V.table(spark, d, "lineitem")
    side = F.when(F.col("l_linestatus") == "O", "east").otherwise("west")
    s = li.select(
        V.species_name(F.col("l_suppkey") % 16).alias("species"),
        F.concat(side, F.col("l_linenumber").cast("string")).alias("region"),
        (F.col("l_returnflag") == "R").cast("int").alias("presence"),
        (F.col("l_quantity") / 50.0).alias("score"),
    )
    limits = s.select("species").distinct().withColumn("threshold", F.lit(0.5))
    return rounded(M.regional(s, ["species"], limits, M.region_column(s)))


AUC_ALL = f"all_auc AS ({auc_sql('species, algo')})"


def auc_table(spark, d):
    """AUC (species, algo, metric, value) of the algorithms and their ensemble."""
    s = V.scored(spark, d)
    e = E.with_ensemble(s, E.tss_weights(fold_table(spark, d)))
    long = e.unpivot(["species", "presence"], [*S.ALGORITHMS, "ensemble"], "algo", "score").filter("score IS NOT NULL")
    return M.auc(long, K).select(*K, F.lit("auc").alias("metric"), F.col("auc").alias("value"))


@query("ag_metric_means", with_views([*LONG, BEST_HIGH, AUC_ALL], "SELECT 'auc' AS metric, round(avg(auc), 6) AS mean, count(auc) AS n FROM all_auc UNION ALL SELECT 'tss', round(avg(greatest(lead, 0) / pn::DOUBLE), 6), count(*) FROM best"))
def ag_metric_means(spark, d):
    s = V.scored_long(spark, d)
    m = M.discrimination(s, K, M.max_tss_roc(s, K)).unpivot(K, ["auc", "tss"], "metric", "value")
    return rounded(M.metric_means(m))


@query(
    "m_compare_models",
    with_views(
        [V.SCORED_LONG, TRAIN_BEST, WEIGHTS, ENS,
         "with_ens AS (SELECT species, algo, presence, score FROM scored_long UNION ALL SELECT species, 'ensemble', presence, ensemble FROM ens WHERE ensemble IS NOT NULL)",
         f"ens_auc AS ({auc_sql('species, algo', 'with_ens')})"],
        """SELECT a.algo, 'auc' AS metric, round(avg(a.auc), 6) AS mean_algo, round(avg(e.auc), 6) AS mean_ours,
        count(*) FILTER (e.auc >= a.auc) AS n_ours_at_least, count(*) AS n_species FROM ens_auc a JOIN ens_auc e
        ON a.species = e.species AND e.algo = 'ensemble' WHERE a.algo <> 'ensemble' GROUP BY a.algo""",
    ),
)
def m_compare_models(spark, d):
    return rounded(M.compare_models(auc_table(spark, d)))


@query(
    "w_sort_metric",
    with_views([V.SCORED_LONG, BOYCE_UNIT, RANKED], f"SELECT species, boyce FROM ({BOYCE_OUT.format(least=5)}) WHERE algo = 'gam'"),
)
def w_sort_metric(spark, d):
    b = M.boyce_unit(V.scored_long(spark, d), K).filter("algo = 'gam'")
    return rounded(M.by_boyce(b.select("species", "boyce")))
