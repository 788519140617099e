"""Boosted trees grown leaf by leaf from histograms, for many species and folds at once.

Models are independent, so they are the unit of work: the rows of one model meet in one task if they are at most
``habitspark.window.maxGroupRows``; a species beyond that gets no model here and is reported, so that the caller can fit it on
distributed rows (``models.fit``). Rows are scored where they are by models sent along, if these are few
(``habitspark.broadcast.maxBytes``), else in slices of bounded size next to the models of their species.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.plans.scale import attach, broadcast_bytes_limit, group_rows_limit, scored_in_place, stored

# Settings of the published model that its tuning does not name, and its defaults for those it does.
SETTINGS: dict[str, Any] = {
    "rounds": 400, "learning_rate": 0.1, "num_leaves": 31, "min_child_samples": 20, "reg_lambda": 0.0, "colsample_bytree": 1.0, "subsample": 1.0,
}
LEAST_CURVATURE = 1e-3
BINS = 255
SLICE_ROWS = 100_000
MOST_TASKS = 10_000
NODE_BYTES = 28

MODELS = (
    "species string, held_out int, n_pres long, n_bg long, base double, feature array<int>, threshold array<double>, below array<int>, above array<int>, "
    "value array<double>, roots array<int>, status string"
)


def bin_edges(v: np.ndarray, most: int = BINS) -> np.ndarray:
    """Upper limits of bins: between neighbouring values if these are few, else at quantiles."""
    distinct = np.unique(v)
    if len(distinct) > most:
        distinct = np.unique(np.quantile(v, np.linspace(0, 1, most + 1)))
    return (distinct[1:] + distinct[:-1]) / 2


def histogram(codes: np.ndarray, width: int, *weights: np.ndarray) -> np.ndarray:
    """Sums of each weight per feature and bin; ``codes`` has one column a feature."""
    return np.array([[np.bincount(c, w, width) for c in codes.T] for w in weights])


def best_split(h: np.ndarray, lam: float, least: float, allowed: np.ndarray) -> tuple[float, int, int]:
    """Gain, feature and last bin below of the best split of a histogram (gradient, curvature, rows); gain 0 if none."""
    low = np.cumsum(h, axis=2)[:, :, :-1]
    total = h[:, :1].sum(axis=2, keepdims=True)
    high = total - low
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = low[0] ** 2 / (low[1] + lam) + high[0] ** 2 / (high[1] + lam) - total[0] ** 2 / (total[1] + lam)
    ok = (low[2] >= least) & (high[2] >= least) & (low[1] >= LEAST_CURVATURE) & (high[1] >= LEAST_CURVATURE) & allowed[:, None]
    gain = np.where(ok, gain, 0.0)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def grow(codes: np.ndarray, width: int, g: np.ndarray, h: np.ndarray, rows: np.ndarray, allowed: np.ndarray, q: Mapping[str, Any]) -> tuple[list[list], list[tuple]]:
    """One tree: nodes [feature, bin, below, above, value] and its leaves (node, rows).

    The leaf with the largest gain is split until there are ``num_leaves``; of two siblings, one histogram is a difference.
    """
    by_feature = codes.T

    def sums(r: np.ndarray) -> np.ndarray:
        own = np.stack([c[r] for c in by_feature]).T  # a column in one piece is read fastest
        return histogram(own, width, g[r], h[r], np.ones(len(r)))

    nodes: list[list] = [[-1, 0, -1, -1, 0.0]]
    first = sums(rows)
    leaves = [(best_split(first, q["reg_lambda"], q["min_child_samples"], allowed), 0, rows, first)]
    while len(leaves) < q["num_leaves"]:
        k = max(range(len(leaves)), key=lambda i: leaves[i][0][0])
        (gain, feature, last), node, own, table = leaves[k]
        if gain <= 1e-12:
            break
        under = codes[own, feature] <= last
        sides = [own[under], own[~under]]
        small = int(len(sides[1]) < len(sides[0]))
        tables = [None, None]
        tables[small] = sums(sides[small])
        tables[1 - small] = table - tables[small]
        nodes[node][:4] = [feature, last, len(nodes), len(nodes) + 1]
        new = []
        for side, t in zip(sides, tables):
            new.append((best_split(t, q["reg_lambda"], q["min_child_samples"], allowed), len(nodes), side, t))
            nodes.append([-1, 0, -1, -1, 0.0])
        leaves[k : k + 1] = new
    for _, node, own, _ in leaves:
        nodes[node][4] = -q["learning_rate"] * g[own].sum() / (h[own].sum() + q["reg_lambda"] + 1e-300)
    return nodes, [(node, own) for _, node, own, _ in leaves]


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, q: Mapping[str, Any], seed: int = S.SEED) -> dict[str, Any]:
    """Trees of one model as flat arrays; rows and features of a round are drawn with a fixed seed."""
    draw = np.random.default_rng(seed)
    edges = [bin_edges(x[:, k]) for k in range(x.shape[1])]
    codes = np.array([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)]).T  # columns in one piece
    width = max(1, *(len(e) for e in edges)) + 1  # constant predictors have one bin
    share = (w * y).sum() / w.sum()
    base = math.log(share / (1 - share))
    score = np.full(len(y), base)
    flat: list[list] = []
    roots = []
    for _ in range(int(q["rounds"])):
        mu = 1 / (1 + np.exp(-score))
        g, h = w * (mu - y), w * mu * (1 - mu)
        rows = np.arange(len(y)) if q["subsample"] >= 1 else np.sort(draw.choice(len(y), max(1, int(q["subsample"] * len(y))), replace=False))
        allowed = np.ones(x.shape[1], bool)
        if q["colsample_bytree"] < 1:
            allowed[:] = False
            allowed[draw.choice(x.shape[1], max(1, round(q["colsample_bytree"] * x.shape[1])), replace=False)] = True
        nodes, leaves = grow(codes, width, g, h, rows, allowed, q)
        if len(leaves) == 1:
            if q["subsample"] >= 1 and q["colsample_bytree"] >= 1:
                break  # nothing left to split, and no later round would differ
            continue
        at = len(flat)
        roots.append(at)
        flat += [[f, edges[f][b] if f >= 0 else 0.0, below + at, above + at, v] for f, b, below, above, v in nodes]
        if len(rows) == len(y):
            for node, own in leaves:
                score[own] += nodes[node][4]
        else:
            score += _walk(x, *_arrays(flat[at:], at), np.zeros(1, np.int64))
    feature, threshold, below, above, value = [list(c) for c in zip(*flat)] if flat else [[] for _ in range(5)]
    return {"base": base, "feature": feature, "threshold": threshold, "below": below, "above": above, "value": value, "roots": roots}


def _arrays(nodes: Sequence[Sequence], at: int) -> tuple[np.ndarray, ...]:
    f, t, below, above, v = (np.array(c) for c in zip(*nodes))
    return f, t, below - at, above - at, v


def _walk(x: np.ndarray, feature, threshold, below, above, value, roots) -> np.ndarray:
    """Sum of the leaves that each row reaches, all trees one after another over whole columns."""
    out = np.zeros(len(x))
    for root in roots:
        at = np.full(len(x), root)
        while True:
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            node = at[inner]
            at[inner] = np.where(x[inner, f[inner]] <= threshold[node], below[node], above[node])
        out += value[at]
    return out


# lowest bit of a word of so many bits: multiplied and shifted, it is the number of that bit in an order of its own
WORDS = {32: (np.uint32, 0x077CB531, 27), 64: (np.uint64, 0x03F79D71B4CB0A89, 58)}
CHUNK = 16_384


class Scorer:
    """Trees of a model as words of bits: a bit stands for a leaf, and a row loses those it cannot reach.

    Of each predictor, the bin of a row gives the leaves left by all splits on it; the first leaf that all predictors leave is
    the one the row reaches. Trees with more than 64 leaves are walked instead. Both add the same values in the same order.
    """

    def __init__(self, m: Mapping[str, Any]) -> None:
        self.base = m["base"]
        self.nodes = [np.asarray(m[c]) for c in ("feature", "threshold", "below", "above", "value", "roots")]
        feature, threshold, below, above, value, roots = self.nodes
        self.trees: list[tuple] | None = []
        self.cuts = {int(f): np.unique(threshold[feature == f]) for f in np.unique(feature) if f >= 0} if len(feature) else {}
        ends = np.r_[roots[1:], len(feature)].astype(int) if len(roots) else []
        leaves = [int((feature[a:b] < 0).sum()) for a, b in zip(roots, ends)]
        bits = 32 if max(leaves, default=0) <= 32 else 64
        if max(leaves, default=0) > 64:
            self.trees = None
            return
        self.kind, factor, self.shift = WORDS[bits]
        self.factor = self.kind(factor)
        place = (((1 << np.arange(bits, dtype=object)) * factor % (1 << bits)) >> self.shift).astype(int)
        at = {f: np.searchsorted(self.cuts[f], threshold) for f in self.cuts}
        for root in roots:
            table: dict[int, np.ndarray] = {}
            values = np.zeros(bits)
            # from the leaves on: which leaves lie below a node, numbered from below to above
            todo, order, number = [int(root)], [], 0
            while todo:
                node = todo.pop()
                order.append(node)
                if feature[node] >= 0:
                    todo += [int(above[node]), int(below[node])]
            held: dict[int, int] = {}
            for node in order:
                if feature[node] < 0:
                    held[node] = 1 << number
                    values[place[number]] = value[node]
                    number += 1
            for node in reversed(order):
                f = int(feature[node])
                if f >= 0:
                    held[node] = held[int(below[node])] | held[int(above[node])]
                    words = table.setdefault(f, np.full(len(self.cuts[f]) + 1, (1 << bits) - 1, self.kind))
                    words[at[f][node] + 1 :] &= self.kind((1 << bits) - 1 - held[int(below[node])])
            self.trees.append((list(table.items()), values))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return 1 / (1 + np.exp(-(self.base + _walk(x, *self.nodes))))
        out = np.zeros(len(x))
        for first in range(0, len(x), CHUNK):
            some = x[first : first + CHUNK]
            codes = {f: np.searchsorted(cuts, some[:, f]) for f, cuts in self.cuts.items()}
            total, word, other, value = out[first : first + CHUNK], *(np.empty(len(some), k) for k in (self.kind, self.kind, np.float64))
            for tables, values in self.trees:
                for i, (f, words) in enumerate(tables):
                    np.take(words, codes[f], out=other if i else word, mode="clip")
                    if i:
                        np.bitwise_and(word, other, out=word)
                np.negative(word, out=other)
                np.bitwise_and(word, other, out=word)
                np.multiply(word, self.factor, out=word)
                np.right_shift(word, self.kind(self.shift), out=word)
                np.take(values, word, out=value, mode="clip")
                np.add(total, value, out=total)
        return 1 / (1 + np.exp(-(self.base + out)))


def predict(x: np.ndarray, m: Mapping[str, Any]) -> np.ndarray:
    return Scorer(m)(x)


def fit_boosted(training: DataFrame, chosen: DataFrame, names: Sequence[str], settings: Mapping[str, Any] | None = None, folds: bool = True) -> DataFrame:
    """One row per species and left-out fold (null: none), with trees as arrays and a status.

    ``training`` has species, cv_fold, presence and ``names``, complete in the predictors that ``chosen`` lists for the species.
    Presences weigh 1, background their ratio. A fold counts if it holds both classes and leaves both. Status is ok, or
    too large (no trees); a species without both classes, and an empty table, give no row.
    """
    unknown = set(settings or {}) - set(SETTINGS)
    if unknown:
        raise ValueError(f"boosting has no setting {sorted(unknown)}; it takes {sorted(SETTINGS)}")
    q = {**SETTINGS, **(settings or {})}
    names = list(names)
    limit = group_rows_limit(training.sparkSession)
    ids = ["species", "cv_fold", "presence"]
    rows = stored(training.select(*ids, *[F.col(n).cast("double").alias(n) for n in names]))
    p, b = F.count_if(F.col("presence") == 1), F.count_if(F.col("presence") == 0)
    counts = rows.groupBy("species", "cv_fold").agg(p.alias("p"), b.alias("b"))
    whole = counts.groupBy("species").agg(F.sum("p").alias("all_p"), F.sum("b").alias("all_b"))
    usable = counts.join(whole, "species").filter("p > 0 AND b > 0 AND p < all_p AND b < all_b").select("species", F.col("cv_fold").cast("int").alias("held_out"))
    wanted = whole.filter("all_p > 0 AND all_b > 0").select("species", F.lit(None).cast("int").alias("held_out"), (F.col("all_p") + F.col("all_b")).alias("n"))
    if folds:
        wanted = wanted.unionByName(usable.join(wanted.select("species", "n"), "species"))
    wanted = stored(wanted)
    own = chosen.groupBy("species").agg(F.array_sort(F.collect_set("predictor")).alias("_own"))
    fits = attach(rows, wanted.filter(F.col("n") <= limit).groupBy("species").agg(F.collect_list(F.struct("held_out")).alias("_fits")), ["species"])
    fits = attach(fits, own, ["species"]).withColumn("held_out", F.explode("_fits.held_out")).filter("held_out IS NULL OR held_out <> cv_fold")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        used = [n for n in names if n in set(frame["_own"].iloc[0])]
        x, y = frame[used].to_numpy(float), frame["presence"].to_numpy(float)
        w = np.where(y == 1, 1.0, y.sum() / (y == 0).sum())
        m = boost(x, y, w, q)
        m["feature"] = [names.index(used[f]) if f >= 0 else -1 for f in m["feature"]]
        row = {"species": frame["species"].iloc[0], "held_out": frame["held_out"].iloc[0], "n_pres": int(y.sum()), "n_bg": int((y == 0).sum()), **m, "status": "ok"}
        return pd.DataFrame([row], columns=[c.split()[0] for c in MODELS.split(", ")]).astype({"held_out": "Int32"})

    # models take long for few rows, so tasks are dealt by their number and not by bytes
    tasks = max(int(training.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(wanted.count(), MOST_TASKS))
    dealt = fits.select("species", "held_out", "presence", "_own", *names).repartition(tasks, "species", "held_out")
    fitted = dealt.groupBy("species", "held_out").applyInPandas(fit, MODELS)
    missing = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in MODELS.split(", ")[2:-1]]
    large = wanted.filter(F.col("n") > limit).select("species", "held_out", *missing, F.lit("too large").alias("status"))
    return stored(fitted.unionByName(large))


def score_boosted(rows: DataFrame, fitted: DataFrame, names: Sequence[str], keys: Sequence[str] = ("species",), column: str = "gbm") -> DataFrame:
    """Rows with the suitability by the model of their ``keys`` in ``column``; null where there is none or a predictor is missing.

    Few models are sent along. Of many, slices of at most about ``SLICE_ROWS`` rows meet a copy of their model, so no task holds a species.
    """
    names, keys = list(names), list(keys)
    models = fitted.filter("status = 'ok'").select(*keys, "base", "feature", "threshold", "below", "above", "value", "roots")
    nodes = models.agg(F.sum(F.size("feature"))).first()[0] or 0
    if nodes * NODE_BYTES <= broadcast_bytes_limit(rows.sparkSession):
        kinds = {"feature": np.int32, "threshold": np.float64, "below": np.int32, "above": np.int32, "value": np.float64, "roots": np.int32}
        table = models.toArrow()
        sent = {}
        for i in range(table.num_rows):
            m = {c: np.asarray(table[c][i].values.to_numpy(zero_copy_only=False), k) for c, k in kinds.items()}
            sent[tuple(table[k][i].as_py() for k in keys)] = {"base": table["base"][i].as_py(), **m}

        def in_place(key: tuple, x: np.ndarray) -> list[np.ndarray]:
            m = sent.get(key)
            if m is None:
                return [np.full(len(x), np.nan)]
            if "scorer" not in m:
                m["scorer"] = Scorer(m)
            used = sorted(m["scorer"].cuts)
            return [np.where(np.isnan(x[:, used]).any(axis=1), np.nan, m["scorer"](np.nan_to_num(x)))]

        return scored_in_place(rows, keys, names, [column], in_place)
    # ids are given on reading a written table, so a repeated task gives the same
    kept = stored(rows)
    sizes = kept.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("_slices"))
    numbered = kept.withColumn("_slice", F.monotonically_increasing_id())
    sliced = attach(numbered, sizes, keys).withColumn("_slice", F.pmod("_slice", F.col("_slices")).cast("int")).drop("_slices")
    copies = models.join(sizes, keys).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{column}` double"

    def score(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out = part.drop(columns=["_slice"])
        if len(model):
            m = model.iloc[0].to_dict()
            x = out[names].to_numpy(float)
            used = sorted({f for f in m["feature"] if f >= 0})
            p = predict(np.nan_to_num(x), m)
            out[column] = np.where(np.isnan(x[:, used]).any(axis=1), np.nan, p)
        else:
            out[column] = np.nan
        return out

    found = sliced.groupBy(*keys, "_slice").cogroup(copies.groupBy(*keys, "_slice")).applyInPandas(score, schema)
    value: Column = F.col(column)
    return found.withColumn(column, F.when(~F.isnan(value), value))
