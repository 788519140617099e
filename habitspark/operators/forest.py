"""Forests of deep trees, grown and kept away from the driver.

A tree of full depth has about two nodes a row, so hundreds of them are no object for one machine. Rows are first coded to at
most ``BINS`` bins a predictor (every value its own, or equal shares of the rows) and equal rows are combined. The draws of a
tree follow from the row's codes and the tree, those of a node from its place, so a forest does not depend on how rows are dealt.

Trees are the unit of work: a task gets all combined rows, if they are at most ``habitspark.window.maxGroupRows``, and grows
some of the trees level by level. Of more rows, the nodes above that limit are split by sums over all tasks; the
driver then holds these few upper nodes, and the rows of each node below meet in a task that grows its branch. Both take the
same splits. Trees are rows of a written table; rows are scored in slices next to some of the trees, and their votes are added up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.plans.scale import group_rows_limit, running_totals, scratch_folder, stored

BINS = 255
PIECE_ROWS = 65_536
SLICE_ROWS = 1_000_000
TASK_BYTES = 64 << 20  # trees that one task holds while it scores
SENT_BYTES = 64 << 20
WAVE_ROWS = 32  # times the limit of a group: rows that are dealt to branches at once
ROOT = 1  # nodes are numbered by their path: the children of i are 2 i and 2 i + 1
MANY = 32  # Poisson draws of larger means are added up from draws of this mean

# ``part`` is the path of the node a branch starts at. Per node: predictor (-1 leaf, -2 start of another branch), last bin below, position
# of the child below (the one above follows it), share of presences (of a start: its path)
TREES = "tree int, part long, feature binary, last binary, below binary, share binary"
KINDS = {"feature": np.int8, "last": np.uint8, "below": np.int32, "share": np.float64}
PIECES = "codes binary, y binary, n binary, hash binary"


@dataclass(frozen=True)
class Settings:
    """What a task needs to know of a forest."""

    trees: int
    depth: int
    least: int
    tried: int
    background: float
    predictors: int
    seed: int = S.SEED

    @classmethod
    def of(cls, q: Mapping[str, Any], predictors: int, background: float) -> "Settings":
        strategy = str(q["featureSubsetStrategy"])
        known = {"sqrt": math.ceil(math.sqrt(predictors)), "log2": max(1, math.ceil(math.log2(predictors))), "all": predictors, "auto": math.ceil(math.sqrt(predictors)), "onethird": math.ceil(predictors / 3)}
        if strategy not in known:
            raise ValueError(f"featureSubsetStrategy {strategy} is none of {sorted(known)}")
        return cls(int(q["numTrees"]), int(q["maxDepth"]), int(q["minInstancesPerNode"]), min(predictors, known[strategy]), float(background), predictors)


# ---- draws


def _mixed(v: np.ndarray) -> np.ndarray:
    v = v + np.uint64(0x9E3779B97F4A7C15)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _unit(*parts) -> np.ndarray:
    """Uniform value in [0, 1) from whole numbers."""
    h = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = _mixed(h ^ np.asarray(p).astype(np.int64, copy=False).view(np.uint64))
    return (h >> np.uint64(11)) / float(1 << 53)


def _poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    out = np.zeros(len(u), np.int64)
    at = np.arange(len(u))
    chance = np.exp(-mean)
    reached = chance.copy()
    for k in range(1, 200):
        more = u[at] >= reached
        at, chance, reached = at[more], chance[more], reached[more]
        if not len(at):
            break
        out[at] = k
        chance = chance * mean[at] / k
        reached = reached + chance
    return out


def draws(hashes: np.ndarray, n: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree takes each combined row: of rows drawn with replacement, the number that equal it."""
    out = _poisson(_unit(seed, np.array(tree).reshape(1), hashes), np.minimum(n, MANY).astype(float))
    for i in np.flatnonzero(n > MANY):
        rest = int(n[i]) - MANY
        means = np.full(-(-rest // MANY), float(MANY))
        means[-1] = rest - MANY * (len(means) - 1)
        out[i] += _poisson(_unit(seed, np.array(tree).reshape(1), hashes[i : i + 1], np.arange(1, len(means) + 1)), means).sum()
    return out


def tried(paths: np.ndarray, tree: int, q: Settings) -> np.ndarray:
    """Predictors that each node looks at, one row a node."""
    u = np.stack([_unit(q.seed, np.array(-1 - tree).reshape(1), paths, np.array([f])) for f in range(q.predictors)], axis=1)
    return np.argsort(u, axis=1, kind="stable")[:, : q.tried]


# ---- splits


def gains(p_low, n_low, p, n, background: float):
    """What a split takes off the Gini impurity, times the weight of the node; presences weigh 1."""
    n_low, n = n_low * background, n * background
    p_high, n_high = p - p_low, n - n_low
    part = lambda a, b: (a * a + b * b) / np.maximum(a + b, 1e-300)
    return part(p_low, n_low) + part(p_high, n_high) - part(p, n)


def _least_gain(p, n, background: float):
    return 1e-12 * (p + n * background)


def _best_of_cells(j: np.ndarray, codes: np.ndarray, pos: np.ndarray, neg: np.ndarray, p: np.ndarray, n: np.ndarray, q: Settings):
    """(gain, last bin below) of the best split of each node by one predictor; ``j`` is the node of a row, ``p`` and ``n`` its sums."""
    size = len(p)
    key = (j << 32) | (codes.astype(np.int64) << 24)
    sums_pos, sums_neg = [], []
    if size * 256 <= 4 * len(j):
        cell = j * 256 + codes
        sums_pos, sums_neg = np.bincount(cell, pos, size * 256), np.bincount(cell, neg, size * 256)
        cells = np.flatnonzero((sums_pos > 0) | (sums_neg > 0))
        a, b = sums_pos[cells].astype(np.int64), sums_neg[cells].astype(np.int64)
        owner, code = cells >> 8, cells & 255
    else:
        key = np.sort(key | np.arange(len(j)))
        order = key & 0xFFFFFF
        cell = key >> 24
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        a, b = np.add.reduceat(pos[order], first), np.add.reduceat(neg[order], first)
        owner, code = cell[first] >> 8, cell[first] & 255
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])  # every node has rows
    low_a, low_b = np.cumsum(a), np.cumsum(b)
    before = np.r_[0, starts[1:] - 1]
    base_a, base_b = low_a[before], low_b[before]
    base_a[0] = base_b[0] = 0
    low_a, low_b = low_a - base_a[owner], low_b - base_b[owner]
    taken = low_a + low_b
    gain = gains(low_a, low_b, p[owner], n[owner], q.background)
    gain = np.where((taken >= q.least) & ((p + n)[owner] - taken >= q.least), gain, 0.0)
    gain[np.r_[starts[1:] - 1, len(owner) - 1]] = 0.0
    best = np.maximum.reduceat(gain, starts)
    hit = np.flatnonzero(gain == best[owner])[::-1]
    last = np.zeros(size, np.int64)
    last[owner[hit]] = code[hit]  # the first of equals
    return best, last


def grow(codes: np.ndarray, pos: np.ndarray, neg: np.ndarray, tree: int, part: int, q: Settings) -> dict[str, np.ndarray]:
    """A branch from the node ``part`` on, level by level; ``pos`` and ``neg`` count the presences and background drawn of each row."""
    taken = np.flatnonzero(pos + neg > 0)
    codes, pos, neg = codes[taken], pos[taken], neg[taken]
    out: dict[str, list] = {c: [] for c in KINDS}
    at, paths, made = np.zeros(len(taken), np.int64), np.array([part], np.int64), 1
    while len(paths):
        size = len(paths)
        p, n = (np.bincount(at, v, size).astype(np.int64) for v in (pos, neg))
        depth = int(paths[0]).bit_length() - 1
        feature, last, below = np.full(size, -1, np.int8), np.zeros(size, np.uint8), np.zeros(size, np.int32)
        with np.errstate(invalid="ignore"):
            share = np.where(p + n > 0, p / (p + n * q.background), 0.0)
        open_ = (p > 0) & (n > 0) & (p + n >= 2 * q.least) & (depth < q.depth)
        split = np.zeros(0, np.int64)
        if open_.any():
            number = np.cumsum(open_) - 1
            rows = np.flatnonzero(open_[at])
            codes, pos, neg, j = codes[rows], pos[rows], neg[rows], number[at[rows]]
            own = np.flatnonzero(open_)
            some = tried(paths[own], tree, q)
            best, which, cut = _least_gain(p[own], n[own], q.background), np.full(len(own), -1), np.zeros(len(own), np.int64)
            for s in range(q.tried):
                f = some[:, s]
                gain, bin_ = _best_of_cells(j, codes[np.arange(len(j)), f[j]], pos, neg, p[own], n[own], q)
                better = gain > best
                best, which, cut = np.where(better, gain, best), np.where(better, f, which), np.where(better, bin_, cut)
            split = np.flatnonzero(which >= 0)
            feature[own[split]], last[own[split]] = which[split], cut[split]
            below[own[split]] = made + 2 * np.arange(len(split))
            order = np.full(len(own), -1)
            order[split] = np.arange(len(split))
            rows = np.flatnonzero(order[j] >= 0)
            codes, pos, neg, j = codes[rows], pos[rows], neg[rows], j[rows]
            at = 2 * order[j] + (codes[np.arange(len(j)), which[j]] > cut[j])
            paths = np.repeat(2 * paths[own[split]], 2) + np.tile([0, 1], len(split))
        else:
            paths = paths[:0]
        made += 2 * len(split)
        for c, v in (("feature", feature), ("last", last), ("below", below), ("share", share)):
            out[c].append(v)
    return {c: np.concatenate(v).astype(KINDS[c]) for c, v in out.items()}


def _row(tree: int, part: int, nodes: Mapping[str, np.ndarray]) -> tuple:
    return (tree, part, *[nodes[c].astype(k).tobytes() for c, k in KINDS.items()])


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["tree", "part", *KINDS])


# ---- coded rows


def edges_of(rows: DataFrame, predictors: Sequence[str]) -> list[list[float]]:
    """Limits between the bins of each predictor: halfway between neighbouring values, or where equal shares of the rows meet."""
    long = rows.select(F.posexplode(F.array(*[F.col(p).cast("double") for p in predictors])).alias("k", "v"))
    counts = long.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))
    t = running_totals(counts, ["k"], "v", ["n", "one"])
    share = F.floor((F.col("cum_n") - F.col("n")) * F.lit(BINS) / F.col("tot_n"))
    bins = t.withColumn("bin", F.when(F.col("tot_one") <= BINS, F.col("cum_one") - 1).otherwise(share))
    ends = bins.groupBy("k", "bin").agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("k", "bin").collect()  # at most BINS rows a predictor
    out: list[list[float]] = [[] for _ in predictors]
    for a, b in zip(ends, ends[1:]):
        if a["k"] == b["k"]:
            middle = (a["high"] + b["low"]) / 2
            out[a["k"]].append(middle if middle < b["low"] else a["high"])
    return out


def _coded(x: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    return np.array([np.searchsorted(np.array(e), x[:, k]) for k, e in enumerate(edges)], np.uint8).T.copy()


def _batch(kind: str, columns: Sequence[Sequence]) -> pa.RecordBatch:
    names, kinds = zip(*[c.split() for c in kind.split(", ")])
    arrow = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(columns, kinds)], list(names))


def _pieces(rows: DataFrame, predictors: Sequence[str], edges: list[list[float]]) -> DataFrame:
    """Combined rows, packed: codes, presence, number and hash of each."""
    k = len(predictors)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
            codes = _coded(x, edges)
            yield pa.RecordBatch.from_arrays([pa.array(list(map(bytes, codes)), pa.binary()), batch.column(k)], ["code", "y"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = ((1, np.uint8), (2, np.int64), (3, np.int64))
        for batch in batches:
            for some in (batch.slice(i, PIECE_ROWS) for i in range(0, batch.num_rows, PIECE_ROWS)):
                yield _batch(PIECES, [[b"".join(some.column(0).to_pylist())], *[[some.column(i).to_numpy(zero_copy_only=False).astype(t).tobytes()] for i, t in kinds]])

    plain = rows.select(*[F.col(p).cast("double").alias(f"x{i}") for i, p in enumerate(predictors)], (F.col("presence") == 1).cast("int").alias("y"))
    combined = plain.mapInArrow(code, "code binary, y int").groupBy("code", "y").agg(F.count(F.lit(1)).alias("n"))
    return stored(combined.select("code", "y", "n", F.xxhash64("code", "y").alias("hash")).mapInArrow(pack, PIECES))


def _unpacked(codes: bytes, y: bytes, n: bytes, hashes: bytes, k: int) -> tuple[np.ndarray, ...]:
    return np.frombuffer(codes, np.uint8).reshape(-1, k), np.frombuffer(y, np.uint8), np.frombuffer(n, np.int64), np.frombuffer(hashes, np.int64)


def _tasks(spark: SparkSession, trees: int) -> int:
    return min(trees, 4 * spark.sparkContext.defaultParallelism)


# ---- fits


def _in_one_task(pieces: DataFrame, q: Settings) -> DataFrame:
    """Whole trees, some in each task."""
    n = _tasks(pieces.sparkSession, q.trees)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(*r, q.predictors) for r in frame[["codes", "y", "n", "hash"]].itertuples(index=False)]
        codes, y, counts, hashes = (np.concatenate(v) for v in zip(*parts))
        rows = []
        for tree in range(int(frame["g"].iloc[0]), q.trees, n):
            w = draws(hashes, counts, tree, q.seed)
            rows.append(_row(tree, ROOT, grow(codes, w * y, w * (1 - y.astype(np.int64)), tree, ROOT, q)))
        return _table(rows)

    copies = pieces.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartitionByRange(n, "g")
    return copies.groupBy("g").applyInPandas(fit, TREES)


class _Top:
    """Upper nodes of a tree while it grows; a node is open, or starts a branch, or is split."""

    def __init__(self) -> None:
        self.feature, self.last, self.below, self.path = [-2], [0], [0], [ROOT]
        self.open = [0]

    def places(self, codes: np.ndarray) -> np.ndarray:
        feature, last, below = (np.array(v) for v in (self.feature, self.last, self.below))
        at = np.zeros(len(codes), np.int64)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = below[node] + (codes[inner, feature[node]] > last[node])

    def row(self, tree: int) -> tuple:
        return _row(tree, 0, {"feature": np.array(self.feature), "last": np.array(self.last), "below": np.array(self.below), "share": np.array(self.path, float)})


SUMS = "tree int, sums binary"
SPLIT = "tree int, node int, feature int, last int, rows_below long, rows_above long"


def _split_round(pieces: DataFrame, tops: dict[int, _Top], q: Settings) -> list:
    """Best splits of all open nodes from sums over all tasks; a row per node on the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece in zip(*[batch.column(c).to_pylist() for c in range(4)]):
                codes, y, n, hashes = _unpacked(*piece, q.predictors)
                for tree, top in tops.items():
                    w = draws(hashes, n, tree, q.seed)
                    number = np.full(len(top.feature), -1)
                    number[top.open] = np.arange(len(top.open))
                    j = np.where(w > 0, number[top.places(codes)], -1)
                    rows = np.flatnonzero(j >= 0)
                    j, own, labels, weights = j[rows], codes[rows], y[rows], w[rows]
                    some = tried(np.array(top.path)[top.open], tree, q)
                    sums = held.setdefault(tree, np.zeros((3, len(top.open), q.tried, 256), np.int64))
                    for s in range(q.tried):
                        cell = j * 256 + own[np.arange(len(j)), some[j, s]]
                        for i, v in enumerate((weights * labels, weights * (1 - labels.astype(np.int64)), np.ones(len(j)))):
                            sums[i, :, s] += np.bincount(cell, v, len(top.open) * 256).reshape(-1, 256).astype(np.int64)
                if sum(v.nbytes for v in held.values()) > SENT_BYTES:
                    yield _batch(SUMS, [list(held), [v.tobytes() for v in held.values()]])
                    held = {}
        yield _batch(SUMS, [list(held), [v.tobytes() for v in held.values()]])

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        tree, rows = int(frame["tree"].iloc[0]), []
        top = tops[tree]
        total = np.zeros((3, len(top.open), q.tried, 256), np.int64)
        for raw in frame["sums"]:
            total += np.frombuffer(raw, np.int64).reshape(total.shape)
        some = tried(np.array(top.path)[top.open], tree, q)
        for i, node in enumerate(top.open):
            p, n = total[0, i, 0].sum(), total[1, i, 0].sum()
            best = (_least_gain(p, n, q.background), -1, 0, 0, 0)
            if p > 0 and n > 0 and p + n >= 2 * q.least and top.path[node].bit_length() <= q.depth:
                for s in range(q.tried):
                    a, b = np.cumsum(total[0, i, s]), np.cumsum(total[1, i, s])
                    here = (total[0, i, s] + total[1, i, s] > 0) & (a + b >= q.least) & (p + n - a - b >= max(q.least, 1))
                    gain = np.where(here, gains(a, b, p, n, q.background), 0.0)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        low = int(total[2, i, s, : at + 1].sum())
                        best = (gain[at], int(some[i, s]), at, low, int(total[2, i, s].sum()) - low)
            rows.append((tree, node, *best[1:]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SPLIT.split(", ")])

    return pieces.mapInArrow(add, SUMS).groupBy("tree").applyInPandas(choose, SPLIT).collect()


def _over_tasks(pieces: DataFrame, n_rows: int, limit: int, q: Settings) -> DataFrame:
    """Upper nodes by sums over all tasks, branches of at most ``limit`` rows in one task each."""
    spark = pieces.sparkSession
    tops = {tree: _Top() for tree in range(q.trees)}
    while running := {tree: top for tree, top in tops.items() if top.open}:
        found = _split_round(pieces, running, q)
        for top in running.values():
            top.open = []
        for r in found:
            top = tops[r["tree"]]
            if r["feature"] < 0:
                continue  # its branch is a leaf
            node, made = r["node"], len(top.feature)
            top.feature[node], top.last[node], top.below[node] = r["feature"], r["last"], made
            top.feature += [-2, -2]
            top.last += [0, 0]
            top.below += [0, 0]
            top.path += [2 * top.path[node], 2 * top.path[node] + 1]
            top.open += [made + i for i, side in enumerate(("rows_below", "rows_above")) if r[side] > limit]
    path = scratch_folder(spark)
    at_once = max(1, WAVE_ROWS * limit // n_rows)
    for first in range(0, q.trees, at_once):
        wave = {tree: tops[tree] for tree in range(first, min(first + at_once, q.trees))}
        _branches(pieces, wave, q).write.mode("append").parquet(path)
    spark.createDataFrame(pd.DataFrame([top.row(tree) for tree, top in tops.items()], columns=["tree", "part", *KINDS]), TREES).write.mode("append").parquet(path)
    return spark.read.schema(TREES).parquet(path)


def _branches(pieces: DataFrame, tops: dict[int, _Top], q: Settings) -> DataFrame:
    rows_of = "tree int, part long, codes binary, pos binary, neg binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in zip(*[batch.column(c).to_pylist() for c in range(4)]):
                codes, y, n, hashes = _unpacked(*piece, q.predictors)
                for tree, top in tops.items():
                    w = draws(hashes, n, tree, q.seed)
                    at = np.where(w > 0, top.places(codes), -1)
                    order = np.argsort(at, kind="stable")
                    starts = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
                    columns: list[list] = [[] for _ in range(5)]
                    for rows in np.split(order, starts[1:]):
                        if at[rows[0]] < 0:
                            continue
                        pos, neg = w[rows] * y[rows], w[rows] * (1 - y[rows].astype(np.int64))
                        for c, v in zip(columns, (tree, top.path[at[rows[0]]], codes[rows].tobytes(), pos.astype(np.int32).tobytes(), neg.astype(np.int32).tobytes())):
                            c.append(v)
                    yield _batch(rows_of, columns)

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tree, part = map(int, key)
        codes = np.concatenate([np.frombuffer(v, np.uint8).reshape(-1, q.predictors) for v in frame["codes"]])
        pos, neg = (np.concatenate([np.frombuffer(v, np.int32) for v in frame[c]]).astype(np.int64) for c in ("pos", "neg"))
        return _table([_row(tree, part, grow(codes, pos, neg, tree, part, q))])

    return pieces.mapInArrow(deal, rows_of).groupBy("tree", "part").applyInPandas(fit, TREES)


class _Save:
    def __init__(self, forest: "Forest", mode: str = "error") -> None:
        self.forest, self.mode = forest, mode

    def overwrite(self) -> "_Save":
        return _Save(self.forest, "overwrite")

    def save(self, path: str) -> None:
        f = self.forest
        f.trees.write.mode(self.mode).parquet(f"{path}/trees")
        about = f.trees.sparkSession.createDataFrame([(f.size, [list(map(float, e)) for e in f.edges])], "size int, edges array<array<double>>")
        about.coalesce(1).write.mode(self.mode).parquet(f"{path}/edges")


@dataclass
class Forest:
    """A fitted forest: its trees as a written table, the limits of the bins, the number of trees."""

    trees: DataFrame
    edges: list[list[float]]
    size: int

    def write(self) -> _Save:
        return _Save(self)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Forest":
        about = spark.read.parquet(f"{path}/edges").first()
        return cls(spark.read.schema(TREES).parquet(f"{path}/trees"), [list(e) for e in about["edges"]], about["size"])


def fit_forest(train: DataFrame, predictors: Sequence[str], q: Mapping[str, Any], background_weight: float) -> Forest:
    """A forest on ``train`` (``presence`` and ``predictors``, complete); presences weigh 1."""
    settings = Settings.of(q, len(predictors), background_weight)
    rows = stored(train.select("presence", *predictors))
    complete = rows.na.drop(subset=list(predictors))
    if rows.count() != complete.count():
        raise ValueError("training rows lack predictors")
    edges = edges_of(rows, predictors)
    pieces = _pieces(rows, predictors, edges)
    n = pieces.agg(F.sum(F.octet_length("y"))).first()[0]
    limit = min(group_rows_limit(train.sparkSession), 1 << 24)  # positions in ``_best_of_cells`` have 24 bits
    trees = stored(_in_one_task(pieces, settings)) if n <= limit else _over_tasks(pieces, n, limit, settings)
    return Forest(trees, edges, settings.trees)


# ---- scores


def _assembled(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """One tree from its branches; ``parts`` starts with the one that holds the root."""
    at, offsets, out = 0, {}, {c: [] for c in KINDS}
    for p in parts:
        offsets[p["part"]] = at
        for c in KINDS:
            out[c].append(p[c] + at if c == "below" else p[c])
        at += len(p["feature"])
    tree = {c: np.concatenate(v) for c, v in out.items()}
    starts = np.flatnonzero(tree["feature"] == -2)
    if len(starts):
        # a start without a branch drew no rows at all: a leaf without presences
        roots = np.array([offsets.get(int(path), -1) for path in tree["share"][starts]])
        for c in KINDS:
            tree[c][starts] = np.where(roots >= 0, tree[c][roots], -1 if c == "feature" else 0)
    return tree


def walk(codes: np.ndarray, tree: Mapping[str, np.ndarray]) -> np.ndarray:
    """Share of presences in the leaf that each row reaches."""
    flat, k = codes.ravel(), codes.shape[1]
    feature, last, below = tree["feature"], tree["last"], tree["below"]
    at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    out = np.empty(len(codes))
    while len(rows):
        f = feature[at]
        done = f < 0
        if done.any():
            out[rows[done]] = tree["share"][at[done]]
            rows, at, f = rows[~done], at[~done], f[~done]
        at = below[at] + (flat[rows * k + f] > last[at])
    return out


def score_forest(df: DataFrame, forest: Forest, predictors: Sequence[str], column: str = "rf") -> DataFrame:
    """``df`` with the mean vote of the trees in ``column``, null where a predictor is missing.

    Slices of at most about ``SLICE_ROWS`` rows meet some of the trees in a task; the sums of a row's votes are added up by its number.
    """
    spark, k, edges = df.sparkSession, len(predictors), forest.edges
    kept = stored(df.drop(column).withColumn("_id", F.monotonically_increasing_id()))
    slices = max(1, -(-kept.count() // SLICE_ROWS))
    weight = forest.trees.agg(F.sum(F.octet_length("share"))).first()[0] * 2
    groups = min(forest.size, max(-(-_tasks(spark, forest.size) // slices), -(-weight // TASK_BYTES)))
    complete = kept.na.drop(subset=list(predictors)).select("_id", *[F.col(p).cast("double").alias(f"x{i}") for i, p in enumerate(predictors)])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
            ids = batch.column(0).to_numpy()
            yield _batch("slice int, ids binary, codes binary", [[int(_mixed(ids[:1].view(np.uint64))[0] % np.uint64(slices))] if len(ids) else [], [ids.tobytes()] if len(ids) else [], [_coded(x, edges).tobytes()] if len(ids) else []])

    def vote(key: tuple, rows: pa.Table, trees: pa.Table) -> pa.Table:
        ids = [np.frombuffer(v.as_buffer(), np.int64) for v in rows["ids"]]
        codes = [np.frombuffer(v.as_buffer(), np.uint8).reshape(-1, k) for v in rows["codes"]]
        if not ids:
            return pa.table({"_id": pa.array([], pa.int64()), "votes": pa.array([], pa.float64())})
        ids, codes = np.concatenate(ids), np.concatenate(codes)
        votes = np.zeros(len(ids))
        number = trees["tree"].to_numpy()
        for tree in np.unique(number):
            own = np.flatnonzero(number == tree)
            own = own[np.argsort(trees["part"].to_numpy()[own])]
            parts = [{"part": trees["part"][i].as_py(), **{c: np.frombuffer(trees[c][i].as_buffer(), kind) for c, kind in KINDS.items()}} for i in own.tolist()]
            votes += walk(codes, _assembled(parts))
        return pa.table({"_id": ids, "votes": votes})

    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    number = lambda: (F.col("slice") * groups + F.col("g")).alias("task")
    n = slices * groups
    rows = complete.mapInArrow(code, "slice int, ids binary, codes binary").select("*", each(groups, "g")).select(number(), "ids", "codes")
    dealt = forest.trees.withColumn("g", F.pmod("tree", F.lit(groups))).select("*", each(slices, "slice")).select(number(), "tree", "part", *KINDS)
    # tasks differ little in work, so as many partitions as tasks would leave some with several: take twice as many
    found = rows.repartition(2 * n, "task").groupBy("task").cogroup(dealt.repartition(2 * n, "task").groupBy("task")).applyInArrow(vote, "_id long, votes double")
    mean = found.groupBy("_id").agg((F.sum("votes") / F.lit(float(forest.size))).alias(column))
    return kept.join(mean, "_id", "left").drop("_id")
