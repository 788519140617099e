"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are scaled to length one and grouped by the nearest of a few centres. The difference
to the centre is rotated by a fixed random rotation and kept as one bit per
dimension, with two scalars per vector: its length over the inner product with its own code, and
the width of the error bound that follows from it. A query is rotated once and rounded to eight bits, so an
inner product is a sum of bit counts of packed words. In every block the vectors whose
upper bound reaches the k-th best lower bound are compared exactly, in double precision on the
original values. A query first looks at its nearest centres, then at every other centre whose radius still
allows a better cosine than its k-th best so far; on vectors without clusters that is most of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from habitspark.plans.scale import stored

PLANES = 8
BOUND = 3.0  # standard errors of the bound
BLOCK_ROWS = 16_384
QUERY_ROWS = 4_096
CENTRE_ROWS = 4_096  # rows per centre on average
MAX_CENTRES = 1_024
PROBES = 32
SAMPLE_ROWS = 20_000  # the index (centres) is fitted on at most so many rows


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint64)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, scale and error width of unit vectors ``x`` around ``centre``."""
    away = (x - centre) @ turn.T
    length = np.sqrt((away * away).sum(axis=1))
    bits = away > 0
    # inner product of the unit difference with its code
    own = np.abs(away).sum(axis=1) / (np.maximum(length, 1e-300) * np.sqrt(x.shape[1]))
    scale = np.where(length > 1e-12, length / np.maximum(own, 1e-12), 0.0)
    width = scale * np.sqrt(np.maximum(1 - own**2, 0)) * BOUND / np.sqrt(max(x.shape[1] - 1, 1))
    return _packed(bits), scale, width


def estimate(codes: np.ndarray, ones: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the codes' sign vectors (of length one) with a rotated query."""
    low, high = y.min(), y.max()
    step = (high - low) / ((1 << PLANES) - 1) or 1.0
    level = np.rint((y - low) / step).astype(np.int64)
    planes = _packed(((level[None, :] >> np.arange(PLANES)[:, None]) & 1).astype(bool))
    total = np.zeros(len(codes))
    for j in range(PLANES):
        total += np.bitwise_count(codes & planes[j]).sum(axis=1) * float(1 << j)
    dot = low * ones + step * total
    return (2 * dot - (low * len(y) + step * level.sum())) / np.sqrt(len(y))


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed in the order of the components."""
    dot, xx, qq = np.zeros(len(x)), np.zeros(len(x)), 0.0
    for d in range(x.shape[1]):
        dot += x[:, d] * q[d]
        xx += x[:, d] * x[:, d]
        qq += q[d] * q[d]
    return dot / (np.sqrt(xx) * np.sqrt(qq))


def _search(centres: np.ndarray, turn: np.ndarray, k: int):
    def run(key: tuple, data: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if data.num_rows and queries.num_rows:
            centre = centres[key[0].as_py()]
            raw = _matrix(data["embedding"].combine_chunks())
            ids = data["vec_id"].to_numpy()
            x = _unit(raw)
            codes, scale, width = encode(x, centre, turn)
            ones = np.bitwise_count(codes).sum(axis=1).astype(float)
            asked = _matrix(queries["embedding"].combine_chunks())
            for q, number in zip(asked, queries["vec_id"].to_pylist()):
                unit = q / np.sqrt((q * q).sum())
                near = centre @ unit + scale * estimate(codes, ones, turn @ unit)
                other = ids != number
                low = np.where(other, near - width, -np.inf)
                least = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
                take = np.flatnonzero(other & (near + width >= least))
                score = exact(raw[take], q)
                best = np.lexsort((ids[take], -score))[:k]
                found += [(number, int(i), float(s)) for i, s in zip(ids[take][best], score[best])]
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    return run


def _placed(centres: np.ndarray, probes: int):
    """The nearest ``probes`` centres of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column(1)))
            gap = -2 * (x @ centres.T) + (centres * centres).sum(axis=1) if len(x) else np.zeros((0, len(centres)))
            near = np.argsort(gap, axis=1, kind="stable")[:, :probes]
            take = np.repeat(np.arange(len(x)), near.shape[1])
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(take)) for i in range(2)], pa.array(near.ravel().astype(np.int32))], ["vec_id", "embedding", "centre"])

    return run


def _open(centres: np.ndarray, radius: np.ndarray, probes: int):
    """The centres of every query beyond the nearest ``probes`` that may hold a cosine of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column(1)))
            least = batch.column(2).to_numpy(zero_copy_only=False)
            dot = x @ centres.T if len(x) else np.zeros((0, len(centres)))
            near = np.argsort(-2 * dot + (centres * centres).sum(axis=1), axis=1, kind="stable")[:, :probes]
            may = dot + radius >= least[:, None] - 1e-9
            np.put_along_axis(may, near, False, axis=1)
            take, centre = np.nonzero(may)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(take)) for i in range(2)], pa.array(centre.astype(np.int32))], ["vec_id", "embedding", "centre"])

    return run


def _radii(centres: np.ndarray):
    """The largest distance from each centre to the vectors placed there, per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_numpy()
            far = np.sqrt(((_unit(_matrix(batch.column(0))) - centres[own]) ** 2).sum(axis=1)) if len(own) else np.zeros(0)
            top = np.full(len(centres), -1.0)
            np.maximum.at(top, own, far)
            used = np.flatnonzero(top >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(top[used])], ["centre", "far"])

    return run


def fit_centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of unit vectors by a few rounds of k-means."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds if k > 1 else 1):
        own = (-2 * (x @ centres.T) + (centres * centres).sum(axis=1)).argmin(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
    return centres


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows that take part: an id, and a vector of the most frequent length, finite and not zero.

    Of rows with the same id the smallest vector counts.
    """
    v = F.col("embedding")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    good = rows.filter(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
        & F.exists(v, lambda e: e != 0)
    )
    sizes = good.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return good.filter(F.size(v) == (sizes[0] if sizes else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, probes: int = PROBES) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` most similar vectors of every query but itself.

    Both frames come from ``usable``. Ties go to the smaller id; an empty frame gives no rows. A query looks
    at the ``probes`` nearest centres, then at each other one that may hold a nearer vector than its ``k``-th so far, so the
    choice of centres loses no neighbour. Centres with many vectors are split into blocks, so neither a block of vectors nor a
    block of queries grows with the data.
    """
    vectors = stored(vectors)
    n = vectors.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = vectors.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(SAMPLE_ROWS).select("embedding").toArrow()
    x = _unit(_matrix(sample["embedding"].combine_chunks()))
    centres = fit_centres(x, min(MAX_CENTRES, len(x), -(-n // CENTRE_ROWS)))
    turn = rotation(x.shape[1])
    kind = "vec_id long, embedding array<double>, centre int"
    placed = stored(vectors.mapInArrow(_placed(centres, 1), kind))
    sizes = placed.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).select("centre", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    at = lambda count: F.pmod(F.xxhash64("vec_id"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    columns = ["centre", "block", "part", "vec_id", "embedding"]

    def search(asked: DataFrame) -> DataFrame:
        asked = stored(asked.join(F.broadcast(sizes), "centre"))
        parts = asked.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("parts"))
        # at most MAX_CENTRES rows in either table that is broadcast
        left = placed.join(F.broadcast(sizes), "centre").join(F.broadcast(parts), "centre").withColumn("block", at("blocks")).withColumn("part", every("parts"))
        right = asked.join(F.broadcast(parts), "centre").withColumn("part", at("parts")).withColumn("block", every("blocks"))
        return (
            left.select(*columns).groupBy("centre", "block", "part")
            .cogroup(right.select(*columns).groupBy("centre", "block", "part"))
            .applyInArrow(_search(centres, turn, k), "query_id long, vec_id long, score double")
        )

    best = search(queries.select("vec_id", "embedding").mapInArrow(_placed(centres, min(probes, len(centres))), kind))
    if probes < len(centres):
        best = stored(best)
        radius = np.full(len(centres), -np.inf)
        # one row per centre
        for centre, far in placed.select("embedding", "centre").mapInArrow(_radii(centres), "centre int, far double").groupBy("centre").agg(F.max("far")).collect():
            radius[centre] = far
        kth = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        least = best.withColumn("r", F.row_number().over(kth)).filter(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        known = queries.select("vec_id", "embedding").join(least, "vec_id", "left").select("vec_id", "embedding", F.coalesce("least", F.lit(-2.0)).alias("least"))
        best = best.unionByName(search(known.mapInArrow(_open(centres, radius, probes), kind)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
