"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Raking finds one factor per
source, per language and per topic so that the weighted tokens meet all three target
marginals. Factors of sources are computed where the cells are and never leave Spark; the driver holds
one number per language, per topic and per pair of them. Documents are then drawn with probabilities
proportional to the weight of their cell, calibrated to a token budget.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitspark.llm import words
from habitspark.plans.scale import attach, hash_unit, stored

TOPICS = 8
MAX_PAIRS = 100_000  # languages times topics: more is refused


def _measured(topics: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, topic = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, w in words.slices(batch.column(1)):
                n = len(w.first) - 1
                h = w.hashes()
                text = np.repeat(np.arange(n), np.diff(w.first))
                long = (w.ends - w.starts) >= 6
                votes = np.bincount(text[long] * topics + (h[long] % np.uint64(topics)).astype(np.int64), minlength=n * topics).reshape(n, topics)
                tokens.append(np.diff(w.first))
                topic.append(np.where(votes.any(axis=1), votes.argmax(axis=1), -1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(tokens)), pa.array(np.concatenate(topic), pa.int32()), batch.column(2), batch.column(3)],
                ["doc_id", "n_tokens", "topic", "source", "lang"],
            )

    return run


def measure(docs: DataFrame, topics: int = TOPICS, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``topic``, ``source``, ``lang`` of every row.

    The topic is the part of a vocabulary split by hash that most words of six bytes or more
    belong to (smallest on ties, -1 without such words); a null text has no tokens.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"))
    return rows.mapInArrow(_measured(topics), "doc_id long, n_tokens long, topic int, source string, lang string")


def _key(c: str) -> Column:
    """A text that tells null from every value."""
    return F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))


def tempered(totals: Mapping[str, float], power: float) -> dict[str, float]:
    """Target shares proportional to totals to a power: below 1, small parts are raised."""
    raised = {k: v**power if v > 0 else 0.0 for k, v in totals.items()}
    whole = sum(raised.values()) or 1.0
    return {k: v / whole for k, v in raised.items()}


def rake(
    cells: DataFrame, source_targets: DataFrame, lang_targets: Mapping[str, float], topic_targets: Mapping[str, float], tolerance: float = 1e-6, rounds: int = 100
) -> tuple[DataFrame, int, float]:
    """Weights per token of cells (``s``, ``l``, ``t``, ``n``); targets are shares of one whole.

    ``source_targets`` has ``s`` and ``share``. Returns the cells with ``weight``, the number of
    rounds, and the largest difference left between a weighted marginal and its target. Cells with a target of zero get weight zero; targets of empty parts
    cannot be met and show in that difference.
    """
    langs, topics = list(lang_targets), list(topic_targets)
    width = len(topics)
    at = {(l, t): i * width + j for i, l in enumerate(langs) for j, t in enumerate(topics)}
    if len(at) > MAX_PAIRS:
        raise ValueError(f"{len(langs)} languages times {width} topics: over {MAX_PAIRS} pairs")
    place = F.array_position(F.lit(langs), F.col("l")).cast("int") - 1
    column = F.array_position(F.lit(topics), F.col("t")).cast("int") - 1
    flat = cells.withColumn("k", place * width + column)
    per_source = stored(
        flat.groupBy("s").agg(F.collect_list(F.struct("k", "n")).alias("cells")).join(source_targets, "s").select("s", "share", "cells.k", "cells.n")
    )
    want_l = np.array([lang_targets[x] for x in langs])
    want_t = np.array([topic_targets[x] for x in topics])
    b, c = np.ones(len(langs)), np.ones(width)
    factor = lambda: np.outer(b, c).ravel()

    def sums(weights: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(weights))
            for batch in batches:
                for share, k, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    part = np.array(n, float) * weights[k]
                    if part.sum() > 0:
                        total[k] += share / part.sum() * part
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["k", "mass"])

        return run

    done, error = 0, np.inf
    while done < rounds and error > tolerance:
        rows = per_source.select("share", "k", "n").mapInArrow(sums(factor()), "k int, mass double").groupBy("k").agg(F.sum("mass")).collect()
        mass = np.zeros(len(at))
        for k, m in rows:
            mass[k] = m
        mass = mass.reshape(len(langs), width)
        # sources fit exactly here; the others show how far the fit is
        error = max(np.abs(mass.sum(axis=1) - want_l).max(initial=0.0), np.abs(mass.sum(axis=0) - want_t).max(initial=0.0))
        if error <= tolerance:
            break
        step = np.divide(want_l, mass.sum(axis=1), out=np.zeros(len(langs)), where=mass.sum(axis=1) > 0)
        b = b * step
        mass = mass * step[:, None]
        c = c * np.divide(want_t, mass.sum(axis=0), out=np.zeros(width), where=mass.sum(axis=0) > 0)
        done += 1
    weights = F.element_at(F.lit(factor().tolist()), F.col("k") + 1) if len(at) else F.lit(0.0)
    scored = flat.withColumn("f", weights)
    source_mass = scored.groupBy("s").agg(F.sum(F.col("n") * F.col("f")).alias("m")).join(source_targets, "s")
    out = scored.join(source_mass.select("s", F.when(F.col("m") > 0, F.col("share") / F.col("m")).otherwise(0.0).alias("a")), "s")
    return out.select("s", "l", "t", "n", (F.col("a") * F.col("f")).alias("weight")), done, float(error)


def _rate(cells: DataFrame, budget: float) -> float:
    """Factor that makes the expected tokens of ``min(1, factor * weight)`` meet the budget."""
    top = cells.agg(F.min(F.when(F.col("weight") > 0, F.col("weight"))), F.max("weight"), F.sum(F.when(F.col("weight") > 0, F.col("n")))).first()
    if not top[1]:
        return 0.0
    low, high = 0.0, 1.0 / top[0]
    if (top[2] or 0) <= budget:
        return high
    for _ in range(4):
        grid = np.linspace(low, high, 65).tolist()
        row = cells.agg(*[F.sum(F.col("n") * F.least(F.lit(1.0), F.col("weight") * g)) for g in grid]).first()
        i = max(1, next(i for i, v in enumerate(row) if v >= budget or i == 64))
        low, high = grid[i - 1], grid[i]
    return high


def mix(docs: DataFrame, budget_share: float = 0.5, power: float = 0.5, topics: int = TOPICS, seed: int = 7, **columns) -> DataFrame:
    """One row per input row: ``doc_id``, ``source``, ``lang``, ``topic``, ``n_tokens``, ``weight``, ``probability``, ``selected``.

    Targets are the token shares of sources, languages and topics to the power ``power``. The expected number of drawn tokens is ``budget_share`` of all, less what cells cannot give.
    A null source or language is a part of its own. Documents without tokens carry no weight: weight and
    probability are zero and they are not drawn. The draw depends on the id and the seed only.
    """
    measured = stored(measure(docs, topics, **columns))
    keyed = measured.withColumns({"s": _key("source"), "l": _key("lang"), "t": _key("topic")})
    cells = stored(keyed.filter("n_tokens > 0").groupBy("s", "l", "t").agg(F.sum("n_tokens").cast("double").alias("n")))
    whole = cells.agg(F.sum("n")).first()[0] or 0.0
    of = lambda c: {k: v for k, v in cells.groupBy(c).agg(F.sum("n")).orderBy(c).limit(MAX_PAIRS + 1).collect()}
    lang_targets = tempered(of("l"), power)
    topic_targets = tempered(of("t"), power)
    by_source = cells.groupBy("s").agg(F.pow(F.sum("n"), F.lit(power)).alias("r"))
    norm = by_source.agg(F.sum("r")).first()[0] or 1.0
    weighted = stored(rake(cells, by_source.select("s", (F.col("r") / norm).alias("share")), lang_targets, topic_targets)[0])
    rate = _rate(weighted, budget_share * whole)
    joined = attach(keyed, weighted.select("s", "l", "t", "weight"), ["s", "l", "t"], "left")
    weight = F.when(F.col("n_tokens") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0)
    out = joined.select("doc_id", "source", "lang", "topic", "n_tokens", weight.alias("weight"))
    out = out.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(rate)))
    return out.withColumn("selected", hash_unit(F.col("doc_id"), seed=seed) < F.col("probability"))
