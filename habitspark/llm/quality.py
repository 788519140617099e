"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, a few vector operations per slice of documents. Trees
have a fixed depth and are flattened into arrays (feature, threshold, leaf), so a batch
walks all of them with one gather per level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitspark.llm import words
from habitspark.plans.scale import stored

FEATURES = [
    "log_bytes", "log_words", "word_length", "word_length_sd", "digits", "upper", "signs", "marks", "bars", "beyond_ascii",
    "feeds_per_word", "line_bytes", "repeated_lines", "closed_lines", "sentence_ends", "distinct_words", "top_word", "long_words",
    "one_letter_words", "repeated_bytes", "marked_words", "byte_variety", "short_lines", "common_ends",
]

_CLASS = {}
for _name, _bytes in {
    "digits": range(0x30, 0x3A), "upper": range(0x41, 0x5B), "marks": b"#%*$&@^~<>{}[]\\_=+", "bars": b"|", "ends": b".!?", "beyond": range(0x80, 0x100),
    "signs": [b for b in range(0x21, 0x7F) if not (0x30 <= b < 0x3A or 0x41 <= b < 0x5B or 0x61 <= b < 0x7B)],
}.items():
    _CLASS[_name] = np.zeros(256, np.int64)
    _CLASS[_name][list(_bytes)] = 1


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _grouped(text: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of distinct keys and count of the most frequent one."""
    mixed = words.mix(key + words.mix(text.astype(np.uint64) + np.uint64(1)))
    _, first, count = np.unique(mixed, return_index=True, return_counts=True)
    owner = text[first]
    top = np.zeros(n)
    np.maximum.at(top, owner, count)
    return np.bincount(owner, minlength=n).astype(float), top


def statistics(column: pa.Array) -> Iterator[np.ndarray]:
    """[text, feature] for consecutive texts; an empty text has zeros, every share has a divisor of at least one."""
    raw, bounds = words.text_bytes(column)
    for at, w in words.slices(column):
        off = w.offsets
        n = len(off) - 1
        data = raw[bounds[at] : bounds[at] + off[-1]]
        size = np.diff(off).astype(float)
        byte = np.maximum(size, 1)
        is_in = {k: _per_text(c[data], off) for k, c in _CLASS.items()}
        count = np.diff(w.first).astype(float)
        per = np.maximum(count, 1)
        length = (w.ends - w.starts).astype(float)
        mean = _per_text(length, w.first) / per
        spread = np.sqrt(np.maximum(_per_text(length**2, w.first) / per - mean**2, 0))
        text = np.repeat(np.arange(n), np.diff(w.first))
        h = w.hashes()
        distinct, top = _grouped(text, h, n)
        last = w.data[w.ends - 1] if len(h) else np.zeros(0, np.uint8)
        # lines: runs between line feeds, told apart by the sum of their mixed words and positions
        feeds = np.flatnonzero(w.data == 10)
        row = np.searchsorted(feeds, w.starts) + text  # a new text is a new line as well
        cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(h) else np.zeros(0, np.int64)
        ends = np.r_[cut[1:], len(h)]
        sums = np.r_[np.uint64(0), np.cumsum(words.mix(h), dtype=np.uint64)]
        line_text = text[cut] if len(h) else text
        line_key = sums[ends] - sums[cut] if len(h) else h
        lines = np.maximum(np.bincount(line_text, minlength=n), 1).astype(float)
        line_distinct, _ = _grouped(line_text, line_key, n)
        closed = np.bincount(line_text, weights=_CLASS["ends"][last[ends - 1]] if len(h) else None, minlength=n)
        short = np.bincount(line_text, weights=(ends - cut) < 4 if len(h) else None, minlength=n)
        same = np.r_[False, data[1:] == data[:-1]] if len(data) else np.zeros(0, bool)
        fours = (data.astype(np.uint64) >> np.uint64(2)) if len(data) else np.zeros(0, np.uint64)
        mask = np.bitwise_or.reduceat(np.uint64(1) << fours, np.minimum(off[:-1], len(data) - 1)) if len(data) else np.zeros(n, np.uint64)
        mask[size == 0] = 0
        end_hash, _ = _grouped(text, last.astype(np.uint64), n)
        share = lambda flags: _per_text(flags, w.first) / per
        yield np.stack(
            [
                np.log1p(size), np.log1p(count), mean, spread, is_in["digits"] / byte, is_in["upper"] / byte, is_in["signs"] / byte,
                is_in["marks"] / byte, is_in["bars"] / byte, is_in["beyond"] / byte, _per_text(w.data == 10, off) / per, size / lines,
                1 - line_distinct / lines, closed / lines, share(_CLASS["ends"][last]), distinct / per, top / per, share(length > 15),
                share(length == 1), _per_text(same, off) / byte, share(_CLASS["marks"][last]), np.bitwise_count(mask).astype(float),
                short / lines, end_hash / per,
            ],
            axis=1,
        )


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.concatenate([np.zeros((0, len(FEATURES))), *statistics(batch.column(1))])
        values = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "x"])


def describe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``x``, the array of ``FEATURES``, for every row; a null text counts as empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_described, "doc_id long, x array<double>")


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 1.0) -> dict:
    """Boosted trees for log odds. With one class or no rows only the smoothed share is left."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner = (1 << depth) - 1
    feature = np.zeros((trees, inner), np.int32)
    limit = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, 1 << depth))
    model = {"base": base, "depth": depth, "feature": feature, "limit": limit, "leaf": leaf}
    if len(y) < 2 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)  # value <= edges[code]
    width = x.shape[1] * bins
    flat = code + np.arange(x.shape[1]) * bins
    score = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            n = 1 << level
            at = (node[:, None] * width + flat).ravel()
            g = np.bincount(at, np.repeat(grad, x.shape[1]), n * width).reshape(n, -1, bins).cumsum(axis=2)
            s = np.bincount(at, np.repeat(hess, x.shape[1]), n * width).reshape(n, -1, bins).cumsum(axis=2)
            gt, st = g[:, :1, -1:], s[:, :1, -1:]
            gain = g**2 / (s + penalty) + (gt - g) ** 2 / (st - s + penalty) - gt**2 / (st + penalty)
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = -1
            gain[(s < 1) | (st - s < 1)] = -1
            best = gain.reshape(n, -1).argmax(axis=1)
            f, b = best // bins, best % bins
            split = gain.reshape(n, -1)[np.arange(n), best] > 1e-9
            slot = n - 1 + np.arange(n)
            feature[t, slot[split]] = f[split]
            limit[t, slot[split]] = [edges[i][j] for i, j in zip(f[split], b[split])]
            node = 2 * node + (split[node] & (code[np.arange(len(y)), f[node]] > b[node]))
        top = np.bincount(node, grad, 1 << depth)
        low = np.bincount(node, hess, 1 << depth)
        leaf[t] = rate * top / (low + penalty)
        score += leaf[t][node]
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of class 1 for every row."""
    score = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for feature, limit, leaf in zip(model["feature"], model["limit"], model["leaf"]):
        node = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
        score += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-score))


def _predicted(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(predict(model, x))], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, training: Column, target: str = "quality", sample_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score``, the probability of label 1, for every row of ``docs``.

    ``training`` is a condition on ``doc_id``. The trees are fitted on at most
    ``sample_rows`` labelled rows (smallest hash of the id); rows with a null label do not count, a
    repeated label counts each time. Labels, and columns other than the text, are never inputs of a score. Empty
    and null texts get a score as any other; without labelled rows all get 0.5.
    """
    described = stored(describe(docs, doc_id, text))
    marks = labels.filter(F.col(target).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("y"))
    known = described.filter(training).join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("x", "y")
    sample = known.toArrow()
    x = np.asarray(sample["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    model = grow(x, sample["y"].to_numpy())
    return described.select("doc_id", "x").mapInArrow(_predicted(model), "doc_id long, score double")
