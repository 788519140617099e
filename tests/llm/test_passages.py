"""Induced sorting and the removal of repeated passages against brute force."""

import collections
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from habitspark.llm import induction, passages, suite  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", [np.uint8, np.int32])
@pytest.mark.parametrize("limit", [50, 1 << 20])
def test_suffixes_in_order(kind, limit):
    draw = random.Random(limit)
    for _ in range(200):
        symbols = draw.choice([1, 2, 3, 5, 200])
        text = [draw.randint(1, symbols) for _ in range(draw.randint(0, 60))] + [0]
        got = induction.suffix_array(np.array(text, kind), limit, draw.choice([1, 8, 1 << 21])).tolist()
        assert got == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("limit", [50, 1 << 20])
def test_carried_prefixes_find_repeats(limit):
    draw = random.Random(limit + 1)
    for _ in range(200):
        symbols, size = draw.choice([1, 2, 3, 5]), draw.choice([1, 2, 3, 5, 9, 17])
        text = [draw.randint(1, symbols) for _ in range(draw.randint(1, 300))]
        text = text + text[draw.randint(0, len(text)) :] + [symbols] * draw.randint(0, 30) + [0]
        seen = collections.Counter(tuple(text[i : i + size]) for i in range(len(text) - size + 1))
        want = [i + size <= len(text) and seen[tuple(text[i : i + size])] > 1 for i in range(len(text))]
        assert induction.repeated_starts(np.array(text, np.uint8), size, limit, draw.choice([1, 8, 1 << 21])).tolist() == want


def test_large_shard_waits_on_disk():
    draw = np.random.default_rng(5)
    part = draw.integers(1, 250, 40_000).astype(np.uint8)
    text = np.r_[part, draw.integers(1, 250, 60_000).astype(np.uint8), part, np.uint8(0)]
    small, large = (induction.repeated_starts(text, 200, limit, memory) for limit, memory in ((1000, 100), (1 << 30, 1 << 21)))
    assert (small == large).all() and small.sum() == 2 * (40_000 - 199)


def answers(cut):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    rows = cut.select("doc_id", F.length("kept") + removed, removed, F.size("spans"), F.sha2("kept", 256)).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, *r[1:], r[0]))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, *r[1:], r[0]))


@pytest.mark.parametrize("size, group", [(20, 1 << 23), (20, 300), (7, 50), (200, 1 << 23)])
def test_awkward_documents(spark, size, group):
    draw = random.Random(size)
    text = lambda n: "".join(draw.choice(["alpha", "beta", "ß", "gamma", " ", "\0", "x"]) for _ in range(n))
    base = [text(30) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "x" * 500), (4, "xy" * 70), (5, "x" * 20), (None, base[0]), (6, base[0])]
    rows += [(10 + k, text(draw.randint(0, 40)) + draw.choice(base) + text(draw.randint(0, 9)) + draw.choice(base)[draw.randint(0, 50) :]) for k in range(40)]
    rows += rows[-3:]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, key string, uid long")
    got = passages.remove_repeated_passages(docs, size, group_bytes=group, queue_bytes=200)
    assert answers(got) == ordered(brute.uncovered(rows, size))


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = suite.QUERIES["op13_suffix_array_dedup"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert ordered(tuple(r) for r in got.collect()) == ordered(brute.uncovered(rows))


def test_very_long_text(spark):
    # windows of one text lie in several blocks
    draw = np.random.default_rng(1)
    part = "".join(map(chr, draw.integers(97, 123, 3000)))
    long = part + "".join(map(chr, draw.integers(97, 123, passages.BLOCK + 500))) + part
    docs = spark.createDataFrame([(1, long), (2, "a" * 50_000)], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in passages.remove_repeated_passages(docs).collect()}
    assert got == {1: [(0, 3000), (len(long) - 3000, len(long))], 2: [(0, 50_000)]}


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert passages.remove_repeated_passages(docs).collect() == []
