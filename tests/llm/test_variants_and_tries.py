"""Spelling variants and conversation tries against brute force, on awkward rows and on empty tables."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from habitspark.llm import spellings, turntrie  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, head string, n long, depth string"


def variants_of(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, word string, n long, key string")
    got = spellings.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in got.collect())


def test_variants_of_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()][:60]
    assert variants_of(spark, rows) == brute.variants(brute.worn_words(rows))


def test_variants_of_awkward_texts(spark):
    words = ["straßen", "strassen", "Straßen", "grössere", "groessere", "abcdefg", "abcdefh", "bcdefgh", "aaaaaaa", "aaaaaaaa", "éèàçñöü", "x" * 3000, "x" * 2999]
    rows = [(k, " ".join(words[k % len(words) :])) for k in range(40)]
    rows += [(1, None), (None, None), (2, ""), (3, "short words only"), (None, "abcdefgh " * 90), (4, "a,b" * 5000), (5, "abcdefg×÷ abcdefg×÷"), (6, "ABCDEFGÀ abcdefgà " * 3)]
    rows += [rows[0]] * 5
    assert variants_of(spark, rows) == brute.variants(brute.worn_words(rows))


def test_variants_of_nothing(spark):
    assert variants_of(spark, []) == []
    assert variants_of(spark, [(1, None)]) == []


def test_forms_follow_counts_and_code_points(spark):
    # a chain of three, a tie decided by code points, and a word just below the ratio
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "zzzzzzz": 3, "zzzzzzy": 40, "zzzzzzx": 40, "mmmmmmm": 2, "mmmmmmn": 19}
    words = spark.createDataFrame([*counts.items(), ("", 5), (None, 5)], "word string, n long")
    got = {r.word: (r.form, r.root) for r in spellings.group_variants(words).collect()}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghi") and got["zzzzzzz"] == ("zzzzzzx", "zzzzzzx") and got["mmmmmmm"] == (None, "mmmmmmm")
    assert got[""] == (None, "") and got[None] == (None, None)


@pytest.mark.parametrize("seed", range(3))
def test_every_near_pair_meets(spark, seed):
    draw = random.Random(seed)
    words = {"".join(draw.choice("abcß") for _ in range(draw.randint(1, 9))) for _ in range(400)}
    got = {(r.word, r.other) for r in spellings.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()}
    assert got == {(a, b) for a in words for b in words if brute.one_apart(a, b)}


def trie_of(spark, rows, burst):
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS)
    got = turntrie.conversation_trie(table, burst)
    return sorted(tuple(-1 if v is None else v for v in r) for r in got.collect())


@pytest.mark.parametrize("burst", [1, 5, 512])
def test_trie_of_given_conversations(spark, burst):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_of(spark, rows, burst) == brute.trie(brute.rebuilt(rows))


@pytest.mark.parametrize("burst", [1, 3, 512])
def test_trie_of_awkward_conversations(spark, burst):
    draw = random.Random(burst)
    rows = []
    for c in [-7, -5, *range(40), 10**12]:
        for t in range(draw.randint(1, 9)):
            rows.append((c, draw.choice([None, t, t // 2]), draw.choice(["user", None, ""]), draw.choice(["a", "ä", None, "", "b" * 5000])))
    rows += [(100 + c, t, "user", "same") for c in range(0, 200) for t in range(3)]
    rows += [(500, t, "user", f"turn {t % 7}") for t in range(3000)]
    rows += [(None, 0, "user", "without a conversation"), *rows[:5]]
    want = brute.trie(brute.rebuilt(rows))
    assert trie_of(spark, rows, burst) == want


def test_trie_of_nothing(spark):
    assert trie_of(spark, [], 1) == []
    assert trie_of(spark, [(None, 1, "user", "x")], 1) == []


def test_pieces_of_one_node_are_hashed_in_order(spark):
    members = spark.range(50_000).select(F.lit(b"k").alias("key"), F.col("id").alias("conv_id")).repartition(5)
    import hashlib

    got = turntrie.id_digests(members).collect()
    assert [r.sha for r in got] == [hashlib.sha256(",".join(map(str, range(50_000))).encode()).hexdigest()]
