"""Spelling variants: words one letter apart, found by partition-and-enumerate signatures.

The letters of a word are a binary vector: one dimension for each (letter, how often it has come up). One
inserted or deleted letter changes one dimension, one replaced letter two, so near words are at a Hamming distance of at
most two. The dimensions are dealt to ``PARTS`` parts; two changes spoil at most two of them, so near words agree wholly
in one of the ways to choose ``PARTS`` - 2 parts. Each choice is a signature.

The equi-join key also holds what an edit cannot touch at once: for a shorter word of m letters, either its first
m // 2 letters or its last m - m // 2. Words are listed under their own length, and under one letter less as the longer
of a pair. Keys are 64-bit hashes; every pair that meets is verified by its edit distance, so nothing depends on them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitspark.plans.scale import stored

PARTS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"A-Za-zÀ-ÿ"


def runs(docs: DataFrame, min_length: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``doc_id``, ``run``: maximal runs of at least ``min_length`` letters, A-Z in lower case."""
    found = F.regexp_extract_all(F.col(text), F.lit("[%s]{%d,}" % (LETTERS, min_length)), F.lit(0))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))


def worn(runs: DataFrame, every: int = 31) -> DataFrame:
    """Column ``word``: the run, without one letter where the crc32 of ``<doc_id>:<run>`` is divisible by ``every``.

    A null id counts as empty.
    """
    owner = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    hashed = runs.withColumn("h", F.crc32(F.concat(owner, F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def count_words(words: DataFrame, min_length: int, min_count: int) -> DataFrame:
    """Distinct words of enough letters and occurrences: ``word``, ``n``; counted before the shuffle."""
    long_enough = words.filter(F.char_length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _chosen(word: str, part_of: dict[str, int]) -> list[str]:
    """The signatures of a word: the letters of every choice of parts, as text."""
    parts: list[list[str]] = [[] for _ in range(PARTS)]
    times: dict[str, int] = {}
    for letter in word:
        times[letter] = k = times.get(letter, 0) + 1
        dim = f"{letter}{k}"
        if dim not in part_of:
            part_of[dim] = (ord(letter) * 7 + k * 13) % 257 % PARTS
        parts[part_of[dim]].append(dim)
    named = ["".join(sorted(p)) for p in parts]
    return ["|".join([str(c), *[named[p] for p in chosen]]) for c, chosen in enumerate(itertools.combinations(range(PARTS), PARTS - 2))]


def _signatures(roles: tuple[bool, ...]):
    """Rows (longer, key text, word, n), for words as the shorter or the longer one of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_of: dict[str, int] = {}  # dimensions are few: letters times repeats within a word
        for batch in batches:
            texts, longer, rows = [], [], []
            for at, word in enumerate(batch.column(0).to_pylist()):
                chosen = _chosen(word, part_of)
                for role in roles:
                    m = len(word) - role
                    affixes = (f"{m}<{word[: m // 2]}|", f"{m}>{word[len(word) - (m - m // 2) :]}|")
                    texts += [affix + signature for affix in affixes for signature in chosen]
                    longer += [role] * (2 * len(chosen))
                    rows += [at] * (2 * len(chosen))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), pa.array(longer, pa.bool_()), batch.column(0).take(at), batch.column(1).take(at)],
                ["text", "longer", "word", "n"],
            )

    return run


def near_words(words: DataFrame) -> DataFrame:
    """Ordered pairs of ``words`` (``word``, ``n``) one insertion, deletion or replacement apart.

    Columns ``word``, ``other``, ``other_n``; both directions of a pair. The words of one key share half their letters in
    place and half their multiset, so keys stay small; a key with many words is split by adaptive joins, and
    pairs that fail the edit distance are dropped inside the join.
    """
    kind = "text string, longer boolean, word string, n long"
    listed = lambda *roles: words.select("word", "n").mapInArrow(_signatures(roles), kind).withColumn("key", F.xxhash64("text"))
    short = listed(False).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    other = listed(False, True).select("key", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
    close = (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    pairs = short.join(other, "key").filter(close).select("a", "a_n", "b", "b_n").distinct()
    both = F.explode(F.array(_pair("a", "b"), _pair("b", "a")))
    return pairs.select(both.alias("p")).select("p.word", "p.other", "p.other_n")


def _pair(word: str, other: str) -> Column:
    return F.struct(F.col(word).alias("word"), F.col(other).alias("other"), F.col(f"{other}_n").alias("other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """Last form of each chain: columns ``word``, ``root``, from rows ``word``, ``form`` without nulls.

    Counts rise along a chain, so chains have no cycles; steps double each round.
    """
    table = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = table.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(table.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        table = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return table


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Each word with its form: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``words`` has one row per ``word`` with its count ``n``; other columns are ignored, null and empty words are near no
    other. The form is the near word with the largest count (ties: the first in code-point order), if that is at least
    ``ratio`` (above 1) times the word's. An empty table gives an empty result.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    near = near_words(words.filter("length(word) > 0")).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= F.col("n") * ratio
    judged = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    last = roots(judged.filter("form is not null"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Variants among the words of whole texts, see ``runs``, ``worn``, ``count_words`` and ``group_variants``.

    Null and empty texts have no words, repeated rows count again, and other columns are ignored. Only runs of
    ``min_length`` letters are read, as shorter ones cannot become words.
    """
    words = count_words(worn(runs(docs, min_length, doc_id, text)), min_length, min_count)
    return group_variants(words, ratio)
