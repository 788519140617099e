"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens in which numbers, names and units are typed placeholders:
a number holds a digit, a unit follows a number and is in ``UNITS``, a name is a run of
capitalised words that does not begin a sentence. Everything else is a literal in lower case; punctuation is dropped.
Windows of eight tokens with at least five literals are hashed and joined with the
windows of the benchmark. A document holds an item if at least six different windows of
the item (13 tokens in a row), or all of a shorter item, match and the values in the slots are consistent:
each value of the item stands for one value of the document and the other way
round. That is judged for every occurrence by itself: the matches at one distance between the positions of document and
item, a stretch of matches that goes forward in both (so an occurrence with inserted words), and all
matches of the document together. One that passes is enough. So a question asked again with other numbers is
found, also next to the original, and a table of unrelated numbers is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from habitspark.llm import words
from habitspark.plans.scale import broadcast_bytes_limit, stored

WINDOW = 8
LITERALS = 5
ENOUGH = 6
GAP = 2 * WINDOW  # positions without a match that end a stretch
CONSISTENT = 0.8
# units of measure, currencies and time spans (fixed values)
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hrs ms day days week weeks month months year years "
    "hour hours minute minutes second seconds meter meters metre metres kilometer kilometers kilogram kilograms gram grams "
    "liter liters litre litres mile miles foot feet inch inches pound pounds dollar dollars usd eur euro euros cent cents "
    "percent degree degrees c f k v w kw kwh j kj cal kcal hz khz mhz ghz kb mb gb tb mph kmh"
).split()

NUMBER, NAME, UNIT = (np.uint64(v) for v in (11, 22, 33))
_KINDS = {int(NUMBER): "number", int(NAME): "name", int(UNIT): "unit"}

_TOKEN = np.zeros(256, bool)
_TOKEN[0x30:0x3A] = _TOKEN[0x41:0x5B] = _TOKEN[0x61:0x7B] = _TOKEN[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_ENDER = np.zeros(256, bool)
_ENDER[list(b".!?:\n")] = True
_OWN_BREAK = 0  # byte written over separators, so that points inside numbers survive


def _hash_of(word: str) -> np.uint64:
    return words.split_words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())])).hashes()[0]


_UNIT_HASHES = np.sort(np.array([_hash_of(u) for u in UNITS], np.uint64))


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token codes (placeholder or hash), literal flags, byte ranges and the first token of each text."""
    n = len(data)
    keep = _TOKEN[data]
    digit = _DIGIT[data]
    inner = ((data == 0x2E) | (data == 0x2C)) & np.r_[False, digit[:-1]] & np.r_[digit[1:], False] if n else keep
    keep = keep | inner
    # capitals of two-byte letters (A grave to thorn) become small as well
    raw = data
    wide = np.r_[False, (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)] if n else keep
    shaped = np.where(wide, raw + 0x20, raw).astype(np.uint8)
    shaped[~keep] = _OWN_BREAK
    between = np.zeros(256, bool)
    between[_OWN_BREAK] = True
    w = words.split_words(shaped, offsets, between)
    h = w.hashes()
    m = len(h)
    if not m:
        return h, np.zeros(0, bool), w.starts, w.ends, w.first
    count = np.r_[0, np.cumsum(digit)]
    number = count[w.ends] > count[w.starts]
    first = np.zeros(m, bool)
    first[w.first[:-1][w.first[:-1] < m]] = True
    after_number = np.r_[False, number[:-1]] & ~first
    unit = ~number & after_number & np.isin(h, _UNIT_HASHES)
    lead = raw[w.starts]
    capital = ((lead >= 0x41) & (lead <= 0x5A)) | ((lead == 0xC3) & wide[np.minimum(w.starts + 1, n - 1)])
    ends = np.r_[0, np.cumsum(_ENDER[raw] & ~keep)]
    opens = first | (ends[w.starts] > ends[np.r_[0, w.ends[:-1]]])
    name = capital & ~opens & ~number & ~unit
    code = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, h)))
    literal = ~(number | unit | name)
    # a name of several words is one slot
    more = name & np.r_[False, name[:-1]] & ~first
    heads = np.flatnonzero(~more)
    tails = w.ends[np.r_[heads[1:], m] - 1]
    kept_before = np.r_[0, np.cumsum(~more)]
    return code[heads], literal[heads], w.starts[heads], tails, kept_before[w.first]


def _windows(column: pa.Array, wanted: np.ndarray | None) -> Iterator[tuple[int, int, int, int, list[str]]]:
    """(text, position, hash, windows of the text, slots as 'kind:value'), for the wanted hashes only if given."""
    raw, bounds = words.text_bytes(column)
    n = len(bounds) - 1
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + words.SLICE_BYTES, "right")) - 1)
        data, off = raw[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        code, literal, starts, ends, first = canonical(data, off)
        if len(code) >= WINDOW:
            h = words.rolling(code, WINDOW)
            lits = np.r_[0, np.cumsum(literal)]
            text = np.searchsorted(first, np.arange(len(h)), "right") - 1
            good = (lits[WINDOW:] - lits[:-WINDOW] >= LITERALS) & (np.arange(len(h)) + WINDOW <= first[text + 1])
            number = np.bincount(text[good], minlength=end - at)
            if wanted is not None:
                place = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
                good &= wanted[place] == h if len(wanted) else False
            for i in np.flatnonzero(good).tolist():
                slots = [
                    f"{_KINDS[int(code[j])]}:{data[starts[j] : ends[j]].tobytes().decode('utf-8', 'replace').lower()}"
                    for j in range(i, i + WINDOW)
                    if not literal[j]
                ]
                yield at + int(text[i]), i - int(first[text[i]]), int(h[i].view(np.int64)), int(number[text[i]]), slots
        at = end


def _windowed(wanted: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_windows(batch.column(1), wanted))
            ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    ids, batch.column(2).take(pa.array([f[0] for f in found], pa.int64())), *[pa.array([f[i] for f in found], pa.int64()) for i in (1, 2, 3)],
                    pa.array([f[4] for f in found], pa.list_(pa.string())),
                ],
                ["id", "copy", "pos", "h", "total", "slots"],
            )

    return run


_SCHEMA = "id long, copy long, pos long, h long, total long, slots array<string>"


def windows(df: DataFrame, key: str, text: str, wanted: np.ndarray | None = None) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("copy")).filter(F.col("text").isNotNull())
    return rows.mapInArrow(_windowed(wanted), _SCHEMA)


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold a benchmark item: ``doc_id``, ``item_id``, ``windows``, ``slots``, ``consistent``.

    One row per document and item found, with the figures of its occurrence of most windows. Rows with the same id are also
    judged together, and so are items; null texts hold nothing. An item without a window (under eight tokens, or mostly
    placeholders) is never found. With no item the result is empty.
    """
    spark = docs.sparkSession
    items = stored(windows(benchmark, item_id, item_text).withColumnRenamed("id", "item_id"))
    distinct = items.select("h").distinct()
    wanted = None
    if distinct.count() * 8 <= broadcast_bytes_limit(spark):
        # few enough to send along, so that only matching windows leave the scan
        wanted = np.sort(distinct.toArrow()["h"].to_numpy()).view(np.uint64)
        wanted = np.sort(wanted)
    hits = windows(docs, doc_id, text, wanted).select(F.col("id").alias("doc_id"), "copy", F.col("pos").alias("doc_pos"), "h", F.col("slots").alias("doc_slots"))
    matched = stored(hits.join(items.select("item_id", F.col("copy").alias("item_copy"), "pos", "h", "total", "slots"), "h"))
    pair = ["doc_id", "copy", "item_id", "item_copy"]
    forward = Window.partitionBy(*pair).orderBy("doc_pos", "pos")
    # a stretch ends where nothing matches for long, or where the item begins anew
    back = (F.col("doc_pos") > F.lag("doc_pos").over(forward)) & (F.col("pos") < F.lag("pos").over(forward))
    ends = F.coalesce(back | (F.col("doc_pos") - F.lag("doc_pos").over(forward) > GAP), F.lit(False))
    stretch = F.sum(F.col("ends").cast("int")).over(forward.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # each match counts for its distance, for its stretch and for the whole document
    places = F.array(
        F.xxhash64(F.lit("distance"), *[F.coalesce(F.col(c), F.lit(-1)) for c in pair], F.col("doc_pos") - F.col("pos")),
        F.xxhash64(F.lit("stretch"), *[F.coalesce(F.col(c), F.lit(-1)) for c in pair], "stretch"),
        F.xxhash64(F.lit("all"), F.col("doc_id").isNull(), F.col("item_id").isNull(), "doc_id", "item_id"),
    )
    placed = matched.withColumn("ends", ends).withColumn("stretch", stretch).withColumn("place", F.explode(places))
    per_place = placed.groupBy("doc_id", "item_id", "place").agg(F.countDistinct("pos").alias("windows"), F.max("total").alias("total"))
    enough = stored(per_place.filter(F.col("windows") >= F.least(F.lit(ENOUGH), F.col("total"))).drop("total"))
    pairs = placed.filter(F.size("slots") > 0).join(enough.select("place"), "place", "left_semi").select("place", F.explode(F.arrays_zip("slots", "doc_slots")).alias("s"))
    pairs = pairs.select("place", F.col("s.slots").alias("there"), F.col("s.doc_slots").alias("here")).distinct()
    seen = pairs.groupBy("place", "there").agg(F.count(F.lit(1)).alias("to"), F.min("here").alias("here"))
    back = seen.groupBy("place", "here").agg(F.count(F.lit(1)).alias("from"), F.sum((F.col("to") == 1).cast("int")).alias("single"))
    share = back.groupBy("place").agg(F.sum("from").alias("slots"), F.sum(F.when(F.col("from") == 1, F.col("single")).otherwise(0)).alias("good"))
    consistent = F.coalesce(F.col("good") / F.col("slots"), F.lit(1.0))
    judged = enough.join(share, "place", "left").select("doc_id", "item_id", "windows", consistent.alias("consistent"), F.coalesce("slots", F.lit(0)).alias("slots"))
    best = judged.filter(F.col("consistent") >= CONSISTENT).groupBy("doc_id", "item_id").agg(F.max(F.struct("windows", "consistent", "slots")).alias("b"))
    return best.select("doc_id", "item_id", "b.windows", "b.slots", "b.consistent")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """Every row of ``docs`` as ``doc_id``, ``contaminated``, ``item_id`` (smallest one found) and ``items``."""
    doc_id = columns.get("doc_id", "doc_id")
    leaks = find_leaks(docs, benchmark, **columns).groupBy("doc_id").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("items"))
    leaks = leaks.withColumnRenamed("doc_id", "_id")
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    return ids.join(leaks, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), "item_id", F.coalesce("items", F.lit(0)).alias("items")
    )
