"""Exact removal of repeated passages: external induced sorting of suffixes, over shards dealt by content.

A *window* is a string of ``size`` bytes within one document. A byte goes if a window over it begins anywhere else too.

* **Shards.** The key of a window is the least hash of its grams, so equal windows have equal keys. Consecutive windows of equal
  key are a *run*; its bytes are an *extract*. Keys of one window only are dropped. Equal extracts become one with its number
  of copies. Extracts are dealt to shards by key, so all occurrences of a window meet in one shard.
* **Sorting.** A shard sorts all suffixes of its extracts by induction (``induction``), with queues on disk and capped common
  prefixes. A window is repeated if its suffix shares ``size`` bytes with a neighbour, or its extract has copies.
* **Hot keys.** A key with more than ``GROUP_BYTES`` of different extracts is dealt again with longer grams, in the end by the
  windows themselves, of which equal ones are one. So no key puts more than that into one task, and none is left out.

Rows of the second exchange are runs, not texts; texts move once, for the extracts, and once for the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitspark.llm.induction import QUEUE_BYTES, repeated_starts
from habitspark.llm.words import Bytes
from habitspark.plans.scale import stored

BLOCK = 1 << 17  # bytes that are looked at together
LONGEST_RUN = 4096
PIECE_ROWS = 100_000  # rows that a task sends on together
CUT_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
GROUP_BYTES = 8 << 20

RUN = "key long, digest long, uid long, start long, n long, weight long"


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` consecutive values."""
    out, size = values, 1
    while 2 * size <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(values) - width + 1], out[width - size :]) if size < width else out


def _runs(data: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of equal key in texts that lie one after another.

    Columns: index of the text, key, digest of the extract, first window, windows, and 2 if a window may come twice.
    """
    hashes = Bytes(data)
    grams = hashes.grams(gram)
    width = size - gram + 1
    least = _slide(grams, width, np.minimum)
    inside = np.zeros(len(data) + 1, np.int8)  # windows that end within their text
    lengths = np.diff(offsets)
    some = lengths >= size
    inside[offsets[:-1][some]] += 1
    inside[offsets[1:][some] - size + 1] -= 1
    inside = np.cumsum(inside[: len(least)]) > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge = edge[: len(least)] | np.r_[True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])]
    fresh = np.flatnonzero(edge)
    ends = np.r_[fresh[1:], len(least)]
    fresh, ends = fresh[inside[fresh]], ends[inside[fresh]]
    pieces = -(-(ends - fresh) // LONGEST_RUN)
    starts = np.repeat(fresh, pieces) + LONGEST_RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    ends = np.minimum(np.repeat(ends, pieces), starts + LONGEST_RUN)
    key = least[starts]
    digest = hashes.between(starts, ends + size - 1)
    # a window can come twice in a run only if the least gram does
    around = _slide(np.r_[np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)], width, np.maximum)
    anchors = np.flatnonzero(grams == around)
    first, last = np.searchsorted(anchors, starts), np.searchsorted(anchors, ends + width - 1)
    n = last - first
    run = np.repeat(np.arange(len(starts)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    same = np.bincount(run, weights=grams[anchors[place]] == key[run], minlength=len(starts))
    text = np.searchsorted(offsets, starts, "right") - 1
    return text, key, digest, starts - offsets[text], ends - starts, np.where(same > 1, 2, 1)


def _blocks(texts: pa.Array, size: int, gram: int) -> Iterator[tuple]:
    """Runs of all texts, about ``BLOCK`` bytes at a time: index of the text, then the columns of ``_runs``."""
    held: list[tuple[int, int, np.ndarray]] = []

    def sent() -> tuple:
        owner, begin = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        offsets = np.r_[0, np.cumsum([len(h[2]) for h in held])]
        piece, key, digest, start, n, weight = _runs(np.concatenate([h[2] for h in held]), offsets, size, gram)
        return owner[piece], key, digest, start + begin[piece], n, weight

    for at, raw in enumerate(texts):
        data = np.frombuffer(raw.as_buffer(), np.uint8) if raw.is_valid else np.zeros(0, np.uint8)
        for begin in range(0, len(data) - size + 1, BLOCK):
            held.append((at, begin, data[begin : begin + BLOCK + size - 1]))
            if len(held) * size >= BLOCK or sum(len(h[2]) for h in held) >= BLOCK:
                yield sent()
                held = []
    if held:
        yield sent()


def _found(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "digest", "uid", "start", "n", "weight"]
        for batch in batches:
            uids = batch.column(0).to_numpy()
            out: list[tuple] = []
            held = 0
            for at, key, digest, start, n, weight in _blocks(batch.column(1), size, gram):
                out.append((key.view(np.int64), digest.view(np.int64), uids[at], start, n, weight))
                held += len(key)
                if held > PIECE_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    return run


def _keys(size: int, gram: int):
    """Keys and weights only, combined per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _found(size, gram)(batches):
            key, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            weight = np.bincount(at, weights=batch.column(5).to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(weight)], ["key", "weight"])

    return run


def _cut(size: int):
    """The bytes of extracts, a bounded number of them at a time."""

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["key", "digest", "copies", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for text, extracts in zip(batch.column(0), batch.column(1)):
                data = text.as_buffer()
                for e in extracts:
                    begin, n = e["start"].as_py(), e["n"].as_py()
                    rows.append((e["key"].as_py(), e["digest"].as_py(), e["copies"].as_py(), data[begin : begin + n + size - 1].to_pybytes()))
                    if len(rows) * (LONGEST_RUN + size) > CUT_BYTES:
                        yield sent(rows)
                        rows = []
        yield sent(rows)

    return run


def _shard(size: int, limit: int):
    """Repeated windows of a shard's extracts as stretches [first, last) of window starts."""

    def run(table: pa.Table) -> pa.Table:
        raw = [np.frombuffer(b.as_buffer(), np.uint8) for b in table["bytes"].combine_chunks()]
        lengths = np.array([len(r) for r in raw])
        offsets = np.r_[0, np.cumsum(lengths + 1)]
        text = np.ones(offsets[-1] + 1, np.uint8)  # 1 ends an extract, bytes of UTF-8 texts stay below 254
        text[-1] = 0
        for at, r in zip(offsets, raw):
            text[at : at + len(r)] = r + 2
        again = repeated_starts(text, size, limit)
        copies = table["copies"].to_numpy()
        for k in np.flatnonzero(copies > 1).tolist():
            again[offsets[k] : offsets[k + 1]] = True
        for at, n in zip(offsets, lengths):
            again[at + n - size + 1 : at + n + 1] = False  # no whole window begins here
        again[-1] = False
        edges = np.flatnonzero(np.diff(np.r_[False, again, False].astype(np.int8)))
        first, last = edges[::2], edges[1::2]
        owner = np.searchsorted(offsets, first, "right") - 1
        return pa.table(
            {
                "key": table["key"].to_numpy()[owner],
                "digest": table["digest"].to_numpy()[owner],
                "first": first - offsets[owner],
                "last": last - offsets[owner],
            }
        )

    return run


def repeated_windows(units: DataFrame, size: int, grams: tuple[int, ...], group_bytes: int, shard_bytes: int, queue_bytes: int) -> DataFrame:
    """Stretches of starts of repeated windows: ``uid``, ``first``, ``last`` (exclusive), from rows ``uid``, ``text`` (binary).

    Rows of equal ``uid`` must have equal texts. ``grams`` are the gram lengths to deal by, the last of them ``size``.
    """
    gram = grams[0]
    spark = units.sparkSession
    weights = units.mapInArrow(_keys(size, gram), "key long, weight long").groupBy("key").agg(F.sum("weight").alias("w"))
    wanted = stored(weights.filter("w > 1").select("key"))
    runs = stored(units.mapInArrow(_found(size, gram), RUN).join(wanted, "key", "left_semi"))
    distinct = stored(
        runs.groupBy("key", "digest").agg(
            F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.min(F.struct("uid", "start")).alias("at")
        )
    )
    total, over = stored(distinct.groupBy("key").agg(F.sum(F.col("n") + size).alias("b"))).agg(F.sum("b"), F.max("b")).first()
    places = distinct.select(F.col("at.uid").alias("uid"), F.struct("key", "digest", "copies", "n", F.col("at.start").alias("start")).alias("e"))
    texts = units.dropDuplicates(["uid"]).join(places.groupBy("uid").agg(F.collect_list("e").alias("extracts")), "uid")
    extracts = texts.select("text", "extracts").mapInArrow(_cut(size), "key long, digest long, copies long, bytes binary")
    hits = []
    if (over or 0) > group_bytes and len(grams) > 1:
        extracts = stored(extracts)
        hot = distinct.groupBy("key").agg(F.sum(F.col("n") + size).alias("b")).filter(F.col("b") > group_bytes).select("key")
        apart = stored(extracts.join(hot, "key", "left_semi").withColumn("uid", F.xxhash64("key", "digest")))
        extracts = extracts.join(hot, "key", "left_anti")
        below = repeated_windows(apart.select("uid", F.col("bytes").alias("text")), size, grams[1:], group_bytes, shard_bytes, queue_bytes)
        copied = apart.filter("copies > 1").select("key", "digest", F.lit(0).cast("long").alias("first"), (F.length("bytes") - size + 1).cast("long").alias("last"))
        hits = [apart.select("uid", "key", "digest").join(below, "uid").select("key", "digest", "first", "last"), copied]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // shard_bytes))
    dealt = extracts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    marks = dealt.groupBy("shard").applyInArrow(_shard(size, queue_bytes), "key long, digest long, first long, last long")
    for more in hits:
        marks = marks.unionByName(more)
    return runs.join(marks, ["key", "digest"]).select("uid", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")).distinct()


def _kept(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for text, stretches in zip(batch.column(1), batch.column(2)):
                data = text.as_buffer()
                pieces, gone, at = [], [], 0
                for s in sorted(stretches.as_py() or [], key=lambda s: s["first"]):
                    first, last = s["first"], s["last"] + size - 1
                    if gone and first <= gone[-1]["end"]:
                        gone[-1]["end"] = max(gone[-1]["end"], last)
                    else:
                        gone.append({"start": first, "end": last})
                for g in gone:
                    pieces.append(data[at : g["start"]].to_pybytes())
                    at = g["end"]
                kept.append(b"".join([*pieces, data[at:].to_pybytes()]))
                spans.append(gone)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "spans", "kept"])

    return run


def remove_repeated_passages(
    docs: DataFrame, size: int = 200, doc_id: str = "doc_id", text: str = "text", grams: tuple[int, ...] | None = None,
    group_bytes: int = GROUP_BYTES, shard_bytes: int = SHARD_BYTES, queue_bytes: int = QUEUE_BYTES,
) -> DataFrame:
    """One row per input row: ``doc_id``, removed ``spans`` (start, end in bytes) and ``kept``, the remaining bytes.

    A null text counts as empty; texts under ``size`` bytes stay whole. Rows are documents, so a repeated row repeats all its
    windows, whatever its id. Spans may begin or end within a character, so ``kept`` is binary. Other columns are ignored.
    Rows and extracts are told apart by 64-bit hashes of (id, text) and of (gram, extract).
    """
    grams = grams or (min(40, size), max(min(40, size), size * 4 // 5), size)
    binary = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), binary.alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    units = rows.filter(F.length("text") >= size).select("uid", "text")
    found = repeated_windows(units, size, grams, group_bytes, shard_bytes, queue_bytes)
    stretches = found.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("stretches"))
    return rows.join(stretches, "uid", "left").select("doc_id", "text", "stretches").mapInArrow(
        _kept(size), "doc_id long, spans array<struct<start:long,end:long>>, kept binary"
    )
