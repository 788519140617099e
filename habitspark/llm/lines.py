"""Line deduplication by an exact set-similarity join on line tokens.

A line is the set of its distinct words. A line goes when a line before it (smaller document id, then
smaller line number) has a Jaccard similarity of at least ``percent`` / 100; whether that
earlier line stays itself does not matter. Lines with fewer than ``min_tokens`` distinct words are
too short to judge and always stay.

Equal sets are one class, found by digest. For different sets, words are ordered by rarity:
by the magnitude of a count kept in a table of fixed size (4 MB, words share
counters by hash), then by hash. Any two similar sets share a word among the first
few of each, the prefix, and a second one among those and the next. A class is listed under each rare word of its prefix, and
for a common word (over ``COMMON`` lines) under the pairs of that word and each later one instead, so lists stay short. Pairs on one list pass the length and the
positional filter, and one on 64 parities of the words of each set, then one on 512, before their whole sets are
compared. A list that is long all the same is not paired directly: all its classes are compared with the
earliest one, and those still without an earlier match then meet the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitspark.llm import words
from habitspark.llm.tables import dropped, written
from habitspark.plans.scale import broadcast_bytes_limit

COMMON = 1024
NEAREST = 1
POSTINGS = 250_000
BLOCK = 100_000  # pairs looked at in one piece
PAIRS = 2000  # pairs verified in one piece, below 2^18
ROUNDS = 16  # at most so many shares of the pairs, for which whole sets are sent one after the other
PARITIES = 8  # longs of parities that are compared before whole sets are
FLUSH = 250_000
SKETCH_BITS = 22
PAGE_BITS = 12
MARK_BITS = 26  # a bitmap of marked hashes has at most so many bits, 8 MB
BROADCAST_SHARE = 8  # rows take several times their own size in a broadcast, and each executor holds it


def _sorted(high: np.ndarray, mid: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """Order by ``high`` (below 2^18), then ``mid`` (below 2^8), then hash."""
    key = high.astype(np.uint64) << np.uint64(46)
    if mid is None:
        key |= h >> np.uint64(18)
    else:
        key |= mid.astype(np.uint64) << np.uint64(38) | h >> np.uint64(26)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    # bits cut off may only hide equal hashes
    if (same & (h[order][1:] != h[order][:-1])).any():
        return np.lexsort((h, high) if mid is None else (h, mid, high))
    return order


class Lines:
    """The lines of enough words of some texts: sets of word hashes, one after the other."""

    def __init__(self, w: words.Words, min_tokens: int, base: int):
        h = w.hashes()
        feeds = np.flatnonzero(w.data == 10)
        text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        # a new text is a new line as well
        row = np.searchsorted(feeds, w.starts) + text
        order = _sorted(row, None, h) if len(h) and row[-1] < 1 << 18 else np.lexsort((h, row))
        h, row = h[order], row[order]
        fresh = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
        h, row, text = h[fresh], row[fresh], text[fresh]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(h)])
        long = n >= min_tokens
        self.hashes = h[np.repeat(long, n)]
        self.n = n[long]
        self.first = np.cumsum(self.n) - self.n
        self.text = text[first[long]] + base
        self.number = row[first[long]] - text[first[long]] - np.searchsorted(feeds, w.offsets[:-1])[text[first[long]]]
        if len(self.n):
            one = np.add.reduceat(words.mix(self.hashes), self.first)
            two = np.add.reduceat(words.mix(self.hashes ^ np.uint64(0x2545F4914F6CDD1D)), self.first)
            self.cls = words.mix(one ^ words.mix(two + self.n.astype(np.uint64))).view(np.int64)
            bit = np.uint64(1) << ((self.hashes >> np.uint64(7)) & np.uint64(63))
            self.parity = np.bitwise_xor.reduceat(bit, self.first).view(np.int64)
        else:
            self.cls = self.parity = np.zeros(0, np.int64)


def lines_of(column: pa.Array, min_tokens: int) -> Iterator[Lines]:
    for at, w in words.slices(column):
        yield Lines(w, min_tokens, at)


def _summaries(min_tokens: int):
    """Lines (page null), and per task the counts of words (doc_id and line null) in pages of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "line", "cls", "n", "parity", "page", "at", "counts"]
        for batch in batches:
            for found in lines_of(batch.column(1), min_tokens):
                m = len(found.n)
                slot = np.sort((found.hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32))
                first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
                counts[slot[first]] += np.diff(np.r_[first, len(slot)]).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(found.text)), pa.array(found.number.astype(np.int32)), pa.array(found.cls), pa.array(found.n.astype(np.int32)),
                        pa.array(found.parity), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()),
                    ],
                    names,
                )
        pages = counts.reshape(-1, 1 << PAGE_BITS)
        used = np.flatnonzero(pages.any(axis=1))
        at = [np.flatnonzero(pages[p]).astype(np.uint16) for p in used]
        m = len(used)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()),
                pa.array(used.astype(np.int32)), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([pages[p][a].tobytes() for p, a in zip(used, at)], pa.binary()),
            ],
            names,
        )

    return run


def _page(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << PAGE_BITS, np.int64)
    for at, n in zip(table["at"].to_pylist(), table["counts"].to_pylist()):
        total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
    level = np.ceil(np.log2(np.maximum(total, 1)) * 4).astype(np.uint8)
    return pa.table({"page": table["page"][:1], "level": pa.array([level.tobytes()], pa.binary())})


def rarity(summaries: DataFrame) -> bytes:
    """Magnitude of the number of lines that hold a word, one byte for each hash range."""
    pages = summaries.filter("page is not null").select("page", "at", "counts").groupBy("page").applyInArrow(_page, "page int, level binary")
    out = bytearray(1 << SKETCH_BITS)
    for page, level in pages.collect():  # at most 2^SKETCH_BITS bytes, whatever the input
        out[page << PAGE_BITS : (page + 1) << PAGE_BITS] = level
    return bytes(out)


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def _keys(found: Lines, new: np.ndarray, percent: int, level: np.ndarray, common_level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the prefixes of the marked lines, with the line and the rank of the first word of each key."""
    line = np.repeat(np.arange(len(found.n)), found.n)
    often = level[found.hashes >> np.uint64(64 - SKETCH_BITS)]
    order = _sorted(line, often, found.hashes) if line[-1] < 1 << 18 else np.lexsort((found.hashes, often, line))
    hashes, often = found.hashes[order], often[order]
    rank = np.arange(len(line)) - found.first[line] + 1
    length = _need(found.n, percent)[line]
    first = (rank <= length) & new[line]
    # a word counted once has no other line
    one = np.flatnonzero(first & (often > 0) & (often <= common_level))
    two = np.flatnonzero(first & (often > common_level))
    times = length[two] + 1 - rank[two]
    two = np.repeat(two, times)
    later = two + 1 + np.arange(len(two)) - np.repeat(np.cumsum(times) - times, times)
    pairs = words.mix(hashes[two] * np.uint64(3) + words.mix(hashes[later]))
    at = np.r_[one, two]
    return np.r_[hashes[one], pairs], line[at], rank[at]


def _common_level(long_list: int) -> int:
    return int(np.floor(np.log2(long_list) * 4))


def _marked_page(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << PAGE_BITS, bool)
    bits[table["slot"].to_numpy() & ((1 << PAGE_BITS) - 1)] = True
    return pa.table({"page": table["page"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def marks(hashes: DataFrame) -> np.ndarray:
    """Bitmap by the first bits of some 64-bit hashes, the only column; about one in sixteen others is marked too, more if there are very many."""
    column = F.col(hashes.columns[0])
    bits = max(PAGE_BITS + 1, min(MARK_BITS, (16 * hashes.count()).bit_length()))
    slots = hashes.select(F.shiftrightunsigned(column, 64 - bits).alias("slot")).withColumn("page", F.shiftright("slot", PAGE_BITS).cast("int"))
    out = np.zeros((1 << (bits - PAGE_BITS), 1 << (PAGE_BITS - 3)), np.uint8)
    for page, raw in slots.groupBy("page").applyInArrow(_marked_page, "page int, bits binary").collect():
        out[page] = np.frombuffer(raw, np.uint8)
    return out.ravel()


def _marked(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = hashes.view(np.uint64) >> np.uint64(64 - (8 * len(bitmap) - 1).bit_length())
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] << (slot & np.uint64(7)).astype(np.uint8) & np.uint8(128)) != 0


def _postings(min_tokens: int, percent: int, level_bytes: bytes, buckets: int, long_list: int, wanted: np.ndarray | None):
    """Distinct lines under the keys (at least the marked ones) of their prefixes: hash, class, size, rank of the first word, parities, smallest document."""

    def flush(parts: list, seen: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, own, n, rank, parity = (np.concatenate([p[i] for p in parts]) for i in range(5))
        doc = least[np.searchsorted(seen, own)]
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        # of a word that is common within this batch already, enough classes to show it go to its bucket
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        place = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
        over = order[place > long_list]
        bucket[over] = -1 - own[over] % buckets
        order = np.lexsort((h, bucket))
        bucket = bucket[order]
        values = [v[order] for v in (h, own, n.astype(np.uint32), rank.astype(np.uint32), parity, doc)]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[cuts[1:], len(h)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[cuts]), *[pa.array([v[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()) for v in values]],
            ["bucket", "hashes", "owners", "sizes", "ranks", "maps", "docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(level_bytes, np.uint8)
        parts: list = []
        seen = least = np.zeros(0, np.int64)  # classes since the last flush, with their smallest document
        held = 0
        for batch in batches:
            ids = pc.fill_null(batch.column(0), -(1 << 63)).to_numpy()
            for found in lines_of(batch.column(1), min_tokens):
                if not len(found.n):
                    continue
                _, once = np.unique(found.cls, return_index=True)
                new = np.zeros(len(found.n), bool)
                new[once] = True
                new &= ~np.isin(found.cls, seen)
                keys, at, rank = _keys(found, new, percent, level, _common_level(long_list))
                if wanted is not None:
                    hit = _marked(keys, wanted)
                    keys, at, rank = keys[hit], at[hit], rank[hit]
                parts.append((keys, found.cls[at], found.n[at], rank, found.parity[at]))
                cls, doc = np.r_[seen, found.cls], np.r_[least, ids[found.text]]
                order = np.lexsort((doc, cls))
                order = order[np.r_[True, cls[order][1:] != cls[order][:-1]]]
                seen, least = cls[order], doc[order]
                held += len(at)
                if held >= FLUSH:
                    yield from flush(parts, seen, least)
                    parts, held, seen, least = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if parts and held:
            yield from flush(parts, seen, least)

    return run


def _least(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    return -(-(n_a + n_b) * percent // (100 + percent))


def _bucket(percent: int, long_list: int, only: np.ndarray | None, nearest: int | None):
    """Pairs of classes that pass the length, positional and parity filters; classes on long lists (b null).

    A class gets the ``nearest`` earliest partners of a list, by the smallest documents; a row that has it on both sides
    names a list on which it has more. Within one document either of the two may be the earlier, so both are said to have more. Without that limit, and with ``only``, all pairs are given
    in which one of these classes may be the later, and nothing else.
    """

    def run(table: pa.Table) -> pa.Table:
        kinds = (("hashes", np.uint64), ("owners", np.int64), ("sizes", np.uint32), ("ranks", np.uint32), ("maps", np.uint64), ("docs", np.int64))
        h, own, n, rank, parity, doc = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in kinds)
        if only is not None and table["bucket"][0].as_py() < 0:
            return pa.table({c: pa.nulls(0, pa.int64()) for c in ("a", "b", "key")})
        if table["bucket"][0].as_py() < 0:
            return pa.table({"a": pa.array(own), "b": pa.nulls(len(own), pa.int64()), "key": pa.array(h.view(np.int64))})
        order = np.lexsort((doc, own, h))
        h, own = h[order], own[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]
        order = order[fresh]
        h, own, doc = h[fresh], own[fresh], doc[order]
        again = np.lexsort((own, doc, h))  # earliest documents first within a list
        h, own, order, doc = h[again], own[again], order[again], doc[again]
        n, rank, parity = n[order].astype(np.int64), rank[order].astype(np.int64), parity[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[first, len(h)])
        common = np.repeat(size > long_list, size) & (only is None)
        asked = None if only is None else np.isin(own, only)
        lefts, rights, more = ([np.zeros(0, np.int64)] for _ in range(3))
        more_keys = [np.zeros(0, np.uint64)]
        for m in np.unique(size[(size > 1) & (size <= long_list)]).tolist():
            at = first[size == m][:, None] + np.arange(m)
            # later classes of a list down, earlier ones across; so a class's pairs lie in one run
            j, i = np.tril_indices(m, -1)
            if asked is not None:
                at = at[asked[at].any(axis=1)]
            for block in np.array_split(at, max(1, len(at) * len(i) // BLOCK)):
                a, b = block[:, i].ravel(), block[:, j].ravel()
                list_of = np.repeat(np.arange(len(block)), len(i))
                if asked is not None:
                    take = asked[b] | (asked[a] & (doc[a] == doc[b]))
                    a, b, list_of = a[take], b[take], list_of[take]
                na, nb, ra, rb = n[a], n[b], rank[a], rank[b]
                need = _least(na, nb, percent)
                ok = (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent) & (np.minimum(ra, rb) + np.minimum(na - ra, nb - rb) >= need)
                # every parity that differs is a word that only one of the two has
                ok &= np.bitwise_count(parity[a] ^ parity[b]) <= na + nb - 2 * need
                a, b, list_of = a[ok], b[ok], list_of[ok]
                one_doc, of_key = doc[a] == doc[b], h[a]
                a, b = own[a], own[b]
                if nearest is not None and len(a):
                    run_start = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (list_of[1:] != list_of[:-1])])
                    place = np.arange(len(b)) - np.repeat(run_start, np.diff(np.r_[run_start, len(b)]))
                    # once for each class and list; for the earlier class of one document as well
                    beyond, both = place == nearest, (place >= nearest) & one_doc
                    more.append(np.r_[b[beyond], a[both]])
                    more_keys.append(np.r_[of_key[beyond], of_key[both]])
                    a, b = a[place < nearest], b[place < nearest]
                lefts.append(a)
                rights.append(b)
        a, b = np.concatenate(lefts), np.concatenate(rights)
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        start = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        a, b = a[start], b[start]
        longer, extra, extra_keys = np.flatnonzero(common), np.concatenate(more), np.concatenate(more_keys)
        return pa.table(
            {
                "a": pa.array(np.r_[a, own[longer], extra]),
                "b": pa.concat_arrays([pa.array(b), pa.nulls(len(longer), pa.int64()), pa.array(extra)]),
                "key": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(np.r_[h[longer], extra_keys].view(np.int64))]),
            }
        )

    return run


def _sets(min_tokens: int, bitmap: np.ndarray):
    """Word sets of the lines whose classes are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in lines_of(batch.column(1), min_tokens):
                hit = _marked(found.cls, bitmap)
                if not hit.any():
                    continue
                ends = pa.array(np.r_[0, np.cumsum(found.n[hit])] * 8, pa.int64())
                tokens = pa.py_buffer(found.hashes[np.repeat(hit, found.n)].tobytes())
                sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(hit.sum()), [None, ends.buffers()[1], tokens])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(found.text[hit])), pa.array(found.number[hit].astype(np.int32)), pa.array(found.cls[hit]), sets.cast(pa.binary())],
                    ["doc_id", "line", "cls", "tokens"],
                )

    return run


def _shared(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Number of common words of each two sets, both in ascending order."""

    def flat(sets: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = pc.binary_length(sets).to_numpy().astype(np.int64) // 8
        words_of = np.frombuffer(b"".join(s.as_buffer() for s in sets), np.uint64)
        pair = np.repeat(np.arange(len(n)), n)
        return words_of, pair, pair.astype(np.uint64) << np.uint64(46) | words_of >> np.uint64(18)

    (hx, px, kx), (hy, py, ky) = flat(x), flat(y)
    if not len(kx) or not len(ky):
        return np.zeros(len(x), np.int64)
    first, last = np.searchsorted(kx, ky), np.searchsorted(kx, ky, "right")
    at = np.minimum(first, len(kx) - 1)
    same = (last > first) & (hx[at] == hy)
    # words of one set that differ in the bits cut off only
    for i in np.flatnonzero(last - first > 1):
        same[i] = (hx[first[i] : last[i]] == hy[i]).any()
    return np.bincount(py[same], minlength=len(x))


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(at, PAIRS)
                x, y = batch.column(2), batch.column(3)
                both = _shared(x, y)
                n = (pc.binary_length(x).to_numpy().astype(np.int64) + pc.binary_length(y).to_numpy()) // 8
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(100 * both >= percent * (n - both)))

    return run


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and 64 x ``PARITIES`` parities of each set."""
    for batch in batches:
        n = pc.binary_length(batch.column(1)).to_numpy().astype(np.int64) // 8
        h = np.frombuffer(b"".join(s.as_buffer() for s in batch.column(1)), np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        out = np.zeros((len(n), PARITIES), np.uint64)
        at = (h >> np.uint64(13)) % np.uint64(PARITIES)
        np.bitwise_xor.at(out, (row, at.astype(np.int64)), np.uint64(1) << ((h >> np.uint64(7)) & np.uint64(63)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n.astype(np.int32)), *[pa.array(out[:, i].view(np.int64)) for i in range(PARITIES)]],
            ["cls", "n", *[f"s{i}" for i in range(PARITIES)]],
        )


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parities do not rule out that they are similar. Each that differs is a word that only one of the two sets has."""
    sketches = written(sets.mapInArrow(_parities, "cls long, n int" + "".join(f", s{i} long" for i in range(PARITIES))))
    side = lambda c: sketches.select(F.col("cls").alias(c), F.col("n").alias("n" + c), *[F.col(f"s{i}").alias(f"{c}{i}") for i in range(PARITIES)])
    need = F.ceil((F.col("na") + F.col("nb")) * percent / F.lit(100 + percent))
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(PARITIES)), F.lit(0))
    near = written(pairs.join(side("a"), "a").join(side("b"), "b").filter(apart <= F.col("na") + F.col("nb") - 2 * need).select("a", "b"))
    dropped(sets.sparkSession, sketches)
    return near


def _later(pairs: DataFrame, sets_a: DataFrame, sets_b: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Classes that a verified pair shows to have an earlier match; the sets are those of the first and of the second classes."""
    left = sets_a.select(F.col("cls").alias("a"), F.col("tokens").alias("x"))
    right = sets_b.select(F.col("cls").alias("b"), F.col("tokens").alias("y"))
    linked = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verified(percent), "a long, b long")
    at = classes.select("cls", F.struct("doc_id", "line", "cls").alias("at"))
    placed = linked.join(at.select(F.col("cls").alias("a"), F.col("at").alias("at_a")), "a").join(
        at.select(F.col("cls").alias("b"), F.col("at").alias("at_b")), "b"
    )
    return placed.select(F.when(F.col("at_a") < F.col("at_b"), F.col("b")).otherwise(F.col("a")).alias("cls")).distinct()


def _without(min_tokens: int):
    """Cut the removed lines out of the texts. A removed line takes its line feed along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [len(t.split("\n")) if t is not None else 0 for t in texts]
            gone = [0] * len(texts)
            marked = [k for k, d in enumerate(batch.column(2).is_valid().to_pylist()) if d and texts[k] is not None]
            drops = [{(d["line"], d["cls"]) for d in batch.column(2)[k].as_py()} for k in marked]
            cut: list[set] = [set() for _ in marked]
            for found in lines_of(batch.column(1).take(pa.array(marked, pa.int64())), min_tokens):
                for k, number, cls in zip(found.text.tolist(), found.number.tolist(), found.cls.tolist()):
                    if (number, cls) in drops[k]:
                        cut[k].add(number)
            for k, out in zip(marked, cut):
                texts[k] = "\n".join(p for i, p in enumerate(texts[k].split("\n")) if i not in out)
                gone[k] = len(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(gone, pa.int32()), *[batch.column(i) for i in range(3, batch.num_columns)]],
                ["doc_id", "text", "n_lines", "n_removed", *batch.schema.names[3:]],
            )

    return run


def _broadcast_bytes(df: DataFrame) -> int:
    return broadcast_bytes_limit(df.sparkSession) // BROADCAST_SHARE


def _hinted(df: DataFrame, row_bytes: int) -> DataFrame:
    """A broadcast hint if the written rows are few enough, an ordinary join otherwise."""
    return F.broadcast(df) if df.count() * row_bytes <= _broadcast_bytes(df) else df


def deduplicate_lines(
    docs: DataFrame, percent: int = 80, min_tokens: int = 5, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), long_list: int = COMMON
) -> DataFrame:
    """Documents without repeated lines: ``doc_id``, ``text``, ``n_lines``, ``n_removed`` and the columns ``keep``.

    Lines end at a line feed; words are as in ``words``. A null text stays null with no
    lines, an empty one is one empty line. Every input row comes back; a document may become
    empty. Rows with the same id count as one place in the order: equal lines at the same
    place of such rows are one line and stay together. A null id comes before all others.
    Column names of the input other than the named ones do not matter. ``long_list`` only moves work between the
    two ways of comparing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *[F.col(k).alias(f"_keep_{k}") for k in keep])
    summaries = written(
        rows.select("doc_id", "text").mapInArrow(_summaries(min_tokens), "doc_id long, line int, cls long, n int, parity long, page int, at binary, counts binary")
    )
    level = rarity(summaries)
    lines = summaries.filter("page is null").select("doc_id", "line", "cls", "n", "parity")
    classes = written(
        lines.groupBy("cls")
        .agg(F.min(F.struct("doc_id", "line")).alias("at"), F.first("n").alias("n"), F.first("parity").alias("parity"))
        .select("cls", "at.doc_id", "at.line", "n", "parity")
    )
    total = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // POSTINGS))

    def indexed(only: np.ndarray | None, every: int | None, keys: np.ndarray | None = None) -> DataFrame:
        listed = rows.select("doc_id", "text").mapInArrow(
            _postings(min_tokens, percent, level, buckets, long_list, keys), "bucket long, hashes binary, owners binary, sizes binary, ranks binary, maps binary, docs binary"
        )
        # a few buckets a task, however many rows the session's partitions would hold
        spread = listed.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 2), "bucket")
        return written(spread.groupBy("bucket").applyInArrow(_bucket(percent, long_list, only, every), "a long, b long, key long"))

    index = indexed(None, NEAREST)
    common = index.filter("b is null").select("key", F.col("a").alias("cls")).distinct()
    placed = common.join(classes.select("cls", "n", "parity", F.struct("doc_id", "line", "cls").alias("at")), "cls")
    hubs = placed.groupBy("key").agg(F.min("at").alias("hub")).select("key", F.col("hub.cls").alias("hub"))
    starred = common.join(hubs, "key").filter("hub <> cls").select(F.col("hub").alias("a"), F.col("cls").alias("b"))
    side = lambda s: classes.select(F.col("cls").alias(s), F.col("n").alias("n" + s), F.col("parity").alias("p" + s))
    need = F.ceil((F.col("na") + F.col("nb")) * percent / F.lit(100 + percent))
    alike = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= F.col("na") + F.col("nb") - 2 * need)
    sized = starred.distinct().join(side("a"), "a").join(side("b"), "b").filter(alike).select("a", "b")
    first_pairs = written(
        index.filter("key is null").select("a", "b").unionByName(sized)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )

    def sets_of(pairs: DataFrame) -> DataFrame:
        """Word sets of the classes in some pairs, from their first lines."""
        wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "doc_id", "line"), "cls"))
        bitmap = marks(wanted.select("cls"))
        holders = written(wanted.select(F.col("doc_id").alias("_id")).distinct())
        # nearly every document holds some unless they are few
        some = holders.count() * 32 <= _broadcast_bytes(holders)
        holding = rows.join(F.broadcast(holders), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi") if some else rows
        found = holding.select("doc_id", "text").mapInArrow(_sets(min_tokens, bitmap), "doc_id long, line int, cls long, tokens binary")
        at = wanted.select(F.col("cls").alias("_c"), F.col("doc_id").alias("_d"), F.col("line").alias("_l"))
        here = (F.col("cls") == F.col("_c")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("line") == F.col("_l"))
        sets = written(found.join(_hinted(at, 48), here, "left_semi").select("cls", "tokens"))
        dropped(spark, wanted)
        dropped(spark, holders)
        return sets

    def matches(pairs: DataFrame) -> DataFrame:
        """Classes with an earlier match among the pairs. Each round takes a share of the second classes of all pairs."""
        every = sets_of(pairs)
        near = _near(pairs, every, percent)
        ends = written(near.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        sets, late = written(every.join(_hinted(ends, 24), "cls", "left_semi")), None
        dropped(spark, every)
        # a round sends about as many sets as there are
        rounds = min(ROUNDS, max(1, -(-near.count() // max(1, ends.count()))))
        share = lambda c: F.pmod(F.xxhash64(c), F.lit(rounds))
        for i in range(rounds):
            one = written(_later(near.filter(share("b") == i), sets, sets.filter(share("cls") == i), classes, percent))
            late = one if late is None else late.unionByName(one)
        for table in (sets, near, ends):
            dropped(spark, table)
        return late.distinct()

    # every class first with the earliest it may match; most that match at all are settled by that
    at = classes.select("cls", F.struct("doc_id", "line", "cls").alias("at"))
    placed_pairs = first_pairs.join(at.select(F.col("cls").alias("a"), F.col("at").alias("at_a")), "a").join(
        at.select(F.col("cls").alias("b"), F.col("at").alias("at_b")), "b"
    )
    directed = written(placed_pairs.select(F.least("at_a", "at_b").alias("early"), F.greatest("at_a", "at_b")["cls"].alias("late")))
    unordered = lambda early, late: (F.least(early, late).alias("a"), F.greatest(early, late).alias("b"))
    earliest = written(directed.groupBy("late").agg(F.min("early")["cls"].alias("early")))
    matched = written(matches(earliest.select(*unordered("early", "late"))))
    open_pairs = written(
        directed.select("late", F.col("early.cls").alias("early")).join(matched.withColumnRenamed("cls", "late"), "late", "left_anti")
        .join(earliest, ["late", "early"], "left_anti").select(*unordered("early", "late"))
    )
    dropped(spark, directed)
    dropped(spark, earliest)
    if not open_pairs.isEmpty():
        matched = written(matched.unionByName(matches(open_pairs)).distinct())

    # classes with further partners on some list, and without an earlier match among the first ones
    further = index.filter("a = b").select(F.col("a").alias("cls"), "key")
    further = written(further.join(matched, "cls", "left_anti"))
    beyond = written(further.select("cls").distinct())
    waiting = beyond.count()
    if waiting:
        few = waiting * 8 <= broadcast_bytes_limit(spark)
        ends = indexed(beyond.toArrow()["cls"].to_numpy() if few else None, None, marks(further.select("key").distinct())).filter("b is not null").select("a", "b").distinct()
        if not few:
            ends = ends.select("a", "b", F.explode(F.array("a", "b")).alias("cls")).join(beyond, "cls", "left_semi").select("a", "b").distinct()
        matched = written(matched.unionByName(matches(written(ends.join(first_pairs, ["a", "b"], "left_anti")))).distinct())

    # classes of long lists that have no earlier match yet meet the others of their lists
    keys = written(placed.join(matched.withColumn("done", F.lit(True)), "cls", "left"))
    x = keys.select("key", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("at").alias("at_a"), F.col("parity").alias("pa"))
    z = keys.filter("done is null").select("key", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("at").alias("at_b"), F.col("parity").alias("pb"))
    rest = written(x.join(z, "key").filter("at_a < at_b").filter(alike).select(*unordered("a", "b")).distinct().join(first_pairs, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        matched = written(matched.unionByName(matches(rest)).distinct())
    heads = classes.join(matched, "cls", "left_anti").select("cls", F.col("doc_id").alias("d0"), F.col("line").alias("l0"))
    removed = (
        lines.join(heads, "cls", "left")
        .filter(F.col("l0").isNull() | ~(F.col("doc_id").eqNullSafe(F.col("d0")) & (F.col("line") == F.col("l0"))))
        .select("doc_id", F.struct("line", "cls").alias("drop"))
    )
    removed = written(removed.groupBy("doc_id").agg(F.collect_set("drop").alias("drop")).withColumnRenamed("doc_id", "_id"))
    size = removed.agg(F.sum(F.size("drop") * 24 + 32)).first()[0] or 0
    hinted = F.broadcast(removed) if 4 * size <= broadcast_bytes_limit(spark) else removed
    kept = [F.col(f"_keep_{k}") for k in keep]
    joined = rows.join(hinted, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "drop", *kept)
    kinds = "".join(f", `_keep_{k}` {joined.schema[f'_keep_{k}'].dataType.simpleString()}" for k in keep)
    out = joined.mapInArrow(_without(min_tokens), "doc_id long, text string, n_lines int, n_removed int" + kinds)
    return out.select("doc_id", "text", "n_lines", "n_removed", *[F.col(f"_keep_{k}").alias(k) for k in keep])
