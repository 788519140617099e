"""Exact similarity join of documents on word shingles by grouped prefixes.

A document is the set of its five-word shingles (64-bit hashes). Two documents link when
the Jaccard similarity of their sets is at least ``percent`` / 100.

Order of shingles: by hash. Every set is indexed by its shingles below a fixed share of
the hash range, 1.5 times the share a prefix filter needs. Documents of the same size with
the same indexed part form one group, and groups instead of documents go into the index.
A shingle with more than ``COMMON`` groups is common and counts as last in the order;
a pair of documents that hold enough rarer ones shares at least one of them, and the number
they share is a further exact filter on pairs of groups. The few *dense* documents
without enough rare indexed shingles (short ones, or made of common passages) are joined
among themselves on prefixes ordered by exact frequency, with positional and parity filters.

Surviving pairs of groups are expanded to members and verified on whole sets. Links of members with one
representative of their group, or with a few drawn neighbours, come first; further pairs are expanded only between
parts that are not yet connected, so a group of copies costs a few comparisons per member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from habitspark.llm import words
from habitspark.llm.graph import components
from habitspark.plans.scale import broadcast_bytes_limit, stored

COMMON = 32
POSTINGS = 250_000
FLUSH = 250_000
SKETCH = 4
DRAWS = 4
MAPS = 8


def _digest(values: np.ndarray, n: int) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8, key=b"%d" % n).digest(), "little", signed=True)


def _share(percent: int) -> np.uint64:
    return np.uint64(int(min(0.999, 1.5 * (1 - percent / 100)) * 2**64))


def _need(n: int, percent: int) -> int:
    """Length of the prefix that two linked sets must share an element in."""
    return n - -(-n * percent // 100) + 1


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _summaries(percent: int, size: int):
    limit = _share(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, low, cls, grp = [], [], [], []
            for s in words.shingle_sets(batch.column(1)):
                k = int(np.searchsorted(s, limit))
                n.append(len(s))
                low.append(k)
                cls.append(_digest(s, len(s)) if len(s) else None)
                # a part too short for the prefix filter does not identify a group
                grp.append(None if not len(s) else _digest(s[:k], len(s)) if k >= _need(len(s), percent) else cls[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(cls, pa.int64()), pa.array(grp, pa.int64())],
                ["doc_id", "n", "low", "cls", "grp"],
            )

    return run


def _postings(percent: int, buckets: int, limit_groups: int):
    limit = _share(percent)
    width = np.uint64(int(limit) // buckets + 1)

    def flush(hashes: list, owners: list) -> Iterator[pa.RecordBatch]:
        if not hashes:
            return
        h = np.concatenate(hashes)
        own = np.repeat(np.array([o for o, _ in owners], np.int64), [c for _, c in owners])
        order = np.argsort(h, kind="stable")
        h, own = h[order], own[order]
        # a shingle that is common within this batch already: enough owners to show it, the rest as counts
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        place = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
        over = place > limit_groups
        extra, times = np.unique(own[over], return_counts=True)
        h, own = h[~over], own[~over]
        bucket = (h // width).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(h) else np.zeros(0, np.int64)
        ends = np.r_[cuts[1:], len(h)]
        keys = bucket[cuts].tolist()
        hs = [h[a:b].tobytes() for a, b in zip(cuts, ends)]
        os = [own[a:b].tobytes() for a, b in zip(cuts, ends)]
        if len(extra):
            side = extra % buckets
            for k in np.unique(side):
                keys.append(-1 - int(k))
                hs.append(times[side == k].astype(np.int64).tobytes())
                os.append(extra[side == k].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(hs, pa.binary()), pa.array(os, pa.binary())], ["bucket", "hashes", "owners"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list = []
        owners: list = []
        seen: set = set()
        held = 0
        for batch in batches:
            for s in words.shingle_sets(batch.column(0)):
                k = int(np.searchsorted(s, limit))
                if not k:
                    continue
                part = s[:k].copy()
                g = _digest(part, len(s)) if k >= _need(len(s), percent) else _digest(s, len(s))
                if g in seen:
                    continue
                seen.add(g)
                hashes.append(part)
                owners.append((g, k))
                held += k
                if held >= FLUSH:
                    yield from flush(hashes, owners)
                    hashes, owners, held = [], [], 0
                    seen = set()
        yield from flush(hashes, owners)

    return run


def _bucket(limit_groups: int):
    return lambda table: _bucket_pairs(table, limit_groups)


def _bucket_pairs(table: pa.Table, limit_groups: int) -> pa.Table:
    """Counts of common shingles per group (b null) and pairs of groups with the number of rare shingles they share."""
    h = np.frombuffer(b"".join(table["hashes"].to_pylist()), np.uint64)
    own = np.frombuffer(b"".join(table["owners"].to_pylist()), np.int64)
    if table["bucket"][0].as_py() < 0:
        ids, at = np.unique(own, return_inverse=True)
        count = np.bincount(at, weights=h.astype(np.float64)).astype(np.int64)
        return pa.table({"a": pa.array(ids), "b": pa.nulls(len(ids), pa.int64()), "c": pa.array(count)})
    order = np.lexsort((own, h))
    h, own = h[order], own[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]
    h, own = h[fresh], own[fresh]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.r_[first, len(h)])
    common, times = np.unique(own[np.repeat(size > limit_groups, size)], return_counts=True)
    lefts, rights = [], []
    for m in np.unique(size[(size > 1) & (size <= limit_groups)]).tolist():
        rows = own[first[size == m][:, None] + np.arange(m)]
        i, j = np.triu_indices(m, 1)
        lefts.append(rows[:, i].ravel())
        rights.append(rows[:, j].ravel())
    a = np.concatenate(lefts) if lefts else np.zeros(0, np.int64)
    b = np.concatenate(rights) if rights else np.zeros(0, np.int64)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    count = np.diff(np.r_[start, len(a)])
    return pa.table(
        {
            "a": pa.array(np.r_[common, a[start]]),
            "b": pa.concat_arrays([pa.nulls(len(common), pa.int64()), pa.array(b[start])]),
            "c": pa.array(np.r_[times, count].astype(np.int64)),
        }
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sets = [], []
        for s in words.shingle_sets(batch.column(0)):
            if len(s):
                keys.append(_digest(s, len(s)))
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["cls", "shingles"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest shingle of each residue class: near copies agree in most of them."""
    for batch in batches:
        keys, cls = [], []
        for c, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = np.frombuffer(raw.as_buffer(), np.uint64)
            kind = s % np.uint64(SKETCH)
            for r in range(SKETCH):
                at = np.flatnonzero(kind == r)
                if len(at):
                    keys.append(s[at[0]])
                    cls.append(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array(_signed(np.array(keys, np.uint64))), pa.array(cls, pa.int64())], ["key", "cls"]
        )


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set, 64 * ``MAPS`` parities of its shingles by hash."""
    for batch in batches:
        maps = np.zeros((batch.num_rows, MAPS), np.uint64)
        for k, raw in enumerate(batch.column(1)):
            s = np.frombuffer(raw.as_buffer(), np.uint64)
            np.bitwise_xor.at(maps[k], ((s >> np.uint64(6)) % np.uint64(MAPS)).astype(np.int64), np.uint64(1) << (s & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(maps[:, i].view(np.int64).copy()) for i in range(MAPS)]], ["cls", *[f"m{i}" for i in range(MAPS)]])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in batch.column(1)]
        n = [len(s) for s in sets]
        h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        cls = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), n)
        yield pa.RecordBatch.from_arrays([pa.array(_signed(h)), pa.array(cls), pa.array(np.repeat(n, n).astype(np.int64))], ["h", "cls", "n"])


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose whole sets are similar enough."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(_verified(percent), "a long, b long")


def _near_size(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _prefix_of(n: str, percent: int):
    return F.col(n) - F.ceil(F.col(n) * percent / 100) + 1


def link_documents(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text", common_groups: int = COMMON) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``.

    A text with fewer than five words is one shingle, a null text or one without words has
    none and links with nothing: its component is its own id. Rows are told apart by text; a
    repeated id gives one row for each input row. A null id comes back with a null component unless
    a linked row has an id. Other columns are ignored. Sets are identified by a 64-bit
    digest, so that two different texts fall together with odds of about rows squared / 2^65.
    ``common_groups`` only moves work between the two joins.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    summary = stored(rows.mapInArrow(_summaries(percent, words.SHINGLE), "doc_id long, n long, low long, cls long, grp long"))
    classes = stored(
        summary.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "low", "grp")])
    )
    total = classes.agg(F.sum("low")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // POSTINGS))
    texts = rows.select("text").filter(F.col("text").isNotNull())
    index = stored(
        texts.mapInArrow(_postings(percent, buckets, common_groups), "bucket long, hashes binary, owners binary")
        .groupBy("bucket")
        .applyInArrow(_bucket(common_groups), "a long, b long, c long")
    )
    common = index.filter("b is null").groupBy(F.col("a").alias("grp")).agg(F.sum("c").alias("common"))
    groups = stored(
        classes.groupBy("grp")
        .agg(F.min("cls").alias("head"), F.first("n").alias("n"), F.first("low").alias("low"), F.count(F.lit(1)).alias("members"))
        .join(common, "grp", "left")
        .withColumn("rare", F.col("low") - F.coalesce("common", F.lit(0)))
        .drop("common", "low")
        .withColumn("dense", F.col("rare") < _prefix_of("n", percent))
    )
    # filter pairs of groups: sizes, then the number of shared rare shingles
    side = lambda s: groups.select(*[F.col(c).alias(c + s) for c in ("grp", "head", "n", "members", "rare")])
    overlap = F.ceil((F.col("n_a") + F.col("n_b")) * percent / F.lit(100 + percent))
    group_pairs = stored(
        index.filter("b is not null")
        .groupBy(F.col("a").alias("grp_a"), F.col("b").alias("grp_b"))
        .agg(F.sum("c").alias("shared"))
        .join(side("_a"), "grp_a")
        .join(side("_b"), "grp_b")
        .filter(_near_size("n_a", "n_b", percent))
        .filter((F.col("shared") >= F.col("rare_a") - F.col("n_a") + overlap) & (F.col("shared") >= F.col("rare_b") - F.col("n_b") + overlap))
    )
    multiple = groups.filter("members > 1")
    members = stored(
        classes.select("cls", "grp").join(multiple.select("grp", "head"), "grp")
    )
    dense = classes.select("cls", "grp").join(groups.filter("dense").select("grp"), "grp").select("cls")
    wanted = stored(
        members.select("cls")
        .unionByName(dense)
        .unionByName(group_pairs.select(F.explode(F.array("head_a", "head_b")).alias("cls")))
        .distinct()
    )
    if wanted.count() * 32 <= broadcast_bytes_limit(spark):
        wanted = F.broadcast(wanted)
    found = texts.mapInArrow(_sets, "cls long, shingles binary").join(wanted, "cls", "left_semi")
    sets = stored(found.dropDuplicates(["cls"]))

    # representatives first: members with the head of their group, heads of paired groups, and dense sets with
    # a few drawn ones among those of the same sketch key
    dense_sets = sets.join(dense, "cls", "left_semi")
    sketch = stored(dense_sets.select("cls", "shingles").mapInArrow(_sketch, "key long, cls long").join(classes.select("cls", "n"), "cls"))
    draws = [F.min(F.struct(F.xxhash64("cls", "key", F.lit(r)).alias("draw"), F.col("cls").alias("hub"), F.col("n").alias("n_hub"))) for r in range(DRAWS)]
    hubs = sketch.groupBy("key").agg(F.array(*draws).alias("hubs"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    near = (
        sketch.join(hubs, "key").select("cls", "n", F.explode("hubs").alias("h")).select("cls", "n", "h.hub", "h.n_hub")
        .filter(F.col("cls") != F.col("hub")).filter(_near_size("n", "n_hub", percent))
        .select(F.col("hub").alias("a"), F.col("cls").alias("b"))
    )
    tested = stored(
        members.filter("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b"))
        .unionByName(group_pairs.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))
        .unionByName(near)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    links = stored(verify(tested, sets, percent))
    roots = components(links)

    def rooted(df: DataFrame, key: str) -> DataFrame:
        known = roots.select(F.col("node").alias(key), "root")
        return df.join(known, key, "left").withColumn("root", F.coalesce("root", key))

    # the rest: only pairs whose ends are not connected yet
    inside = rooted(members.select("grp", "cls"), "cls")
    split = inside.groupBy("grp").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("grp")
    inside = inside.join(split, "grp", "left_semi")
    within = _across(inside, ["grp"])
    everyone = rooted(classes.select("grp", "cls"), "cls")
    some = group_pairs.filter("members_a > 1 or members_b > 1").select("grp_a", "grp_b")
    ends = lambda s: everyone.select(*[F.col(c).alias(c + s) for c in everyone.columns])
    expanded = (
        some.join(ends("_a"), "grp_a").join(ends("_b"), "grp_b").filter("root_a <> root_b")
        .select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))
    )
    exploded = dense_sets.select("cls", "shingles").mapInArrow(_spread, "h long, cls long, n long")
    counts = exploded.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy("df", "h"))
    prefix = stored(
        rooted(
            exploded.join(counts, "h").withColumns({"rank": rank, "alone": F.count_if(F.col("df") == 1).over(Window.partitionBy("cls"))})
            .filter(F.col("rank") <= _prefix_of("n", percent))
            .filter("df > 1")
            .select("h", "cls", "n", "rank", "alone"),
            "cls",
        )
    )
    kinds = ", ".join(f"m{i} long" for i in range(MAPS))
    maps = stored(dense_sets.select("cls", "shingles").mapInArrow(_parities, f"cls long, {kinds}"))
    mixed = prefix.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("h")
    x = prefix.join(mixed, "h", "left_semi").join(maps, "cls")
    # every parity that differs is a shingle that only one of the two has
    differ = sum((F.bit_count(F.col(f"m{i}_a").bitwiseXOR(F.col(f"m{i}_b"))) for i in range(MAPS)), F.lit(0))
    # what comes later, and what came before less the shingles that no other set has
    rest = F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b")) + F.least(
        F.col("rank_a") - F.col("alone_a"), F.col("rank_b") - F.col("alone_b")
    )
    ordered = _sided(x, "_a").join(_sided(x, "_b").withColumnRenamed("h_b", "h_a"), "h_a")
    # the first shared shingle is among the first n - overlap + 1 of either set
    early = (F.col("rank_a") <= F.col("n_a") - overlap + 1) & (F.col("rank_b") <= F.col("n_b") - overlap + 1)
    dense_pairs = (
        ordered.filter("root_a <> root_b and cls_a < cls_b").filter(early)
        .filter(_near_size("n_a", "n_b", percent) & (rest >= overlap) & (differ <= F.col("n_a") + F.col("n_b") - 2 * overlap))
        .select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))
    )
    left = (
        within.unionByName(expanded).unionByName(dense_pairs)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
        .join(tested, ["a", "b"], "left_anti")
    )
    links = links.unionByName(stored(verify(left, sets, percent)))
    return _labelled(summary, classes, components(links))


def _sided(df: DataFrame, s: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c + s) for c in df.columns])


def _across(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of classes with equal keys and different roots."""
    other = df.select(*keys, F.col("cls").alias("b"), F.col("root").alias("root_b"))
    return df.join(other, keys).filter("root <> root_b and cls < b").select(F.col("cls").alias("a"), "b")


def _labelled(summary: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """The smallest id of every component, for each row."""
    known = classes.select("cls", "doc_id").join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = known.select("cls", "root").join(smallest, "root").select("cls", "component_id")
    return summary.join(named, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
