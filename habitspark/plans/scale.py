"""Strategies that keep grouped work bounded when one group dominates the data.

Three rules are applied everywhere:

* a table is broadcast only after its size has been measured; beyond the limit it is
  joined by key, keys with very many rows apart;
* an ordered window runs over a whole group only after the largest group has been
  measured; beyond the limit the ordered work is cut into range slices;
* what is cut into slices is first written to a table in the shared folder, so a lost
  executor cannot move rows between slices.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP_ROWS_CONF = "habitspark.window.maxGroupRows"
BROADCAST_BYTES_CONF = "habitspark.broadcast.maxBytes"
SALTS_CONF = "habitspark.join.salts"
TASK_GROUPS = 250_000  # groups of a few numbers that one task sums up
SCORED_ROWS = 131_072  # rows scored together, so that each model has many of them
RADIX = 4096
RADIX_LEVELS = 5  # 60 bits, more than a draw in [0, 1) made by hash_unit has


def group_rows_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_CONF, "1000000"))


def broadcast_bytes_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_BYTES_CONF, str(64 * 1024 * 1024)))


def salts(spark: SparkSession) -> int:
    return int(spark.conf.get(SALTS_CONF, "32"))


def scratch_folder(spark: SparkSession) -> str:
    """New folder below the shared checkpoint folder; a local one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is not None:
        return f"{shared.rstrip('/')}/habitspark-{uuid.uuid4()}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="spark-") + "/out"


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to a table in the shared folder and read that.

    Later steps then see real sizes and prune columns, and a lost executor costs a read.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest group; reads the key columns only."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def groups_fit(df: DataFrame, keys: Sequence[str]) -> bool:
    return largest_group(df, keys) <= group_rows_limit(df.sparkSession)


def _row_bytes(schema: T.StructType) -> Column:
    total: Column = F.lit(16)
    for field in schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            total = total + F.greatest(F.size(c), F.lit(0)) * 40 + 16
        elif isinstance(field.dataType, T.StructType):
            total = total + 16 * len(field.dataType.fields)
        else:
            total = total + 8
    return total


def measured(df: DataFrame) -> tuple[DataFrame, bool]:
    """Keep ``df`` for reuse and tell whether it is small enough to broadcast."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    size = kept.agg(F.sum(_row_bytes(kept.schema))).first()[0] or 0
    if size > broadcast_bytes_limit(df.sparkSession):
        kept.unpersist()  # too big to broadcast, too big to hold
        return df, False
    return kept, True


def attach(big: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a per-key lookup onto ``big``.

    Small lookups are broadcast, so ``big`` is not shuffled. Larger ones are joined by key; keys
    with very many rows are joined apart, and adaptive execution splits what is left of skew.
    """
    lookup, small = measured(lookup)
    if small:
        return big.join(F.broadcast(lookup), list(keys), how)
    return join_hot(big, lookup, keys, how)


def dealt(df: DataFrame, keys: Sequence[str], groups: int) -> DataFrame:
    """Rows ready to be summed by ``keys``, of which there are about ``groups`` values.

    Many groups are dealt to so many tasks that the table of sums in each has a bounded size; few need nothing.
    """
    n = -(-groups // TASK_GROUPS)
    if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(n, *keys)


def every_salt(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def running_totals(
    table: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], source: DataFrame | None = None
) -> DataFrame:
    """Add ``cum_<c>`` (up to and including the row) and ``tot_<c>`` per group.

    ``table`` holds one row per group and order value, so callers aggregate first. When
    they pass the rows it was made from as ``source``, their number per group is tried as
    a cheap upper bound before the table itself is counted.
    """
    whole = source is not None and groups_fit(source, keys)
    if not whole:
        table = stored(table)  # made once, then counted, perhaps sliced, and read
        whole = groups_fit(table, keys)
    if whole:
        part = Window.partitionBy(*keys)
        run = part.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return table.select(
            "*",
            *[F.sum(c).over(run).alias(f"cum_{c}") for c in sums],
            *[F.sum(c).over(part).alias(f"tot_{c}") for c in sums],
        )
    spark = table.sparkSession
    # a slice, and so the window over it, stays below the limit
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * table.count() // group_rows_limit(spark)))
    sliced = stored(
        table.repartitionByRange(n, *[F.col(k) for k in keys], F.col(order)).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    # at most n slices per group, so these windows stay small
    per_slice = sliced.groupBy(*keys, "_slice").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    part = Window.partitionBy(*keys)
    run = part.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    offsets = per_slice.select(
        *keys,
        "_slice",
        *[(F.sum(f"_s_{c}").over(run) - F.col(f"_s_{c}")).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(part).alias(f"tot_{c}") for c in sums],
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sliced.join(offsets, [*keys, "_slice"]).select(
        *table.columns,
        *[(F.col(f"_before_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in sums],
        *[F.col(f"tot_{c}") for c in sums],
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group; ``probs`` maps output names to levels.

    One formula on counts of distinct values, whatever the size of a group.
    """
    rows = df.filter(F.col(value).isNotNull())
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        counts = counts.withColumn("_all", F.lit(0))
    ranks = running_totals(counts, list(keys) or ["_all"], value, ["n"], source=rows if keys else None)
    aggs, final = [], []
    for i, (name, p) in enumerate(probs.items()):
        h = (F.col("tot_n") - 1) * F.lit(float(p))
        low = F.floor(h)
        aggs += [
            F.min(F.when(F.col("cum_n") >= low + 1, F.col(value))).alias(f"_lo{i}"),
            F.min(F.when(F.col("cum_n") >= F.least(low + 2, F.col("tot_n")), F.col(value))).alias(f"_hi{i}"),
            F.max(h - low).alias(f"_w{i}"),
        ]
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        final.append((lo + (hi - lo) * F.col(f"_w{i}")).alias(name))
    return ranks.groupBy(*keys).agg(*aggs).select(*keys, *final)


def take_smallest(df: DataFrame, keys: Sequence[str], draw: str, n: int, ties: Sequence[str]) -> DataFrame:
    """The ``n`` rows of each group with the smallest ``draw``, a value in [0, 1); rows without one come first.

    In large groups the range of ``draw`` is cut into bins, and the bin that holds the n-th row is cut again and again until its
    rows fit into a task. Bins below it are kept without ordering, only that bin is ranked. If so many rows have one and the same
    ``draw``, slices of their order are ranked instead.
    """
    if n <= 0:
        return df.filter(F.lit(False))
    order = [F.col(draw), *[F.col(t) for t in ties]]
    if groups_fit(df, keys):
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")
    level, cut = 1, stored(_cut(df.withColumn("_need", F.lit(n).cast("long")), keys, _bin(draw, 1)))
    largest = lambda: cut.agg(F.max("_held")).first()[0] or 0
    limit = group_rows_limit(df.sparkSession)
    while largest() > limit and level < RADIX_LEVELS:
        inside = attach(df, cut.select(*keys, "_edge", "_need"), keys).filter(_bin(draw, level) == F.col("_edge"))
        level += 1
        cut = stored(_cut(inside, keys, _bin(draw, level)))
    placed = attach(df, cut.select(*keys, "_edge", "_need"), keys, "left")
    at = _bin(draw, level)
    whole = placed.filter(F.col("_edge").isNull() | (at < F.col("_edge")))
    edge = placed.filter(at == F.col("_edge"))
    if largest() <= limit:
        ranked = edge.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        t = edge.withColumns({"_at": F.struct(*order), "_one": F.lit(1)})
        ranked = running_totals(t, keys, "_at", ["_one"]).withColumnRenamed("cum__one", "_rank")
    return whole.select(*df.columns).unionByName(ranked.filter(F.col("_rank") <= F.col("_need")).select(*df.columns))


def _bin(draw: str, level: int) -> Column:
    # a power of two only moves the exponent, so bins of a level lie wholly in one bin of the level before
    return F.floor(F.coalesce(F.col(draw), F.lit(0.0)) * F.lit(float(RADIX**level)))


def _cut(rows: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """Per group the bin with the row number ``_need``: its number, its rows and how many of them are needed.

    Groups with fewer rows have none. The rows of a group lie in at most ``RADIX`` bins, so the window stays small.
    """
    counts = rows.groupBy(*keys, at.alias("_edge")).agg(F.count(F.lit(1)).alias("_held"), F.first("_need").alias("_need"))
    run = Window.partitionBy(*keys).orderBy("_edge").rowsBetween(Window.unboundedPreceding, 0)
    below = F.col("_cum") - F.col("_held")
    found = counts.withColumn("_cum", F.sum("_held").over(run)).filter((below < F.col("_need")) & (F.col("_need") <= F.col("_cum")))
    return found.select(*keys, "_edge", "_held", (F.col("_need") - below).alias("_need"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key. The filter on the rank lets Spark drop all but one row per
    key before the shuffle, so a key with many copies costs one row per input task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == 1).drop("_rank")


def hash_unit(*parts: Column, seed: int = 0) -> Column:
    """Reproducible uniform value in [0, 1) from the parts of a row key."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11)
    return h.cast("double") / F.lit(float(1 << 53))


def join_hot(big: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join many rows per key onto a large lookup (one row per key).

    Keys holding more than ``habitspark.join.hotKeyRows`` rows are joined apart against
    their own lookup rows, if those are measured to be few enough to broadcast; all other keys go
    through an ordinary shuffled join.
    """
    spark = big.sparkSession
    limit = int(spark.conf.get("habitspark.join.hotKeyRows", "1000000"))
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot, few = measured(counts.filter(F.col("_n") > limit).select(*keys))
    if not few or hot.isEmpty():
        return big.join(lookup, list(keys), how)
    hot = F.broadcast(hot)
    rows, small = measured(lookup.join(hot, list(keys), "left_semi"))
    if not small:
        return big.join(lookup, list(keys), how)
    apart = big.join(hot, list(keys), "left_semi").join(F.broadcast(rows), list(keys), how)
    rest = big.join(hot, list(keys), "left_anti").join(lookup, list(keys), how)
    return apart.unionByName(rest)


def scored_in_place(rows: DataFrame, keys: Sequence[str], names: Sequence[str], columns: Sequence[str], score: Callable[[tuple, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """Rows with ``columns``, NaN as null, without moving them: ``score`` gets a key and the ``names`` of its rows, null as NaN."""
    kept = rows.drop(*columns)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.DoubleType()) for c in columns]])

    def scored(table: pa.Table) -> pa.RecordBatch:
        n = table.num_rows
        x = np.empty((n, len(names)))
        for i, c in enumerate(names):
            x[:, i] = table[c].cast(pa.float64()).to_numpy(zero_copy_only=False)
        codes = np.zeros(n, np.int64)
        values = []
        for k in keys:
            coded = table[k].combine_chunks().dictionary_encode("encode")
            values.append(coded.dictionary.to_pylist())
            codes = codes * (len(values[-1]) + 1) + coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.r_[True, codes[order][1:] != codes[order][:-1]])
        out = np.full((len(columns), n), np.nan)
        for own in np.split(order, starts[1:]):
            code, key = int(codes[own[0]]), []
            for v in reversed(values):
                key.insert(0, v[code % (len(v) + 1)])
                code //= len(v) + 1
            for i, v in enumerate(score(tuple(key), x[own])):
                out[i, own] = v
        arrays = [table[c].combine_chunks() for c in table.column_names] + [pa.array(v, mask=np.isnan(v)) for v in out]
        return pa.RecordBatch.from_arrays(arrays, [*table.column_names, *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= SCORED_ROWS:
                yield scored(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield scored(pa.Table.from_batches(held))

    return kept.mapInArrow(run, schema)
