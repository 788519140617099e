"""Wide parities of word sets never rule out a similar pair, and most others."""

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from habitspark.llm import lines


def test_near_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    swapped = lambda k: np.sort(np.r_[base[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)])
    sets = [np.sort(base), swapped(5), swapped(11), swapped(40), swapped(100)]
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "cls long, tokens binary")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 5)], T.StructType([T.StructField(c, T.LongType()) for c in "ab"]))
    near = {r.b for r in lines._near(pairs, table, 80).collect()}
    assert {1, 2} <= near and not near & {3, 4}


def test_marks_miss_nothing_and_few_others_pass(spark):
    rng = np.random.default_rng(4)
    marked, others = rng.integers(-(1 << 63), 1 << 63, (2, 5000))
    bitmap = lines.marks(spark.createDataFrame([(int(h),) for h in marked], "h long"))
    assert len(bitmap) <= 1 << (lines.MARK_BITS - 3)
    assert lines._marked(marked, bitmap).all()
    assert lines._marked(others, bitmap).mean() < 0.1
    assert not lines._marked(others, lines.marks(spark.createDataFrame([], "h long"))).any()


def test_only_sets_of_marked_lines_leave_a_task(spark):
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array(["a b c d e\nf g h i j\nshort", "k l m n o"])], ["doc_id", "text"])
    (found,) = lines.lines_of(batch.column(1), 5)
    bitmap = lines.marks(spark.createDataFrame([(int(found.cls[1]),)], "h long"))
    rows = [r for b in lines._sets(5, bitmap)(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["line"], r["cls"], len(r["tokens"])) for r in rows] == [(7, 1, found.cls[1], 40)]


def test_lists_on_which_a_class_has_more_partners_are_named():
    m = 4
    columns = {"hashes": np.full(m, 9, np.uint64), "owners": np.arange(1, m + 1), "sizes": np.full(m, 5, np.uint32), "ranks": np.ones(m, np.uint32),
               "maps": np.zeros(m, np.uint64), "docs": np.array([1, 2, 2, 3])}
    table = pa.table({"bucket": [0], **{k: pa.array([v.tobytes()], pa.binary()) for k, v in columns.items()}})
    got = lines._bucket(80, 8, None, 1)(table).to_pylist()
    assert [(r["a"], r["b"]) for r in got if r["key"] is None] == [(1, 2), (1, 3), (1, 4)]
    # 3 stands in the document of 2, so 2 may be the later of them
    assert {(r["a"], r["b"], r["key"]) for r in got if r["key"] is not None} == {(2, 2, 9), (3, 3, 9), (4, 4, 9)}
