"""Forests: the same trees without sending them along, on all cores."""

from pyspark.sql import functions as F

from habitspark.operators import models as MD

LIGHT = {"rf": {"numTrees": 12, "maxDepth": 8, "minInstancesPerNode": 2}}


def rows(spark):
    one = spark.range(400).coalesce(1).withColumns({"x": F.sin("id"), "y": F.cos(F.col("id") * 3)})
    return one.withColumn("presence", ((F.col("x") + F.col("y") * F.sin(F.col("id") * 7)) > 0.2).cast("int"))


def test_rows_keep_their_nodes(spark, monkeypatch):
    data = rows(spark)
    profile = MD.Profile.of(data, ["x", "y"])
    design = MD._design
    assert design("rf", ["x", "y"], profile, MD.parameters("rf"))[2].getCacheNodeIds()
    kept = MD.fit(data, ["x", "y"], "rf", LIGHT)

    def sent_along(*args):
        terms, weight, forest = design(*args)
        return terms, weight, forest.setCacheNodeIds(False)

    monkeypatch.setattr(MD, "_design", sent_along)
    sent = MD.fit(data, ["x", "y"], "rf", LIGHT)
    assert kept.pipeline.stages[-1].toDebugString.split("\n")[1:] == sent.pipeline.stages[-1].toDebugString.split("\n")[1:]


def test_one_split_is_spread(spark):
    data = rows(spark)
    spread = MD._spread(data, ["x", "y"])
    assert data.rdd.getNumPartitions() == 1
    assert spread.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread.exceptAll(data).count() == 0 and spread.count() == 400
