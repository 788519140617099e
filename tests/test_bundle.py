"""Bundles: round trip, versions, half-written and damaged ones."""

import pytest
from pyspark.sql import functions as F

from habitspark.operators import bundle, models
from habitspark.plans.scale import scratch_folder


def test_bundle(spark):
    data = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("presence"), (F.col("id") % 17 + F.when(F.col("id") % 3 == 0, 4).otherwise(0)).cast("double").alias("x")).cache()
    fitted = {"glm": models.fit(data, ["x"], "glm")}
    scored = fitted["glm"].score(data)
    tables = {
        "weights": spark.createDataFrame([("glm", 1.0)], "algo string, weight double"),
        "thresholds": bundle.score_thresholds(scored, ["glm"]),
        "fold_scores": spark.createDataFrame([], "algo string, held_out int, auc double"),
        "environment": bundle.training_environment(data, ["x"]),
    }
    path = scratch_folder(spark)
    with pytest.raises(ValueError, match="no complete version"):
        bundle.read(spark, path)
    with pytest.raises(ValueError, match="has the tables"):
        bundle.write(path, fitted, {"weights": tables["weights"]})
    # a run that was lost before its manifest
    tables["weights"].write.parquet(f"{path}/parts-lost/weights")
    with pytest.raises(ValueError, match="no complete version"):
        bundle.read(spark, path)
    assert bundle.write(path, fitted, tables) == 1
    got = bundle.read(spark, path)
    assert got.version == 1 and got.models["glm"].predictors == ["x"] and got.tables["fold_scores"].count() == 0
    assert sorted(got.tables["environment"].collect()) == sorted(tables["environment"].collect())
    assert got.tables["thresholds"].collect() == tables["thresholds"].collect()
    same = scored.select("row_id", "glm").exceptAll(got.models["glm"].score(data).select("row_id", "glm"))
    assert same.count() == 0
    assert bundle.write(path, fitted, {**tables, "weights": spark.createDataFrame([("glm", 0.5)], "algo string, weight double")}) == 2
    assert bundle.read(spark, path).tables["weights"].first()["weight"] == 0.5
    assert bundle.read(spark, path, 1).tables["weights"].first()["weight"] == 1.0
    with pytest.raises(ValueError, match="no complete version"):
        bundle.read(spark, path, 3)
    folder = spark.read.parquet(f"{path}/manifest").filter("version = 2").first()["folder"]
    spark.createDataFrame([("gam", 0.1)], "algo string, weight double").write.mode("append").parquet(f"{path}/{folder}/weights")
    with pytest.raises(ValueError, match="has 2 rows, written were 1"):
        bundle.read(spark, path)
