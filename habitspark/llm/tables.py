"""Tables between the steps of a long operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from habitspark.plans.scale import stored

CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000  # whole texts in an Arrow batch, which a task holds on both sides


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, as ``stored``; the shuffle files it took are dropped once it is there.

    Spark keeps shuffle files as long as the driver holds the plan. The table replaces them, and a plan that needs such
    a stage once more computes it again.
    """
    spark = df.sparkSession
    settings = {CLEANUP_CONF: "true", BATCH_CONF: str(BATCH_ROWS)}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return stored(df)
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by ``written`` once nothing reads it any more, so everything made of it must be written itself."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
