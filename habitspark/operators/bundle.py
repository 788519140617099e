"""Versioned bundles: fitted models with every table that is needed to use and to judge them.

A bundle is a folder. Each version writes its pipelines and tables to a folder of its own and its manifest last, so a
run that was lost half-way leaves rows without a manifest, which no reader looks at. A version never changes.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitspark.operators import metrics as M
from habitspark.operators.models import Model, load_pipeline

FORMAT = 1
# what a bundle holds beside the models
TABLES = ("weights", "thresholds", "fold_scores", "environment")
MANIFEST = "version long, format int, folder string, models array<struct<algo: string, shift: double, predictors: array<string>>>, tables map<string, bigint>"


@dataclass
class Bundle:
    version: int
    models: dict[str, Model]
    tables: dict[str, DataFrame]


def training_environment(training: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Presence and predictors of the rows the models were fitted on; similarity of new places is measured against them."""
    return training.select(F.col("presence").cast("int").alias("presence"), *[F.col(p).cast("double").alias(p) for p in predictors])


def score_thresholds(scored: DataFrame, algorithms: Sequence[str]) -> DataFrame:
    """``algo`` and its thresholds from the scores of the training rows, one column per algorithm."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("algo"), F.col(a).alias("score")) for a in algorithms]))
    long = scored.select("presence", each.alias("s")).select("presence", "s.algo", "s.score").filter("score IS NOT NULL")
    return M.thresholds(long, ["algo"])


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """Manifests of all complete versions, one row each; none if nothing has been completed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest") if files.exists(folder) else None


def write(path: str, models: Mapping[str, Model], tables: Mapping[str, DataFrame]) -> int:
    """Add a version and return its number. ``tables`` holds all of ``TABLES``, any of which may be empty.

    One writer at a time: two at once might take the same number, which readers refuse.
    """
    if set(tables) != set(TABLES):
        raise ValueError(f"a bundle has the tables {sorted(TABLES)}, got {sorted(tables)}")
    spark = tables["weights"].sparkSession
    folder = f"parts-{uuid.uuid4()}"
    rows = {}
    for name, table in tables.items():
        table.write.parquet(f"{path}/{folder}/{name}")
        rows[name] = spark.read.schema(table.schema).parquet(f"{path}/{folder}/{name}").count()
    for algo, model in models.items():
        model.pipeline.write().save(f"{path}/{folder}/models/{algo}")
    known = _manifest(spark, path)
    version = 1 + ((known.agg(F.max("version")).first()[0] or 0) if known is not None else 0)
    entry = (version, FORMAT, folder, [(a, m.shift, list(m.predictors)) for a, m in models.items()], rows)
    spark.createDataFrame([entry], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def read(spark: SparkSession, path: str, version: int | None = None) -> Bundle:
    """A version, by default the latest complete one.

    Raises ``ValueError`` if there is none, if its number is taken twice, if its format is another one, or if a
    table has lost rows since.
    """
    known = _manifest(spark, path)
    if known is not None and version is None:
        version = known.agg(F.max("version")).first()[0]
    found = known.filter(F.col("version") == version).limit(2).collect() if known is not None and version is not None else []
    if len(found) != 1:
        raise ValueError(f"{path} holds {'two versions' if found else 'no complete version'} {version if version is not None else ''}".rstrip())
    entry = found[0]
    if entry["format"] != FORMAT:
        raise ValueError(f"bundle format {entry['format']}, expected {FORMAT}")
    tables = {}
    for name, n in entry["tables"].items():
        tables[name] = spark.read.parquet(f"{path}/{entry['folder']}/{name}")
        if (now := tables[name].count()) != n:
            raise ValueError(f"table {name} of version {version} has {now} rows, written were {n}")
    models = {
        m["algo"]: Model(m["algo"], list(m["predictors"]), load_pipeline(spark, f"{path}/{entry['folder']}/models/{m['algo']}"), m["shift"])
        for m in entry["models"]
    }
    return Bundle(version, models, tables)
