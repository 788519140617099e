"""Occurrence records: raw exports, landed API pages and cleaned CSV tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Headings of the raw export and the names used from there on.
HEADINGS = {
    "Especie": "especie",
    "Nombre cientifico GBIF": "nombre_cientifico",
    "Latitud": "lat",
    "Longitud": "lon",
    "Incertidumbre (m)": "incertidumbre_m",
    "Pais": "pais",
    "Region / Estado": "region",
    "Localidad": "localidad",
    "Fecha": "fecha",
    "Ano": "ano",
    "Tipo de registro": "tipo_registro",
    "Institucion": "institucion",
    "Dataset": "dataset",
    "Catalogo": "catalogo",
    "GBIF ID": "gbif_id",
}
# Fields of an occurrence API result and their column.
API_FIELDS = {
    "scientificName": "nombre_cientifico",
    "decimalLatitude": "lat",
    "decimalLongitude": "lon",
    "coordinateUncertaintyInMeters": "incertidumbre_m",
    "country": "pais",
    "stateProvince": "region",
    "locality": "localidad",
    "eventDate": "fecha",
    "year": "ano",
    "basisOfRecord": "tipo_registro",
    "institutionCode": "institucion",
    "datasetName": "dataset",
    "catalogNumber": "catalogo",
    "key": "gbif_id",
}
# Country codes an API page is requested for.
API_COUNTRIES = ["AR", "BO", "BR", "CL", "CO", "EC", "FK", "GF", "GY", "PE", "PY", "SR", "UY", "VE"]

COLUMNS = list(HEADINGS.values())
_DOUBLES = {"lat", "lon", "incertidumbre_m"}
_TYPES = {"ano": T.IntegerType(), "gbif_id": T.LongType()}


def _type(column: str) -> T.DataType:
    return T.DoubleType() if column in _DOUBLES else _TYPES.get(column, T.StringType())


RAW_SCHEMA = T.StructType([T.StructField(h, _type(c)) for h, c in HEADINGS.items()])
CLEAN_SCHEMA = T.StructType([T.StructField(c, _type(c)) for c in COLUMNS])
PAGE_SCHEMA = T.StructType(
    [
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [T.StructField(f, _type(c)) for f, c in API_FIELDS.items()]
                    + [T.StructField("countryCode", T.StringType())]
                )
            ),
        ),
        T.StructField("endOfRecords", T.BooleanType()),
    ]
)


def no_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into null, so that comparisons and aggregates skip it."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def read_raw(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Raw export with its headings mapped to the column contract."""
    reader = spark.read.schema(RAW_SCHEMA)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return no_nan(df.withColumnsRenamed(HEADINGS))


def read_clean(spark: SparkSession, path: str, schema: T.StructType = CLEAN_SCHEMA) -> DataFrame:
    """Cleaned table; a missing path fails when it is read, as any Spark source."""
    return no_nan(spark.read.schema(schema).option("header", True).csv(path))


def from_api_pages(pages: DataFrame, species: Column, countries: Iterable[str] = tuple(API_COUNTRIES)) -> DataFrame:
    """Flatten landed result pages (column ``page``) into the column contract."""
    rows = pages.select(species.alias("especie"), F.explode("page.results").alias("r"))
    wanted = rows.filter(
        F.col("r.decimalLatitude").isNotNull()
        & F.col("r.decimalLongitude").isNotNull()
        & F.col("r.countryCode").isin(list(countries))
    )
    flat = wanted.select("especie", *[F.col(f"r.{f}").alias(c) for f, c in API_FIELDS.items()])
    return flat.select(*COLUMNS)
