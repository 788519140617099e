"""Name and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    return F.replace(F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_")), F.lit("."), F.lit(""))


def unslug(value: Column) -> Column:
    return F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))


def reliability_tier(boyce: Column) -> Column:
    return (
        F.when(boyce >= 0.9, "Excelente")
        .when(boyce >= 0.7, "Confiable")
        .when(boyce >= 0.3, "Aceptable")
        .otherwise("Revisar")
    )
