"""Labels by path and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The language whose label stands in where one is missing.
FALLBACK = "eu"


def localized(requests: DataFrame, catalog: DataFrame, fallback: str = FALLBACK) -> DataFrame:
    """requests (path, lang, ...) with `label`: the catalog's (path, lang, label) for that language, else for the fallback,
    else the path itself. The catalog has one row a path and language."""
    own = catalog.select(F.col("path").alias("_p"), F.col("lang").alias("_l"), F.col("label").alias("_own"))
    other = catalog.where(F.col("lang") == fallback).select(F.col("path").alias("_q"), F.col("label").alias("_other"))
    out = requests.join(own, (F.col("path") == F.col("_p")) & (F.col("lang") == F.col("_l")), "left").join(other, F.col("path") == F.col("_q"), "left")
    return out.withColumn("label", F.coalesce("_own", "_other", "path")).drop("_p", "_l", "_own", "_q", "_other")


def known_language(tag: Column, languages: tuple[str, ...], fallback: str = FALLBACK) -> Column:
    """The language of a tag like `es-MX`, if it is one of `languages`; else the fallback."""
    primary = F.lower(F.substring_index(tag, "-", 1))
    return F.when(primary.isin(*languages), primary).otherwise(F.lit(fallback))
