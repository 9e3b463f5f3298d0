"""Reading the corpus tables and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalgrid.session import materialise

__all__ = ["materialise", "partitions", "read", "utf8_bytes", "white_words"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_bytes(text: str | Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def white_words(text: Column) -> Column:
    """Words between ASCII white space, as an array; null gives an empty array."""
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\u000b\f\r", "     ")
    return F.filter(F.split(blank, " "), lambda w: w != "")
