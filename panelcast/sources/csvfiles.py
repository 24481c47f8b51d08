"""IO1/IO2/IO7: the weekly feature table, the label table and the forecast template as CSV.

Schemas are declared (no inference); a blank cell is NULL and NaN never enters
the data.  ``week_start_date`` is parsed to DATE (IO7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.features import RAW_FEATURES

KEYS = ["city", "year", "weekofyear"]

FEATURE_SCHEMA = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("weekofyear", T.IntegerType()),
        T.StructField("week_start_date", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in RAW_FEATURES],
    ]
)
LABEL_SCHEMA = T.StructType([*[T.StructField(c, t) for c, t in (("city", T.StringType()), ("year", T.IntegerType()), ("weekofyear", T.IntegerType()))], T.StructField("total_cases", T.IntegerType())])


def _read_by_name(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns are matched by header name (any order), then cast to the declared
    type; a missing column fails the read.  No type inference pass."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """IO1 + IO7."""
    return _read_by_name(spark, path, FEATURE_SCHEMA).withColumn("week_start_date", F.to_date("week_start_date"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """IO2: labels, or the forecast template (same four columns)."""
    return _read_by_name(spark, path, LABEL_SCHEMA)


def join_labels(features: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    """Features with labels on (city, year, weekofyear)."""
    return features.join(labels, KEYS, how)
