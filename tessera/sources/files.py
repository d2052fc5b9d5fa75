"""File readers."""

from __future__ import annotations

import importlib.util
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema


def folder(location: str) -> str:
    """`folder/*` reads as the folder."""
    return location.removesuffix("/*")


def csv(spark: SparkSession, location: str, schema: Sequence[str] | str | T.StructType | None, has_header: bool, sep: str) -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", has_header)
    if isinstance(schema, (str, T.StructType)):
        return reader.schema(schema).csv(folder(location))
    if schema is None and not has_header:
        raise ValueError("a CSV without header needs a schema")
    df = reader.option("inferSchema", True).csv(folder(location))
    return df.toDF(*schema) if schema is not None else df


def parquet(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.parquet(folder(location))


def json(spark: SparkSession, location: str, schema: str | T.StructType | None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(folder(location))


def blobs(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder(location)).select(F.col("path").alias("filename"), F.col("content").alias("object"))


def vectors(spark: SparkSession, location: str, column: str) -> DataFrame:
    if location.rstrip("/").endswith(".lance"):
        return lance(spark, location)
    df = parquet(spark, location)
    if not isinstance(df.schema[column].dataType, T.ArrayType):
        raise TypeError(f"{column} is not an array column")
    return df


def lance(spark: SparkSession, location: str) -> DataFrame:
    """A Lance dataset; tasks read its fragments, the driver only their numbers and the schema."""
    if importlib.util.find_spec("lance") is None:
        raise ImportError("reading Lance datasets needs the lance package")
    from lance import dataset

    whole = dataset(location)
    numbers = [f.fragment_id for f in whole.get_fragments()]
    parts = spark.createDataFrame([(n,) for n in numbers], "fragment long").repartitionById(max(1, len(numbers)), F.col("fragment").cast("int"))

    def run(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                yield from dataset(location).get_fragment(number).to_batches()

    return parts.mapInArrow(run, from_arrow_schema(whole.schema))


def iceberg(spark: SparkSession, table: str, snapshot: int | None) -> DataFrame:
    """Needs the Iceberg runtime on the class path."""
    reader = spark.read.format("iceberg")
    return (reader if snapshot is None else reader.option("snapshot-id", snapshot)).load(table)


def delta(spark: SparkSession, location: str, version: int | None) -> DataFrame:
    """Needs the Delta runtime on the class path."""
    reader = spark.read.format("delta")
    return (reader if version is None else reader.option("versionAsOf", version)).load(location)
