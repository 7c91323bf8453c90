"""Sources and sinks: tables of a folder, and sketches stored as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.cells import Sketch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def save(sketch: Sketch, path: str) -> None:
    sketch.write(path)


def load(spark: SparkSession, kind: type[Sketch], path: str) -> Sketch:
    return kind.read(spark, path)
