"""Parquet tables as inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a scan over all cores when it has fewer splits than those.

    A large table has splits enough and passes through unshuffled; only a table of
    one or a few row groups is dealt out. ``scan`` must not contain a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
