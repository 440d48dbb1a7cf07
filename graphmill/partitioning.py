"""Partitioning of inputs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def spread(scan: DataFrame, key: str) -> DataFrame:
    """The rows of a plain scan over as many partitions as there are cores, at least.

    A small table in one file is one task's work however many cores are idle; then its rows are dealt by a hash of the
    key, in order of the key within a partition, so that a task that runs again sees the same rows in the same order.
    A table with more splits than cores is left as it is: nothing is shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, key).sortWithinPartitions(key)


#: Rows that one task sorts or hashes, about.
ROWS = 500_000


def dealt(rows: DataFrame, *keys: str, scan: DataFrame | None = None) -> DataFrame:
    """The rows by a hash of the keys, in a partition for every ROWS of them and at least as many as there are cores.

    So what a task holds stays the same as the input grows, where joined partitions of a set size in bytes grow in rows.
    scan: what to count instead of the rows; a plain scan is counted from its files' footers.
    """
    n = (rows if scan is None else scan).count()
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / ROWS)), *keys)
