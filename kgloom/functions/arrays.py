"""Helpers for turning computed arrays into rows."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list, array, name: str, pos: str | None = None) -> DataFrame:
    """Rows of a computed array, with its position if ``pos`` is given; NULL and empty arrays give none.

    The outer form is used on purpose: for a plain explode the optimizer adds a
    non-empty filter below it, which would compute an expensive array twice.
    """
    at = pos or "_at"
    out = df.select(*keep, F.posexplode_outer(array).alias(at, name)).filter(F.col(at).isNotNull())
    return out if pos else out.drop(at)


def bound_rows(df: DataFrame, keep: list, value, *steps, name: str = "_b") -> DataFrame:
    """``keep`` and a struct ``name``: ``value`` passed through ``steps``, each a function of the column before it.

    Every step is computed once per row. With a Python function among the columns the
    optimizer otherwise writes a computed column out wherever it is used, inside lambda
    functions too, where it is computed for every element; it does not do so across the
    rows of an array.
    """
    bound = F.array(value)
    for step in steps:
        bound = F.transform(bound, step)
    return explode_rows(df, keep, bound, name)


def spread(df: DataFrame) -> DataFrame:
    """Splits a scan with fewer partitions than cores over all cores; larger scans are left alone.

    For CPU-heavy text work on a table stored in a few big row groups.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
