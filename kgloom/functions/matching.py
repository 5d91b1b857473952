"""Approximate string join."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.arrays import explode_rows


def _shorter(strings: Column) -> Column:
    """Every string of an array with one character left out, in all ways."""
    def drops(s):
        n = F.length(s)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
            F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(strings, drops)))


def _variants(col: str, bound: int) -> Column:
    level = F.array(F.col(col))
    out = level
    for _ in range(bound):
        level = _shorter(level)
        out = F.array_union(out, level)
    return out


def close_strings(left: DataFrame, right: DataFrame, bound: int) -> DataFrame:
    """a, b, dist for all pairs of distinct strings within ``bound`` edits.

    Two strings that close share a form with at most ``bound`` characters left
    out of each, so candidates come from an equi join on those forms and are
    verified by their edit distance: exact, and without comparing every pair.
    """
    la = explode_rows(left.select("a").distinct(), ["a"], _variants("a", bound), "form")
    rb = explode_rows(right.select("b").distinct(), ["b"], _variants("b", bound), "form")
    pairs = la.join(rb, "form").select("a", "b").distinct()
    return pairs.withColumn("dist", F.levenshtein("a", "b")).filter(F.col("dist") <= bound)
