"""Catalogue of runnable queries and their SQL twins."""
from functools import wraps

QUERIES = {}
SQL = {}


def query(name, sql=None):
    """Registers ``fn(spark, sf_dir)`` under ``name`` with an optional SQL twin."""
    def keep(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            # split skewed join partitions even where that costs a further shuffle
            spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep
