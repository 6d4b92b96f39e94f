"""A small collector the catalog modules share."""

from __future__ import annotations

from pyspark.sql import functions as F


class Catalog:
    def __init__(self):
        self.queries, self.oracle = {}, {}

    def __call__(self, name, sql=None):
        def add(fn):
            if name in self.queries:
                raise ValueError(f"{name} registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.oracle[name] = sql
            return fn

        return add


def r6(name, digits=6):
    return F.round(F.col(name), digits).alias(name)


def frame(key, width):
    return f"(PARTITION BY {key} ORDER BY us RANGE BETWEEN {width} PRECEDING AND 1 PRECEDING)"
