"""All registered queries and their SQL twins, collected from the catalog modules."""

from __future__ import annotations

import importlib
from functools import wraps

MODULES = ("windows_q", "features_q", "splits_q", "metrics_q", "graph_q", "realism_q", "typology_q", "sources_q", "models_q", "streaming_q")


def _modules():
    return [importlib.import_module(f"paysieve.catalog.{name}") for name in MODULES]


def _in_utc(fn):
    """Hour and day arithmetic is defined in UTC whatever the caller's session zone."""

    @wraps(fn)
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    return run


def all_queries():
    out = {}
    for module in _modules():
        out.update(module.query.queries)
    return {name: _in_utc(fn) for name, fn in sorted(out.items())}


def all_oracles():
    out = {}
    for module in _modules():
        out.update(module.query.oracle)
    return dict(sorted(out.items()))
