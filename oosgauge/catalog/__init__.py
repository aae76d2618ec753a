"""The query catalogue: importing every module registers its queries."""

from functools import wraps
from importlib import import_module

MODULES = ("metrics", "neighbours", "prep", "files", "reports", "projections", "fuzzy", "affinities", "synth", "models")


def load():
    from oosgauge.catalog.base import ORACLES, QUERIES

    for name in MODULES:
        import_module(f"oosgauge.catalog.{name}")
    return {name: _shipping(fn) for name, fn in QUERIES.items()}, dict(ORACLES)


def _shipping(fn):
    from oosgauge.session import ship

    @wraps(fn)
    def run(spark, sf_dir):
        return fn(ship(spark), sf_dir)

    return run
