"""Registered queries over the warehouse tables."""

from ratebook.plans import (  # noqa: F401
    drift, features, files, intervals, learning, metrics, pricing, registry, splits, streams, transforms, validation,
)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLE)
