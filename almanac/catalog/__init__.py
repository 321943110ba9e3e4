"""All registered queries."""

from almanac.catalog import reshape, impute, quality, stats, features, components, forecast, precip, alerts, io, sifting, statespace, arma  # noqa: F401
from almanac.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
