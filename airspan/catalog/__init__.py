"""Every named query, by subject."""

from airspan.catalog import alerts, features, files, intake, models, readings, streams  # noqa: F401
from airspan.catalog.registry import ORACLE, QUERIES  # noqa: F401
