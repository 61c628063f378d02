"""The engine's own queries, by theme, and their SQL."""

from weftline.catalog import formats, joins, labels, models, numeric, signals, streams, text  # noqa: F401
from weftline.catalog.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
