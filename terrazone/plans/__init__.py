"""Queries and their DuckDB equivalents; importing the package registers all of them."""

from terrazone.plans import checks, overlays, registry, shapes  # noqa: F401
