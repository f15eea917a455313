"""Test views, and the queries with their SQL twins."""

from . import accounts, catalog, desk, feeds, rules, finding, streams  # noqa: F401
