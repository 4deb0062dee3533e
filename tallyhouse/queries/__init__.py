"""Importing this package registers every query."""

from tallyhouse.queries import completed, datasets, evaluation, exact, extras, gates, gold, loading, planning, quality, records, recovery, retrieval, series, streams, texts  # noqa: F401
