"""Check queries for every operator, with the SQL each is compared to."""

from __future__ import annotations


def all_checks():
    """(queries, sql) of every registered check."""
    # Importing a module registers its checks.
    from checks import decide, models, registry, relational, scalar, storage, streams  # noqa: F401

    return dict(registry.QUERIES), dict(registry.SQL)
