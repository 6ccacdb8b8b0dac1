"""Every registered query with its DuckDB counterpart."""

from urlsieve.catalog import corpus, evaluation, features, given, models, text

_MODULES = (corpus, features, evaluation, text, models, given)


def all_queries() -> dict:
    return {name: q for module in _MODULES for name, q in module.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
