"""The registered queries over the driver tables, and their SQL."""

from __future__ import annotations

from .plans import contracts, datasets, features, jobs, ops, phrases, retrieval, sampling

MODULES = (phrases, features, sampling, ops, retrieval, datasets, jobs, contracts)


def _all() -> dict:
    out: dict = {}
    for m in MODULES:
        clash = out.keys() & m.QUERIES.keys()
        if clash:
            raise ValueError(f"registered twice: {clash}")
        out |= m.QUERIES
    return out


def queries() -> dict:
    return {name: fn for name, (fn, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}
