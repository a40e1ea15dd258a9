"""Every registered query with its oracle.

A query takes (spark, sf_dir) and returns a DataFrame; its oracle is DuckDB SQL over the same
tables. Queries that SQL can't express (random forests, random resampling) have none.
"""

from __future__ import annotations

from collections.abc import Callable

from strataflow.adapters import ctes

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: str = "", sql: str | None = None) -> Callable:
    """Register a query; ``needs`` names the adapters that ``sql`` reads, and ``sql`` may go on with further CTEs (", a as (...) select ...")."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (ctes(needs) + " " if needs else "") + sql.strip()
        return f

    return add


from strataflow.plans import evaluation, geology, geostatistics, hydraulics, learning, raster, records, sources  # noqa: E402, F401
