"""All registered queries of the library, each with SQL of its own for DuckDB."""

from __future__ import annotations

from .plans import answers, evaluation, files, models, prompting, routing

QUERIES: dict = {}
ORACLES: dict = {}
for part in (routing, prompting, answers, evaluation, files, models):
    QUERIES.update(part.QUERIES)
    ORACLES.update(part.ORACLES)
