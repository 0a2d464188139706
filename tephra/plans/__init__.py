"""Registered queries: each callable takes (spark, sf_dir); ORACLES has the same in DuckDB's SQL."""

from __future__ import annotations

from tephra.plans import answering, climate, corpus, front

QUERIES = {**corpus.QUERIES, **climate.QUERIES, **answering.QUERIES, **front.QUERIES}
ORACLES = {**corpus.ORACLES, **climate.ORACLES, **answering.ORACLES, **front.ORACLES}
