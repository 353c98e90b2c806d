"""All queries by name; SQL has the same for DuckDB."""

from __future__ import annotations

from . import diffs, explains, graphs, ledgers, releases
from .base import Ledger

_BUILD = {**ledgers.BUILD, **graphs.BUILD, **explains.BUILD, **releases.BUILD, **diffs.QUERIES}

QUERIES = {name: (lambda spark, sf_dir, build=build: build(Ledger(spark, sf_dir))) for name, build in _BUILD.items()} | diffs.PLAIN

SQL = {**ledgers.SQL, **graphs.SQL, **explains.SQL, **releases.SQL, **diffs.SQL}
