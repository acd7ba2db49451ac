"""Every query of the library, with the SQL that it is held against."""

from __future__ import annotations

from . import chunking, evaluation, extras, lexical, ranking, service, streams, tables, vectors
from .base import Query

MODULES = (lexical, vectors, ranking, chunking, evaluation, tables, service, extras, streams)


def queries() -> dict[str, Query]:
    return {n: f for m in MODULES for n, f in m.Q.functions.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in MODULES for n, s in m.Q.sql.items()}
