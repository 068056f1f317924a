"""Queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from functools import partial

from ..sources import tables
from . import extended, relational

PLAIN = {n: n for n in tables.NAMES}


def _query(text: str, spark, sf_dir: str):
    return tables.sql(spark, sf_dir, text)


QUERIES = {n: partial(_query, t.replace("<NTZ>", "TIMESTAMP_NTZ")) for n, t in relational.SHARED.items()} | {n: partial(_query, t) for n, (t, _) in relational.PAIRS.items()} | extended.QUERIES
SQL = {n: t.replace("<NTZ>", "TIMESTAMP").format(**PLAIN) for n, t in relational.SHARED.items()} | {n: t for n, (_, t) in relational.PAIRS.items()} | extended.SQL
