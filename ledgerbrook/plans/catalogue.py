"""All queries of the library with their oracle SQL."""

from __future__ import annotations

from ..functions import scalar
from ..operators import changelog, relational, replay, runstats, validate
from ..sources import batches, keyed
from ..streaming import progress, state
from ..streaming import replay as stream
from . import patterns, shapes, tpch, verification

MODULES = [tpch, patterns, shapes, relational, scalar, changelog, replay, runstats, validate, batches, keyed, stream, progress, state, verification]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
