"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from tidemark.plans import domain, holdings, increment, ladder, ledger, market, matching, relational, research, scalars, serve, states, strata, trades, wire

_GROUPS = [relational, market, research, scalars, domain, serve, states, ledger, ladder, matching, increment, trades, wire, holdings, strata]
QUERIES = {k: v for g in _GROUPS for k, v in g.QUERIES.items()}
ORACLE_SQL = {k: v for g in _GROUPS for k, v in g.ORACLE.items()}
