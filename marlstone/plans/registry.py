"""Every query of the research operators and its SQL."""

from __future__ import annotations

from marlstone.plans import checkpoint_queries, evidence_queries, factor_queries, ledger_queries, market_queries, path_queries, register_queries, rule_queries, scan_queries, signal_queries, state_queries, stream_queries

MODULES = (factor_queries, ledger_queries, market_queries, evidence_queries, state_queries, rule_queries, scan_queries, signal_queries, register_queries, checkpoint_queries, path_queries, stream_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
