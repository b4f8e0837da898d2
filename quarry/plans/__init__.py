"""Named queries over the given tables; importing this package registers all of them."""

from . import (audit_plans, baseline_plans, chain_plans, extra_plans, io_plans, model_plans, drift_plans, eval_plans, explain_plans, framing_plans, gate_plans,  # noqa: F401
               prep_plans, quality, session_plans, similar_plans, split_plans, stream_plans)
from .registry import ORACLE, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
