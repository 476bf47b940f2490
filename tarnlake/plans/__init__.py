"""From SQL text to plans, and looking at plans."""

from tarnlake.plans.explain import describe, optimizer_trace, scans, without_rules
from tarnlake.plans.sql import parse, run_sql

__all__ = ["describe", "optimizer_trace", "parse", "run_sql", "scans", "without_rules"]
