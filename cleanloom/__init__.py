"""Data cleaning, profiling and drift checks as lazy PySpark DataFrame functions."""

from .functions.core import OpError
from .functions.scan import settle
from .plans.pipeline import dry_run, effect, list_ops, metrics, older_step, register_op, run_plan, validate

__all__ = ["OpError", "dry_run", "effect", "list_ops", "metrics", "older_step", "register_op", "run_plan", "settle", "validate"]
