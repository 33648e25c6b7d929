"""Registered queries over the test tables, each with its SQL counterpart."""

from importlib import import_module
from types import ModuleType

_MODULES = (
    "prep_queries",
    "sampling_queries",
    "reply_queries",
    "agreement_queries",
    "alpha_queries",
    "long_queries",
    "alttest_queries",
    "iterate_queries",
    "annotate_queries",
    "generate_queries",
    "source_queries",
    "scenario_queries",
)


def load_all() -> ModuleType:
    """Import every query module and return the registry."""
    for name in _MODULES:
        import_module(f"accordant.plans.{name}")
    return import_module("accordant.plans.registry")
