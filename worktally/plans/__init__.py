"""Registered queries, grouped by area; importing the modules fills the registry."""
import importlib

AREAS = ["core", "rules", "files", "normalise", "reports", "messages", "matching", "streams"]


def load():
    for area in AREAS:
        importlib.import_module(f"worktally.plans.{area}")
    from worktally.plans import registry
    return registry.QUERIES, registry.ORACLES
