"""Query plans: the operators applied to tables."""

import importlib

MODULES: tuple[str, ...] = ("enrichment", "cells", "stats", "pairwise", "ontology", "graphs", "integration", "interactions", "streams", "bulk", "regulation", "fusion", "storage")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"helixframe.plans.{name}")
