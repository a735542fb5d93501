"""Query plans wired to the driver tables. Importing this package registers
every query in :data:`plumbline.plans.registry.REGISTRY`."""

import importlib

from plumbline.plans.registry import REGISTRY  # noqa: F401

_MODULES = ("q_sources", "q_filters", "q_joins", "q_aggs", "q_windows", "q_sets",
            "q_functions", "q_metrics", "q_cohort", "q_uncertainty", "q_compare",
            "q_audit", "q_telemetry", "q_text", "q_etl")

for _m in _MODULES:
    try:
        importlib.import_module(f"plumbline.plans.{_m}")
    except ModuleNotFoundError as e:  # modules are added incrementally
        if e.name != f"plumbline.plans.{_m}":
            raise
