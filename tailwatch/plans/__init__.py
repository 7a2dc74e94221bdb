"""Named queries over the library's operators."""

from importlib import import_module

MODULES = [
    "telemetry_queries",
    "inference_queries",
    "temporal_queries",
    "diagnosis_queries",
    "robustness_queries",
    "quality_queries",
    "learner_queries",
    "comparison_queries",
    "source_queries",
]


def load():
    """Import every query module and return the registry."""
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    return import_module(f"{__name__}.registry").QUERIES
