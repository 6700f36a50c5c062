"""Part of the robustness analytics: all queries, registered by their modules."""

from . import experiment, queries, reports

__all__ = ["experiment", "queries", "reports"]
