"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import calibration_queries, dashboard_queries, data_queries, exam_queries, file_queries, human_queries, run_queries, runner_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
