"""The queries. Each takes DataFrames and plain arguments and returns a lazy DataFrame."""

from runlens.operators.adhoc import run_readonly_query, statement_audit
from runlens.operators.audit import id_time_audit, retention_coverage
from runlens.operators.detail import activity_get, missing_ids
from runlens.operators.history import activity_history, history_runs, history_stats
from runlens.operators.lineage import activity_lineage
from runlens.operators.logs import (
    activity_log_summary,
    activity_logs,
    log_summary_categories,
    log_summary_exceptions,
    log_summary_stats,
    logs_search,
)
from runlens.operators.manifest import page_manifest
from runlens.operators.reports import RunReports, run_reports
from runlens.operators.rollup import catalog, catalog_keys, fleet_overview, fleet_overview_levels
from runlens.operators.runs import activities_list, recent_failures
from runlens.operators.shapes import paged_result, to_json

__all__ = [
    "RunReports",
    "activities_list",
    "activity_get",
    "activity_history",
    "activity_lineage",
    "activity_log_summary",
    "activity_logs",
    "catalog",
    "catalog_keys",
    "fleet_overview",
    "fleet_overview_levels",
    "history_runs",
    "history_stats",
    "id_time_audit",
    "log_summary_categories",
    "log_summary_exceptions",
    "log_summary_stats",
    "logs_search",
    "missing_ids",
    "page_manifest",
    "paged_result",
    "recent_failures",
    "retention_coverage",
    "run_readonly_query",
    "run_reports",
    "statement_audit",
    "to_json",
]
