"""All registered queries on the reference operators, by family."""

from __future__ import annotations

import importlib

_FAMILIES = ("q_entities", "q_diffs", "q_aggregates", "q_graphs", "q_search", "q_sql", "q_sources", "q_extraction", "q_streams", "q_more", "q_functions", "q_reports")
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in _FAMILIES:
    try:
        _m = importlib.import_module(f"lodeplane.plans.{_name}")
    except ModuleNotFoundError as _e:
        if _e.name != f"lodeplane.plans.{_name}":
            raise
        continue
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE

#: Results that DuckDB would give as HUGEINT, cast to the width of the Spark column.
_WIDE = {"s2_read_capped": ["bytes"], "l2_budget": ["bytes_upto"], "u5_line_multisets": ["lines"], "a12_cohesion": ["internal", "external"], "g7_impact_summary": ["entry_points"], "g25_api_list": ["elsewhere"], "r2_index": ["weight"], "f12_marker_counts": ["marks"], "q_case_coalesce": ["ready"], "s9_lcov": ["hits"]}
for _name, _columns in _WIDE.items():
    ORACLE[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _columns)}) FROM ({ORACLE[_name]})"
