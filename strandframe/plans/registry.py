"""All queries of the interval and copy-number operators, and their DuckDB SQL."""

from __future__ import annotations

from . import q_copynumber, q_intervals, q_kernels, q_screens, q_transfer

QUERIES, ORACLES = {}, {}
for _module in (q_intervals, q_copynumber, q_kernels, q_screens, q_transfer):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
