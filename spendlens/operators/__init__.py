"""Operators: detection, normalisation, validation, reports, scoring,
budget, chart datasets and fact-table maintenance."""
