"""Scans and sinks: CSV, nested JSON, Markdown columns, reader state, ledger."""
