"""Structured Streaming forms of the rejection run and the session ledger."""
