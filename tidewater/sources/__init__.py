"""Readers of vendor payloads and sinks of append-only tables."""
