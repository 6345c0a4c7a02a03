"""Incremental (Structured Streaming) landing of reading pages."""
