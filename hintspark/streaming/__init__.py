"""Trace summaries and streaming scoring."""
