"""Spark jobs for text hints, leakage audits and ranking evaluation."""
