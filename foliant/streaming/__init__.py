"""Metric logs as streams."""
