"""Composite queries: health, alerts, scheduling, statistics."""
