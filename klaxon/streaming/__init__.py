"""Alerting over Structured Streaming sources."""
