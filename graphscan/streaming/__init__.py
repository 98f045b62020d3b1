"""Queues and live indexes."""
