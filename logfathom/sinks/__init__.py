"""Exports: events to CSV, JSON lines, bulk-index, event-collector and STIX rows."""
