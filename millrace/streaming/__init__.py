"""The change feed and event-time extensions."""
