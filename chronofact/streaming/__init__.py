"""Catch-up of views from a growing log, and reducers over streams."""
