"""Readers and writers of logs, CSV, numbered sequences and snapshots."""
