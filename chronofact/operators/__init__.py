"""Relational operators over indexes, logs and derived views."""
