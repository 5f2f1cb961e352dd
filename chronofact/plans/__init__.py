"""Registered queries, their SQL, and planning of view builds."""
