"""Reusable DataFrame operators (joins, roll-ups, cross-tabs, domains, checks)."""
