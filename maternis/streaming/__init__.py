"""Incremental refresh of the preliminary years as new files land."""
