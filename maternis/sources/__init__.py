"""Readers, writers and the benchmark-derived fixture inputs."""
