"""Readers, table adapters and the synthetic generator."""
