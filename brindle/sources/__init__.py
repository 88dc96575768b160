"""Readers, writers and adapters to the interactions table."""
