"""Readers and writers of the inventory table."""
